"""Authority over decisions: decaying weight, levels, permissions, audit chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.columns import UNIT
from eventlens.settings import DEFAULT, Settings

#: What a remembered outcome takes from the weight (any other outcome: UNKNOWN_PENALTY) or gives.
PENALTIES = {"disputed": 0.12, "deteriorated": 0.05, "no_response": 0.05}
UNKNOWN_PENALTY, CREDIT = 0.05, {"improved": 0.30}
#: The most weight that a confidence allows.
CONFIDENCE_CAPS = {"none": 0.0, "low": 0.35, "medium": 0.70, "high": 1.0}
#: Actions taken without approval, and restricted ones with the role that may approve.
PERMITTED = ("recap", "micro_question", "checkpoint_prompt", "focus_quiz", "hint", "pacing_adjustment", "resource_suggestion", "break_suggestion")
RESTRICTED = {
    "grade_modification": "course_coordinator",
    "high_stakes_recommendation": "academic_advisor",
    "external_communication": "student_services_officer",
    "data_export": "data_protection_officer",
    "permanent_record_change": "records_manager",
    "credential_revocation": "registrar",
}
#: What is to be done, in order, to have a restricted action decided by the role that may.
ESCALATION = {
    "grade_modification": ("note the assessment and the mark asked for", "have the coordinator confirm the mark", "let the change be made in the gradebook"),
    "high_stakes_recommendation": ("add the evidence and how certain it is", "have the advisor read the whole record", "keep the advisor's decision apart from the prediction"),
    "external_communication": ("write down what would be said to whom", "have the services office make the contact", "note that the contact was only proposed"),
    "data_export": ("list fields, recipient and legal basis", "have the protection officer approve", "let the governed export run"),
    "permanent_record_change": ("state the entry and that it can't be contested", "have the records manager authorise it", "let the records system make it"),
    "credential_revocation": ("note the right or qualification concerned", "have the registrar confirm", "let the identity provider revoke it"),
}


def _lookup(col: Column, values: dict[str, float], other: float) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in values.items():
        out = out.when(col == k, v)
    return out.otherwise(other)


def decayed_authority(memory: DataFrame, decisions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A1: ``decisions(decision_id, learner_id, context, decided_us)`` with penalties, credits, entries and weight.

    Each remembered entry of the learner and context up to the decision counts by its weight, halved
    every ``half_life``; credit never lifts the weight above the initial one.
    """
    age = F.greatest(F.lit(0.0), (F.col("decided_us") - F.col("recorded_us")) / 1e6)
    part = F.col("weight") * F.pow(F.lit(2.0), -age / s.half_life)
    credit = F.col("outcome").isin(*CREDIT)
    m = memory.select("learner_id", "context", "outcome", "weight", "recorded_us")
    j = decisions.select("decision_id", "learner_id", "context", "decided_us").join(m, ["learner_id", "context"]).where(F.col("recorded_us") <= F.col("decided_us"))
    g = j.groupBy("decision_id").agg(
        F.sum(F.when(credit, 0.0).otherwise(part * _lookup(F.col("outcome"), PENALTIES, UNKNOWN_PENALTY))).alias("penalties"),
        F.sum(F.when(credit, part * _lookup(F.col("outcome"), CREDIT, 0.0)).otherwise(0.0)).alias("credits"), F.count("*").alias("entries"),
    )
    out = decisions.join(g, "decision_id", "left").na.fill(0.0, ["penalties", "credits"]).na.fill(0, ["entries"])
    return out.withColumn("decayed", F.least(F.lit(s.initial_authority), s.initial_authority - F.col("penalties") + F.col("credits")))


def confidence_cap(level: Column) -> Column:
    """A2: null counts as none."""
    return _lookup(F.coalesce(level, F.lit("none")), CONFIDENCE_CAPS, 0.0)


def clamp_authority(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A3: adds authority (floor first, then the confidence cap, which wins) and what bound it."""
    floored = F.greatest(F.col("decayed"), F.lit(s.authority_floor))
    cap = confidence_cap(F.col("confidence"))
    return df.withColumn("authority", F.least(floored, cap)).withColumn("bound_by", F.when(cap < floored, "confidence").when(F.col("decayed") < s.authority_floor, "floor").when(F.col("decayed") < s.initial_authority, "memory").otherwise("initial"))


def authority_level(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A4: adds level (human_required / restricted / allowed) and the reasons; ``risk, reversible, high_stakes``."""
    human = F.array_compact(F.array(F.when(~F.col("reversible"), "irreversible"), F.when(F.col("high_stakes"), "high_stakes"), F.when(F.col("risk") == "high", "high_risk")))
    limited = F.array_compact(F.array(F.when(F.col("authority") < s.restricted_below, "low_authority"), F.when(F.col("risk") == "medium", "medium_risk")))
    level = F.when(F.size(human) > 0, "human_required").when(F.size(limited) > 0, "restricted").otherwise("allowed")
    return df.withColumn("level", level).withColumn("level_reasons", F.when(F.size(human) > 0, human).otherwise(limited))


def action_permissions(df: DataFrame, keys: list[str]) -> DataFrame:
    """A5: (keys, action, permission, approver, reason, steps): each restricted action is withheld, with why and the way to
    its approver; each default action is permitted or needs approval; none of those is listed for human_required.
    ``level, reversible, high_stakes``."""
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    where = F.when(~F.col("reversible"), "irreversible").when(F.col("high_stakes"), "high_stakes").otherwise("never_autonomous")
    grade = F.when(~F.col("high_stakes"), "never_self_service").otherwise(where)

    def cell(action: str, permission: Column, approver: Column, reason: Column, steps: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), permission.alias("permission"), approver.alias("approver"), reason.alias("reason"), steps.alias("steps"))

    cells = [cell(a, F.lit("withheld"), F.lit(r), grade if a == "grade_modification" else where, F.array(*map(F.lit, ESCALATION[a]))) for a, r in RESTRICTED.items()]
    own = F.when(F.col("level") == "allowed", "permitted").otherwise("needs_approval")
    cells += [F.when(F.col("level") != "human_required", cell(a, own, text, text, none)) for a in PERMITTED]
    return df.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def final_action(df: DataFrame, s: Settings = DEFAULT, restricted_defers: bool = False, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Adds final and final_reason for ``selected, level, authority, high_impact, expires_us, decided_us``.

    A restricted level is refused, or with ``restricted_defers`` deferred to a human.
    """
    case = (
        F.when(F.col("selected").isNull(), "refused|not_selected").when(F.col("decided_us") >= F.col("expires_us"), "refused|expired").when(F.col("level") == "human_required", "deferred|human_required")
        .when(F.col("level") != "allowed", "deferred|restricted" if restricted_defers else "refused|level_not_allowed").when(~F.col("selected").isin(*permitted), "refused|action_not_permitted")
        .when(F.col("high_impact") & (F.col("authority") < s.high_impact), "refused|high_impact").otherwise("allowed|cleared")
    )
    return df.withColumns({"final": F.split(case, "\\|")[0], "final_reason": F.split(case, "\\|")[1]})


def feedback_effects(df: DataFrame) -> DataFrame:
    """Adds status and memory_outcome of ``feedback(verdict, context, corrected_reading)``.

    A blank context, or a reading where none belongs (or none where one belongs), is rejected; confirmed is
    recorded without effect; disputed, corrected and override are remembered as disputed with weight 1.
    """
    known = F.col("verdict").isin("confirmed", "disputed", "corrected", "override")
    fits = (F.col("verdict") == "corrected") == F.col("corrected_reading").isNotNull()
    ok = (F.trim(F.coalesce("context", F.lit(""))) != "") & F.coalesce(known, F.lit(False)) & F.coalesce(fits, F.lit(False))
    counts = ok & (F.col("verdict") != "confirmed")
    return df.withColumns({"status": F.when(~ok, "rejected").when(counts, "remembered").otherwise("recorded"), "memory_outcome": F.when(counts, "disputed"), "memory_weight": F.when(counts, 1.0)})


def memory_counts(memory: DataFrame) -> DataFrame:
    """Entries by learner, context and outcome, with the totals of each level, from one grouping."""
    return memory.groupingSets([["learner_id", "context", "outcome"], ["learner_id", "context"], ["learner_id"], []], "learner_id", "context", "outcome").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def memory_by_action(memory: DataFrame) -> DataFrame:
    """A8 per action: entries of each learner, context, action and outcome, and of each action over all outcomes (outcome null)."""
    keys = ["learner_id", "context", "action"]
    return memory.groupingSets([[*keys, "outcome"], keys], *keys, "outcome").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def entry_json(cols: list[str]) -> Column:
    """Canonical JSON of an entry: sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def hash_chain(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """(key, place, payload, previous_hash, entry_hash): each entry's SHA-256 over the hash before it and its JSON.

    Sequential by nature: a chain is one key's entries, sorted into one task and streamed past the last hash.
    """
    rows = df.select(key, *order, entry_json(cols).alias("payload"))
    dealt = rows.repartition(key).sortWithinPartitions(key, *order, "payload")
    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}, place int, payload string, previous_hash string, entry_hash string"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place, last = None, 0, ""
        for b in batches:
            out = []
            for k, j in zip(b[key].to_pylist(), b["payload"].to_pylist()):
                if not place or k != here:
                    here, place, last = k, 0, ""
                place += 1
                before, last = last, hashlib.sha256(f"{last}:{j}".encode()).hexdigest()
                out.append((place, before, last))
            n, before, own = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b[key], pa.array(n, pa.int32()), b["payload"], pa.array(before, pa.string()), pa.array(own, pa.string())], [key, "place", "payload", "previous_hash", "entry_hash"])

    return dealt.mapInArrow(link, kind)


def verify_chain(chain: DataFrame, key: str) -> DataFrame:
    """A10: per chain, entries and the first place that does not fit; the first kept entry is the anchor."""
    w = Window.partitionBy(key).orderBy("place")
    before = F.lag("entry_hash").over(w)
    own = F.sha2(F.concat("previous_hash", F.lit(":"), "payload"), 256) != F.col("entry_hash")
    bad = chain.withColumn("_bad", own | F.coalesce(before != F.col("previous_hash"), F.lit(False)))
    return bad.groupBy(key).agg(F.count("*").alias("entries"), F.min(F.when(F.col("_bad"), F.col("place"))).alias("first_break")).withColumn("intact", F.col("first_break").isNull())


def retain_last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def delivery_status(df: DataFrame) -> DataFrame:
    """Adds delivery_status and gate (policy, safety or human_approval) from selected and final."""
    status = F.when(F.col("selected").isNull(), "not_selected").when(F.col("final") == "allowed", "delivered").otherwise("selected_not_delivered")
    gate = F.when(F.col("selected").isNull(), "policy").when(F.col("final") == "deferred", "human_approval").when(F.col("final") == "refused", "safety")
    return df.withColumns({"delivery_status": status, "gate": gate})


def intervention_id(learner: Column, session: Column, kind: Column, instant: Column) -> Column:
    """A name that the same delivery always gets."""
    return F.concat(F.lit("intervention-"), F.substring(F.sha2(F.concat_ws(UNIT, learner, session, kind, instant), 256), 1, 24))


