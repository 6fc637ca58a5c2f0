"""Intervention history and policy: frequency caps and restraint for every decision at once.

Deliveries are ``learner_id, session_id, intervention_id, intervention_type, delivered_us, outcome``;
decisions are ``decision_id, learner_id, session_id, decided_us`` with ``verdict, probability,
threshold, confidence, evidence, state``.  History is read by windows over one union of both, so
that no delivery is joined to every later decision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.settings import DEFAULT, Settings

#: Fixed values.
RESPONSES = ("accepted", "responded", "completed", "engaged")
NON_RESPONSES = ("dismissed", "ignored", "timeout", "declined", "abandoned")
ACTIONABLE = ("declining", "increasing_deviation", "high_deviation")
CONFIDENCE_RANK = {"unknown": 0, "insufficient_data": 0, "low": 1, "medium": 2, "high": 3}
BLAME = (("retired", "type_retired"), ("repeated", "repeated_type_limit"), ("confidence", "confidence_too_low"), ("not_applicable", "no_eligible_candidate"))


@dataclass(frozen=True)
class Candidate:
    """One kind of intervention; the lowest priority that survives is chosen."""

    intervention_type: str
    priority: int
    confidence: str
    states: tuple[str, ...] = ()


#: Fixed values.
CATALOGUE = (Candidate("recap", 0, "medium"), Candidate("micro_question", 1, "medium"), Candidate("checkpoint_prompt", 2, "high"), Candidate("focus_quiz", 3, "high"))


def confidence_rank(col: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in CONFIDENCE_RANK.items():
        out = out.when(col == name, rank)
    return F.coalesce(out, F.lit(0))


def delivery_history(events: DataFrame, up_to_us: int | None = None) -> DataFrame:
    """Starts with their completion: the first of each id wins; completions without a start are dropped."""
    if up_to_us is not None:
        events = events.where(F.col("us") <= up_to_us)
    w = Window.partitionBy("learner_id", "intervention_id").orderBy("us", "event_id")
    first = lambda t: events.where((F.col("event_type") == t) & F.col("intervention_id").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    start = first("intervention_started").select("learner_id", "session_id", "intervention_id", "intervention_type", F.col("us").alias("delivered_us"))
    done = first("intervention_completed").select("learner_id", "intervention_id", "outcome", F.col("us").alias("completed_us"))
    return start.join(done, ["learner_id", "intervention_id"], "left")


def outcome_class(col: Column) -> Column:
    """Response, non_response, unclassified, or not_reported for null and blank."""
    t = F.lower(F.trim(col))
    return F.when(col.isNull() | (t == ""), "not_reported").when(t.isin(*RESPONSES), "response").when(t.isin(*NON_RESPONSES), "non_response").otherwise("unclassified")


def history_as_of(deliveries: DataFrame, decisions: DataFrame, latest: int | None = None) -> DataFrame:
    """The deliveries at or before each decision of its learner: (decision_id, learner_id, decided_us, back, delivery columns).

    ``back`` counts from 1, the latest.  One row for each pair; ranks are taken by decision, so that a busy learner's
    pairs are spread.  With ``latest`` each delivery carries so many deliveries up to itself, and a decision takes what
    the delivery before it carries: one sort of a learner's rows, not a join of every decision with every delivery.
    """
    if latest is None:
        pairs = decisions.select("decision_id", "learner_id", "decided_us").join(deliveries, "learner_id").where(F.col("delivered_us") <= F.col("decided_us"))
        back = F.row_number().over(Window.partitionBy("decision_id").orderBy(F.desc("delivered_us"), F.desc("intervention_id")))
        return pairs.select("decision_id", "learner_id", "decided_us", back.alias("back"), *[c for c in deliveries.columns if c != "learner_id"])
    cols = [c for c in deliveries.columns if c != "learner_id"]
    upto = Window.partitionBy("learner_id").orderBy("delivered_us", "intervention_id").rowsBetween(1 - latest, Window.currentRow)
    held = deliveries.select("learner_id", F.col("delivered_us").alias("_us"), F.lit(0).alias("_asks"), "intervention_id", F.collect_list(F.struct(*cols)).over(upto).alias("_held"))
    asked = decisions.select("learner_id", F.col("decided_us").alias("_us"), F.lit(1).alias("_asks"), "decision_id", "decided_us")
    w = Window.partitionBy("learner_id").orderBy("_us", "_asks", "intervention_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.unionByName(asked, allowMissingColumns=True).withColumn("_held", F.last("_held", True).over(w)).where("_asks = 1")
    rows = both.select("decision_id", "learner_id", "decided_us", F.posexplode(F.reverse("_held")).alias("_at", "_d"))
    return rows.select("decision_id", "learner_id", "decided_us", (F.col("_at") + 1).alias("back"), "_d.*")


def streaks(deliveries: DataFrame) -> DataFrame:
    """P7, P8 at each delivery: ``run`` (latest deliveries of one type in a row) and ``declined``
    (latest non-responses to its type, other types skipped)."""
    learner = Window.partitionBy("learner_id").orderBy("delivered_us", "intervention_id")
    by_type = Window.partitionBy("learner_id", "intervention_type").orderBy("delivered_us", "intervention_id")
    d = deliveries.withColumn("class", outcome_class(F.col("outcome")))
    d = d.withColumn("_new", F.coalesce((F.col("intervention_type") != F.lag("intervention_type").over(learner)).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(learner))
    d = d.withColumn("run", F.row_number().over(Window.partitionBy("learner_id", "_island").orderBy("delivered_us", "intervention_id")))
    d = d.withColumn("_n", F.row_number().over(by_type))
    other = F.max(F.when(F.col("class") != "non_response", F.col("_n"))).over(by_type)
    return d.withColumn("declined", F.col("_n") - F.coalesce(other, F.lit(0))).drop("_new", "_island", "_n")


def decision_history(decisions: DataFrame, deliveries: DataFrame, catalogue: tuple[Candidate, ...] = CATALOGUE, s: Settings = DEFAULT) -> DataFrame:
    """P4 to P10 for each decision: in_window, in_session, total_delivered, seconds_since_last, last_type and
    ``candidates``: of each type its run, declined count, and measured responses and non-responses."""
    d = streaks(deliveries)
    rows = d.select(
        "learner_id", "session_id", F.col("delivered_us").alias("us"), F.lit(0).alias("is_decision"), F.lit(None).cast("long").alias("decision_id"), "intervention_type", "run", "declined", "class", "intervention_id",
    ).unionByName(decisions.select("learner_id", "session_id", F.col("decided_us").alias("us"), F.lit(1).alias("is_decision"), F.col("decision_id").cast("long").alias("decision_id")), allowMissingColumns=True)
    here = F.col("is_decision") == 0
    order = Window.partitionBy("learner_id").orderBy("us", "is_decision", "intervention_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    width = Window.partitionBy("learner_id").orderBy("us").rangeBetween(-int(s.cap_window * 1e6) + 1, Window.currentRow)
    session = Window.partitionBy("learner_id", "session_id").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(here, F.struct("us", "intervention_type", "run")), True).over(order)
    per = []
    for c in catalogue:
        mine = here & (F.col("intervention_type") == c.intervention_type)
        per.append(F.struct(
            F.lit(c.intervention_type).alias("type"), F.lit(c.priority).alias("priority"), F.lit(CONFIDENCE_RANK[c.confidence]).alias("floor"), F.array(*map(F.lit, c.states)).cast("array<string>").alias("states"),
            F.when(F.col("_l.intervention_type") == c.intervention_type, F.col("_l.run")).otherwise(0).alias("run"),
            F.coalesce(F.last(F.when(mine, F.col("declined")), True).over(order), F.lit(0)).alias("declined"),
            F.count_if(mine & (F.col("class") == "response")).over(order).alias("responses"), F.count_if(mine & (F.col("class") == "non_response")).over(order).alias("non_responses"),
        ))
    out = rows.withColumns({"_l": last, "in_window": F.count_if(here).over(width), "in_session": F.count_if(here).over(session), "total_delivered": F.count_if(here).over(order)})
    out = out.withColumn("candidates", F.array(*per)).where("is_decision = 1")
    out = out.select("decision_id", "in_window", "in_session", "total_delivered", ((F.col("us") - F.col("_l.us")) / 1e6).alias("seconds_since_last"), F.col("_l.intervention_type").alias("last_type"), "candidates")
    return decisions.join(out, "decision_id")


def retired_types(history: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds the sorted types whose declined count reached ``abandon_after``."""
    return history.withColumn("retired", F.array_sort(F.transform(F.filter("candidates", lambda c: c["declined"] >= s.abandon_after), lambda c: c["type"])))


def eligible_candidates(history: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``judged``: each candidate with the reasons that drop it; none: it is eligible."""
    rank = confidence_rank(F.col("confidence"))

    def judge(c: Column) -> Column:
        why = F.array_compact(F.array(
            F.when(c["declined"] >= s.abandon_after, "retired"), F.when(c["run"] >= s.repeat_cap, "repeated"), F.when(rank < c["floor"], "confidence"),
            F.when((F.size(c["states"]) > 0) & ~F.array_contains(c["states"], F.coalesce("state", F.lit(""))), "not_applicable"),
        ))
        return F.struct(c["type"].alias("type"), c["priority"].alias("priority"), why.alias("why"))

    return history.withColumn("judged", F.transform("candidates", judge))


def blame(judged: Column) -> Column:
    """The reason to name when nobody is left, by precedence."""
    every = F.flatten(F.transform(judged, lambda c: c["why"]))
    out = F.when(F.lit(False), "")
    for why, reason in BLAME:
        out = out.when(F.array_contains(every, why), reason)
    return F.coalesce(out, F.lit("no_eligible_candidate"))


def select_candidate(judged: Column) -> tuple[Column, Column]:
    """(the eligible type of lowest priority or null, the other types in order)."""
    ok = F.array_sort(F.transform(F.filter(judged, lambda c: F.size(c["why"]) == 0), lambda c: F.struct(c["priority"], c["type"])))
    first = F.get(ok, F.lit(0))["type"]
    return first, F.filter(F.transform(judged, lambda c: c["type"]), lambda t: first.isNull() | (t != first))


def _refusals(s: Settings, floor: int) -> list[tuple[str, Column]]:
    p, state = F.col("probability"), F.col("state")
    return [
        ("not_resolved", ~F.col("verdict").eqNullSafe("resolved")),
        ("probability_below_floor", F.coalesce(p < F.greatest(F.lit(s.act_probability), F.coalesce("threshold", F.lit(0.0))), F.lit(True))),
        ("confidence_too_low", confidence_rank(F.col("confidence")) < floor),
        ("state_insufficient", state.isNull() | (state == "insufficient_data")),
        ("state_not_indicated", ~state.isin(*ACTIONABLE)),
        ("minimum_evidence_not_met", F.coalesce(F.col("evidence") < s.policy_evidence, F.lit(True))),
        ("in_cooldown", F.coalesce(F.col("seconds_since_last") < s.policy_cooldown, F.lit(False))),
        ("session_cap_reached", F.col("in_session") >= s.session_cap),
        ("window_cap_reached", F.col("in_window") >= s.window_cap),
    ]


def decide(decisions: DataFrame, deliveries: DataFrame, catalogue: tuple[Candidate, ...] = CATALOGUE, s: Settings = DEFAULT) -> DataFrame:
    """Adds decision (intervene / no_intervention), reason (of a refusal), selected and excluded types."""
    j = eligible_candidates(decision_history(decisions, deliveries, catalogue, s), s)
    floor = min(CONFIDENCE_RANK[c.confidence] for c in catalogue)
    chosen, rest = select_candidate(F.col("judged"))
    reason = F.when(F.lit(False), "")
    for name, bad in _refusals(s, floor):
        reason = reason.when(bad, name)
    reason = reason.when(chosen.isNull(), blame(F.col("judged")))
    j = j.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return j.withColumns({"decision": F.when(ok, "intervene").otherwise("no_intervention"), "selected": F.when(ok, chosen), "excluded": F.when(ok, rest)})


_KIND = {"probability_below_floor": "probability_floor", "confidence_too_low": "confidence_floor", "state_insufficient": "state_rule", "state_not_indicated": "state_rule", "minimum_evidence_not_met": "minimum_evidence", "in_cooldown": "cooldown", "session_cap_reached": "session_cap", "window_cap_reached": "window_cap", "type_retired": "type_retired", "repeated_type_limit": "repeated_type_limit", "no_eligible_candidate": "candidate_applicability"}


def restraints_long(decided: DataFrame, s: Settings = DEFAULT, catalogue: tuple[Candidate, ...] = CATALOGUE) -> DataFrame:
    """A row for each restraint evaluated: kind, limit, observed, margin (0 or more: held), binding.

    The first four are listed for every resolved decision, caps up to the binding one, candidate filters
    where they removed something.  A refusal of a resolved decision has exactly one binding row.
    """
    floor = min(CONFIDENCE_RANK[c.confidence] for c in catalogue)
    rows = [
        ("probability_floor", F.greatest(F.lit(s.act_probability), F.col("threshold")), F.col("probability"), 1),
        ("confidence_floor", F.lit(float(floor)), confidence_rank(F.col("confidence")).cast("double"), 1),
        ("state_rule", F.lit(1.0), F.coalesce(F.col("state").isin(*ACTIONABLE), F.lit(False)).cast("double"), 1),
        ("minimum_evidence", F.lit(float(s.policy_evidence)), F.col("evidence").cast("double"), 1),
        ("cooldown", F.lit(s.policy_cooldown), F.col("seconds_since_last"), 1),
        ("session_cap", F.lit(float(s.session_cap)), F.col("in_session").cast("double"), -1),
        ("window_cap", F.lit(float(s.window_cap)), F.col("in_window").cast("double"), -1),
    ]
    kind = F.when(F.lit(False), "")
    for r, k in _KIND.items():
        kind = kind.when(F.col("reason") == r, k)
    d = decided.where(F.col("verdict") == "resolved").withColumn("_k", kind)
    place = {k: i for i, (k, *_) in enumerate(rows)}
    at = F.when(F.lit(False), 0)
    for k, i in place.items():
        at = at.when(F.col("_k") == k, i)
    at = F.coalesce(at, F.lit(99))
    cells = []
    for k, limit, seen, side in rows:
        margin = (seen - limit) * side - (0 if side > 0 else 1)
        cell = F.struct(F.lit(k).alias("kind"), limit.cast("double").alias("limit"), seen.cast("double").alias("observed"), margin.alias("margin"), F.coalesce(F.col("_k") == k, F.lit(False)).alias("binding"))
        cells.append(cell if place[k] < 4 else F.when(at >= place[k], cell))
    for why, reason in BLAME:
        n = F.size(F.filter("judged", lambda c: F.array_contains(c["why"], why))).cast("double")
        name = _KIND[reason] if why != "confidence" else "candidate_confidence"
        binding = F.coalesce(F.col("reason") == reason, F.lit(False)) & (F.col("_k") == _KIND[reason]) if why != "confidence" else F.lit(False)
        cells.append(F.when((at == 99) & (n > 0), F.struct(F.lit(name).alias("kind"), F.lit(0.0).alias("limit"), n.alias("observed"), (-n).alias("margin"), binding.alias("binding"))))
    return d.select("decision_id", F.inline(F.array_compact(F.array(*cells))))
