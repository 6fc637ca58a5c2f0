"""Validation and data quality: typed findings, quarantine, dataset reports.

Rules become one ``violations`` array of (code, severity, field); rows are never clamped or
repaired.  A dataset is named by a key column; ``seq`` is the arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.columns import utc_finding, utc_micros, valid_pseudonym, valid_unit_interval
from eventlens.sources.event_log import FIELDS, PAYLOADS, allowed, by_type, names, required
from eventlens.sources.shared import saved

ENVELOPE_KEYS = ("event_id", "learner_id", "session_id", "timestamp", "event_type", "payload", "origin", "provenance")
ORIGINS = ("real", "synthetic")

#: Rules on payload values, by field: all types that have the field.
_NOT_NEGATIVE = [f for f in FIELDS if f.endswith("seconds")]
_UNIT = ("difficulty", "completion_ratio", "trigger_probability")
_AT_LEAST_ONE = ("attempt_number", "pause_count")
_IDS = ("content_id",)
_LONGEST = 256


def violation(bad: Column, code: str, field: str, severity: str = "error") -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def payload_rules(df: DataFrame) -> Column:
    """V4: violations of the row's payload columns, for those payload fields that the frame has."""
    t, out = F.col("event_type"), []
    for f in FIELDS:
        if f not in df.columns:
            continue
        types = [k for k in PAYLOADS if f in allowed(k)]
        here, value = t.isin(*types), F.col(f)
        out.append(violation(t.isin(*[k for k in types if f in required(k)]) & value.isNull(), "missing_field", f))
        if f in _NOT_NEGATIVE:
            out.append(violation(here & (F.isnan(value) | (value < 0)), "negative_seconds", f))
        if f in _UNIT:
            out.append(violation(here & value.isNotNull() & ~valid_unit_interval(value), "not_in_unit_interval", f))
        if f in _AT_LEAST_ONE:
            out.append(violation(here & (value < 1), "below_one", f))
        if f == "playback_rate":
            out.append(violation(here & ~(value > 0), "not_positive", f))
        if f in _IDS:
            out.append(violation(here & value.isNotNull() & ~valid_pseudonym(value), "invalid_identifier", f))
        elif dict(df.dtypes)[f] == "string":
            out.append(violation(here & (F.length(value) > _LONGEST), "too_long", f))
    return F.array_compact(F.array(*out))


def origin_rules(df: DataFrame) -> Column:
    """V5: a synthetic event needs a stamp and is not observed."""
    synthetic = F.col("origin") == "synthetic"
    return F.array_compact(F.array(
        violation(~F.col("origin").isin(*ORIGINS) | F.col("origin").isNull(), "unknown_origin", "origin"),
        violation(synthetic & ~F.coalesce("has_stamp", F.lit(False)), "missing_stamp", "synthetic_stamp"),
        violation(synthetic & (F.col("provenance") == "observed"), "synthetic_observed", "provenance"),
    ))


def envelope_rules(df: DataFrame) -> Column:
    """V1, V2 and the event type over the envelope columns."""
    ids = [violation(F.col(c).isNull(), "missing_field", c) for c in ("event_id", "learner_id", "session_id")]
    ids += [violation(F.col(c).isNotNull() & ~valid_pseudonym(F.col(c)), "invalid_identifier", c) for c in ("event_id", "learner_id", "session_id")]
    when = utc_finding(F.col("timestamp"))
    ts = F.when(when.isNotNull(), F.struct(when.alias("code"), F.lit("error").alias("severity"), F.lit("timestamp").alias("field")))
    return F.array_compact(F.array(*ids, ts, violation(F.col("event_type").isNull() | ~F.col("event_type").isin(*PAYLOADS), "unknown_event_type", "event_type")))


def with_violations(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", F.concat(envelope_rules(df), payload_rules(df), origin_rules(df)))


def ingest(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """V6: (accepted with ``us``, rejected with the first violation's code and field).

    ``strict`` makes the job fail at the first row that breaks a rule.
    """
    checked = with_violations(df)
    if strict:
        checked = checked.where(F.when(F.size("violations") > 0, F.raise_error(F.to_json(F.get("violations", F.lit(0))))).otherwise(F.lit(True)))
    good = checked.where(F.size("violations") == 0).withColumn("us", utc_micros(F.col("timestamp"))).drop("violations")
    first = F.get("violations", F.lit(0))
    return good, checked.where(F.size("violations") > 0).withColumn("code", first["code"]).withColumn("field", first["field"])


def reject_duplicate_ids(accepted: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V7: (first of each event_id in arrival order, later ones); ids of ``history`` are taken already."""
    w = Window.partitionBy("event_id").orderBy("seq")
    marked = accepted.withColumn("_r", F.row_number().over(w))
    if history is not None:
        known = history.select("event_id").distinct().withColumn("_old", F.lit(1))
        marked = marked.join(known, "event_id", "left").withColumn("_r", F.when(F.col("_old").isNotNull(), F.col("_r") + 1).otherwise(F.col("_r"))).drop("_old")
    return marked.where("_r = 1").drop("_r"), marked.where("_r > 1").drop("_r")


def ingest_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V8: accepted, rejected (duplicates among them, counted once), total and acceptance rate, 0 when empty."""
    checked = with_violations(df)
    ok = F.size("violations") == 0
    w = Window.partitionBy("event_id", ok).orderBy("seq")
    marked = checked.withColumn("_dup", ok & (F.row_number().over(w) > 1)).withColumn("_ok", ok)
    out = marked.groupBy(*(by or [])).agg(F.count_if(F.col("_ok") & ~F.col("_dup")).alias("accepted"), F.count_if(~F.col("_ok") | F.col("_dup")).alias("rejected"), F.count_if("_dup").alias("duplicates"), F.count("*").alias("total"))
    return out.withColumn("acceptance_rate", F.coalesce(F.try_divide("accepted", "total"), F.lit(0.0)))


def cap_batch(df: DataFrame, most: int, batch: str) -> DataFrame:
    """V9: adds ``rejected``: 'batch_size_exceeded' past the first ``most`` rows of a batch."""
    w = Window.partitionBy(batch).orderBy("seq")
    return df.withColumn("rejected", F.when(F.row_number().over(w) > most, "batch_size_exceeded"))


def report_duplicates(df: DataFrame, dataset: str) -> DataFrame:
    """Every repeat of an event_id within a dataset, with the index first seen."""
    w = Window.partitionBy(dataset, "event_id").orderBy("seq")
    return df.withColumn("first_seq", F.first("seq").over(w)).where(F.col("seq") > F.col("first_seq")).select(dataset, "event_id", "seq", "first_seq")


def implausible_values(df: DataFrame, column: str = "response_seconds", most: float = 3600.0) -> DataFrame:
    """Rows whose value exceeds ``most``."""
    return df.where(F.col(column) > most)


def session_bounds_findings(df: DataFrame, dataset: str) -> DataFrame:
    """Missing declared starts and ends warn; events outside the declared bounds are errors."""
    w = Window.partitionBy(dataset)
    at = lambda t: F.when(F.col("event_type") == t, F.col("us"))
    b = df.withColumn("_lo", F.min(at("session_started")).over(w)).withColumn("_hi", F.max(at("session_ended")).over(w))
    inner = b.where((F.col("us") < F.col("_lo")) | (F.col("us") > F.col("_hi"))).select(dataset, "seq", F.when(F.col("us") < F.col("_lo"), "before_session_start").otherwise("after_session_end").alias("code"), F.lit("error").alias("severity"))
    missing = df.groupBy(dataset).agg(F.bool_or(F.col("event_type") == "session_started").alias("s"), F.bool_or(F.col("event_type") == "session_ended").alias("e"))
    codes = F.array_compact(F.array(F.when(~F.col("s"), "missing_session_start"), F.when(~F.col("e"), "missing_session_end")))
    return inner.unionByName(missing.select(dataset, F.lit(None).cast("long").alias("seq"), F.explode(codes).alias("code"), F.lit("warning").alias("severity")))


def out_of_order(df: DataFrame, dataset: str) -> DataFrame:
    """Per dataset, whether arrival order differs from time order, and how often time steps back."""
    w = Window.partitionBy(dataset).orderBy("seq")
    back = df.withColumn("_back", F.col("us") < F.lag("us").over(w))
    return back.groupBy(dataset).agg(F.coalesce(F.bool_or("_back"), F.lit(False)).alias("out_of_order"), F.count_if("_back").alias("steps_back"))


def multi_key_findings(df: DataFrame, dataset: str) -> DataFrame:
    """Datasets with more than one learner or session, with the sorted ids."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    per = df.groupBy(dataset).agg(ids("learner_id").alias("l"), ids("session_id").alias("s"))
    rows = F.array_compact(F.array(
        F.when(F.size("l") > 1, F.struct(F.lit("multiple_learners").alias("code"), F.array_join("l", ",").alias("ids"))),
        F.when(F.size("s") > 1, F.struct(F.lit("multiple_sessions").alias("code"), F.array_join("s", ",").alias("ids"))),
    ))
    return per.select(dataset, F.explode(rows).alias("x")).select(dataset, "x.code", "x.ids")


def flattened_event_hint(df: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """JSON objects without payload whose keys are payload fields or foreign: both lists, sorted."""
    k = F.json_object_keys(F.col(item))
    flat = F.array_sort(F.array_intersect(k, names(FIELDS)))
    foreign = F.array_sort(F.array_except(k, names([*FIELDS, *ENVELOPE_KEYS])))
    out = df.select(*keys, F.array_join(flat, ",").alias("flattened"), F.array_join(foreign, ",").alias("foreign"), F.array_contains(k, "payload").alias("_has"))
    return out.where(~F.col("_has") & ((F.col("flattened") != "") | (F.col("foreign") != ""))).drop("_has")


def identity_check(df: DataFrame, dataset: str, stated: DataFrame) -> DataFrame:
    """Per dataset of ``stated(dataset, learner_id, session_id)``: whether the stated learner is the
    only one in the data, and whether the stated session occurs."""
    per = df.groupBy(dataset).agg(F.collect_set("learner_id").alias("l"), F.collect_set("session_id").alias("s"))
    j = stated.join(per, dataset, "left")
    return j.select(
        dataset, F.coalesce((F.size("l") == 1) & F.array_contains("l", F.col("learner_id")), F.lit(False)).alias("learner_ok"),
        F.coalesce(F.array_contains("s", F.col("session_id")), F.lit(False)).alias("session_ok"),
    )


def dataset_summary(df: DataFrame, dataset: str) -> DataFrame:
    """Counts, span, accuracy and mean latency (null without answers) and origin of each dataset."""
    answered = F.col("event_type") == "question_answered"
    real, synthetic = F.bool_or(F.col("origin") == "real"), F.bool_or(F.col("origin") == "synthetic")
    return df.groupBy(dataset).agg(
        F.count("*").alias("n_events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), ((F.max("us") - F.min("us")) / 1e6).alias("span_seconds"),
        F.count_if(answered).alias("answers"), F.count_if(answered & F.col("correct")).alias("n_correct"),
        F.avg(F.when(answered, F.col("correct").cast("int"))).alias("accuracy"), F.avg(F.when(answered, F.col("response_seconds"))).alias("mean_latency"),
        F.when(real & synthetic, "mixed").when(real, "real").when(synthetic, "synthetic").otherwise("unknown").alias("origin_label"),
    )


def dataset_findings(df: DataFrame, dataset: str, most_per_event: int = 6, few: int = 3) -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts): each dataset's findings (dataset, seq, code, severity), and per dataset
    accepted, errors, warnings and can_proceed (some accepted, no error).

    Rows are checked once, and what the findings need of them is saved; the findings are saved for the verdicts.
    """
    needs = dict.fromkeys((dataset, "seq", "event_id", "learner_id", "session_id", "us", "event_type", "response_seconds", "violations"))
    checked = saved(with_violations(df).withColumn("us", utc_micros(F.col("timestamp"))).select(*needs), "checked")
    ok = checked.where(F.size("violations") == 0)
    schema = checked.select(dataset, "seq", F.explode(F.slice("violations", 1, most_per_event)).alias("v")).select(dataset, "seq", F.col("v.code").alias("code"), F.col("v.severity").alias("severity"))
    none = F.lit(None).cast("long").alias("seq")
    small = ok.groupBy(dataset).agg(F.count("*").alias("n")).where(F.col("n") < few).select(dataset, none, F.lit("too_few_events").alias("code"), F.lit("error").alias("severity"))
    dup = report_duplicates(ok, dataset).select(dataset, "seq", F.lit("duplicate_event_id").alias("code"), F.lit("warning").alias("severity"))
    slow = implausible_values(ok).select(dataset, "seq", F.lit("implausible_response_time").alias("code"), F.lit("warning").alias("severity"))
    order = out_of_order(ok, dataset).where("out_of_order").select(dataset, none, F.lit("out_of_order").alias("code"), F.lit("warning").alias("severity"))
    keys = multi_key_findings(ok, dataset).select(dataset, none, "code", F.lit("warning").alias("severity"))
    findings = schema
    for part in (small, dup, slow, order, keys, session_bounds_findings(ok, dataset)):
        findings = findings.unionByName(part)
    findings = saved(findings, "findings")
    counts = findings.groupBy(dataset).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    accepted = checked.groupBy(dataset).agg(F.count_if(F.size("violations") == 0).alias("accepted"))
    verdict = accepted.join(counts, dataset, "left").na.fill(0, ["errors", "warnings"])
    return findings, verdict.withColumn("can_proceed", (F.col("accepted") > 0) & (F.col("errors") == 0))
