"""Registered queries: sources, validation and data quality over a raw form of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import columns as X
from eventlens.operators import validation as V
from eventlens.plans.canon import CANON, events
from eventlens.sources import event_log as S
from eventlens.sources.shared import shared_path


def raw(s, d) -> DataFrame:
    """The log as it might arrive: text ids and instants, payload columns, and defects that ``k`` decides."""
    e, k = events(s, d), F.col("k")
    t = lambda *names: F.col("event_type").isin(*names)
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    twin = F.when(k % 17 == 0, F.col("event_id") - F.col("event_id") % 3).otherwise(F.col("event_id"))
    return e.select(
        F.col("event_id").alias("seq"), "us",
        F.when(k % 23 == 0, "e1").otherwise(F.concat(F.lit("evt-"), F.lpad(twin.cast("string"), 8, "0"))).alias("event_id"),
        F.concat(F.lit("learner-"), F.lpad("learner_id", 4, "0")).alias("learner_id"), F.concat(F.lit("session-"), "session_id").alias("session_id"),
        F.when(k % 31 == 0, None).when(k % 29 == 0, "yesterday").when(k % 19 == 0, iso).otherwise(F.concat(iso, F.lit("Z"))).alias("timestamp"),
        F.when(k == 97, "mystery").otherwise(F.col("event_type")).alias("event_type"),
        "origin", F.when((F.col("origin") == "synthetic") & (k % 13 != 0), "simulated").otherwise("observed").alias("provenance"), (k % 11 != 0).alias("has_stamp"),
        "question_id", "difficulty", "topic", "correct",
        F.when(k == 95, F.lit(-1.0)).when(k == 94, F.lit(4000.0)).otherwise(F.col("response_seconds")).alias("response_seconds"),
        F.when(t("question_answered"), k % 5).alias("attempt_number"),
        F.when(t("content_opened", "content_closed"), F.when(k % 41 == 0, "c1").otherwise(F.concat(F.lit("content-"), "content_id"))).alias("content_id"),
        F.when(t("content_closed"), k / 2.0).alias("time_open_seconds"),
        F.when(t("interaction"), F.lit("tap")).alias("interaction_type"),
        F.when(t("intervention_started", "intervention_completed"), F.concat(F.lit("intervention-"), F.col("intervention_id").cast("string"))).alias("intervention_id"),
        "intervention_type", F.when(t("intervention_started"), k / 90.0).alias("trigger_probability"), F.when(t("intervention_started"), F.lit("declining")).alias("trigger_state"), "outcome", "k",
    )


RAW = CANON + """, rawe AS (
  SELECT event_id AS seq, us, CASE WHEN k % 23 = 0 THEN 'e1' ELSE 'evt-' || lpad(CAST(CASE WHEN k % 17 = 0 THEN event_id - event_id % 3 ELSE event_id END AS VARCHAR), 8, '0') END AS event_id,
         'learner-' || lpad(learner_id, 4, '0') AS learner_id, 'session-' || session_id AS session_id,
         CASE WHEN k % 31 = 0 THEN 'missing_field' WHEN k % 29 = 0 THEN 'invalid_timestamp' WHEN k % 19 = 0 THEN 'naive_timestamp' END AS ts_code,
         CASE WHEN k = 97 THEN 'mystery' ELSE event_type END AS event_type, origin,
         CASE WHEN origin = 'synthetic' AND k % 13 <> 0 THEN 'simulated' ELSE 'observed' END AS provenance, k % 11 <> 0 AS has_stamp,
         question_id, difficulty, correct, CASE WHEN k = 95 THEN -1.0 WHEN k = 94 THEN 4000.0 ELSE response_seconds END AS response_seconds,
         CASE WHEN event_type IN ('content_opened', 'content_closed') THEN CASE WHEN k % 41 = 0 THEN 'c1' ELSE 'content-' || content_id END END AS content_id,
         intervention_id, outcome, k
  FROM ev),
viol AS (
  SELECT *, list_filter([
     CASE WHEN event_id = 'e1' THEN 'invalid_identifier:event_id' END,
     CASE WHEN ts_code IS NOT NULL THEN ts_code || ':timestamp' END,
     CASE WHEN event_type = 'mystery' THEN 'unknown_event_type:event_type' END,
     CASE WHEN event_type = 'question_answered' AND k % 5 = 0 THEN 'below_one:attempt_number' END,
     CASE WHEN event_type IN ('content_opened', 'content_closed') AND content_id = 'c1' THEN 'invalid_identifier:content_id' END,
     CASE WHEN event_type IN ('intervention_started', 'intervention_completed') AND intervention_id IS NULL THEN 'missing_field:intervention_id' END,
     CASE WHEN event_type IN ('question_started', 'question_answered') AND question_id IS NULL THEN 'missing_field:question_id' END,
     CASE WHEN event_type IN ('question_answered', 'intervention_completed') AND response_seconds < 0 THEN 'negative_seconds:response_seconds' END,
     CASE WHEN event_type = 'intervention_started' AND k > 90 THEN 'not_in_unit_interval:trigger_probability' END,
     CASE WHEN origin = 'synthetic' AND k % 11 = 0 THEN 'missing_stamp:synthetic_stamp' END,
     CASE WHEN origin = 'synthetic' AND k % 13 = 0 THEN 'synthetic_observed:provenance' END], lambda x: x IS NOT NULL) AS v
  FROM rawe),
good AS (SELECT * FROM viol WHERE len(v) = 0)
"""


def _joined(violations):
    return F.array_join(F.transform(violations, lambda v: F.concat_ws(":", v["code"], v["field"])), ",")


def _good(s, d) -> DataFrame:
    good, _ = V.ingest(raw(s, d))
    return good


def s1(s, d):
    path = shared_path(s, "log")
    e = raw(s, d).select("event_id", "learner_id", "session_id", "timestamp", "event_type", "origin", "provenance", F.col("seq").alias("ingest_seq"))
    lines = S.export_json_lines(e).union(e.where("ingest_seq % 100 = 0").select(F.concat(F.lit('{"event_id": '), "event_id")))
    lines.write.text(path)
    return S.log_summary(S.read_event_log(s, path))


def s2(s, d):
    """Two batches, the first one sent twice, and a third whose writer was lost before its entry."""
    path = shared_path(s, "log")
    e = raw(s, d).select("event_id", "session_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("event_date"))
    early, late = e.where("event_date < '2024-01-15'"), e.where("event_date >= '2024-01-15'")
    S.append_event_log(early, path, "b1", "event_date")
    S.append_event_log(early, path, "b1", "event_date")
    S.append_event_log(late, path, "b2", "event_date")
    late.write.partitionBy("event_date").parquet(f"{path}/data/batch=b3/attempt=lost")
    log = S.read_appended(s, path)
    return log.groupBy(F.col("event_date").cast("string").alias("event_date"), F.col("batch").cast("string").alias("batch")).agg(F.count("*").alias("n"))


def s3(s, d):
    e = raw(s, d)
    fields = [F.col(c) for c in S.FIELDS if c in e.columns]
    payload = F.when(F.col("k") % 43 == 0, F.lit('{"video_id":"v1"}')).otherwise(F.to_json(F.struct(*fields)))
    p = S.parse_payload(e.select("seq", "event_type", payload.alias("payload")))
    return p.select("seq", "payload_ok", F.array_join("missing", ",").alias("missing"), F.array_join("foreign", ",").alias("foreign"), F.col("p.difficulty").alias("difficulty"), F.col("p.correct").alias("correct"), F.col("p.outcome").alias("outcome"))


def documents(s, d) -> DataFrame:
    e = raw(s, d).select("seq", "session_id", "event_type", F.to_json(F.struct("event_type", "seq")).alias("j"))
    per = e.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "j"))).alias("js"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("js", lambda x: x["j"]), ","), F.lit("]"))
    n = F.size("js")
    doc = (
        F.when(n % 7 == 0, F.lit("[]")).when(n % 7 == 1, F.get("js", F.lit(0))["j"]).when(n % 7 == 2, F.concat(F.lit('{"events":'), joined, F.lit("}")))
        .when(n % 7 == 3, F.lit("7")).when(n % 7 == 4, F.lit('{"events":5}')).when(n % 7 == 5, F.lit("not json")).otherwise(joined)
    )
    return per.select("session_id", doc.alias("document"))


def s4(s, d):
    x = S.explode_event_documents(documents(s, d), "document", ["session_id"])
    return x.select("session_id", "root_shape", "idx", F.get_json_object("item", "$.seq").cast("long").alias("seq"), "finding")


def v10(s, d):
    findings, verdict = V.dataset_findings(raw(s, d), "session_id")
    codes = findings.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return verdict.join(codes, "session_id", "left")


def v16(s, d):
    e = raw(s, d).select("seq", F.when(F.col("seq") % 2 == 0, F.to_json(F.struct("event_id", "question_id", F.lit("x").alias("subject")))).otherwise(F.to_json(F.struct("event_id", F.struct("k").alias("payload")))).alias("j"))
    return V.flattened_event_hint(e, "j", ["seq"])


def v17(s, d):
    e = raw(s, d)
    stated = e.groupBy("session_id").agg(F.min("learner_id").alias("learner_id")).select(F.col("session_id").alias("dataset"), "learner_id", F.concat("session_id", F.when(F.hash("session_id") * 0 == 0, "")).alias("session_id"))
    stated = stated.withColumn("learner_id", F.when(F.col("dataset").endswith("3"), "someone-else").otherwise(F.col("learner_id")))
    return V.identity_check(e.withColumn("dataset", F.col("session_id")), "dataset", stated)


QUERIES = {
    "s1_read_event_log": s1,
    "s2_append_event_log": s2,
    "s3_parse_payload": s3,
    "s4_explode_event_documents": s4,
    "v1_valid_pseudonym": lambda s, d: raw(s, d).select("seq", X.valid_pseudonym(F.col("event_id")).alias("event_ok"), X.valid_pseudonym(F.col("learner_id")).alias("learner_ok")),
    "v2_require_utc": lambda s, d: raw(s, d).select("seq", X.utc_finding(F.col("timestamp")).alias("finding"), X.utc_micros(F.col("timestamp")).alias("at_us")),
    "v3_valid_unit_interval": lambda s, d: raw(s, d).select("seq", X.valid_unit_interval(F.col("trigger_probability")).alias("ok"), X.valid_unit_interval(F.when(F.col("k") == 1, F.lit(float("nan"))).otherwise(F.col("difficulty"))).alias("difficulty_ok")),
    "v4_payload_rules": lambda s, d: raw(s, d).select("seq", _joined(V.payload_rules(raw(s, d))).alias("violations")),
    "v5_origin_rules": lambda s, d: raw(s, d).select("seq", _joined(V.origin_rules(raw(s, d))).alias("violations")),
    "v6_ingest": lambda s, d: V.ingest(raw(s, d))[1].select("seq", "code", "field"),
    "v7_reject_duplicate_ids": lambda s, d: V.reject_duplicate_ids(_good(s, d))[1].select("seq", "event_id"),
    "v8_ingest_summary": lambda s, d: V.ingest_summary(raw(s, d)),
    "v9_cap_batch": lambda s, d: V.cap_batch(raw(s, d), 20, "learner_id").groupBy("learner_id").agg(F.count_if(F.col("rejected") == "batch_size_exceeded").alias("n_rejected"), F.count("*").alias("n")),
    "v10_dataset_findings": v10,
    "v11_report_duplicates": lambda s, d: V.report_duplicates(_good(s, d).withColumn("batch", F.floor(F.col("seq") / 100)), "batch"),
    "v12_implausible_values": lambda s, d: V.implausible_values(raw(s, d)).select("seq", "response_seconds"),
    "v13_session_bounds_findings": lambda s, d: V.session_bounds_findings(raw(s, d).withColumn("event_type", F.when(F.col("k") == 3, "session_started").when(F.col("k") == 60, "session_ended").otherwise(F.col("event_type"))), "learner_id"),
    "v14_out_of_order": lambda s, d: V.out_of_order(raw(s, d).withColumn("seq", X.stable_bucket(F.col("seq").cast("string"))), "session_id"),
    "v15_multi_key_findings": lambda s, d: V.multi_key_findings(raw(s, d).withColumn("batch", F.floor(F.col("seq") / 3)), "batch"),
    "v16_flattened_event_hint": v16,
    "v17_identity_check": v17,
    "v18_dataset_summary": lambda s, d: V.dataset_summary(events(s, d), "session_id"),
}

_BUCKET = "CAST('0x' || substr(sha256(CAST(seq AS VARCHAR)), 1, 15) AS BIGINT)"

ORACLES = {
    "s1_read_event_log": "SELECT count(*) AS events, count(*) FILTER (WHERE event_id % 100 = 0) AS skipped_lines FROM events",
    "s2_append_event_log": "SELECT strftime(ts, '%Y-%m-%d') AS event_date, CASE WHEN strftime(ts, '%Y-%m-%d') < '2024-01-15' THEN 'b1' ELSE 'b2' END AS batch, count(*) AS n FROM events GROUP BY 1, 2",
    "s3_parse_payload": RAW + """, miss AS (
  SELECT *, CASE WHEN k % 43 = 0 THEN CASE event_type WHEN 'question_started' THEN 'question_id' WHEN 'question_answered' THEN 'attempt_number,correct,question_id,response_seconds'
       WHEN 'content_opened' THEN 'content_id' WHEN 'content_closed' THEN 'content_id,time_open_seconds' WHEN 'interaction' THEN 'interaction_type'
       WHEN 'intervention_started' THEN 'intervention_id,intervention_type,trigger_probability,trigger_state' WHEN 'intervention_completed' THEN 'intervention_id,outcome' END
     WHEN event_type = 'mystery' THEN NULL
     WHEN event_type IN ('question_started', 'question_answered') AND question_id IS NULL THEN 'question_id'
     WHEN event_type = 'intervention_completed' AND intervention_id IS NULL THEN 'intervention_id' ELSE '' END AS missing
  FROM rawe)
SELECT seq, event_type <> 'mystery' AND missing = '' AND k % 43 <> 0 AND NOT (k IN (94, 95) AND event_type NOT IN ('question_answered', 'intervention_completed')) AS payload_ok, missing,
       CASE WHEN event_type = 'mystery' THEN NULL WHEN k % 43 = 0 THEN 'video_id' WHEN k IN (94, 95) AND event_type NOT IN ('question_answered', 'intervention_completed') THEN 'response_seconds' ELSE '' END AS "foreign",
       CASE WHEN k % 43 <> 0 THEN difficulty END AS difficulty, CASE WHEN k % 43 <> 0 THEN correct END AS correct, CASE WHEN k % 43 <> 0 THEN outcome END AS outcome
FROM miss""",
    "s4_explode_event_documents": RAW + """, per AS (SELECT session_id, count(*) AS n FROM rawe GROUP BY 1),
item AS (SELECT r.session_id, r.seq, CAST(row_number() OVER (PARTITION BY r.session_id ORDER BY r.seq) - 1 AS INTEGER) AS idx, n FROM rawe r JOIN per USING (session_id))
SELECT session_id, CASE n % 7 WHEN 2 THEN 'envelope' ELSE 'array' END AS root_shape, idx, seq, NULL AS finding FROM item WHERE n % 7 IN (2, 6)
UNION ALL
SELECT session_id, ['array', 'single_event', NULL, 'scalar', 'object', 'not_json'][n % 7 + 1], NULL, NULL, ['empty_collection', 'single_event_object', NULL, 'scalar_root', 'unknown_object', 'not_json'][n % 7 + 1]
FROM per WHERE n % 7 NOT IN (2, 6)""",
    "v1_valid_pseudonym": RAW + "SELECT seq, event_id <> 'e1' AS event_ok, true AS learner_ok FROM rawe",
    "v2_require_utc": RAW + "SELECT seq, ts_code AS finding, CASE WHEN ts_code IS NULL THEN us END AS at_us FROM rawe",
    "v3_valid_unit_interval": RAW + "SELECT seq, coalesce(event_type = 'intervention_started' OR (k = 97 AND seq IN (SELECT event_id FROM ev WHERE event_type = 'intervention_started')), false) AND k <= 90 AS ok, k <> 1 AND difficulty IS NOT NULL AS difficulty_ok FROM rawe",
    "v4_payload_rules": RAW + "SELECT seq, array_to_string(list_filter(v, lambda x: split_part(x, ':', 2) NOT IN ('event_id', 'timestamp', 'event_type', 'synthetic_stamp', 'provenance')), ',') AS violations FROM viol",
    "v5_origin_rules": RAW + "SELECT seq, array_to_string(list_filter(v, lambda x: split_part(x, ':', 2) IN ('synthetic_stamp', 'provenance')), ',') AS violations FROM viol",
    "v6_ingest": RAW + "SELECT seq, split_part(v[1], ':', 1) AS code, split_part(v[1], ':', 2) AS field FROM viol WHERE len(v) > 0",
    "v7_reject_duplicate_ids": RAW + "SELECT seq, event_id FROM good QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) > 1",
    "v8_ingest_summary": RAW + ", m AS (SELECT len(v) = 0 AS ok, len(v) = 0 AND row_number() OVER (PARTITION BY event_id, len(v) = 0 ORDER BY seq) > 1 AS dup FROM viol) SELECT count(*) FILTER (WHERE ok AND NOT dup) AS accepted, count(*) FILTER (WHERE NOT ok OR dup) AS rejected, count(*) FILTER (WHERE dup) AS duplicates, count(*) AS total, count(*) FILTER (WHERE ok AND NOT dup) / count(*) AS acceptance_rate FROM m",
    "v9_cap_batch": RAW + "SELECT learner_id, greatest(count(*) - 20, 0) AS n_rejected, count(*) AS n FROM rawe GROUP BY 1",
    "v10_dataset_findings": RAW + """, f AS (
  SELECT session_id, split_part(unnest(v[1:6]), ':', 1) AS code, 'error' AS sev FROM viol
  UNION ALL SELECT session_id, 'too_few_events', 'error' FROM good GROUP BY 1 HAVING count(*) < 3
  UNION ALL SELECT session_id, 'duplicate_event_id', 'warning' FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id, event_id ORDER BY seq) AS r FROM good) WHERE r > 1
  UNION ALL SELECT session_id, 'implausible_response_time', 'warning' FROM good WHERE response_seconds > 3600
  UNION ALL SELECT DISTINCT session_id, 'out_of_order', 'warning' FROM (SELECT session_id, us < lag(us) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM good) WHERE b
  UNION ALL SELECT DISTINCT session_id, unnest(['missing_session_start', 'missing_session_end']), 'warning' FROM good)
SELECT a.session_id, accepted, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, accepted > 0 AND coalesce(errors, 0) = 0 AS can_proceed, codes
FROM (SELECT session_id, count(*) FILTER (WHERE len(v) = 0) AS accepted FROM viol GROUP BY 1) a
LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE sev = 'error') AS errors, count(*) FILTER (WHERE sev = 'warning') AS warnings, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM f GROUP BY 1) b USING (session_id)""",
    "v11_report_duplicates": RAW + "SELECT batch, event_id, seq, f AS first_seq FROM (SELECT seq // 100 AS batch, event_id, seq, min(seq) OVER (PARTITION BY seq // 100, event_id) AS f FROM good) WHERE seq > f",
    "v12_implausible_values": RAW + "SELECT seq, response_seconds FROM rawe WHERE response_seconds > 3600",
    "v13_session_bounds_findings": RAW + """, b AS (SELECT learner_id, seq, us, min(CASE WHEN k = 3 THEN us END) OVER w AS lo, max(CASE WHEN k = 60 THEN us END) OVER w AS hi FROM rawe WINDOW w AS (PARTITION BY learner_id))
SELECT learner_id, seq, CASE WHEN us < lo THEN 'before_session_start' ELSE 'after_session_end' END AS code, 'error' AS severity FROM b WHERE us < lo OR us > hi
UNION ALL SELECT learner_id, NULL, 'missing_session_start', 'warning' FROM rawe GROUP BY 1 HAVING NOT bool_or(k = 3)
UNION ALL SELECT learner_id, NULL, 'missing_session_end', 'warning' FROM rawe GROUP BY 1 HAVING NOT bool_or(k = 60)""",
    "v14_out_of_order": RAW + f"SELECT session_id, coalesce(bool_or(b), false) AS out_of_order, count(*) FILTER (WHERE b) AS steps_back FROM (SELECT session_id, us < lag(us) OVER (PARTITION BY session_id ORDER BY {_BUCKET}) AS b FROM rawe) GROUP BY 1",
    "v15_multi_key_findings": RAW + ", p AS (SELECT seq // 3 AS batch, list_sort(list(DISTINCT learner_id)) AS l, list_sort(list(DISTINCT session_id)) AS s FROM rawe GROUP BY 1) SELECT batch, 'multiple_learners' AS code, array_to_string(l, ',') AS ids FROM p WHERE len(l) > 1 UNION ALL SELECT batch, 'multiple_sessions', array_to_string(s, ',') FROM p WHERE len(s) > 1",
    "v16_flattened_event_hint": RAW + "SELECT seq, CASE WHEN question_id IS NOT NULL THEN 'question_id' ELSE '' END AS flattened, 'subject' AS \"foreign\" FROM rawe WHERE seq % 2 = 0",
    "v17_identity_check": RAW + "SELECT DISTINCT session_id AS dataset, NOT ends_with(session_id, '3') AS learner_ok, true AS session_ok FROM rawe",
    "v18_dataset_summary": CANON + """SELECT session_id, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us, (max(us) - min(us)) / 1e6 AS span_seconds,
  count(*) FILTER (WHERE event_type = 'question_answered') AS answers, count(*) FILTER (WHERE correct) AS n_correct, avg(CAST(correct AS INTEGER)) AS accuracy, avg(response_seconds) AS mean_latency,
  CASE WHEN count(DISTINCT origin) = 2 THEN 'mixed' ELSE min(origin) END AS origin_label FROM ev GROUP BY session_id""",
}
