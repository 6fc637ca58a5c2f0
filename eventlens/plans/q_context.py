"""Registered queries: session context and features."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from eventlens.operators import context as C
from eventlens.operators import features as X
from eventlens.plans.canon import CANON, events
from eventlens.settings import SPARSE

ID = ["event_id"]


def _at(step, *cols):
    return lambda s, d: step(events(s, d)).selectExpr(*ID, *cols)


def features(s, d):
    """All features at every event; maturity and trajectory stand for what later layers add."""
    e = events(s, d).withColumn("trajectory", F.when(F.col("k") % 5 == 0, "Recovering ").when(F.col("k") % 5 == 1, "flat").when(F.col("k") % 5 == 2, "sideways"))
    return X.compute_features(e.withColumn("baseline_maturity", F.when(F.col("session_no") < 4, "cold_start").when(F.col("session_no") < 7, "early")), SPARSE)


def _feature(*names):
    return lambda s, d: features(s, d).select("event_id", *[F.round(n, 6).alias(n) if n not in X.CATEGORICAL else F.col(n) for n in names])


def f15(s, d):
    cols = [F.col(f) if f in X.CATEGORICAL else F.round(F.col(f).cast("double"), 6).alias(f) for f in X.FEATURES]
    return C.end_of_session(features(s, d)).select("session_id", *cols)


QUERIES = {
    "c1_session_progress": _at(lambda e: C.session_progress(e, SPARSE), "round(elapsed_seconds, 6) AS elapsed_seconds", "round(position, 6) AS position", "event_count", "start_inferred", "has_ended"),
    "c2_current_content": _at(C.current_content, "content_kind", "content_ref", "content_difficulty"),
    "c3_recent_performance": _at(lambda e: C.recent_performance(e, SPARSE), "answer_count", "round(recent_accuracy, 6) AS recent_accuracy", "round(recent_response, 6) AS recent_response"),
    "c3_at_end": lambda s, d: C.recent_performance_at_end(events(s, d), SPARSE).select("session_id", "answer_count", F.round("recent_accuracy", 6).alias("recent_accuracy"), F.round("recent_response", 6).alias("recent_response")),
    "c4_intervention_status": _at(lambda e: C.intervention_status(e, SPARSE), "interventions", "last_intervention_type", "last_outcome", "round(seconds_since_last, 6) AS seconds_since_last", "in_cooldown", "round(cooldown_remaining, 6) AS cooldown_remaining"),
    "c5_missing_keys": lambda s, d: C.missing_keys(C.session_context(events(s, d), SPARSE)).select("event_id", F.array_join("missing_keys", ",").alias("missing"), F.array_join("blocking_keys", ",").alias("blocking"), "interpretable"),
    "c6_origin_label": _at(C.origin_label, "origin_label", "synthetic_only"),
    "c7_seen_event_types": _at(C.seen_event_types, "array_join(seen_types, ',') AS seen"),
    "f1_session_elapsed_seconds": _feature("session_elapsed_seconds"),
    "f2_session_position": _feature("session_position"),
    "f3_session_event_count": _feature("session_event_count"),
    "f4_content_difficulty": _feature("content_difficulty"),
    "f5_content_type_encoded": _feature("content_type_encoded"),
    "f6_performance_recent_accuracy": _feature("performance_recent_accuracy"),
    "f7_performance_recent_response_seconds": _feature("performance_recent_response_seconds"),
    "f8_performance_accuracy_trend": _feature("performance_accuracy_trend"),
    "f9_performance_response_trend": _feature("performance_response_trend"),
    "f10_intervention_count": _feature("intervention_count"),
    "f11_intervention_cooldown_active": _feature("intervention_cooldown_active"),
    "f12_intervention_seconds_since_last": _feature("intervention_seconds_since_last"),
    "f13_trajectory_encoded": _feature("trajectory_encoded"),
    "f14_baseline_maturity_encoded": _feature("baseline_maturity_encoded"),
    "f15_compute_features": f15,
    "f16_features_long": lambda s, d: X.features_long(C.end_of_session(features(s, d)), ["session_id"]).select("session_id", "name", "computed_us", "feature_version", "feature_set", F.col("availability"), F.col("reason"), F.when(F.col("name").isin("session_event_count", "content_type_encoded", "intervention_cooldown_active"), F.col("value")).alias("value")),
    "f17_validate_feature_range": lambda s, d: X.validate_feature_range(C.end_of_session(features(s, d))).select("session_id", F.array_join("out_of_range", ",").alias("out_of_range"), F.round("session_elapsed_seconds", 6).alias("session_elapsed_seconds")),
    "f18_feature_coverage": lambda s, d: X.feature_coverage(X.features_long(C.end_of_session(features(s, d)), ["session_id"])),
    "f18_vector_coverage": lambda s, d: X.vector_coverage(C.end_of_session(features(s, d)), ["session_id"]),
}

_W = "WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

CTX = CANON + f""", c1 AS (
  SELECT *, (max(us) OVER w - first_value(us) OVER w) / 1e6 AS elapsed, count(*) OVER w AS event_count,
         last_value(CASE WHEN event_type IN ('question_started', 'content_opened') THEN event_id END IGNORE NULLS) OVER w AS content_event,
         last_value(CASE WHEN event_type = 'intervention_started' THEN event_id END IGNORE NULLS) OVER w AS start_event,
         count(*) FILTER (WHERE event_type = 'intervention_started') OVER w AS interventions,
         count(*) FILTER (WHERE event_type = 'question_answered') OVER w AS answered,
         bool_or(origin = 'real') OVER w AS has_real, bool_or(origin = 'synthetic') OVER w AS has_syn
  FROM ev {_W}),
ansr AS (SELECT session_id, us, event_id, correct, response_seconds, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS rn FROM ev WHERE event_type = 'question_answered'),
perf AS (
  SELECT session_id, rn, count(*) OVER w AS n, avg(CAST(correct AS INTEGER)) OVER w AS acc, avg(response_seconds) OVER w AS resp
  FROM ansr WINDOW w AS (PARTITION BY session_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
tr AS (
  SELECT event_id,
    avg(CAST(correct AS INTEGER)) OVER r AS ra, count(correct) OVER r AS trn, avg(CAST(correct AS INTEGER)) OVER b AS ba, count(correct) OVER b AS bn,
    avg(response_seconds) OVER r AS rr, avg(response_seconds) OVER b AS br
  FROM ev WINDOW r AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW),
                 b AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 432000000001 PRECEDING)),
done AS (SELECT session_id, intervention_id, us, event_id, outcome FROM ev WHERE event_type = 'intervention_completed' AND intervention_id IS NOT NULL),
out1 AS (
  SELECT c1.event_id, arg_min(d.outcome, (d.us, d.event_id)) AS last_outcome
  FROM c1 JOIN ev s ON s.event_id = c1.start_event JOIN done d ON d.session_id = c1.session_id AND d.intervention_id = s.intervention_id AND (d.us, d.event_id) <= (c1.us, c1.event_id)
  GROUP BY c1.event_id),
ctx AS (
  SELECT c1.*, least(1.0, elapsed / 86400.0) AS position,
         CASE WHEN c.event_type = 'question_started' THEN 'question' WHEN c.event_type IS NOT NULL THEN 'content' END AS content_kind,
         CASE WHEN c.event_type = 'question_started' THEN c.question_id ELSE c.content_id END AS content_ref, c.difficulty AS content_difficulty,
         coalesce(perf.n, 0) AS answer_count, perf.acc AS recent_accuracy, perf.resp AS recent_response,
         s.intervention_type AS last_intervention_type, (c1.us - s.us) / 1e6 AS since, o.last_outcome,
         CASE WHEN has_real AND has_syn THEN 'mixed' WHEN has_real THEN 'real' ELSE 'synthetic' END AS origin_label,
         CASE WHEN trn >= 2 AND bn >= 2 THEN ra - ba END AS acc_trend, CASE WHEN trn >= 2 AND bn >= 2 THEN rr - br END AS resp_trend,
         CASE WHEN c1.k % 5 = 0 THEN 'improving' WHEN c1.k % 5 = 1 THEN 'stable' WHEN c1.k % 5 = 2 THEN 'other' END AS trajectory,
         CASE WHEN c1.session_no < 4 THEN 'new' WHEN c1.session_no < 7 THEN 'early' END AS maturity
  FROM c1 LEFT JOIN ev c ON c.event_id = c1.content_event LEFT JOIN ev s ON s.event_id = c1.start_event
  LEFT JOIN perf ON perf.session_id = c1.session_id AND perf.rn = c1.answered LEFT JOIN out1 o ON o.event_id = c1.event_id JOIN tr ON tr.event_id = c1.event_id),
feat AS (
  SELECT *, CASE WHEN content_kind = 'question' THEN 'question' WHEN content_kind IS NOT NULL THEN 'other' END AS ct,
         CASE WHEN interventions > 0 THEN interventions END AS ic, CASE WHEN interventions > 0 THEN CAST(since < 43200 AS INTEGER) END AS cool
  FROM ctx),
fin AS (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) = 1)
"""

_CTX_NAMES = ("c1", "ansr", "perf", "tr", "done", "out1", "ctx", "feat", "fin")


def context_of(source: str, suffix: str) -> str:
    """The same over another log: CTEs to follow one that defines ``source``, each name with ``suffix``."""
    tail = CTX[len(CANON) :]
    for name in _CTX_NAMES:
        tail = re.sub(rf"\b{name}\b", name + suffix, tail)
    return re.sub(r"\bev\b", source, tail)


LONG = CTX + """, long AS (
  SELECT session_id, name, value, origin_label, has, reason FROM fin, LATERAL (VALUES
   ('session_elapsed_seconds', NULL, true, NULL), ('session_position', NULL, true, NULL), ('session_event_count', event_count || '.000000', true, NULL),
   ('content_difficulty', NULL, content_difficulty IS NOT NULL, 'missing_content_difficulty'), ('content_type_encoded', ct, ct IS NOT NULL, 'missing_content_kind'),
   ('performance_recent_accuracy', NULL, recent_accuracy IS NOT NULL, 'missing_recent_accuracy'), ('performance_recent_response_seconds', NULL, recent_response IS NOT NULL, 'missing_recent_response'),
   ('performance_accuracy_trend', NULL, acc_trend IS NOT NULL, CASE WHEN answer_count > 0 THEN 'too_few_answers' ELSE 'missing_answer_count' END),
   ('performance_response_trend', NULL, resp_trend IS NOT NULL, CASE WHEN answer_count > 0 THEN 'too_few_answers' ELSE 'missing_answer_count' END),
   ('intervention_count', NULL, ic IS NOT NULL, 'missing_interventions'), ('intervention_cooldown_active', cool || '.000000', cool IS NOT NULL, 'missing_seconds_since_last'),
   ('intervention_seconds_since_last', NULL, since IS NOT NULL, 'missing_seconds_since_last'), ('trajectory_encoded', NULL, trajectory IS NOT NULL, 'missing_trajectory'),
   ('baseline_maturity_encoded', NULL, maturity IS NOT NULL, 'missing_baseline_maturity')) v(name, value, has, reason)),
lg AS (SELECT session_id, name, CASE WHEN NOT has THEN 'insufficient_data' WHEN origin_label = 'synthetic' THEN 'synthetic_only' ELSE 'available' END AS availability, CASE WHEN NOT has THEN reason END AS reason, value FROM long)
"""


def _f(name, expr):
    return CTX + f"SELECT event_id, {expr} AS {name} FROM feat"


ORACLES = {
    "c1_session_progress": CTX + "SELECT event_id, round(elapsed, 6) AS elapsed_seconds, round(position, 6) AS position, event_count, true AS start_inferred, false AS has_ended FROM ctx",
    "c2_current_content": CTX + "SELECT event_id, content_kind, content_ref, content_difficulty FROM ctx",
    "c3_recent_performance": CTX + "SELECT event_id, CAST(answer_count AS INTEGER) AS answer_count, round(recent_accuracy, 6) AS recent_accuracy, round(recent_response, 6) AS recent_response FROM ctx",
    "c3_at_end": CTX + "SELECT session_id, CAST(answer_count AS INTEGER) AS answer_count, round(recent_accuracy, 6) AS recent_accuracy, round(recent_response, 6) AS recent_response FROM fin",
    "c4_intervention_status": CTX + "SELECT event_id, interventions, last_intervention_type, last_outcome, round(since, 6) AS seconds_since_last, coalesce(since < 43200, false) AS in_cooldown, CASE WHEN since < 43200 THEN round(43200 - since, 6) END AS cooldown_remaining FROM ctx",
    "c5_missing_keys": CTX + """, m AS (SELECT event_id, list_filter([CASE WHEN content_kind IS NULL THEN 'content_type' END, CASE WHEN content_difficulty IS NULL THEN 'content_difficulty' END,
   CASE WHEN recent_accuracy IS NULL THEN 'recent_accuracy' END, CASE WHEN recent_response IS NULL THEN 'recent_response' END, CASE WHEN answer_count = 0 THEN 'answer_count' END,
   CASE WHEN interventions = 0 THEN 'intervention_history' END, CASE WHEN since IS NULL THEN 'cooldown_status' END, 'trajectory', 'baseline_maturity'], lambda x: x IS NOT NULL) AS l FROM ctx)
SELECT event_id, array_to_string(l, ',') AS missing, array_to_string(list_filter(l, lambda x: x IN ('content_type', 'recent_accuracy', 'answer_count', 'baseline_maturity')), ',') AS blocking, false AS interpretable FROM m""",
    "c6_origin_label": CTX + "SELECT event_id, origin_label, origin_label = 'synthetic' AS synthetic_only FROM ctx",
    "c7_seen_event_types": CANON + "SELECT a.event_id, array_to_string(list_sort(list(DISTINCT b.event_type)), ',') AS seen FROM ev a JOIN ev b ON b.session_id = a.session_id AND (b.us, b.event_id) <= (a.us, a.event_id) GROUP BY a.event_id",
    "f1_session_elapsed_seconds": _f("session_elapsed_seconds", "round(elapsed, 6)"),
    "f2_session_position": _f("session_position", "round(position, 6)"),
    "f3_session_event_count": _f("session_event_count", "event_count"),
    "f4_content_difficulty": _f("content_difficulty", "round(content_difficulty, 6)"),
    "f5_content_type_encoded": _f("content_type_encoded", "ct"),
    "f6_performance_recent_accuracy": _f("performance_recent_accuracy", "round(recent_accuracy, 6)"),
    "f7_performance_recent_response_seconds": _f("performance_recent_response_seconds", "round(recent_response, 6)"),
    "f8_performance_accuracy_trend": _f("performance_accuracy_trend", "round(acc_trend, 6)"),
    "f9_performance_response_trend": _f("performance_response_trend", "round(resp_trend, 6)"),
    "f10_intervention_count": _f("intervention_count", "ic"),
    "f11_intervention_cooldown_active": _f("intervention_cooldown_active", "cool"),
    "f12_intervention_seconds_since_last": _f("intervention_seconds_since_last", "round(since, 6)"),
    "f13_trajectory_encoded": _f("trajectory_encoded", "trajectory"),
    "f14_baseline_maturity_encoded": _f("baseline_maturity_encoded", "maturity"),
    "f15_compute_features": CTX + """SELECT session_id, round(elapsed, 6) AS session_elapsed_seconds, round(position, 6) AS session_position, CAST(event_count AS DOUBLE) AS session_event_count, round(content_difficulty, 6) AS content_difficulty, ct AS content_type_encoded,
  round(recent_accuracy, 6) AS performance_recent_accuracy, round(recent_response, 6) AS performance_recent_response_seconds, round(acc_trend, 6) AS performance_accuracy_trend, round(resp_trend, 6) AS performance_response_trend,
  CAST(ic AS DOUBLE) AS intervention_count, CAST(cool AS DOUBLE) AS intervention_cooldown_active, round(since, 6) AS intervention_seconds_since_last, trajectory AS trajectory_encoded, maturity AS baseline_maturity_encoded FROM fin""",
    "f16_features_long": LONG + "SELECT lg.*, fin.us AS computed_us, '1' AS feature_version, '1' AS feature_set FROM lg JOIN fin USING (session_id)",
    "f17_validate_feature_range": CTX + "SELECT session_id, CASE WHEN elapsed > 86400 THEN 'session_elapsed_seconds' ELSE '' END AS out_of_range, CASE WHEN elapsed <= 86400 THEN round(elapsed, 6) END AS session_elapsed_seconds FROM fin",
    "f18_feature_coverage": LONG + "SELECT coalesce(name, 'all') AS name, coalesce(availability, 'all') AS availability, count(*) AS n FROM lg GROUP BY CUBE (name, availability)",
    "f18_vector_coverage": LONG + "SELECT session_id, CAST(count(*) FILTER (WHERE availability <> 'insufficient_data') AS INTEGER) AS available_count, CAST(count(*) FILTER (WHERE availability = 'insufficient_data') AS INTEGER) AS insufficient_count FROM lg GROUP BY 1",
}
