"""Registered queries: log queries and column helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.functions import columns as X
from eventlens.operators import log_queries as Q
from eventlens.plans.canon import CANON, events, table

_T0 = 1704844800000000  # 2024-01-10
_T1 = 1705708800000000  # 2024-01-20


def q1(s, d):
    return Q.filter_events(events(s, d), types=["question_answered", "question_started"], start_us=_T0, end_us=_T1, origin="real").select("event_id", "us", "event_type", "learner_id")


def q2(s, d):
    return Q.first_n(events(s, d), 50).select("event_id", "us", "event_type")


def q8(s, d):
    """The log against one with changed, lost and repeated rows."""
    cols = ["event_id", "us", "session_id", "event_type", "question_id", "intervention_id"]
    a, k = events(s, d).select(*cols, "k"), F.col("k")
    b = a.where(k % 10 != 0).withColumn("event_type", F.when(k % 10 == 1, "changed").otherwise(F.col("event_type"))).union(a.where(k % 10 == 2))
    return Q.frames_identical(a.select(*cols), b.select(*cols))


def x5(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("body"))
    return X.redact_columns(docs, ["body"]).select("doc_id", F.sha2("body", 256).alias("body_sha"), F.col("body").contains("[REDACTED]").alias("redacted"))


QUERIES = {
    "q1_filter_events": q1,
    "q2_first_n": q2,
    "q3_session_bounds": lambda s, d: Q.session_bounds(events(s, d)),
    "q4_sessions_in_order": lambda s, d: Q.sessions_in_order(events(s, d)).select("learner_id", "session_id", "session_rank"),
    "q5_as_of": lambda s, d: Q.as_of(events(s, d), Q.decision_cut(events(s, d), 2)).select("event_id", "learner_id", "us", "cut_us"),
    "q6_decision_cut": lambda s, d: Q.decision_cut(events(s, d), 2),
    "q7_nth_answer_instant": lambda s, d: Q.nth_answer_instant(events(s, d), 4),
    "q8_frames_identical": q8,
    "x1_content_digest": lambda s, d: table(s, d, "nation").select("n_nationkey", X.content_digest(name=F.col("n_name"), key=F.col("n_nationkey")).alias("digest")),
    "x2_ordered_digest": lambda s, d: X.ordered_digest(events(s, d), ["session_id"], F.col("event_type"), ["us", "event_id"]),
    "x3_stable_bucket": lambda s, d: events(s, d).select("event_id", X.stable_bucket(F.col("learner_id"), F.col("event_id").cast("string")).alias("bucket")),
    "x4_pseudonymous_ref": lambda s, d: table(s, d, "customer").select("c_custkey", X.pseudonymous_ref(F.col("c_name")).alias("ref")),
    "x5_redact": x5,
    "x6_valid_version": lambda s, d: table(s, d, "nation").select("n_nationkey", X.valid_version(F.concat("n_name", F.lit("_V"), F.col("n_regionkey").cast("string"))).alias("valid"), X.valid_version(F.lower("n_name")).alias("lower_valid")),
}

_CUT = """, lastses AS (SELECT * FROM (SELECT *, max(session_no) OVER (PARTITION BY learner_id) AS ms FROM ev) WHERE session_no = ms),
ans AS (SELECT learner_id, us, row_number() OVER (PARTITION BY learner_id ORDER BY us, event_id) - 1 AS i FROM lastses WHERE event_type = 'question_answered'),
cut AS (
  SELECT l.learner_id, l.session_id, l.n AS n_answers, CASE WHEN l.n >= 4 THEN a.us ELSE l.last_us END AS cut_us,
         CASE WHEN l.n >= 4 THEN 'middle_answer' ELSE 'last_event' END AS rule
  FROM (SELECT learner_id, session_id, CAST(count(*) FILTER (WHERE event_type = 'question_answered') AS INTEGER) AS n, max(us) AS last_us FROM lastses GROUP BY ALL) l
  LEFT JOIN ans a ON a.learner_id = l.learner_id AND a.i = l.n // 2)
"""

ORACLES = {
    "q1_filter_events": CANON + f"SELECT event_id, us, event_type, learner_id FROM ev WHERE event_type IN ('question_answered', 'question_started') AND us >= {_T0} AND us < {_T1} AND origin = 'real'",
    "q2_first_n": CANON + "SELECT event_id, us, event_type FROM ev ORDER BY us, event_id LIMIT 50",
    "q3_session_bounds": CANON + "SELECT learner_id, session_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events, arg_min(event_id, (us, event_id)) AS first_event, arg_max(event_id, (us, event_id)) AS last_event FROM ev GROUP BY learner_id, session_id",
    "q4_sessions_in_order": CANON + "SELECT learner_id, session_id, CAST(dense_rank() OVER (PARTITION BY learner_id ORDER BY f, session_id) AS INTEGER) AS session_rank FROM (SELECT learner_id, session_id, min(us) AS f FROM ev GROUP BY ALL)",
    "q5_as_of": CANON + _CUT + "SELECT event_id, learner_id, us, cut_us FROM ev JOIN cut USING (learner_id) WHERE us <= cut_us",
    "q6_decision_cut": CANON + _CUT + "SELECT * FROM cut",
    "q7_nth_answer_instant": CANON + "SELECT learner_id, us, event_id FROM ev WHERE event_type = 'question_answered' QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY us, event_id) = 5",
    "q8_frames_identical": CANON + "SELECT count(*) FILTER (WHERE k % 10 IN (0, 1)) AS only_a, count(*) FILTER (WHERE k % 10 IN (1, 2)) AS only_b, count(*) FILTER (WHERE k % 10 IN (0, 1, 2)) = 0 AS identical FROM ev",
    "x1_content_digest": """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS digest FROM nation""",
    "x2_ordered_digest": CANON + "SELECT session_id, sha256(string_agg(event_type, chr(30) ORDER BY us, event_id)) AS digest FROM ev GROUP BY session_id",
    "x3_stable_bucket": CANON + "SELECT event_id, CAST('0x' || substr(sha256(learner_id || chr(31) || event_id), 1, 15) AS BIGINT) AS bucket FROM ev",
    "x4_pseudonymous_ref": "SELECT c_custkey, substr(c_name, 1, 4) || '#' || substr(sha256(c_name), 1, 8) AS ref FROM customer",
    "x5_redact": r"""SELECT doc_id, sha256(t) AS body_sha, contains(t, '[REDACTED]') AS redacted FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g'),
      '(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}', '[REDACTED]', 'g'), '\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b', '[REDACTED]', 'g'),
    '(?i)(["'']?(?:password|passwd|secret|token|api[_-]?key|apikey|authorization|access[_-]?token)["'']?)(\s*[=:]\s*)("[^"]*"|''[^'']*''|[^\s,;&}\[\]]+)', '\1\2[REDACTED]', 'g') AS t FROM documents)""",
    "x6_valid_version": "SELECT n_nationkey, regexp_matches(n_name || '_V' || n_regionkey, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*_V[0-9]+$') AS valid, regexp_matches(lower(n_name), '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*_V[0-9]+$') AS lower_valid FROM nation",
}
