"""Registered queries: labels, models, metrics, status logs, uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import models as M
from eventlens.operators import registry as R
from eventlens.operators import uncertainty as U
from eventlens.operators.context import end_of_session
from eventlens.plans.canon import CANON, NUDGE, events, r6, steady, table
from eventlens.plans.q_context import CTX, features
from eventlens.settings import DEFAULT
from eventlens.sources.shared import saved, shared_path

#: Features that the log's sessions have often enough to fit on; those of the scored design, and of answers for training.
FIT = ("session_elapsed_seconds", "session_event_count", "content_type_encoded", "trajectory_encoded")
ANSWER_FIT = ("session_elapsed_seconds", "session_event_count", "session_position", "performance_recent_accuracy", "performance_recent_response_seconds", "content_type_encoded")

#: A model by its numbers, and the reference values of its columns.
MODEL = M.Logistic(
    {"session_elapsed_seconds": 0.00001, "session_event_count": -0.05, "content_type_encoded=question": 0.4, "content_type_encoded=video": 0.0, "content_type_encoded=reading": 0.0, "content_type_encoded=other": -0.3,
     "trajectory_encoded=improving": -0.8, "trajectory_encoded=stable": 0.1, "trajectory_encoded=declining": 0.9, "trajectory_encoded=other": 0.2},
    -0.25,
)
REFERENCE = {c: 20000.0 if c == "session_elapsed_seconds" else 4.0 if c == "session_event_count" else float(c.endswith("question") or c.endswith("stable")) for c in MODEL.weights}


def scored(s, d):
    """Labels with a fixed score from the length of the document."""
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 2).alias("p"), F.col("quality").alias("y"))


def design(s, d):
    """Sessions at their end."""
    x = end_of_session(features(s, d)).withColumn("label", (F.col("session_no") % 3 == 0).cast("int")).select("learner_id", "session_id", "us", "label", *FIT)
    return M.encode_design(x, FIT)


def answers(s, d):
    """Answers with their features and the label of M1, over two answers (learners have few): whether the next are worse."""
    label = M.next_k_drop_label(events(s, d).withColumn("session_id", F.col("learner_id")), back=2, ahead=2, skip=2).select("event_id", "label")
    return M.encode_design(features(s, d).join(label, "event_id").select("learner_id", "event_id", "us", "label", *ANSWER_FIT), ANSWER_FIT)


def fitted(s, d):
    """Trained on the learners that aren't held out."""
    return M.train(saved(held_out(s, d)[0]), M.design_columns(ANSWER_FIT))


def fixed(s, d):
    return MODEL.fitted(REFERENCE)


#: Versions of one model: what their weights, feature set and threshold are.
VERSIONS = {
    "V1": MODEL.fitted(REFERENCE, "1", 0.5),
    "V2": M.Logistic({c: w * 1.5 for c, w in MODEL.weights.items()}, 0.1).fitted(REFERENCE, "2", 0.6),
    "V3": M.Logistic({c: MODEL.weights[c] - 0.02 for c in ("session_event_count", "trajectory_encoded=improving", "trajectory_encoded=declining")}, 0.3).fitted(REFERENCE, "2", 0.45),
}

#: (version, day of January 2024, status): the model's log.  V2 is withdrawn before V3 comes; V1 returns at the end.
STATUSES = (
    ("V1", 2, "candidate"), ("V1", 3, "production"), ("V2", 8, "validated"), ("V2", 10, "production"), ("V2", 15, "retired"), ("V3", 16, "validated"), ("V3", 18, "production"), ("V1", 26, "production"),
)
_DAY0 = 1704067200000000


def registered(s, d):
    path = shared_path(s, "registry")
    for version, fitted_ in VERSIONS.items():
        R.register(fitted_, s, path, "risk", version)
    return path


def status_log(s):
    rows = [("risk", v, _DAY0 + (day - 1) * 86_400_000_000, i, status) for i, (v, day, status) in enumerate(STATUSES)]
    return s.createDataFrame(rows, "model_id string, version string, us long, seq int, status string")


def versioned(s, d):
    """The design of each session with its model and its feature set: by its instant, but every eleventh has the other one."""
    early = F.col("us") < _DAY0 + 9 * 86_400_000_000
    odd = F.substring("session_id", -1, 1) == "1"
    gap = F.when(F.substring("session_id", -1, 1) != "5", F.col("session_event_count"))
    return design(s, d)[0].withColumns({"model_id": F.lit("risk"), "feature_set": F.when(early != odd, "1").otherwise("2"), "session_event_count": gap})


def m6_production(s, d):
    x = R.score_in_production(versioned(s, d), registered(s, d), status_log(s), M.design_columns(FIT))
    return x.select("session_id", "version", *r6("probability"), "predicted", "refusal")


def m9(s, d):
    """A version that was saved, read again by another name of the folder's rows, and scores every session."""
    again = R.load(s, registered(s, d), "risk", "V2", M.design_columns(FIT), "2")
    return M.score(design(s, d)[0], again).select("session_id", *r6("probability"), "predicted")


def held_out(s, d):
    """(answers of learners to train on, answers of those held out): every fourth learner in order of appearance."""
    x = M.group_holdout(answers(s, d)[0], "learner_id", "us")
    return x.where("NOT holdout").drop("holdout"), x.where("holdout").drop("holdout")


def m5(s, d):
    """What training found, as what must hold of it: at the optimum the mean of (probability - label) * column is 0 for each column."""
    rows = saved(held_out(s, d)[0])
    model = M.train(rows, M.design_columns(ANSWER_FIT))
    off = F.col("probability") - F.col("label")
    scaled = [(c, F.avg(off * F.col(f"`{c}`")) / F.greatest(F.stddev_pop(f"`{c}`"), F.lit(1.0))) for c in [*model.columns]]
    got = M.score(rows, model).agg(*[F.round(v, 3).alias(c) for c, v in scaled], F.count("*").alias("_n"), F.sum("label").alias("_pos"), F.round(F.avg(off), 3).alias("_off")).first()
    out = [(c, float(model.reference[c]), abs(got[c]), got["_n"], int(got["_pos"]), abs(got["_off"])) for c in model.columns]
    return s.createDataFrame(out, "column string, median double, gradient double, n long, positives long, bias double")


def m6(s, d):
    """The design with a gap: every fifth session's count is absent, so it gets a refusal."""
    x = design(s, d)[0].withColumn("session_event_count", F.when(F.substring("session_id", -1, 1) != "5", F.col("session_event_count")))
    return M.score(x, fixed(s, d)).select("session_id", *r6("probability"), "predicted", "refusal")


def statuses(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 10 != 0, "someone").alias("author"),
                    F.concat(F.lit("MODEL_V"), (F.col("o_orderkey") % 7).cast("string")).alias("version"), F.when(F.col("o_orderpriority") == "1-URGENT", "synthetic").otherwise("real").alias("origin"))


def beliefs(s, d):
    k = F.col("k")
    return events(s, d).where("event_type = 'content_closed'").select(
        "event_id", (k / 100.0).alias("probability"), F.lit(0.5).alias("threshold"), F.when(k % 8 != 0, (k % 7) / 20.0).alias("ece"), (k * k % 600).alias("evidence"),
        F.when(k % 4 == 0, "new").when(k % 4 == 1, "early").when(k % 4 == 2, "developing").otherwise("established").alias("maturity"), F.when(k % 9 == 0, "absent:x").alias("refusal"), (k % 6 != 0).alias("explained"),
    )


def explained(s, d):
    return U.occlusion_contributions(design(s, d)[0], ["session_id"], fixed(s, d))


def u8(s, d):
    return explained(s, d).select("session_id", *r6("base"), F.size("contributions").alias("n"), F.array_join(F.transform("contributions", lambda c: c["feature"]), ",").alias("features"), F.array_join("omitted", ",").alias("omitted"))


def u9(s, d):
    return U.top_contributions(explained(s, d), 2).select("session_id", F.array_join(F.transform("contributions", lambda c: c["feature"]), ",").alias("top"))


_MET = ("precision", "recall", "f1", "accuracy", "brier", "ece", "roc_auc", "pr_auc")

QUERIES = {
    "m1_next_k_drop_label": lambda s, d: M.next_k_drop_label(events(s, d).withColumn("session_id", F.col("learner_id"))).select("event_id", "i", "label"),
    "m2_group_holdout": lambda s, d: M.group_holdout(events(s, d), "learner_id", "event_id").select("event_id", "holdout"),
    "m3_encode_design": lambda s, d: design(s, d)[0].select("session_id", F.col("`content_type_encoded=question`").alias("is_question"), F.col("`trajectory_encoded=stable`").alias("is_stable"), F.col("session_event_count").alias("n_events")),
    "m3_rejected": lambda s, d: design(s, d)[1].select("session_id", F.array_join("lacks", ",").alias("lacks")),
    "m4_column_reference": lambda s, d: M.column_reference(design(s, d)[0], ["session_elapsed_seconds", "session_event_count"]).select(*r6("session_elapsed_seconds", "session_event_count")),
    "m5_train": m5,
    "m6_score": m6,
    "m6_score_trained": lambda s, d: M.score(held_out(s, d)[1], fitted(s, d)).select("event_id", "probability", "predicted", "refusal"),
    "m6_score_in_production": m6_production,
    "m6_in_production": lambda s, d: R.model_at(events(s, d).withColumn("model_id", F.lit("risk")), status_log(s)).select("event_id", "version"),
    "m7_binary_metrics": lambda s, d: M.binary_metrics(scored(s, d), "p", "y").select("n", "positives", *r6(*_MET)),
    "m8_expected_calibration_error": lambda s, d: M.expected_calibration_error(scored(s, d), "p", "y").select(*r6("ece")),
    "m9_save_load_model": m9,
    "m10_latest_status": lambda s, d: M.latest_status(statuses(s, d), ["key"], "seq", "status").where("status = 'P'"),
    "m11_audit_transitions": lambda s, d: M.audit_transitions(statuses(s, d), ["key"], "seq", "status", [("O", "P"), ("P", "F")], "O", ["author"]),
    "m12_monotonic_versions": lambda s, d: M.monotonic_versions(statuses(s, d), "key", "seq", "version"),
    "m13_promotion_guard": lambda s, d: M.promotion_guard(statuses(s, d), "status", "origin", ("P", "F")).select("key", "seq"),
    "u1_reliability_table": lambda s, d: U.reliability_table(scored(s, d), "p", "y").select("bin", "n", *r6("lower", "upper", "mean_predicted", "observed", "gap")),
    "u2_calibration_report": lambda s, d: U.calibration_report(scored(s, d), "p", "y").select("n", "reason", "believable", *r6("brier", "ece")),
    "u3_evidence_ceiling": lambda s, d: beliefs(s, d).select("event_id", F.round(U.evidence_ceiling(F.col("evidence")) + NUDGE, 6).alias("ceiling")),
    "u4_maturity_ceiling": lambda s, d: beliefs(s, d).select("event_id", U.maturity_ceiling(F.col("maturity")).alias("ceiling")),
    "u5_assess_confidence": lambda s, d: U.assess_confidence(beliefs(s, d).na.fill(0.1, ["ece"])).select("event_id", "binding", *r6("confidence_value")),
    "u6_band": lambda s, d: U.assess_confidence(beliefs(s, d).na.fill(0.1, ["ece"])).select("event_id", U.band(F.col("confidence_value") + NUDGE, F.col("explained")).alias("band")),
    "u7_verdict": lambda s, d: U.verdict(beliefs(s, d), DEFAULT).select("event_id", "verdict", "remedy", "probability"),
    "u8_occlusion_contributions": u8,
    "u9_top_contributions": u9,
}

_SC = "WITH sc AS (SELECT doc_id, round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 2) AS p, quality AS y FROM labels JOIN documents USING (doc_id)),\nbn AS (SELECT *, (SELECT max(i) FROM range(10) r(i) WHERE i * CAST(0.1 AS DOUBLE) <= p) AS bin FROM sc),\ncal AS (SELECT sum(abs(sy - sp)) / sum(n) AS ece FROM (SELECT bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM bn GROUP BY 1))\n"
_ST = "WITH st AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderstatus AS status, CASE WHEN o_orderkey % 10 <> 0 THEN 'someone' END AS author, 'MODEL_V' || (o_orderkey % 7) AS version, o_orderkey % 7 AS number, o_orderpriority = '1-URGENT' AS syn FROM orders)\n"
_BE = CANON + """, be AS (SELECT event_id, k / 100.0 AS p, CASE WHEN k % 8 <> 0 THEN (k % 7) / 20.0 END AS ece, k * k % 600 AS n, ['new', 'early', 'developing', 'established'][k % 4 + 1] AS m, [0.30, 0.50, 0.75, 1.0][k % 4 + 1] AS mc, k FROM ev WHERE event_type = 'content_closed'),
ce AS (SELECT *, CASE WHEN n < 10 THEN 0 WHEN n >= 500 THEN 1 ELSE 0.5 + 0.5 * ln(n / 10.0) / ln(50.0) END AS ec FROM be),
co AS (SELECT *, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS a, 1 - coalesce(ece, 0.1) AS c FROM ce),
cv AS (SELECT *, least(a, c, ec, mc) AS v FROM co)
"""
_DES = CTX + ", de AS (SELECT *, content_kind IS NOT NULL AND trajectory IS NOT NULL AS ok FROM feat QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) = 1)\n"

_WEIGHTS = ", ".join(f"('{c}', {w!r}, {REFERENCE[c]!r})" for c, w in MODEL.weights.items())
_OCC = _DES + f""", wt AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_WEIGHTS}) v(col, w, ref)),
dx AS (
  SELECT session_id, col, w, ref, i, split_part(col, '=', 1) AS feature, CASE col WHEN 'session_elapsed_seconds' THEN elapsed WHEN 'session_event_count' THEN CAST(event_count AS DOUBLE) ELSE CAST(split_part(col, '=', 2) = CASE split_part(col, '=', 1) WHEN 'content_type_encoded' THEN ct ELSE trajectory END AS DOUBLE) END AS x
  FROM de, wt WHERE ok),
zs AS (SELECT session_id, {MODEL.intercept} + sum(w * x) AS z FROM dx GROUP BY 1),
ps AS (SELECT session_id, z, 1 / (1 + exp(-z)) AS base FROM zs),
dl AS (SELECT session_id, feature, base, i, 1 / (1 + exp(-(z + w * (ref - x)))) - base AS delta FROM dx JOIN ps USING (session_id)),
bs AS (SELECT session_id, base, feature, arg_max(delta, (round(abs(delta), 12), -i)) AS delta FROM dl GROUP BY 1, 2, 3),
oc AS (
  SELECT session_id, base, count(*) FILTER (WHERE abs(delta) >= 0.001) AS n, coalesce(list(feature ORDER BY round(-abs(delta), 12), feature) FILTER (WHERE abs(delta) >= 0.001), []) AS fs,
    coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE abs(delta) < 0.001), '') AS omitted FROM bs GROUP BY 1, 2)
"""

def _version_sql() -> str:
    """Each session's score by every version, and which one was in production then."""
    rows = ", ".join(f"('{v}', '{c}', {w!r}, {f.model.intercept!r}, '{f.feature_set}', {f.threshold!r})" for v, f in VERSIONS.items() for c, w in f.model.weights.items())
    log = ", ".join(f"('{v}', {_DAY0 + (day - 1) * 86_400_000_000}, {i}, '{status}')" for i, (v, day, status) in enumerate(STATUSES))
    return _OCC + f""", vw AS (SELECT * FROM (VALUES {rows}) v(version, col, w, b, fs, th)),
sl AS (SELECT *, lead(us) OVER (PARTITION BY version ORDER BY us, seq) AS own FROM (VALUES {log}) v(version, us, seq, status)),
ip AS (SELECT version, us AS f, coalesce(least(own, lead(us) OVER (ORDER BY us, seq)), 9e18) AS t FROM sl WHERE status = 'production'),
vs AS (SELECT x.session_id, v.version, any_value(th) AS th, any_value(fs) AS fs, 1 / (1 + exp(-(any_value(b) + sum(v.w * x.x)))) AS p, bool_or(v.col = 'session_event_count') AS counts FROM dx x JOIN vw v USING (col) GROUP BY 1, 2),
se AS (SELECT d.session_id, d.us, ip.version, CASE WHEN (d.us < {_DAY0 + 9 * 86_400_000_000}) <> (d.session_id[-1:] = '1') THEN '1' ELSE '2' END AS has FROM de d LEFT JOIN ip ON d.us >= ip.f AND d.us < ip.t WHERE ok)
"""


def _answer_sql() -> str:
    """Answers of the learners that aren't held out, with label and design columns."""
    return CTX + """, lab AS (
  SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY learner_id) AS n, avg(correct::INT) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, avg(correct::INT) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS f
  FROM ev WHERE event_type = 'question_answered' WINDOW w AS (PARTITION BY learner_id ORDER BY us, event_id)),
tr_in AS (
  SELECT ft.learner_id, ft.us, CAST(f < b - 0.10 AS INTEGER) AS label, elapsed, CAST(event_count AS DOUBLE) AS event_count, position, recent_accuracy, recent_response, ct
  FROM lab JOIN feat ft USING (event_id) WHERE lab.i >= 2 AND lab.i + 2 < lab.n AND ct IS NOT NULL AND recent_accuracy IS NOT NULL AND recent_response IS NOT NULL),
fold_in AS (SELECT learner_id, row_number() OVER (ORDER BY min(us), learner_id) % 4 = 0 AS held FROM tr_in GROUP BY 1),
rows_in AS (SELECT t.* FROM tr_in t JOIN fold_in USING (learner_id) WHERE NOT held)
"""


_ANSWER_COLUMNS = {
    "session_elapsed_seconds": "elapsed", "session_event_count": "event_count", "session_position": "position", "performance_recent_accuracy": "recent_accuracy", "performance_recent_response_seconds": "recent_response",
    **{f"content_type_encoded={v}": f"CAST(ct = '{v}' AS DOUBLE)" for v in M.VOCABULARY["content_type_encoded"]},
}

ORACLES = {
    "m5_train": _answer_sql() + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(median({x}) AS DOUBLE) AS median, CAST(0 AS DOUBLE) AS gradient, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(0 AS DOUBLE) AS bias FROM rows_in" for c, x in _ANSWER_COLUMNS.items()),
    "m6_in_production": _version_sql() + "SELECT event_id, version FROM ev LEFT JOIN ip ON us >= f AND us < t",
    "m6_score_in_production": _version_sql() + """, r AS (
  SELECT se.*, vs.p, vs.th, CASE WHEN se.version IS NULL THEN 'not_in_production' WHEN has <> fs THEN 'feature_set:' || has WHEN counts AND session_id[-1:] = '5' THEN 'absent:session_event_count' END AS refusal
  FROM se LEFT JOIN vs USING (session_id, version))
SELECT session_id, version, CASE WHEN refusal IS NULL THEN round(p, 6) END AS probability, CASE WHEN refusal IS NULL THEN CAST(p >= th AS INTEGER) END AS predicted, refusal FROM r""",
    "m9_save_load_model": _version_sql() + "SELECT session_id, round(p, 6) AS probability, CAST(p >= th AS INTEGER) AS predicted FROM vs WHERE version = 'V2'",
    "m6_score": _OCC + ", r AS (SELECT session_id, CASE WHEN session_id[-1:] <> '5' THEN base END AS p FROM ps) SELECT session_id, round(p, 6) AS probability, CAST(p >= 0.5 AS INTEGER) AS predicted, CASE WHEN p IS NULL THEN 'absent:session_event_count' END AS refusal FROM r",
    "u8_occlusion_contributions": _OCC + "SELECT session_id, round(base, 6) AS base, CAST(n AS INTEGER) AS n, array_to_string(fs, ',') AS features, omitted FROM oc",
    "u9_top_contributions": _OCC + "SELECT session_id, array_to_string(fs[:2], ',') AS top FROM oc",
    "m1_next_k_drop_label": CANON + ", a AS (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY learner_id) AS n, avg(correct::INT) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, avg(correct::INT) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS f FROM ev WHERE event_type = 'question_answered' WINDOW w AS (PARTITION BY learner_id ORDER BY us, event_id)) SELECT event_id, CAST(i AS INTEGER) AS i, CAST(f < b - 0.10 AS INTEGER) AS label FROM a WHERE i >= 10 AND i + 3 < n",
    "m2_group_holdout": CANON + ", f AS (SELECT learner_id, row_number() OVER (ORDER BY min(event_id)) AS r FROM ev GROUP BY 1) SELECT event_id, r % 4 = 0 AS holdout FROM ev JOIN f USING (learner_id)",
    "m3_encode_design": _DES + "SELECT session_id, CAST(ct = 'question' AS DOUBLE) AS is_question, CAST(trajectory = 'stable' AS DOUBLE) AS is_stable, CAST(event_count AS DOUBLE) AS n_events FROM de WHERE ok",
    "m3_rejected": _DES + "SELECT session_id, array_to_string(list_filter([CASE WHEN content_kind IS NULL THEN 'content_type_encoded' END, CASE WHEN trajectory IS NULL THEN 'trajectory_encoded' END], lambda x: x IS NOT NULL), ',') AS lacks FROM de WHERE NOT ok",
    "m4_column_reference": _DES + "SELECT round(median(elapsed), 6) AS session_elapsed_seconds, round(median(CAST(event_count AS DOUBLE)), 6) AS session_event_count FROM de WHERE ok",
    "m7_binary_metrics": _SC + """, g AS (SELECT p, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1), t AS (SELECT count(*) AS n, sum(y) AS pos FROM sc),
r AS (SELECT g.*, sum(n - pos) OVER (ORDER BY p) - (n - pos) AS nb, sum(pos) OVER (ORDER BY p DESC) AS pa, sum(n) OVER (ORDER BY p DESC) AS na FROM g),
k AS (SELECT sum(pos * (nb + (n - pos) / 2.0)) AS u, sum(pos * pa / na) AS ap FROM r),
c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, avg(CAST((p >= 0.5) = (y = 1) AS INT)) AS acc, avg((p - y) * (p - y)) AS brier FROM sc)
SELECT t.n AS n, CAST(t.pos AS BIGINT) AS positives, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(acc, 6) AS accuracy, round(brier, 6) AS brier, round(ece, 6) AS ece, round(u / (t.pos * (t.n - t.pos)), 6) AS roc_auc, round(ap / t.pos, 6) AS pr_auc FROM t, k, c, cal""",
    "m8_expected_calibration_error": _SC + "SELECT round(ece, 6) AS ece FROM cal",
    "m10_latest_status": _ST + "SELECT key, arg_max(status, seq) AS status, max(seq) AS seq FROM st GROUP BY 1 HAVING arg_max(status, seq) = 'P'",
    "m11_audit_transitions": _ST + """, l AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY seq) AS f FROM st)
SELECT key, seq, 'wrong_start' AS violation FROM l WHERE f IS NULL AND status <> 'O' UNION ALL SELECT key, seq, 'no_change' FROM l WHERE f = status
UNION ALL SELECT key, seq, 'forbidden_move' FROM l WHERE f IS NOT NULL AND f <> status AND f || status NOT IN ('OP', 'PF') UNION ALL SELECT key, seq, 'missing_author' FROM l WHERE author IS NULL""",
    "m12_monotonic_versions": _ST + "SELECT key, seq, version, b AS before FROM (SELECT *, lag(number) OVER (PARTITION BY key ORDER BY seq) AS b FROM st) WHERE number <= b",
    "m13_promotion_guard": _ST + "SELECT key, seq FROM st WHERE syn AND status IN ('P', 'F')",
    "u1_reliability_table": _SC + "SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(i * CAST(0.1 AS DOUBLE), 6) AS lower, round((i + 1) * CAST(0.1 AS DOUBLE), 6) AS upper, round(coalesce(mp, 0), 6) AS mean_predicted, round(coalesce(o, 0), 6) AS observed, round(coalesce(o - mp, 0), 6) AS gap FROM range(10) r(i) LEFT JOIN (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS o FROM bn GROUP BY 1) b ON b.bin = i",
    "u2_calibration_report": _SC + "SELECT (SELECT count(*) FROM sc) AS n, NULL AS reason, ece <= 0.25 AS believable, round((SELECT avg((p - y) * (p - y)) FROM sc), 6) AS brier, round(ece, 6) AS ece FROM cal",
    "u3_evidence_ceiling": _BE + "SELECT event_id, round(CAST(ec AS DOUBLE), 6) AS ceiling FROM ce",
    "u4_maturity_ceiling": _BE + "SELECT event_id, CAST(mc AS DOUBLE) AS ceiling FROM be",
    "u5_assess_confidence": _BE + "SELECT event_id, CASE WHEN round(a, 9) = round(v, 9) THEN 'assertion' WHEN round(c, 9) = round(v, 9) THEN 'calibration' WHEN round(ec, 9) = round(v, 9) THEN 'evidence' ELSE 'maturity' END AS binding, round(CAST(v AS DOUBLE), 6) AS confidence_value FROM cv",
    "u6_band": _BE + "SELECT event_id, CASE WHEN k % 6 = 0 THEN 'low' WHEN v + 1.3e-9 >= 0.8 THEN 'high' WHEN v + 1.3e-9 >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM cv",
    "u7_verdict": _BE + ", w AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'refused' WHEN ece IS NULL OR ece > 0.25 THEN 'unknown' WHEN n < 10 THEN 'insufficient_data' ELSE 'resolved' END AS verdict FROM be) SELECT event_id, verdict, CASE verdict WHEN 'refused' THEN 'supply_features' WHEN 'unknown' THEN 'recalibrate' WHEN 'insufficient_data' THEN 'collect_evidence' ELSE 'none' END AS remedy, CASE WHEN verdict = 'resolved' THEN CAST(p AS DOUBLE) END AS probability FROM w",
}
ORACLES = {k: steady(v) for k, v in ORACLES.items()}
