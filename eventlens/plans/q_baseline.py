"""Registered queries: baselines and temporal state."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from eventlens.operators import baseline as B
from eventlens.operators import temporal as T
from eventlens.operators.context import end_of_session
from eventlens.plans.canon import NUDGE, events, r6, shared, steady, table
from eventlens.plans.q_context import CTX, features
from eventlens.settings import SPARSE
from eventlens.sources.shared import saved

KEY = ["learner_id"]


@shared
def ends(s, d):
    """The features at the end of each session."""
    return end_of_session(features(s, d))


def observations(s, d):
    return B.baseline_observations(ends(s, d))


def accepted(s, d):
    return observations(s, d).where("NOT rejected")


def folded(s, d):
    return B.winsorised_ewma(accepted(s, d), ["learner_id", "dimension"], ["us"], "value", SPARSE)


def deviations(s, d):
    """Deviations of every session, with gaps: a z is dropped where the value's session ends on an odd microsecond."""
    dev = B.deviations(folded(s, d), ["learner_id", "dimension"])
    return dev.withColumn("z", F.when(F.col("us") % 7 != 0, F.col("z")))


@shared
def history(s, d):
    return T.state_history(saved(deviations(s, d), "deviations"), SPARSE)  # its tracks read them twice


def b5(s, d):
    a = accepted(s, d).groupBy("learner_id", "dimension").agg(F.collect_list("value").alias("xs"), F.avg("value").alias("c"))
    return a.select("learner_id", "dimension", F.round(B.mad_about(F.col("xs"), F.col("c")) + NUDGE, 6).alias("mad"))


def b6(s, d):
    a = accepted(s, d).groupBy("learner_id", "dimension").agg(F.collect_list("value").alias("xs"), F.median("value").alias("c"))
    return a.select("learner_id", "dimension", F.round(B.rms_about(F.col("xs"), F.col("c")) + NUDGE, 6).alias("rms"))


def b4(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("xs"))
    return o.select("o_custkey", F.array_join(B.decimate(F.col("xs"), 4), ",").alias("kept"))


def orders_fold(s, d, robust=True):
    o = table(s, d, "orders").select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), "o_orderkey", "o_totalprice")
    return B.winsorised_ewma(o, ["o_custkey"], ["us", "o_orderkey"], "o_totalprice", SPARSE, robust)


QUERIES = {
    "b1_baseline_observations": lambda s, d: B.rejections(observations(s, d), KEY),
    "b2_ewma": lambda s, d: B.ewma(accepted(s, d), ["learner_id", "dimension"], ["us"], "value", SPARSE.alpha).select("learner_id", "dimension", "n", *r6("centre")),
    "b3_winsorised_ewma": lambda s, d: folded(s, d).select("learner_id", "dimension", "us", "n", *r6("centre", "spread"), "retained"),
    "b3_orders_fold": lambda s, d: orders_fold(s, d).select("o_orderkey", "n", F.round(F.col("centre") + 1.37e-5, 4).alias("centre"), F.round(F.col("spread") + 1.37e-5, 4).alias("spread")),
    "b4_decimate": b4,
    "b5_mad_about": b5,
    "b6_rms_about": b6,
    "b7_maturity": lambda s, d: accepted(s, d).groupBy("learner_id", "dimension").agg(F.count("*").alias("n")).select("learner_id", "dimension", B.maturity(F.col("n"), SPARSE).alias("maturity"), B.maturity_rank(F.col("n"), SPARSE).alias("rank"), B.basis(F.col("n"), SPARSE).alias("basis")),
    "b8_baseline_reference": lambda s, d: B.baseline_reference(folded(s, d), B.build_priors(accepted(s, d)).where("dimension <> 'content_difficulty'"), SPARSE).select("learner_id", "dimension", "us", *r6("ref_centre", "ref_spread"), "ref_source"),
    "b9_deviation": lambda s, d: B.deviations(folded(s, d), ["learner_id", "dimension"]).select("learner_id", "dimension", "us", *r6("absolute", "z"), "reason"),
    "b9_deviation_before": lambda s, d: B.deviations(folded(s, d), ["learner_id", "dimension"], exclude_current=True).select("learner_id", "dimension", "us", *r6("absolute", "z"), "reason"),
    "b10_refuse_late": lambda s, d: B.refuse_late(events(s, d), "learner_id", ["k", "event_id"]).select("event_id", "refused"),
    "b11_build_priors": lambda s, d: B.build_priors(accepted(s, d)).select("dimension", "n_reference", *r6("prior_centre", "prior_spread")),
    "b12_centre_drift": lambda s, d: B.centre_drift(folded(s, d), KEY).select("learner_id", "dimension", *r6("first_centre", "last_centre", "drift", "relative_drift")),
    "b12_largest_mover": lambda s, d: B.largest_mover(B.centre_drift(folded(s, d), KEY), KEY),
    "b13_baseline_profile": lambda s, d: B.baseline_profile(folded(s, d), B.rejections(observations(s, d), KEY), KEY, SPARSE, end_of_session(features(s, d))).select(
        "learner_id", "dimension", *r6("centre", "spread"), "n", "retained", "updated_us", "rejected", "maturity", "basis", F.array_join("origins", ",").alias("origins"),
    ),
    "t1_recent_points": lambda s, d: T.recent_points(deviations(s, d), SPARSE).select("learner_id", "dimension", "us", F.size("points").alias("held"), F.size(T.measured(F.col("points"))).alias("measured")),
    "t2_sign_run": lambda s, d: T.tracks(deviations(s, d), SPARSE).select("learner_id", "us", "dimension", "run", *r6("run_mean")),
    "t3_change_per_observation": lambda s, d: T.tracks(deviations(s, d), SPARSE).select("learner_id", "us", "dimension", F.round(T.change_per_observation(F.col("zs")) + NUDGE, 6).alias("change")),
    "t4_direction": lambda s, d: T.tracks(deviations(s, d), SPARSE).select("learner_id", "us", "dimension", "direction"),
    "t5_dispersion": lambda s, d: T.tracks(deviations(s, d), SPARSE).select("learner_id", "us", "dimension", *r6("dispersion")),
    "t6_dominant_dimension": lambda s, d: T.dominant_dimension(T.tracks(deviations(s, d), SPARSE)).select("learner_id", "us", F.col("dominant.dimension").alias("dimension"), F.col("dominant.run").alias("run")),
    "t7_classify_state": lambda s, d: history(s, d).select("learner_id", "us", "state", "character", "change_kind"),
    "t8_state_evidence": lambda s, d: history(s, d).select("learner_id", "us", "weakest_maturity", "observations", "evidence_run", *r6("evidence_seconds", "mean_z", "evidence_dispersion")),
    "t9_trajectories": lambda s, d: T.trajectories(T.tracks(deviations(s, d), SPARSE), SPARSE).select("learner_id", "dimension", "start_us", "end_us", "direction", *r6("first_z", "last_z", "mean_z", "peak_z", "rate", "duration_seconds")),
    "t10_state_transitions": lambda s, d: T.state_transitions(history(s, d)),
    "t11_latest_trajectory": lambda s, d: T.latest_trajectory(T.trajectories(T.tracks(deviations(s, d), SPARSE), SPARSE)).select("learner_id", "dimension", "end_us", "direction"),
    "t12_run_span": lambda s, d: T.tracks(deviations(s, d), SPARSE).select("learner_id", "us", "dimension", "run_start", *r6("run_seconds")),
    "t13_refuse_late_observations": lambda s, d: B.refuse_late(deviations(s, d).withColumn("arrival", F.col("n") % 3), "learner_id", ["arrival", "us", "dimension"]).select("learner_id", "dimension", "us", "refused"),
    "t14_temporal_state": lambda s, d: T.temporal_state(history(s, d)).select("learner_id", "us", "state", "direction", "dimension", "observations"),
    "t15_track_coverage": lambda s, d: T.track_coverage(deviations(s, d), SPARSE),
}

#: Observations of each session's end: ob accepted and numbered, and the fold as a recursion.
FOLD = CTX.replace("WITH ev0", "WITH RECURSIVE ev0", 1) + """, obs AS (
  SELECT learner_id, us, dimension, value, NOT (value BETWEEN 0 AND hi) AS rejected
  FROM fin, LATERAL (VALUES ('accuracy', recent_accuracy, 1.0), ('response_seconds', recent_response, 86400.0), ('session_seconds', elapsed, 86400.0), ('content_difficulty', CAST(content_difficulty AS DOUBLE), 1.0)) v(dimension, value, hi)
  WHERE value IS NOT NULL),
ob AS (SELECT learner_id, dimension, us, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY learner_id, dimension ORDER BY us) AS n FROM obs WHERE NOT rejected),
fold AS (
  SELECT learner_id, dimension, us, n, x, x AS centre, CAST(NULL AS DOUBLE) AS spread, [x] AS kept FROM ob WHERE n = 1
  UNION ALL
  SELECT learner_id, dimension, us, n, x, c, CASE WHEN len(kp) >= 2 THEN 1.4826 * list_aggregate(list_transform(kp, lambda v: abs(v - c)), 'median') END, kp
  FROM (
    SELECT o.learner_id, o.dimension, o.us, o.n, o.x,
           f.centre + 0.05 * CASE WHEN f.spread > 0 THEN greatest(-5 * f.spread, least(5 * f.spread, o.x - f.centre)) ELSE o.x - f.centre END AS c,
           CASE WHEN len(f.kept) + 1 > 6 THEN list_transform(range(2, len(f.kept) + 2, 2), lambda i: list_append(f.kept, o.x)[i]) || CASE WHEN len(f.kept) % 2 = 0 THEN [o.x] ELSE [] END ELSE list_append(f.kept, o.x) END AS kp
    FROM fold f JOIN ob o ON o.learner_id = f.learner_id AND o.dimension = f.dimension AND o.n = f.n + 1)),
dev AS (
  SELECT learner_id, dimension, us, n, x, centre, spread, len(kept) AS retained, x - centre AS absolute, CASE WHEN spread > 0 AND us % 7 <> 0 THEN (x - centre) / spread END AS z FROM fold)
"""

TRACK = FOLD + """, pts AS (
  SELECT *, list({'us': us, 'z': z}) OVER (PARTITION BY learner_id, dimension ORDER BY us ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS points FROM dev),
grid AS (SELECT learner_id, us, dimension, i FROM (SELECT DISTINCT learner_id, us FROM dev), (VALUES ('accuracy', 0), ('response_seconds', 1), ('session_seconds', 2), ('content_difficulty', 3)) v(dimension, i)),
g1 AS (
  SELECT g.learner_id, g.us, g.dimension, g.i, p.z IS NOT NULL AS observed, list_filter(coalesce(a.points, []), lambda q: q.z IS NOT NULL) AS m, coalesce(a.n, 0) AS n
  FROM grid g LEFT JOIN pts p ON p.learner_id = g.learner_id AND p.us = g.us AND p.dimension = g.dimension
  ASOF LEFT JOIN pts a ON a.learner_id = g.learner_id AND a.dimension = g.dimension AND a.us <= g.us),
g2 AS (SELECT *, list_transform(m, lambda q: q.z) AS zs, len(m) AS nz FROM g1),
g3 AS (SELECT *, CASE WHEN nz = 0 OR abs(zs[nz]) < 0.01 THEN 0 ELSE coalesce(nullif(list_position(list_transform(list_reverse(zs), lambda v: abs(v) < 0.01 OR sign(v) <> sign(zs[nz])), true), 0) - 1, nz) END AS run FROM g2),
g4 AS (SELECT *, CASE WHEN run >= 2 THEN zs[nz - run + 1:nz] ELSE zs[greatest(nz - 4, 1):nz] END AS b, zs[greatest(nz - 9, 1):nz] AS l10 FROM g3),
g5 AS (SELECT *, CASE WHEN len(b) >= 2 THEN (b[len(b)] - b[1]) / (len(b) - 1) END AS slope, CASE WHEN run > 0 THEN list_aggregate(zs[nz - run + 1:nz], 'sum') / run END AS run_mean, list_aggregate(l10, 'median') AS med FROM g4),
trk AS (
  SELECT *, CASE WHEN slope IS NULL THEN 'insufficient_data' WHEN slope = 0 THEN 'stable' WHEN sign(slope) = sign(b[len(b)]) THEN 'worsening' ELSE 'improving' END AS direction,
    CASE WHEN len(l10) >= 2 THEN 1.4826 * list_aggregate(list_transform(l10, lambda v: abs(v - med)), 'median') END AS dispersion,
    CASE WHEN run > 0 THEN m[nz - run + 1].us END AS run_start, CASE WHEN run > 0 THEN (m[nz].us - m[nz - run + 1].us) / 1e6 END AS run_seconds
  FROM g5),
dom AS (SELECT * FROM trk WHERE nz > 0 QUALIFY row_number() OVER (PARTITION BY learner_id, us ORDER BY run DESC, coalesce(abs(run_mean), 0) DESC, coalesce(dispersion, 0) DESC, i) = 1),
st0 AS (
  SELECT t.*, d.dimension, d.zs, d.nz, d.run, d.run_mean, d.direction AS dir, d.dispersion, d.run_seconds,
    CASE WHEN d.nz IS NULL OR d.nz < 2 THEN 'insufficient_data' WHEN run = 0 THEN 'stable' WHEN run < 3 THEN 'slight_deviation' WHEN abs(run_mean) >= 2 THEN 'high_deviation' WHEN d.direction = 'worsening' THEN 'declining' WHEN d.direction = 'improving' THEN 'recovering' ELSE 'increasing_deviation' END AS state
  FROM (SELECT learner_id, us, CAST(sum(nz) AS INTEGER) AS observations, min(n) AS least_n FROM trk GROUP BY 1, 2) t LEFT JOIN dom d USING (learner_id, us)),
st AS (
  SELECT *, coalesce(last_value(CASE WHEN dir <> 'insufficient_data' THEN dir END IGNORE NULLS) OVER (PARTITION BY learner_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'insufficient_data') AS direction,
    lag(state, 1, 'insufficient_data') OVER (PARTITION BY learner_id ORDER BY us) AS from_state, CASE WHEN state = 'insufficient_data' THEN 0 ELSE run END AS erun
  FROM st0),
traj AS (
  SELECT learner_id, dimension, run_start AS start_us, us AS end_us, direction, zs[nz - 2] AS first_z, zs[nz] AS last_z, run_mean AS mean_z, greatest(abs(zs[nz]), abs(zs[nz - 1]), abs(zs[nz - 2])) AS peak_z, (zs[nz] - zs[nz - 2]) / 2 AS rate, run_seconds AS duration_seconds
  FROM trk WHERE observed AND run = 3 QUALIFY row_number() OVER (PARTITION BY learner_id, dimension ORDER BY us DESC) <= 2)
"""

_TRACK_NAMES = ("pts", "grid", "g1", "g2", "g3", "g4", "g5", "trk", "dom", "st0", "st", "traj")


def track_of(source: str, suffix: str) -> str:
    """The same over other deviations: CTEs to follow one that defines ``source``, each name with ``suffix``."""
    tail = TRACK[len(FOLD) :]
    for name in _TRACK_NAMES:
        tail = re.sub(rf"\b{name}\b", name + suffix, tail)
    return re.sub(r"\bdev\b", source, tail)


_PRIORS = FOLD + """, mid AS (SELECT dimension, median(x) AS c, count(*) AS n_reference FROM ob GROUP BY 1),
priors AS (SELECT dimension, n_reference, c AS prior_centre, 1.4826 * median(abs(x - c)) AS prior_spread FROM ob JOIN mid USING (dimension) GROUP BY ALL HAVING prior_spread > 0)
"""
_DRIFT = FOLD + """, dr AS (SELECT learner_id, dimension, arg_min(centre, n) AS first_centre, arg_max(centre, n) AS last_centre FROM fold GROUP BY 1, 2),
d2 AS (SELECT *, last_centre - first_centre AS drift, CASE WHEN abs(first_centre) > 1e-12 THEN (last_centre - first_centre) / abs(first_centre) END AS rel FROM dr)
"""
_DEVREASON = "CASE WHEN n < 2 THEN 'too_few_values' WHEN spread IS NULL OR spread = 0 THEN 'no_spread' END"

ORACLES = {
    "b1_baseline_observations": FOLD + "SELECT learner_id, dimension, count(*) FILTER (WHERE NOT rejected) AS accepted, count(*) FILTER (WHERE rejected) AS rejected, CASE WHEN bool_or(rejected) THEN 'out_of_range:' || dimension END AS last_reason FROM obs GROUP BY 1, 2",
    "b2_ewma": FOLD + ", e AS (SELECT learner_id, dimension, n, x AS c FROM ob WHERE n = 1 UNION ALL SELECT o.learner_id, o.dimension, o.n, e.c + 0.05 * (o.x - e.c) FROM e JOIN ob o ON o.learner_id = e.learner_id AND o.dimension = e.dimension AND o.n = e.n + 1) SELECT learner_id, dimension, max(n) AS n, round(arg_max(c, n), 6) AS centre FROM e GROUP BY 1, 2",
    "b3_winsorised_ewma": FOLD + "SELECT learner_id, dimension, us, CAST(n AS INTEGER) AS n, round(centre, 6) AS centre, round(spread, 6) AS spread, CAST(retained AS INTEGER) AS retained FROM dev",
    "b3_orders_fold": """WITH RECURSIVE ob AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
fold AS (
  SELECT o_custkey, o_orderkey, n, x AS centre, CAST(NULL AS DOUBLE) AS spread, [x] AS kept FROM ob WHERE n = 1
  UNION ALL
  SELECT o_custkey, o_orderkey, n, c, 1.4826 * list_aggregate(list_transform(kp, lambda v: abs(v - c)), 'median'), kp
  FROM (SELECT o.o_custkey, o.o_orderkey, o.n, f.centre + 0.05 * CASE WHEN f.spread > 0 THEN greatest(-5 * f.spread, least(5 * f.spread, o.x - f.centre)) ELSE o.x - f.centre END AS c,
          CASE WHEN len(f.kept) + 1 > 6 THEN list_transform(range(2, len(f.kept) + 2, 2), lambda i: list_append(f.kept, o.x)[i]) || CASE WHEN len(f.kept) % 2 = 0 THEN [o.x] ELSE [] END ELSE list_append(f.kept, o.x) END AS kp
        FROM fold f JOIN ob o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1))
SELECT o_orderkey, CAST(n AS INTEGER) AS n, round(centre + 1.37e-5, 4) AS centre, round(spread + 1.37e-5, 4) AS spread FROM fold""",
    "b4_decimate": """WITH RECURSIVE o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1),
r AS (SELECT o_custkey, l FROM o UNION ALL SELECT o_custkey, list_transform(range(2, len(l) + 1, 2), lambda i: l[i]) || CASE WHEN len(l) % 2 = 1 THEN [l[-1]] ELSE [] END FROM r WHERE len(l) > 4)
SELECT o_custkey, array_to_string(l, ',') AS kept FROM r WHERE len(l) <= 4""",
    "b5_mad_about": FOLD + ", c AS (SELECT learner_id, dimension, avg(x) AS c FROM ob GROUP BY 1, 2) SELECT learner_id, dimension, CASE WHEN count(*) >= 2 THEN round(1.4826 * median(abs(x - c)), 6) END AS mad FROM ob JOIN c USING (learner_id, dimension) GROUP BY 1, 2",
    "b6_rms_about": FOLD + ", c AS (SELECT learner_id, dimension, median(x) AS c FROM ob GROUP BY 1, 2) SELECT learner_id, dimension, CASE WHEN count(*) >= 2 THEN round(sqrt(sum((x - c) * (x - c)) / (count(*) - 1)), 6) END AS rms FROM ob JOIN c USING (learner_id, dimension) GROUP BY 1, 2",
    "b7_maturity": FOLD + ", m AS (SELECT learner_id, dimension, count(*) AS n FROM ob GROUP BY 1, 2), k AS (SELECT *, CAST((n >= 3)::INT + (n >= 6)::INT + (n >= 10)::INT AS INTEGER) AS rank FROM m) SELECT learner_id, dimension, ['new', 'early', 'developing', 'established'][rank + 1] AS maturity, rank, ['population_prior', 'partial_personal', 'personal', 'personal'][rank + 1] AS basis FROM k",
    "b8_baseline_reference": _PRIORS + "SELECT learner_id, dimension, us, round(CASE WHEN n < 3 THEN prior_centre ELSE centre END, 6) AS ref_centre, round(CASE WHEN n < 3 THEN prior_spread ELSE spread END, 6) AS ref_spread, CASE WHEN n >= 3 THEN 'personal' WHEN prior_centre IS NOT NULL THEN 'population_prior' ELSE 'unavailable' END AS ref_source FROM dev LEFT JOIN (SELECT * FROM priors WHERE dimension <> 'content_difficulty') p USING (dimension)",
    "b9_deviation": FOLD + f"SELECT learner_id, dimension, us, round(absolute, 6) AS absolute, CASE WHEN spread > 0 THEN round(absolute / spread, 6) END AS z, {_DEVREASON} AS reason FROM dev",
    "b9_deviation_before": FOLD + ", p AS (SELECT learner_id, dimension, us, n - 1 AS n, x, lag(centre) OVER w AS centre, lag(spread) OVER w AS spread FROM dev WINDOW w AS (PARTITION BY learner_id, dimension ORDER BY n)) SELECT learner_id, dimension, us, round(x - centre, 6) AS absolute, CASE WHEN n >= 2 AND spread > 0 THEN round((x - centre) / spread, 6) END AS z, CASE WHEN centre IS NULL THEN 'no_reference' WHEN n < 2 THEN 'too_few_values' WHEN spread IS NULL OR spread = 0 THEN 'no_spread' END AS reason FROM p",
    "b10_refuse_late": CTX + "SELECT event_id, CASE WHEN us <= max(us) OVER (PARTITION BY learner_id ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'late' END AS refused FROM ev",
    "b11_build_priors": _PRIORS + "SELECT dimension, n_reference, round(prior_centre, 6) AS prior_centre, round(prior_spread, 6) AS prior_spread FROM priors",
    "b12_centre_drift": _DRIFT + "SELECT learner_id, dimension, round(first_centre, 6) AS first_centre, round(last_centre, 6) AS last_centre, round(drift, 6) AS drift, round(rel, 6) AS relative_drift FROM d2",
    "b12_largest_mover": _DRIFT + "SELECT learner_id, dimension FROM d2 WHERE rel IS NOT NULL QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY abs(rel) DESC, list_position(['accuracy', 'response_seconds', 'session_seconds', 'content_difficulty'], dimension)) = 1",
    "b13_baseline_profile": FOLD + ", l AS (SELECT * FROM dev QUALIFY row_number() OVER (PARTITION BY learner_id, dimension ORDER BY n DESC) = 1), r AS (SELECT o.learner_id, dimension, count(*) FILTER (WHERE rejected) AS rejected, array_to_string(list_sort(list(DISTINCT f.origin_label) FILTER (WHERE NOT rejected)), ',') AS origins FROM obs o JOIN fin f ON f.learner_id = o.learner_id AND f.us = o.us GROUP BY 1, 2) SELECT learner_id, dimension, round(centre, 6) AS centre, round(spread, 6) AS spread, CAST(n AS INTEGER) AS n, CAST(retained AS INTEGER) AS retained, us AS updated_us, rejected, ['new', 'early', 'developing', 'established'][(n >= 3)::INT + (n >= 6)::INT + (n >= 10)::INT + 1] AS maturity, ['population_prior', 'partial_personal', 'personal', 'personal'][(n >= 3)::INT + (n >= 6)::INT + (n >= 10)::INT + 1] AS basis, origins FROM l LEFT JOIN r USING (learner_id, dimension)",
    "t1_recent_points": TRACK + "SELECT learner_id, dimension, us, CAST(len(points) AS INTEGER) AS held, CAST(len(list_filter(points, lambda q: q.z IS NOT NULL)) AS INTEGER) AS measured FROM pts",
    "t2_sign_run": TRACK + "SELECT learner_id, us, dimension, CAST(run AS INTEGER) AS run, round(run_mean, 6) AS run_mean FROM trk",
    "t3_change_per_observation": TRACK + "SELECT learner_id, us, dimension, CASE WHEN nz >= 2 THEN round((zs[nz] - zs[1]) / (nz - 1), 6) END AS change FROM trk",
    "t4_direction": TRACK + "SELECT learner_id, us, dimension, direction FROM trk",
    "t5_dispersion": TRACK + "SELECT learner_id, us, dimension, round(dispersion, 6) AS dispersion FROM trk",
    "t6_dominant_dimension": TRACK + "SELECT learner_id, us, dimension, CAST(run AS INTEGER) AS run FROM st0",
    "t7_classify_state": TRACK + "SELECT learner_id, us, state, CASE WHEN state IN ('insufficient_data', 'stable') THEN 'flat' WHEN state = 'slight_deviation' THEN 'isolated' ELSE 'persistent' END AS character, CASE state WHEN 'insufficient_data' THEN 'none' WHEN 'stable' THEN 'stable' WHEN 'slight_deviation' THEN 'anomaly' WHEN 'recovering' THEN 'recovery' ELSE 'trajectory' END AS change_kind FROM st",
    "t8_state_evidence": TRACK + "SELECT learner_id, us, CAST((least_n >= 3)::INT + (least_n >= 6)::INT + (least_n >= 10)::INT AS INTEGER) AS weakest_maturity, observations, CAST(erun AS INTEGER) AS evidence_run, CASE WHEN state = 'insufficient_data' THEN 0.0 ELSE round(coalesce(run_seconds, 0), 6) END AS evidence_seconds, round(list_aggregate(zs, 'avg'), 6) AS mean_z, round(dispersion, 6) AS evidence_dispersion FROM st",
    "t9_trajectories": TRACK + "SELECT learner_id, dimension, start_us, end_us, direction, round(first_z, 6) AS first_z, round(last_z, 6) AS last_z, round(mean_z, 6) AS mean_z, round(peak_z, 6) AS peak_z, round(rate, 6) AS rate, round(duration_seconds, 6) AS duration_seconds FROM traj",
    "t10_state_transitions": TRACK + "SELECT learner_id, from_state, state AS to_state, us AS at_us, CAST(erun AS INTEGER) AS run FROM st",
    "t11_latest_trajectory": TRACK + "SELECT learner_id, dimension, end_us, direction FROM traj QUALIFY row_number() OVER (PARTITION BY learner_id, dimension ORDER BY end_us DESC) = 1",
    "t12_run_span": TRACK + "SELECT learner_id, us, dimension, run_start, round(run_seconds, 6) AS run_seconds FROM trk",
    "t13_refuse_late_observations": FOLD + "SELECT learner_id, dimension, us, CASE WHEN us <= max(us) OVER (PARTITION BY learner_id ORDER BY n % 3, us, dimension ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'late' END AS refused FROM dev",
    "t14_temporal_state": TRACK + "SELECT learner_id, us, state, direction, dimension, observations FROM st QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY us DESC) = 1",
    "t15_track_coverage": FOLD + ", r AS (SELECT *, row_number() OVER (PARTITION BY learner_id, dimension ORDER BY us DESC) AS rn FROM dev) SELECT learner_id, dimension, count(*) FILTER (WHERE rn <= 6) AS kept, count(*) FILTER (WHERE rn > 6) AS dropped, count(*) FILTER (WHERE rn <= 6 AND z IS NOT NULL) AS measurable FROM r GROUP BY 1, 2",
}

ORACLES = {k: steady(v) for k, v in ORACLES.items()}
