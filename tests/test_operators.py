"""Branches and boundaries that the given tables don't reach, on small frames with expected rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.functions import columns as X
from eventlens.operators import authority as A
from eventlens.operators import baseline as B
from eventlens.operators import context as C
from eventlens.operators import evaluation as E
from eventlens.operators import features as FE
from eventlens.operators import intelligence as I
from eventlens.operators import models as M
from eventlens.operators import outcomes as O
from eventlens.operators import policy as P
from eventlens.operators import temporal as T
from eventlens.operators import uncertainty as U
from eventlens.operators import validation as V
from eventlens.settings import DEFAULT, SPARSE, Settings


def one(spark, col, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).first()["y"]


@pytest.mark.parametrize("arr,limit,want", [([1, 2, 3, 4], 3, [2, 4]), ([1, 2, 3, 4, 5], 3, [2, 4, 5]), (list(range(1, 10)), 4, [4, 8, 9]), ([], 3, []), ([1], 1, [1])])
def test_decimate(spark, arr, limit, want):
    assert one(spark, B.decimate(F.col("x"), limit), arr, "array<int>") == want


def fold(spark, values, **kw):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, us long, value double").repartition(3)
    return [(r["centre"], r["spread"]) for r in B.winsorised_ewma(df, ["k"], ["us"], "value", DEFAULT, **kw).orderBy("n").collect()]


def test_robust_fold_contains_an_outlier(spark):
    got = fold(spark, [20, 22, 18, 21, 300])
    assert [round(c, 6) for c, _ in got] == [20, 20.1, 19.995, 20.04525, 20.584453]
    assert got[0][1] is None and [round(s, 6) for _, s in got[1:]] == [1.4826, 2.957787, 2.156812, 2.09869]
    plain = fold(spark, [20, 22, 18, 21, 300], robust=False)[-1]
    assert round(plain[0], 6) == 34.042987 and round(plain[1], 6) == 133.700101


def test_equal_values_have_no_standardised_deviation(spark):
    df = spark.createDataFrame([("a", i, 5.0) for i in range(3)], "k string, us long, value double")
    rows = B.deviations(B.winsorised_ewma(df, ["k"], ["us"], "value"), ["k"]).orderBy("n").collect()
    assert [r["z"] for r in rows] == [None] * 3 and [r["reason"] for r in rows] == ["too_few_values", "no_spread", "no_spread"]


def test_maturity_and_late(spark):
    got = [one(spark, B.maturity(F.col("x")), n, "int") for n in (19, 20, 99, 100, 499, 500)]
    assert got == ["new", "early", "early", "developing", "developing", "established"]
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 11), (None, 4, 12)], "k string, arrival int, us long")
    assert [r["refused"] for r in B.refuse_late(df, "k", ["arrival"]).orderBy("arrival").collect()] == [None, "late", None, "no_learner"]


def states(spark, zs, s=DEFAULT, dim="accuracy"):
    df = spark.createDataFrame([("a", i * 300_000_000, dim, z, i + 1) for i, z in enumerate(zs)], "learner_id string, us long, dimension string, z double, n int")
    return T.state_history(df, s).orderBy("us").collect(), df


@pytest.mark.parametrize(
    "zs,state,direction",
    [
        ([0.5], "insufficient_data", None), ([0.0, 0.0], "stable", None), ([0.0, 1.0], "slight_deviation", None), ([0.5, 1.0, 1.5], "declining", "worsening"), ([1.5, 1.0, 0.5], "recovering", "improving"),
        ([1.0, 1.0, 1.0], "increasing_deviation", "stable"), ([2.0, 2.5, 3.0], "high_deviation", None), ([-3.0, -2.0, -1.0], "high_deviation", "improving"), ([1.0, None, 1.0, 1.0], "increasing_deviation", "stable"),
    ],
)
def test_ladder_of_states(spark, zs, state, direction):
    rows, df = states(spark, zs)
    assert rows[-1]["state"] == state and (direction is None or rows[-1]["direction"] == direction)
    from eventlens.streaming.processors import classify, track

    run, mean, _, way = track([z for z in zs if z is not None])
    assert classify([z for z in zs if z is not None], run, mean, way) == state


def test_trajectory_once_and_points_bounded(spark):
    _, df = states(spark, [0.5, 1.0, 1.5, 2.0, None])
    assert T.trajectories(T.tracks(df)).count() == 1
    small = Settings(points=4)
    _, df = states(spark, [1.0] * 6)
    cover = T.track_coverage(df, small).first()
    assert (cover["kept"], cover["dropped"]) == (4, 2)


def test_future_rows_and_row_order_change_nothing(spark):
    e = [("a", "s", i * 60_000_000, i, "question_answered", None, i % 2 == 0, 10.0 + i, None, None, None, None, None, "real") for i in range(12)]
    schema = "learner_id string, session_id string, us long, event_id long, event_type string, question_id string, correct boolean, response_seconds double, content_id string, difficulty double, intervention_id long, intervention_type string, outcome string, origin string"
    cols = list(FE.FEATURES)[:9]
    past = FE.compute_features(spark.createDataFrame(e[:8], schema)).select("event_id", *cols)
    whole = FE.compute_features(spark.createDataFrame(e[::-1], schema).repartition(5)).where("event_id < 8").select("event_id", *cols)
    assert past.exceptAll(whole).count() == 0 and whole.exceptAll(past).count() == 0
    assert FE.compute_features(spark.createDataFrame([], schema)).count() == 0


def test_trend_window_holds_its_edge(spark):
    m = 60_000_000
    rows = [("a", "s", t, i, "question_answered", None, c, 5.0, None, None, None, None, None, "real") for i, (t, c) in enumerate([(0, True), (1, True), (2, True), (15 * m + 3, False), (15 * m + 4, False), (15 * m + 5, False)])]
    schema = "learner_id string, session_id string, us long, event_id long, event_type string, question_id string, correct boolean, response_seconds double, content_id string, difficulty double, intervention_id long, intervention_type string, outcome string, origin string"
    last = FE.accuracy_trend(spark.createDataFrame(rows, schema)).orderBy(F.desc("us")).first()
    assert last["performance_accuracy_trend"] == -1.0


def decision(spark, delivered, **over):
    d = {"decision_id": 1, "learner_id": "a", "session_id": "s", "decided_us": 10_000_000_000, "verdict": "resolved", "probability": 0.9, "threshold": 0.5, "confidence": "high", "evidence": 200, "state": "declining"} | over
    dec = spark.createDataFrame([tuple(d.values())], "decision_id long, learner_id string, session_id string, decided_us long, verdict string, probability double, threshold double, confidence string, evidence int, state string")
    rows = [("a", ses, i, kind, t, out) for i, (ses, kind, t, out) in enumerate(delivered)]
    dels = spark.createDataFrame(rows, "learner_id string, session_id string, intervention_id long, intervention_type string, delivered_us long, outcome string")
    return P.decide(dec, dels).first()


NOW = 10_000_000_000


@pytest.mark.parametrize(
    "delivered,over,reason,selected",
    [
        ([], {}, None, "recap"), ([("x", "recap", NOW, None)], {}, "in_cooldown", None), ([("x", "recap", NOW - 599_900_000, None)], {}, "in_cooldown", None), ([("x", "recap", NOW - 600_000_000, None)], {}, None, "recap"),
        ([("s", "recap", NOW - 3_700_000_000 - i, None) for i in range(3)], {}, "session_cap_reached", None), ([("x", "recap", NOW - 700_000_000 - i, None) for i in range(5)], {}, "window_cap_reached", None),
        ([("x", k, NOW - 700_000_000 - i, None) for i, k in enumerate(["pause"] * 4)] + [("x", "pause", NOW - 3_600_000_000, None)], {}, None, "recap"),
        ([("x", "recap", NOW - 9_000_000_000, "dismissed"), ("x", "recap", NOW - 8_000_000_000, "dismissed")], {}, None, "micro_question"),
        ([], {"confidence": "low"}, "confidence_too_low", None), ([], {"verdict": "unknown"}, "not_resolved", None), ([], {"probability": None}, "probability_below_floor", None), ([], {"state": None}, "state_insufficient", None),
        ([], {"state": "stable"}, "state_not_indicated", None), ([], {"evidence": 4}, "minimum_evidence_not_met", None),
    ],
)
def test_decide(spark, delivered, over, reason, selected):
    r = decision(spark, delivered, **over)
    assert (r["reason"], r["selected"]) == (reason, selected)


def test_true_trailing_run(spark):
    r = decision(spark, [("x", k, NOW - 9_000_000_000 + i, None) for i, k in enumerate(("recap", "micro_question", "recap"))])
    assert [c["run"] for c in r["candidates"]] == [1, 0, 0, 0]


def test_authority(spark):
    week = 7 * 86_400_000_000
    dec = spark.createDataFrame([(1, "a", "c", week)], "decision_id long, learner_id string, context string, decided_us long")
    mem = lambda *rows: spark.createDataFrame([("a", "c", o, 1.0, t) for o, t in rows], "learner_id string, context string, outcome string, weight double, recorded_us long")
    assert round(A.decayed_authority(mem(("disputed", 0)), dec).first()["decayed"], 6) == 0.54
    assert round(A.decayed_authority(mem(("disputed", week), ("deteriorated", week)), dec).first()["decayed"], 6) == 0.43
    assert A.decayed_authority(mem(("improved", week)), dec).first()["decayed"] == 0.6
    assert A.clamp_authority(A.decayed_authority(mem(("improved", week)), dec).withColumn("confidence", F.lit(None).cast("string"))).first()["authority"] == 0


def test_chain_reports_the_changed_row(spark):
    df = spark.createDataFrame([("a", i, f"x{i}") for i in range(5)], "k string, i int, v string")
    chain = A.hash_chain(df, "k", ["i"], ["i", "v"])
    assert A.verify_chain(chain, "k").first()["intact"]
    bad = chain.withColumn("payload", F.when(F.col("place") == 3, "other").otherwise(F.col("payload")))
    assert A.verify_chain(bad, "k").first()["first_break"] == 3
    assert A.verify_chain(chain.where("place > 2"), "k").first()["intact"]  # the first kept entry is the anchor


@pytest.mark.parametrize("after,want", [(1.05, "no_change"), (1.0500001, "improved"), (0.9, "deteriorated")])
def test_direction_tolerance(spark, after, want):
    assert one(spark, O.direction_of(F.lit(1.0), F.col("x"), False, 0.05), after, "double") == want


def test_interval_join_edges(spark):
    left = spark.createDataFrame([("a", 1, 1000, 2000)], "k string, id int, lo long, hi long")
    right = spark.createDataFrame([("a", t) for t in (999, 1000, 1500, 1999, 2000)] + [(None, 1500)], "k string, t long")
    for width in (10, 300, 100_000):
        assert sorted(r["t"] for r in O.interval_join(left, right, "k", "lo", "hi", "t", width).collect()) == [1000, 1500, 1999]


def test_rates_and_profiles(spark):
    cells = [("a", "m", "t", "correct", c, None) for c in ("tp", "tn")] + [("b", "m", "t", "incorrect", c, None) for c in ("fp", "fn")]
    r = E.summarise(spark.createDataFrame(cells, "learner_id string, model_version string, target string, verdict string, cell string, response string")).first()
    assert [r[c] for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")] == [0.5] * 6
    none = spark.createDataFrame([("a", "m", "t", "correct", "tn", None)], "learner_id string, model_version string, target string, verdict string, cell string, response string")
    assert E.summarise(none).first()["precision"] is None
    obs = lambda n, rest: spark.createDataFrame([("a", "c", "x", "positive")] * n + [("a", "c", "x", "negative")] * rest, "learner_id string, candidate string, context string, response_direction string")
    assert E.response_profiles(obs(3, 1)).first()["status"] == "collecting" and E.response_profiles(obs(3, 2)).first()["success_rate"] == 0.6
    assert E.response_profiles(obs(1, 31)).first()["success_rate"] == 0.0312


def test_uncertainty(spark):
    want = [(9, 0.0), (10, 0.5), (50, 0.705704), (100, 0.794296), (499, 0.999744), (500, 1.0)]
    assert [round(one(spark, U.evidence_ceiling(F.col("x")), n, "int"), 6) for n, _ in want] == [v for _, v in want]
    from eventlens.operators.models import bin_index

    assert [one(spark, bin_index(F.col("x")), p, "double") for p in (0.0, 0.3, 0.7, 1.0)] == [0, math.floor(0.3 / 0.1 + 1e-12) - (0.3 < 3 * 0.1), 6 + (0.7 >= 7 * 0.1), 9]


def test_change_over_quarters(spark):
    accs = [0.9, 0.9, 0.6, 0.6, 0.6, 0.6, 0.8, 0.8]
    r = spark.createDataFrame([("a", f"s{i}", i, 10, int(a * 10), a, 1.0, 0.1 * i) for i, a in enumerate(accs)], "learner_id string, session_id string, first_us long, answered int, n_correct int, accuracy double, mean_response double, mean_difficulty double")
    halves = I.classify_change(r).first()
    assert (halves["early_difficulty"], halves["late_difficulty"]) == (pytest.approx(0.15), pytest.approx(0.55))
    assert I.classify_change(r).first()["change"] == "recovering" and I.classify_change(r.limit(3)).first()["change"] == "insufficient_evidence"


@pytest.mark.parametrize("role,who,denial", [("student", "a", None), ("student", "b", "other_learner"), ("student", None, "no_identity"), (None, "a", "no_role"), ("guest", "a", "unknown_role"), ("teacher", None, None)])
def test_access(spark, role, who, denial):
    df = spark.createDataFrame([(1, role, who, "a", "?")], "request_id int, role string, requester_id string, learner_id string, question string")
    assert I.authorise_requests(df).first()["denial"] == denial


def test_identifiers_and_instants(spark):
    assert [one(spark, X.valid_pseudonym(F.col("x")), v) for v in ("e1", "1234567", "12345678", " abc-def_9 ", None, "a b c d e f")] == [False, False, True, True, False, False]
    assert [one(spark, X.utc_finding(F.col("x")), v) for v in (None, "12", "soon", "2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00")] == ["missing_field", "not_a_string", "invalid_timestamp", "naive_timestamp", None, None]
    assert "hunter22" not in one(spark, X.redact(F.col("x")), 'password = "hunter22" and Bearer abc.def')


def test_strict_ingest_fails(spark):
    df = spark.createDataFrame([("e1", "learner-1", "session-1", "2024-01-01T00:00:00Z", "interaction", "tap", "real", "observed", True, 1)], "event_id string, learner_id string, session_id string, timestamp string, event_type string, interaction_type string, origin string, provenance string, has_stamp boolean, seq int")
    assert V.ingest(df)[1].first()["code"] == "invalid_identifier"
    with pytest.raises(Exception, match="invalid_identifier"):
        V.ingest(df, strict=True)[0].collect()


def test_plans_have_no_cartesian_product_and_no_python(spark):
    from eventlens.plans import queries

    q = queries()
    for name in ("f15_compute_features", "o11_measure_outcomes", "p12_decide", "t14_temporal_state"):
        text = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_one_busy_key_takes_linear_time(spark):
    """A million rows of one learner and session: what was quadratic before would not end."""
    n = 1_000_000
    i = F.col("id")
    e = spark.range(n).select(
        F.lit("a").alias("learner_id"), F.lit("s").alias("session_id"), i.alias("us"), i.alias("event_id"),
        F.when(i % 3 == 0, "question_answered").when(i % 1000 == 1, "intervention_started").when(i % 1000 == 501, "intervention_completed").otherwise("interaction").alias("event_type"),
        (i % 2 == 0).alias("correct"), (i % 7).cast("double").alias("response_seconds"), F.when(i % 1000 == 1, i).when(i % 1000 == 501, i - 500).alias("intervention_id"), F.lit("hint").alias("intervention_type"), F.lit("accepted").alias("outcome"),
    )
    got = C.intervention_status(C.recent_performance(e, SPARSE), SPARSE).agg(F.count("*").alias("n"), F.sum("correct_count").alias("right"), F.sum("recent_response").alias("slow"), F.count("last_outcome").alias("known"), F.max("interventions").alias("starts")).first()
    ids = np.arange(n)
    answers = ids[::3]
    right, slow = (answers % 2 == 0).astype(int), (answers % 7).astype(float)
    last = lambda x: np.convolve(x, np.ones(SPARSE.recent_answers))[: len(x)]
    per = np.minimum(np.arange(1, len(answers) + 1), SPARSE.recent_answers)
    assert got["n"] == n and got["right"] == last(right)[ids // 3].sum() and abs(got["slow"] - (last(slow) / per)[ids // 3].sum()) < 1e-3
    starts = (ids % 1000 == 1) & (ids % 3 != 0)
    began = np.maximum.accumulate(np.where(starts, ids, -1))
    ended = (began >= 0) & (ids >= began + 500) & ((began + 500) % 3 != 0)
    assert got["starts"] == starts.sum() and got["known"] == ended.sum()

    folded = B.winsorised_ewma(e.select("learner_id", "us", (F.col("us") % 97).alias("value")), ["learner_id"], ["us"], "value", SPARSE)
    assert tuple(folded.agg(F.count("*"), F.max("n"), F.max("retained")).first()) == (n, n, SPARSE.retained)
    chain = A.hash_chain(e, "learner_id", ["us"], ["event_id", "event_type"])
    assert A.verify_chain(chain, "learner_id").first()["intact"] and chain.agg(F.count_distinct("entry_hash")).first()[0] == n
    medians = M.column_reference(e.select("response_seconds", (F.col("us") * 37 % 1009 + 0.5).alias("b"), F.when(F.col("us") < 0, 1.0).alias("none")), ["response_seconds", "b", "none"]).first()
    assert (medians["response_seconds"], medians["b"], medians["none"]) == (np.median(ids % 7), np.median(ids * 37 % 1009 + 0.5), None)


def test_streamed_caps_do_not_depend_on_batches(spark, tmp_path):
    """Deliveries and decisions in batches that are in order of time give what one batch gives."""
    from eventlens.streaming import processors

    rows = [("a", f"s{i // 7}", 40_000 * 1_000_000 * i, None if i % 3 else i) for i in range(60)] + [("b", "t", 5, 900)]
    schema = "learner_id string, session_id string, us long, decision_id long"
    got = []
    for parts in (1, 6):
        path = f"{tmp_path}/{parts}"
        for k in range(parts):
            some = [r for j, r in enumerate(rows) if j * parts // len(rows) == k]
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = processors.stream_caps(stream, SPARSE).writeStream.format("memory").queryName(f"caps{parts}").option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(sorted((r["decision_id"], r["in_session"], r["in_window"], r["cap"]) for r in spark.table(f"caps{parts}").collect()))
    want = []
    for learner, session, us, d in rows:
        if d is not None:
            past = [(u, s) for x, s, u, k in rows if x == learner and k is None and u <= us]
            inside, here = sum(u > us - int(SPARSE.cap_window * 1e6) for u, _ in past), sum(s == session for _, s in past)
            since = (us - max(u for u, _ in past)) / 1e6 if past else None
            want.append((d, here, inside, "in_cooldown" if since is not None and since < SPARSE.policy_cooldown else "session_cap_reached" if here >= SPARSE.session_cap else "window_cap_reached" if inside >= SPARSE.window_cap else None))
    assert got[0] == got[1] == sorted(want)


def test_redaction_rules(spark):
    texts = {
        "Authorization: Bearer abcdefgh12345678 end": "Authorization: [REDACTED] end",
        "auth basic QWxhZGRpbjpvcGVu ok": "auth [REDACTED] ok",
        "x eyJhbGciOiJIUzI1.eyJzdWIi.c2lnbmF0 y": "x [REDACTED] y",
        "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- after": "[REDACTED] after",
        'api-key=abc, "access_token": "q w", plain': 'api-key=[REDACTED], "access_token": [REDACTED], plain',
        "token=[REDACTED]": "token=[REDACTED]",
        "basic facts": "basic facts",
    }
    df = spark.createDataFrame([(t, "v", "w") for t in texts], "body string, session_key string, db_passwd string")
    out = X.redact_columns(df, ["body"]).collect()
    assert [r["body"] for r in out] == list(texts.values()) and all(r["session_key"] is r["db_passwd"] is None for r in out)
    again = X.redact_columns(spark.createDataFrame([(v,) for v in texts.values()], "body string"), ["body"]).collect()
    assert [r["body"] for r in again] == list(texts.values())
