"""Lineage of statements, diagnosis by rules, repeat-safe appends, latest deliveries, and readings by a frozen profile."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import evaluation as E
from eventlens.operators import intelligence as I
from eventlens.operators import lineage as L
from eventlens.operators import policy as P
from eventlens.settings import DEFAULT
from eventlens.sources import event_log as S


def test_digests_of_intervals_against_brute_force(spark):
    rng = random.Random(3)
    log = [(f"l{i % 3}", rng.randint(0, 40), i, rng.choice(["real", "synthetic"])) for i in range(200)]
    spans = [(f"l{i % 4}", *sorted((rng.randint(-5, 45), rng.randint(-5, 45)))) for i in range(60)] + [("l0", None, 5), ("l0", 7, 7)]
    events = spark.createDataFrame(log, "learner_id string, us long, event_id long, origin string")
    got = {(r["learner_id"], r["from_us"], r["to_us"]): r for r in L.interval_digests(spark.createDataFrame(spans, "learner_id string, from_us long, to_us long"), events).collect()}
    assert set(got) == {s for s in spans if s[1] is not None}
    for (who, lo, hi), r in got.items():
        inside = [(i, o) for w, us, i, o in log if w == who and lo <= us <= hi]
        x = 0
        for i, _ in inside:
            x ^= int(hashlib.sha256(str(i).encode()).hexdigest()[:15], 16)
        kinds = {o for _, o in inside}
        assert (r["n_events"], r["events_digest"]) == (len(inside), f"{x:015x}")
        assert r["origin"] == ("unknown" if not kinds else "mixed" if len(kinds) == 2 else kinds.pop())


def test_answers_name_their_events(spark):
    item = ("a", "high", "log/1", "real")
    rows = [(f"{k}:l:", "l", k, c, rel, f"said {k}", "x", src, v, 9, None, n, d, o) for k, c, rel, src, v, n, d, o in [
        ("event", "observed", "high", "log", "log/1", 5, "00a", "real"), ("context", "derived", "medium", "context", "context/1", 2, "00b", "synthetic"), ("temporal", "derived", "high", "baseline", "baseline/1", 4, "00c", "real"),
        ("prediction", "predicted", "low", "model", "m_V2", 5, "00d", "real"), ("uncertainty", "predicted", "medium", "model", "m_V2", 5, "00d", "real"),
    ]]
    cols = "evidence_id string, learner_id string, kind string, class string, reliability string, statement string, provenance string, source string, version string, ts_us long, subject string, n_events long, events_digest string, origin string"
    evidence = spark.createDataFrame(rows, cols)
    gaps = spark.createDataFrame([("g", "l", "no_outcome", "missing", 1, None)], "gap_id string, learner_id string, gap string, gap_type string, priority int, subject string")
    asks = [(1, "l", "student", "l", "Show the timeline"), (2, "l", "teacher", None, "Explain it"), (3, "l", "teacher", None, "Which gaps are there?"), (4, "none", "teacher", None, "Explain it"), (5, "l", "guest", None, "x"), (6, "l", "teacher", None, "Blue skies")]
    got = {r["request_id"]: r for r in I.answer_questions(spark.createDataFrame(asks, "request_id int, learner_id string, role string, requester_id string, question string"), evidence, gaps).collect()}
    one = got[1]
    assert (one["status"], one["answer_type"], one["reliability"], one["confidence"], one["origin"]) == ("answered", "mixed", "medium", "medium", "mixed")
    assert [tuple(x) for x in one["rests_on"]] == [("context:l:", 2, "00b"), ("event:l:", 5, "00a")] and one["versions"] == ["context/1", "log/1"]
    two = got[2]
    assert (two["answer_type"], two["reliability"], two["confidence"], two["sources"]) == ("prediction", "low", "low", ["baseline", "model"])
    three = got[3]
    assert (three["status"], three["reliability"], three["confidence"], three["answer_type"], three["rests_on"]) == ("answered", "low", "unknown", None, [])
    assert "no_outcome" in three["answer"]
    assert [(got[i]["status"], got[i]["reason"], got[i]["rests_on"]) for i in (4, 5, 6)] == [("refused", "missing_data", None), ("denied", "unknown_role", None), ("refused", "unsupported", None)]
    assert item  # names of the fixture


def test_each_category_of_diagnosis(spark):
    fine = {("events", "answered"): "4", ("baseline", "maturity"): "early", ("temporal", "state"): "declining", ("temporal", "character"): "persistent", ("uncertainty", "verdict"): "resolved", ("uncertainty", "binding"): "assertion",
            ("uncertainty", "ceiling"): "0.7", ("policy", "decision"): "intervene", ("authority", "level"): "allowed", ("safety", "final_reason"): "cleared"}
    cases = {
        "no_restriction": {}, "input_rejected": {("events", "answered"): "0"}, "insufficient_data": {("baseline", "maturity"): "new", ("temporal", "state"): "insufficient_data"}, "baseline_adaptation": {("baseline", "relative_drift"): "0.25"},
        "temporal_state_logic": {("temporal", "character"): "isolated", ("temporal", "state"): "slight_deviation"}, "prediction_refusal": {("prediction", "refusal"): "absent:x"}, "uncertainty_limit": {("uncertainty", "binding"): "evidence"},
        "policy_restriction": {("policy", "decision"): "no_intervention", ("policy", "reason"): "in_cooldown"}, "authority_restriction": {("authority", "level"): "restricted"}, "safety_restriction": {("safety", "final_reason"): "expired"},
    }
    rows = [(i, stage, name, value) for i, c in enumerate(cases.values()) for (stage, name), value in (fine | c).items()]
    got = {}
    for r in I.diagnose(spark.createDataFrame(rows, "decision_id long, stage string, name string, value string")).collect():
        got.setdefault(r["decision_id"], {})[r["category"]] = (r["kind"], r["evidence"])
    for i, category in enumerate(cases):
        assert category in got[i]
        caveat = category in ("baseline_adaptation", "temporal_state_logic")
        assert set(got[i]) == ({category, "no_restriction"} if caveat else {category}) and got[i][category][0] == ("caveat" if caveat else "constraint")
    assert got[2]["insufficient_data"][1] == "baseline.maturity=new,temporal.state=insufficient_data"


def test_batches_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("day"))
    assert S.append_event_log(df, path, "b1", "day") and not S.append_event_log(df, path, "b1", "day")
    df.where("id < 5").write.partitionBy("day").parquet(f"{path}/data/batch=b2/attempt=torn")  # its writer was lost
    assert S.read_appended(spark, path).count() == 10
    assert S.append_event_log(df.limit(3), path, "b2", "day")
    assert {(r["batch"], r["count"]) for r in S.read_appended(spark, path).groupBy("batch").count().collect()} == {("b1", 10), ("b2", 3)}
    # a writer that came second leaves rows that no entry names
    assert not S._create(spark, f"{path}/manifest/b2.json", "{}")
    with pytest.raises(ValueError):
        S.append_event_log(df, path, "../x")


def test_latest_deliveries_of_a_decision(spark):
    rng = random.Random(9)
    gave = [(f"l{i % 2}", i, rng.randint(0, 30)) for i in range(40)]
    asked = [(f"l{i % 3}", 100 + i, rng.randint(-2, 33)) for i in range(15)]
    got = P.history_as_of(spark.createDataFrame(gave, "learner_id string, intervention_id long, delivered_us long"), spark.createDataFrame(asked, "learner_id string, decision_id long, decided_us long"), 3).collect()
    want = []
    for who, decision, t in asked:
        past = sorted(((us, i) for w, i, us in gave if w == who and us <= t), reverse=True)[:3]
        want += [(decision, k + 1, i, us) for k, (us, i) in enumerate(past)]
    assert sorted((r["decision_id"], r["back"], r["intervention_id"], r["delivered_us"]) for r in got) == sorted(want)


def test_reading_by_the_frozen_profile(spark):
    """Two chunks of three answers each; later versions of the profile and events outside the window don't count."""
    m = 60_000_000
    kinds = "event_id long, learner_id string, session_id string, us long, event_type string, question_id string, content_id string, difficulty double, correct boolean, response_seconds double, intervention_id string, intervention_type string, outcome string, origin string"
    answers = [(i, "a", "s", us, "question_answered", "q", None, None, right, sec, None, None, None, "real") for i, (us, right, sec) in enumerate([
        (50 * m, True, 99.0), (100 * m, True, 22.0), (101 * m, True, 22.0), (102 * m, False, 22.0), (103 * m, False, 30.0), (104 * m, False, 30.0), (105 * m, False, 30.0), (200 * m, True, 1.0)])]
    snap = spark.createDataFrame([(1, "a", "s", 100 * m, 110 * m, "direction", "worsening", "resolved"), (2, "a", "s", 103 * m, 110 * m, "decline", "declining", "resolved")],
                                 "prediction_id long, learner_id string, session_id string, predicted_us long, window_end long, target string, claim string, status string")
    folded = spark.createDataFrame([("a", "response_seconds", 90 * m, 20.0, 2.0, 30), ("a", "response_seconds", 100 * m, 20.0, 4.0, 31), ("a", "response_seconds", 101 * m, 0.0, 1.0, 32), ("a", "accuracy", 10 * m, 0.5, 0.0, 30)],
                                   "learner_id string, dimension string, us long, centre double, spread double, n int")
    got = E.post_window_reading(snap, spark.createDataFrame(answers, kinds), folded, DEFAULT).collect()
    assert len(got) == 1  # three events make no two chunks
    r = got[0]
    # chunk means 22 and 30 against centre 20 and spread 4: z = 0.5 and 2.5, both of one sign and moving away
    assert (r["prediction_id"], r["reading_us"], r["direction"], r["value"], r["observations"]) == (1, 105 * m, "worsening", "worsening", 2) and r["state"] == "slight_deviation"
