"""Streamed operators over several runs: late rows, timers, closed sessions, restarts, and the running spread."""

import random
import statistics
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventlens.operators import baseline as B
from eventlens.operators import context as C
from eventlens.operators import temporal as T
from eventlens.settings import DEFAULT, SPARSE
from eventlens.streaming import processors as P

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = (
    "learner_id string, session_id string, ts timestamp, us long, event_id long, event_type string, question_id string, content_id string, difficulty double, correct boolean, "
    "response_seconds double, intervention_id string, intervention_type string, outcome string"
)


def event(n, minute, kind, session="s1", **more):
    ts = T0 + timedelta(minutes=minute)
    at = {"learner_id": "a", "session_id": session, "ts": ts, "us": int(ts.timestamp() * 1_000_000), "event_id": n, "event_type": kind}
    return {c.split()[0]: (at | more).get(c.split()[0]) for c in LOG.split(", ")}


def runs(spark, folder, batches, schema, process, mode="append"):
    """Runs the stream once for each batch, each from the checkpoint before: the rows of each run."""
    got = []
    for rows in batches:
        spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else r for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        here = []

        def sink(batch, number, here=here):
            here.extend(batch.collect())

        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        process(stream).writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        got.append(here)
    return got


def test_context_survives_disorder_and_restarts(spark, tmp_path):
    """After each run the streamed context is what the batch forms give over all that has arrived."""
    rng = random.Random(4)
    kinds = ["question_started", "content_opened", "question_answered", "intervention_started", "intervention_completed", "interaction", "session_started", "session_ended", "video_started"]
    log = [
        event(
            n, rng.randint(0, 240), rng.choice(kinds), rng.choice(["s1", "s2"]), question_id=f"q{n % 5}", content_id=f"c{n % 3}", difficulty=rng.choice([None, 0.25, 0.5]), correct=rng.choice([True, False, None]),
            response_seconds=rng.choice([1.0, 2.5, 4.0]), intervention_id=f"i{n % 6}", intervention_type="recap", outcome=rng.choice(["accepted", "ignored"]),
        )
        for n in range(120)
    ]
    small = replace(DEFAULT, recent_answers=4)
    batches = [log[:50], log[50:51], log[51:]]
    got = runs(spark, str(tmp_path), batches, LOG, lambda x: P.stream_context(x, small, delay="30 days"), "update")
    for upto, rows in zip((50, 51, 120), got):
        df = spark.createDataFrame([tuple(r.values()) for r in log[:upto]], LOG).withColumn("origin", F.lit("real"))
        want = {r["session_id"]: r for r in C.end_of_session(C.session_context(df, small)).collect()}
        assert rows
        for r in rows:
            w = want[r["session_id"]]
            same = [c for c in r.asDict() if c not in ("learner_id", "closed", "last_us")]
            assert r["last_us"] == w["us"] and r["closed"] == r["has_ended"]
            for c in same:
                assert r[c] == (pytest.approx(w[c]) if isinstance(w[c], float) else w[c]), c
    assert {r["session_id"] for r in got[1]} == {log[50]["session_id"]}  # only sessions that the run touched


def test_sessions_close_by_end_and_by_timer(spark, tmp_path):
    batches = [
        [event(1, 0, "session_started", "ends"), event(2, 1, "question_answered", "ends", correct=True), event(3, 2, "session_started", "idles")],
        [event(4, 3, "session_ended", "ends")],
        [event(5, 60 * 30, "interaction", "later")],  # the watermark passes the idle session by more than an hour
        [event(6, 5, "interaction", "idles"), event(7, 60 * 30 + 1, "interaction", "later")],  # behind the watermark: dropped
    ]
    got = runs(spark, str(tmp_path), batches, LOG, lambda x: P.stream_context(x, idle_ms=3_600_000), "update")
    seen = [sorted((r["session_id"], r["event_count"], r["has_ended"], r["closed"]) for r in rows) for rows in got]
    assert seen[0] == [("ends", 2, False, False), ("idles", 1, False, False)]
    assert seen[1] == [("ends", 3, True, True)]
    assert seen[2] == [("idles", 1, False, True), ("later", 1, False, False)]
    assert seen[3] == [("later", 2, False, False)]


def test_streams_without_session_ids(spark, tmp_path):
    log = [event(1, 0, "question_started", difficulty=0.5), event(2, 10, "question_answered", correct=True), event(3, 100, "intervention_started", intervention_type="pause"), event(4, 60 * 50, "interaction")]
    got = runs(spark, str(tmp_path), [log, [event(9, 60 * 200, "interaction")]], LOG, lambda x: P.stream_sessions(x, "2 hours"))
    # the second session is done once the watermark passes it, the last one isn't
    rows = sorted((r["event_count"], r["elapsed_seconds"], r["answers"], r["correct"], r["content_event"], r["content_difficulty"], r["interventions"], r["last_intervention_type"]) for run in got for r in run)
    assert rows == [(1, 0.0, 0, 0, None, None, 0, None), (3, 6000.0, 1, 1, "question_started", 0.5, 1, "pause")]


def test_late_observations_go_to_their_own_sink(spark, tmp_path):
    batches = [[("a", 10, 1.0), ("a", 20, 3.0), ("b", 5, None)], [("a", 20, 9.0), ("a", 15, 9.0), ("a", 30, 5.0), (None, 1, 1.0)]]
    got = runs(spark, str(tmp_path), batches, "learner_id string, us long, value double", lambda x: P.stream_baseline(x, DEFAULT))
    rows = spark.createDataFrame([tuple(r) for run in got for r in run], "learner_id string, us long, n long, centre double, spread double, refused string")
    kept, refused = P.split_refused(rows)
    assert sorted((r["us"], r["n"], r["centre"]) for r in kept.where("learner_id = 'a'").collect()) == [(10, 1, 1.0), (20, 2, pytest.approx(1.1)), (30, 3, pytest.approx(1.295))]
    assert sorted((r["us"], r["refused"]) for r in refused.collect()) == [(1, "no_learner"), (15, "late"), (20, "late")]
    batch = B.winsorised_ewma(kept.where("learner_id = 'a'").select("learner_id", "us", F.when(F.col("us") == 10, 1.0).when(F.col("us") == 20, 3.0).otherwise(5.0).alias("value")), ["learner_id"], ["us"], "value")
    assert {r["us"]: r["spread"] for r in batch.collect()} == {r["us"]: r["spread"] for r in kept.where("learner_id = 'a'").collect()}


def test_state_is_chosen_over_four_dimensions(spark, tmp_path):
    kind = "learner_id string, us long, deviations array<struct<dimension:string,z:double>>"
    batches = [
        [("a", 1, [("accuracy", 0.0), ("response_seconds", 1.0)]), ("a", 2, [("accuracy", None), ("response_seconds", 2.0), ("unknown", 9.0)])],
        [("a", 3, [("accuracy", 0.5), ("response_seconds", 3.5)]), ("a", 2, [("accuracy", 9.0)]), ("a", 4, None), (None, 4, [])],
    ]
    got = runs(spark, str(tmp_path), batches, kind, lambda x: P.stream_state(x, DEFAULT))
    rows = sorted(((r["us"], r["refused"] or "", r["from_state"], r["to_state"], r["run"], r["dimension"], r["direction"]) for run in got for r in run), key=repr)
    assert rows == [
        (1, "", "insufficient_data", "insufficient_data", 0, "response_seconds", "insufficient_data"),
        (2, "", "insufficient_data", "slight_deviation", 2, "response_seconds", "worsening"),
        (2, "late", None, None, None, None, None),
        (3, "", "slight_deviation", "high_deviation", 3, "response_seconds", "worsening"),
        (4, "", "high_deviation", "high_deviation", 3, "response_seconds", "worsening"),
        (4, "no_learner", None, None, None, None, None),
    ]


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_streamed_state_adds_a_run_as_the_batch_form(spark, tmp_path, sign):
    """0.1 + 0.2 + 0.3 equals 0.2 + 0.2 + 0.2 in doubles if the oldest is added first: then dispersion decides, over two runs too."""
    kind = "learner_id string, us long, deviations array<struct<dimension:string,z:double>>"
    rows = [("a", i + 1, [("accuracy", 0.2), ("response_seconds", sign * z)]) for i, z in enumerate((0.1, 0.2, 0.3))]
    got = [r for run in runs(spark, str(tmp_path), [rows[:2], rows[2:]], kind, lambda x: P.stream_state(x, SPARSE)) for r in run]
    dev = spark.createDataFrame([(k, us, d, z, us) for k, us, at in rows for d, z in at], "learner_id string, us long, dimension string, z double, n int")
    want = T.state_history(dev, SPARSE).collect()
    assert sorted((r["us"], r["dimension"], r["run"], r["to_state"], r["direction"]) for r in got) == sorted((r["us"], r["dimension"], r["evidence_run"], r["state"], r["direction"]) for r in want)
    assert max(got, key=lambda r: r["us"])["dimension"] == "response_seconds"


def test_running_spread_against_sorting(spark):
    rng = random.Random(2)
    for limit in (1, 2, 5, 6, 50):
        s = replace(SPARSE, retained=limit)
        for robust in (True, False):
            fold, kept, centre, spread = B.RunningSpread(s, robust), [], None, None
            for i in range(300):
                x = rng.choice([rng.gauss(0, 1), float(rng.randint(-2, 2)), 50.0])
                if i == 150:  # as a stream does between batches
                    fold = B.RunningSpread(s, robust).resume(fold.n, fold.centre, fold.spread, fold.arrived())
                step = 0.0 if centre is None else x - centre
                if robust and spread:
                    step = max(-s.step_limit * spread, min(s.step_limit * spread, step))
                centre = x if centre is None else centre + s.alpha * step
                kept.append(x)
                if len(kept) > limit:
                    kept = kept[1::2] + (kept[-1:] if len(kept) % 2 else [])
                if len(kept) > 1:
                    away = [abs(v - centre) for v in kept]
                    spread = B.MAD_SCALE * statistics.median(away) if robust else (sum(a * a for a in away) / (len(kept) - 1)) ** 0.5
                n, c, sp, held = fold.add(x)
                assert (n, held) == (i + 1, len(kept)) and c == pytest.approx(centre) and sp == (None if spread is None else pytest.approx(spread))
    fold.add(None)
    fold.add(float("nan"))
    assert fold.n == 302 and fold.centre == pytest.approx(centre)


class CountingHandle:
    """A handle whose value state and timers are held here; each call counts."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class At:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def test_context_calls_the_state_once_for_many_sessions():
    """Rows of 200 sessions cost three calls; sessions end each at its own time, though one timer waits for all."""
    handle = CountingHandle()
    held = P._Context(DEFAULT, 1000)
    held.init(handle)
    row = lambda i, us, kind: (0, f"a{i % 50}" if i else None, f"s{i}", None, us, i, kind, None, None, None, True, None)
    first = list(held.handleInputRows((0,), iter([row(i, i * 1_000_000, "question_answered") for i in range(200)]), At(-1)))
    assert handle.calls == 3 and handle.timers == {1000} and len({(r["learner_id"], r["session_id"]) for r in first}) == 200
    again = list(held.handleInputRows((0,), iter([row(0, 5_000_000, "interaction"), row(7, 8_000_000, "session_ended")]), At(-1)))
    assert handle.calls == 5 and sorted((r["session_id"], r["event_count"], r["closed"]) for r in again) == [("s0", 2, False), ("s7", 2, True)]
    ends = {f"s{i}": i * 1000 + 1000 for i in range(200)} | {"s0": 6000, "s7": 8001}
    seen, now = {}, 0
    while handle.timers:
        now = min(handle.timers)
        gone = list(held.handleExpiredTimer((0,), At(now), At(now)))
        handle.timers.discard(now)
        assert all(r["closed"] for r in gone)
        seen |= {r["session_id"]: now for r in gone}
    assert seen == {k: v for k, v in ends.items() if k != "s7"} and handle.value is None and now == 200_000
