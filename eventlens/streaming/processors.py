"""Online forms of the batch operators; each refuses what arrives late, as the batch forms do.

State is bounded for each key by the settings' retained values, points and answers, and by the sessions that are open.
Baseline, state and context keep theirs in ``transformWithState`` variables, which Spark holds in RocksDB (``keep_in_rocks``).
"""

from __future__ import annotations

import pickle
import statistics
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventlens.operators.baseline import DIMENSIONS, MAD_SCALE, RunningSpread
from eventlens.operators.validation import with_violations
from eventlens.settings import DEFAULT, Settings

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_in_rocks(spark: SparkSession) -> None:
    """State stores in RocksDB, which ``transformWithState`` asks for, unless the session names a provider."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(name, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(name, ROCKS)


def stream_ingest(stream: DataFrame, delay: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """ST1: (valid events, each event_id once within the watermark of ``ts``; rejected events with their violations)."""
    checked = with_violations(stream)
    good = checked.where(F.size("violations") == 0).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return good.drop("violations"), checked.where(F.size("violations") > 0)


class _Baseline(StatefulProcessor):
    """One profile a learner: centre, spread, count, latest instant and the retained values in order of arrival."""

    def __init__(self, s: Settings):
        self.s = s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", "n long, last long, centre double, spread double, kept array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last, centre, spread, kept = self.profile.get() if self.profile.exists() else (0, None, None, None, [])
        fold = RunningSpread(self.s, True).resume(n, centre, spread, kept)
        for r in sorted(rows, key=lambda r: (r["us"], r["value"] is None, r["value"] or 0.0)):
            why = "no_learner" if key[0] is None else "late" if last is not None and r["us"] <= last else None
            if why is None:
                fold.add(r["value"])
                last = r["us"]
            yield Row(learner_id=key[0], us=r["us"], n=fold.n, centre=fold.centre, spread=fold.spread, refused=why)
        if key[0] is not None:
            self.profile.update((fold.n, last, fold.centre, fold.spread, fold.arrived()))

    def close(self) -> None:
        pass


def stream_baseline(stream: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """ST2: ``(learner_id, us, value)`` -> a row for each observation with count, centre and spread after it.

    ``refused`` is null, late (not strictly after the learner's latest accepted observation) or no_learner;
    a refused observation changes nothing, and its row shows the profile as it stood.  Within a
    batch observations come in order of time.  ``split_refused`` parts the rows for two sinks.
    """
    keep_in_rocks(stream.sparkSession)
    return stream.select("learner_id", "us", F.col("value").cast("double").alias("value")).groupBy("learner_id").transformWithState(
        _Baseline(s), "learner_id string, us long, n long, centre double, spread double, refused string", "Append", "None"
    )


def split_refused(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the reason, refused rows with it) of a stream of ST2 or ST3, or of one of its batches."""
    return rows.where("refused IS NULL").drop("refused"), rows.where("refused IS NOT NULL")


def track(zs: list[float], s: Settings = DEFAULT) -> tuple[int, float, float, str]:
    """(run, its mean, dispersion, direction) of the measured values of one dimension, oldest first; as T2 to T5."""
    run = 0
    for z in reversed(zs):
        if abs(z) < s.material or (run and (z > 0) != (zs[-1] > 0)):
            break
        run += 1
    base = zs[-run:] if run >= 2 else zs[-5:]
    slope = (base[-1] - base[0]) / (len(base) - 1) if len(base) >= 2 else None
    way = "insufficient_data" if slope is None else "stable" if slope == 0 else "worsening" if (slope > 0) == (base[-1] > 0) and base[-1] != 0 else "improving"
    mean = 0.0
    for z in zs[len(zs) - run :]:  # one by one, oldest first, as the batch form and the SQL add; sum() compensates
        mean += z
    last = zs[-s.dispersion_points :]
    spread = 0.0
    if len(last) >= 2:
        mid = statistics.median(last)
        spread = MAD_SCALE * statistics.median(abs(z - mid) for z in last)
    return run, mean / run if run else 0.0, spread, way


def classify(zs: list[float], run: int, mean: float, way: str, s: Settings = DEFAULT) -> str:
    """State of the dominant dimension; the same ladder as T7."""
    if len(zs) < 2:
        return "insufficient_data"
    if run < s.run_length:
        return "stable" if run == 0 else "slight_deviation"
    if abs(mean) >= s.high_mean:
        return "high_deviation"
    return {"worsening": "declining", "improving": "recovering"}.get(way, "increasing_deviation")


class _State(StatefulProcessor):
    """The last points of each dimension, and the learner's latest instant, state and direction."""

    def __init__(self, s: Settings):
        self.s = s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "dimension string", "zs array<double>")
        self.latest = handle.getValueState("latest", "us long, state string, direction string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, before, way = self.latest.get() if self.latest.exists() else (None, "insufficient_data", "insufficient_data")
        held = {k[0]: list(v[0]) for k, v in self.points.iterator()}  # at most one list of points for each dimension
        for r in sorted(rows, key=lambda r: r["us"]):
            why = "no_learner" if key[0] is None else "late" if last is not None and r["us"] <= last else None
            if why:
                yield Row(learner_id=key[0], us=r["us"], from_state=None, to_state=None, run=None, dimension=None, direction=None, refused=why)
                continue
            for d in r["deviations"] or []:
                if d["dimension"] in DIMENSIONS:  # a point without z takes a place
                    held[d["dimension"]] = [*held.get(d["dimension"], []), d["z"]][-self.s.points :]
            best, name, zs, found = None, None, [], (0, 0.0, 0.0, "insufficient_data")
            for i, dimension in enumerate(DIMENSIONS):
                now = [z for z in held.get(dimension, []) if z is not None]
                if now:
                    got = track(now, self.s)
                    rank = (got[0], abs(got[1]), got[2], -i)
                    if best is None or rank > best:
                        best, name, zs, found = rank, dimension, now, got
            run, mean, _, toward = found
            state = classify(zs, run, mean, toward, self.s)
            way = toward if toward != "insufficient_data" else way
            last = r["us"]
            yield Row(
                learner_id=key[0], us=last, from_state=before, to_state=state, run=0 if state == "insufficient_data" else run, dimension=name, direction=way, refused=None
            )
            before = state
        if key[0] is not None and last is not None:
            for dimension, zs in held.items():
                self.points.updateValue((dimension,), (zs,))
            self.latest.update((last, before, way))

    def close(self) -> None:
        pass


def stream_state(stream: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """ST3: ``(learner_id, us, deviations)`` -> a transition for each observation, over all four dimensions.

    ``deviations`` is an array of (dimension, z) that one instant brings; a null z holds a place among
    the points but measures nothing, other dimensions are passed over.  The dominant dimension is
    chosen as by T6; direction is carried where nothing can be measured.  ``refused`` as in ST2.
    """
    keep_in_rocks(stream.sparkSession)
    only = F.transform("deviations", lambda d: F.struct(d["dimension"].alias("dimension"), d["z"].cast("double").alias("z")))
    return stream.select("learner_id", "us", only.alias("deviations")).groupBy("learner_id").transformWithState(
        _State(s), "learner_id string, us long, from_state string, to_state string, run long, dimension string, direction string, refused string", "Append", "None"
    )


#: What ST4 returns after the two keys.
CONTEXT_OUT = (
    "event_count long, last_us long, elapsed_seconds double, position double, start_inferred boolean, has_ended boolean, content_kind string, content_ref string, content_difficulty double, "
    "answer_count int, correct_count int, recent_accuracy double, recent_response double, interventions long, last_intervention_type string, last_intervention_us long, last_outcome string, "
    "seconds_since_last double, in_cooldown boolean, cooldown_remaining double, closed boolean"
)
_CONTENT = {"question_started": "question", "video_started": "video", "content_opened": "content"}


class _Session:
    """A session's record while a run works on it; ``done`` is the first completion of each intervention, ``due`` the time when it ends."""

    def __init__(self, state: tuple | None):
        self.n, self.starts, self.first, self.last, self.mark, self.content, self.start, self.done, self.answers, self.due = state or (0, 0, None, None, None, None, None, {}, [], None)

    def state(self) -> tuple:
        return self.n, self.starts, self.first, self.last, self.mark, self.content, self.start, self.done, self.answers, self.due

    def ended(self) -> bool:
        return self.mark is not None and self.mark[2] == "session_ended"


class _Context(StatefulProcessor):
    """The open sessions of a slot of learners: of each, order-free parts, the earliest, latest and newest of each kind by (us, event_id).

    Each call to the state is a trip to the JVM and each key's rows are a batch of their own, so learners share
    slots: a run reads and writes a slot once, and one timer waits for the first of its sessions that ends.
    """

    def __init__(self, s: Settings, idle_ms: int):
        self.s, self.idle_ms = s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # timer: when the slot is looked at again; sessions: their ``_Session.state()`` by (learner, session), pickled, since
        # nested rows would go with their schema, one by one
        self.open = handle.getValueState("open", "timer long, sessions binary")

    def held(self) -> tuple[int | None, dict]:
        got = self.open.get()
        return (got[0], pickle.loads(got[1])) if got is not None else (None, {})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, held = self.held()
        met: dict[tuple, _Session] = {}
        for slot, learner, session, _, us, event_id, kind, ref, number, word, correct, intervention in rows:
            name, at = (learner, session), (us, event_id)
            x = met.get(name)
            if x is None:
                x = met[name] = _Session(held.get(name))
            x.n += 1
            if x.first is None or (*at, kind) < x.first:
                x.first = (*at, kind)
            if x.last is None or at > x.last:
                x.last = at
            if kind in ("session_started", "session_ended"):
                x.mark = max(x.mark or (*at, kind), (*at, kind))
            elif kind in _CONTENT:
                if x.content is None or at > x.content[:2]:
                    x.content = (*at, _CONTENT[kind], ref, number)
            elif kind == "question_answered":
                insort(x.answers, (*at, int(bool(correct)), number), key=lambda a: a[:2])
                del x.answers[: -self.s.recent_answers]
            elif kind == "intervention_started":
                x.starts += 1
                if x.start is None or at > x.start[:2]:
                    x.start = (*at, word, intervention)
            elif kind == "intervention_completed" and intervention is not None:
                before = x.done.get(intervention)
                if before is None or at < before[:2]:
                    x.done[intervention] = (*at, word)
        first = None
        for name, x in met.items():
            # an ended session waits only for what may still arrive late
            x.due = max(x.last[0] // 1000 + (1 if x.ended() else self.idle_ms), timerValues.getCurrentWatermarkInMs() + 1)
            first = x.due if first is None else min(first, x.due)
            held[name] = x.state()
            yield self.row(name, x, x.ended())
        self.keep(timer, first, held)

    def keep(self, timer: int | None, first: int | None, held: dict) -> None:
        """Writes the slot; a timer is set where none would fire by ``first``."""
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        self.open.update((timer, pickle.dumps(held, pickle.HIGHEST_PROTOCOL)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, held = self.held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        if timer is None or timer > now:  # one that another came before
            return
        first = None
        for name, state in list(held.items()):
            x = _Session(state)
            if x.due > now:
                first = x.due if first is None else min(first, x.due)
                continue
            del held[name]
            if not x.ended():  # an ended one was reported as closed
                yield self.row(name, x, True)
        if held:
            self.keep(None, first, held)
        else:
            self.open.clear()

    def row(self, name: tuple, x: _Session, closed: bool) -> Row:
        done = x.done.get(x.start[3]) if x.start and x.start[3] is not None else None
        elapsed = (x.last[0] - x.first[0]) / 1e6
        right, timed = sum(a[2] for a in x.answers), all(a[3] is not None for a in x.answers)
        since = (x.last[0] - x.start[0]) / 1e6 if x.start else None
        cool = since is not None and since < self.s.context_cooldown
        n = len(x.answers)
        return Row(
            learner_id=name[0], session_id=name[1], event_count=x.n, last_us=x.last[0], elapsed_seconds=elapsed, position=max(0.0, min(1.0, elapsed / self.s.expected_session)),
            start_inferred=x.first[2] != "session_started", has_ended=x.ended(), content_kind=x.content and x.content[2], content_ref=x.content and x.content[3], content_difficulty=x.content and x.content[4],
            answer_count=n, correct_count=right, recent_accuracy=right / n if n else None, recent_response=sum(a[3] for a in x.answers) / n if n and timed else None,
            interventions=x.starts, last_intervention_type=x.start and x.start[2], last_intervention_us=x.start and x.start[0], last_outcome=done and done[2],
            seconds_since_last=since, in_cooldown=cool, cooldown_remaining=self.s.context_cooldown - since if cool else None, closed=closed,
        )

    def close(self) -> None:
        pass


#: Slots that learners share: a slot is read and written as a whole, so more of them suit more learners.
SLOTS = 8192

CONTEXT_IN = ("question_id", "content_id", "difficulty", "correct", "response_seconds", "intervention_id", "intervention_type", "outcome")


def stream_context(stream: DataFrame, s: Settings = DEFAULT, idle_ms: int = 86_400_000, delay: str = "2 hours", slots: int = SLOTS) -> DataFrame:
    """ST4: events of known sessions -> the running context (C1 to C4) of each session that a batch touches.

    A row holds what the batch forms give at the last event of those that have arrived, in whatever
    order they came.  A session is reported as closed when session_ended is its last mark, and once the
    watermark of ``ts`` (``delay`` behind the newest) passes its last event by ``idle_ms``; then its
    state goes.  Events behind the watermark are dropped.  Timers expire sessions rather than a TTL, which
    Spark offers for processing time only.  Sessions are those of learner_id and session_id; state is dealt by
    ``slots`` of learners (without a learner, of sessions), so their number is fixed for a checkpoint's life.
    """
    keep_in_rocks(stream.sparkSession)
    kinds = dict(stream.dtypes)
    given = {c: F.col(c) if c in kinds else F.lit(None).cast("string") for c in CONTEXT_IN}
    is_ = lambda *t: F.col("event_type").isin(*t)
    # what only some kinds have shares columns, each of which costs the worker a conversion
    fields = {
        "ref": F.when(is_("question_started"), given["question_id"].cast("string")).when(is_(*_CONTENT), given["content_id"].cast("string")),
        "number": F.when(is_(*_CONTENT), given["difficulty"].cast("double")).when(is_("question_answered"), given["response_seconds"].cast("double")),
        "word": F.when(is_("intervention_started"), given["intervention_type"]).when(is_("intervention_completed"), given["outcome"]),
        "correct": F.when(is_("question_answered"), given["correct"]), "intervention_id": F.when(is_("intervention_started", "intervention_completed"), given["intervention_id"]),
    }
    slot = F.pmod(F.xxhash64(F.coalesce("learner_id", "session_id")), F.lit(slots)).cast("int").alias("slot")
    events = stream.select(slot, "learner_id", "session_id", "ts", "us", "event_id", "event_type", *[c.alias(n) for n, c in fields.items()])
    return events.withWatermark("ts", delay).groupBy("slot").transformWithState(_Context(s, idle_ms), f"learner_id string, session_id string, {CONTEXT_OUT}", "Update", "EventTime")


def stream_sessions(stream: DataFrame, gap: str = "24 hours", delay: str = "2 hours") -> DataFrame:
    """ST4 for streams without session ids: sessions end at ``gap`` without an event of the learner.

    One row for each session once the watermark passes its end: progress, answers, newest content and
    newest intervention.  Spark merges session windows; no state of ours is kept.
    """
    kind: Column = F.col("event_type")
    is_ = lambda *t: kind.isin(*t)
    at = F.struct("us", "event_id")
    got = stream.withWatermark("ts", delay).groupBy("learner_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("event_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count_if(is_("question_answered")).alias("answers"), F.count_if(is_("question_answered") & F.coalesce(F.col("correct"), F.lit(False))).alias("correct"),
        F.max_by(F.when(is_(*_CONTENT), kind), F.when(is_(*_CONTENT), at)).alias("content_event"), F.max_by(F.col("difficulty"), F.when(is_(*_CONTENT), at)).alias("content_difficulty"),
        F.count_if(is_("intervention_started")).alias("interventions"), F.max_by(F.col("intervention_type"), F.when(is_("intervention_started"), at)).alias("last_intervention_type"),
    )
    return got.select("learner_id", "first_us", "event_count", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("elapsed_seconds"), "answers", "correct", "content_event", "content_difficulty", "interventions", "last_intervention_type")


def stream_caps(stream: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """ST5: ``(learner_id, session_id, us, decision_id)`` of deliveries (no decision_id) and decisions -> the caps on each decision.

    Each decision is held against the learner's deliveries up to its instant that have arrived; those
    of its own batch come in order of time, deliveries first.  State holds the deliveries of the
    last two windows and those of the newest session: no delivery is read again.  A decision that is
    late by more than a window counts what is left.
    """
    width = int(s.cap_window * 1e6)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [] if not state.exists else [tuple(x) for x in zip(*state.get)]  # (us, session) of deliveries
        rows = []
        arrived = sorted((int(r.us), not pd.isna(r.decision_id), -1 if pd.isna(r.decision_id) else int(r.decision_id), r.session_id) for b in batches for r in b.itertuples(index=False))
        for us, asks, decision, session in arrived:
            if not asks:
                held.append((us, session))
                continue
            past = [x for x in held if x[0] <= us]
            inside = sum(t > us - width for t, _ in past)
            here = sum(x == session for _, x in past)
            since = (us - max(t for t, _ in past)) / 1e6 if past else None
            cap = "in_cooldown" if since is not None and since < s.policy_cooldown else "session_cap_reached" if here >= s.session_cap else "window_cap_reached" if inside >= s.window_cap else None
            rows.append((decision, here, inside, since, cap))
        if held:
            held.sort()
            newest, last = held[-1][0], held[-1][1]
            held = [x for x in held if x[0] > newest - 2 * width or x[1] == last]
        state.update(tuple(list(x) for x in zip(*held)) if held else ([], []))
        yield pd.DataFrame(rows, columns=["decision_id", "in_session", "in_window", "seconds_since_last", "cap"])

    return stream.groupBy("learner_id").applyInPandasWithState(
        advance, "decision_id long, in_session long, in_window long, seconds_since_last double, cap string", "us array<long>, session array<string>", "append", GroupStateTimeout.NoTimeout
    )
