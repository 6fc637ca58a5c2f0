"""Session context, at every event (running) or at the end of each session.

Keys are ``learner_id, session_id``; order is ``(us, event_id)``.  Running forms are windows
over one sort of a session; end forms take the last running row or one aggregate.  Answers and
interventions are first read in one other sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.settings import DEFAULT, Settings

KEYS = ("learner_id", "session_id")

#: Keys that may be missing from a context, and those that block its interpretation.
CONTEXT_KEYS = ("elapsed_seconds", "position", "content_type", "content_difficulty", "recent_accuracy", "recent_response", "answer_count", "intervention_history", "cooldown_status", "trajectory", "baseline_maturity")
BLOCKING = ("elapsed_seconds", "content_type", "recent_accuracy", "answer_count", "baseline_maturity")


def running() -> Window:
    return Window.partitionBy(*KEYS).orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def is_last() -> Column:
    """Whether no row of the session follows, in the order of the running forms, which are sorted so already."""
    return F.lead(F.lit(True)).over(Window.partitionBy(*KEYS).orderBy("us", "event_id")).isNull()


def end_of_session(df: DataFrame) -> DataFrame:
    """The last row of each session of a running frame."""
    return df.withColumn("_last", is_last()).where("_last").drop("_last")


@dataclass(frozen=True)
class Step:
    """Columns of a context: those over a session's rows as ``dealt`` orders them, running ones, and what follows from both."""

    running: dict[str, Column]
    derived: dict[str, Column]
    dealt: dict[str, Column] = field(default_factory=dict)


def dealt() -> Window:
    """A session's rows by intervention, the completions first, and then its answers, each in time order."""
    return Window.partitionBy(*KEYS).orderBy("_answered", "_id", "_open", "us", "event_id")


def together(df: DataFrame, *steps: Step) -> DataFrame:
    """The steps' columns from one sort of each session, and one more before it where a step needs its rows dealt."""
    every = {k: c for s in steps for k, c in s.dealt.items()}
    if every:
        answered = F.coalesce(_is("question_answered"), F.lit(False))
        df = df.withColumns({"_answered": answered, "_id": F.when(~answered, F.col("intervention_id")) if "intervention_id" in df.columns else F.lit(None).cast("string"), "_open": ~F.coalesce(_is("intervention_completed"), F.lit(False))})
        df = df.withColumn("_before", F.lag("_id").over(dealt())).withColumns(every)
    running = {k: c for s in steps for k, c in s.running.items()}
    derived = {k: c for s in steps for k, c in s.derived.items()}
    return df.withColumns(running).withColumns(derived).drop(*running, *every, "_answered", "_id", "_open", "_before")


def _progress(s: Settings) -> Step:
    w = running()
    mark = F.last(F.when(_is("session_started", "session_ended"), F.col("event_type")), True).over(w)
    elapsed = (F.col("_max") - F.col("_first")) / 1e6
    return Step({"_max": F.max("us").over(w), "_first": F.first("us").over(w), "_count": F.count("*").over(w), "_began": F.first("event_type").over(w), "_mark": mark}, {
        "elapsed_seconds": elapsed,
        "position": F.greatest(F.lit(0.0), F.least(F.lit(1.0), elapsed / s.expected_session)),
        "event_count": F.col("_count"),
        "start_inferred": F.col("_began") != "session_started",
        "has_ended": F.coalesce(F.col("_mark") == "session_ended", F.lit(False)),
    })


def session_progress(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds elapsed_seconds, position (0 to 1), event_count, start_inferred and has_ended, on event time."""
    return together(df, _progress(s))


def _content() -> Step:
    kind = F.when(_is("question_started"), "question").when(_is("video_started"), "video").when(_is("content_opened"), "content")
    ref = F.when(_is("question_started"), F.col("question_id")).otherwise(F.col("content_id"))
    record = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), ref.alias("ref"), F.col("difficulty")))
    return Step({"_c": F.last(record, True).over(running())}, {"content_kind": F.col("_c.kind"), "content_ref": F.col("_c.ref"), "content_difficulty": F.col("_c.difficulty")})


def current_content(df: DataFrame) -> DataFrame:
    """Adds content_kind, content_ref and content_difficulty of the most recent question, video or content;
    each replaces the whole record, so a difficulty does not outlive its question."""
    return together(df, _content())


def _performance(s: Settings) -> Step:
    # sums over the last n answers: dealt, a session's answers lie together at its end, and what lies before them adds
    # nothing; each later row carries those of the answer before it
    answered, last = F.col("_answered"), dealt().rowsBetween(1 - s.recent_answers, 0)
    right, slow = F.sum(F.when(answered, F.coalesce(F.col("correct").cast("int"), F.lit(0)))).over(last), F.sum(F.when(answered, F.col("response_seconds"))).over(last)
    n, timed = F.count_if(answered).over(last), F.count_if(answered & F.col("response_seconds").isNotNull()).over(last)
    sums = F.struct(n.cast("int").alias("n"), right.cast("int").alias("right"), F.when(timed == n, slow).alias("slow"))
    return Step({"_a": F.last("_s", True).over(running())}, {
        "answer_count": F.coalesce("_a.n", F.lit(0)), "correct_count": F.coalesce("_a.right", F.lit(0)),
        "recent_accuracy": F.try_divide("_a.right", "_a.n"), "recent_response": F.try_divide("_a.slow", "_a.n"),
    }, {"_s": F.when(answered, sums)})


def recent_performance(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds answer_count, correct_count, recent_accuracy and recent_response over the last n answers of
    the session; accuracy and response are null without answers."""
    return together(df, _performance(s))


def recent_performance_at_end(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """C3 at the end of each session, as one aggregate over ranked answers."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("us"), F.desc("event_id"))
    last = df.where(_is("question_answered")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s.recent_answers)
    got = last.groupBy(*KEYS).agg(F.count("*").cast("int").alias("answer_count"), F.count_if("correct").alias("correct_count"), F.avg(F.col("correct").cast("int")).alias("recent_accuracy"), F.avg("response_seconds").alias("recent_response"))
    return df.select(*KEYS).distinct().join(got, list(KEYS), "left").na.fill(0, ["answer_count", "correct_count"])


def _interventions(s: Settings) -> Step:
    w, start = running(), _is("intervention_started")
    # dealt, the first completion of an id is the first row of it; it counts from its own row on
    completion = F.when(~F.col("_open") & ~F.col("_before").eqNullSafe(F.col("_id")), F.struct("_id", "us", "event_id", "outcome"))
    first = F.last(completion, True).over(dealt().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(start, F.struct("intervention_type", "us", F.when(F.col("_d._id") == F.col("_id"), F.col("_d")).alias("done"))), True).over(w)
    since = (F.col("us") - F.col("_l.us")) / 1e6
    outcome = F.when(F.struct(F.col("_l.done.us").alias("us"), F.col("_l.done.event_id").alias("event_id")) <= F.struct("us", "event_id"), F.col("_l.done.outcome"))
    cool = F.coalesce(since < s.context_cooldown, F.lit(False))
    return Step({"_starts": F.count_if(start).over(w), "_l": last}, {
        "interventions": F.col("_starts"), "last_intervention_type": F.col("_l.intervention_type"), "last_intervention_us": F.col("_l.us"), "last_outcome": outcome, "seconds_since_last": since,
        "in_cooldown": cool, "cooldown_remaining": F.when(cool, s.context_cooldown - since),
    }, {"_d": first})


def intervention_status(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """C4: adds interventions (starts so far), last type, instant and outcome, seconds_since_last,
    in_cooldown (strictly less than the cooldown) and cooldown_remaining.

    A completion attaches to the first start with its id in the session; the last start's
    outcome is that of its first completion so far.
    """
    return together(df, _interventions(s))


def missing_keys(df: DataFrame) -> DataFrame:
    """Adds missing_keys, blocking_keys and interpretable from the context columns that the frame has.

    intervention_history is missing without interventions, cooldown_status without seconds_since_last,
    answer_count while it is 0; a key whose column the frame lacks is missing.
    """
    column = {"content_type": "content_kind"}

    def gone(k: str) -> Column:
        if k == "intervention_history":
            return F.col("interventions") == 0
        if k == "cooldown_status":
            return F.col("seconds_since_last").isNull()
        name = column.get(k, k)
        if name not in df.columns:
            return F.lit(True)
        return F.coalesce(F.col(name) == 0, F.lit(True)) if k == "answer_count" else F.col(name).isNull()

    missing = F.array_compact(F.array(*[F.when(gone(k), F.lit(k)) for k in CONTEXT_KEYS]))
    df = df.withColumn("missing_keys", missing).withColumn("blocking_keys", F.array_intersect("missing_keys", F.array(*map(F.lit, BLOCKING))))
    return df.withColumn("interpretable", F.size("blocking_keys") == 0)


def origin_of(real: Column, synthetic: Column) -> Column:
    return F.when(real & synthetic, "mixed").when(real, "real").when(synthetic, "synthetic").otherwise("unknown")


def _origin() -> Step:
    w = running()
    label = origin_of(F.col("_real"), F.col("_synthetic"))
    return Step({"_real": F.bool_or(F.col("origin") == "real").over(w), "_synthetic": F.bool_or(F.col("origin") == "synthetic").over(w)}, {"origin_label": label, "synthetic_only": label == "synthetic"})


def origin_label(df: DataFrame) -> DataFrame:
    """Adds origin_label and synthetic_only of the session so far."""
    return together(df, _origin())


def seen_event_types(df: DataFrame) -> DataFrame:
    """Adds the sorted set of event types of the session so far."""
    return df.withColumn("seen_types", F.array_sort(F.collect_set("event_type").over(running())))


def session_context(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """C1 to C6 at every event, over two sorts of each session."""
    return together(df, _progress(s), _content(), _performance(s), _interventions(s), _origin())
