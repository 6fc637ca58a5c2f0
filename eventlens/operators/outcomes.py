"""Outcomes of deliveries: seven before/after measures, from one interval join.

Deliveries have ``learner_id, session_id, intervention_id, delivered_us, outcome, response_seconds``.
Windows are half-open: before [t - before, t), after [t, t + after), immediate [t, t + immediate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.policy import outcome_class
from eventlens.settings import DEFAULT, Settings

#: Fixed values.
ACTIVITY = ("content_opened", "interaction", "page_changed", "question_answered", "question_reviewed", "question_skipped", "question_started", "video_resumed", "video_started")
MEASURES = ("immediate_interaction_change", "continued_activity", "accuracy_change", "response_latency_change", "task_persistence", "session_continuation", "subsequent_trajectory")


def _us(seconds: float) -> int:
    return int(seconds * 1_000_000)


def outcome_windows(deliveries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """O1: adds before_start, after_end and immediate_end (microseconds); all windows meet at delivered_us."""
    t = F.col("delivered_us")
    return deliveries.withColumns({"before_start": t - _us(s.before), "after_end": t + _us(s.after), "immediate_end": t + _us(s.immediate)})


def interval_join(left: DataFrame, right: DataFrame, key: str, lo: str, hi: str, time: str, width_us: int) -> DataFrame:
    """Rows of ``right`` with lo <= time < hi of ``left``, joined on key and a time bucket of ``width_us``.

    The bucket is part of the join key, so a busy key is spread over its buckets; a left row goes to the
    few buckets that its interval touches.
    """
    bucket = lambda c: F.floor(c / width_us)
    a = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi) - 1))))
    return a.join(right.withColumn("_b", bucket(F.col(time))), [key, "_b"]).where((F.col(time) >= F.col(lo)) & (F.col(time) < F.col(hi))).drop("_b")


def window_join(deliveries: DataFrame, events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """O2: (intervention_id, event columns, side): each event of the learner in the before or after window."""
    d = outcome_windows(deliveries, s).select("learner_id", "intervention_id", "delivered_us", "before_start", "after_end", "immediate_end")
    j = interval_join(d, events.drop("session_id", "intervention_id"), "learner_id", "before_start", "after_end", "us", max(_us(s.before), _us(s.after)))
    return j.withColumn("side", F.when(F.col("us") < F.col("delivered_us"), "before").otherwise("after"))


def direction_of(before: Column, after: Column, lower_is_better: bool, tolerance: float, slack: float = 1e-12) -> Column:
    """O3: no_change up to tolerance * max(|before|, 1), boundary included within a relative ``slack``."""
    d, x = F.abs(after - before), tolerance * F.greatest(F.abs(before), F.lit(1.0))
    same = (d <= x) | (F.abs(d - x) <= slack * F.greatest(F.abs(d), F.abs(x)))
    better = after < before if lower_is_better else after > before
    return F.when(same, "no_change").when(better, "improved").otherwise("deteriorated")


def window_facts(deliveries: DataFrame, events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each delivery with all that the measures need, from one pass over the interval join."""
    active, answer = F.col("event_type").isin(*ACTIVITY), F.col("event_type") == "question_answered"
    before, after, now = F.col("side") == "before", F.col("side") == "after", F.col("us") < F.col("immediate_end")
    j = window_join(deliveries, events, s)
    # items are collected from one row for each of them, so that the windows' many events meet in plain sums
    touched = after & F.col("event_type").isin("content_opened", "content_closed")
    j = j.withColumns({"_kind": F.when(touched, F.col("event_type")), "_item": F.when(touched, F.col("content_id"))})
    part = j.groupBy("intervention_id", "_kind", "_item").agg(
        F.count_if(active & before).alias("n_before"), F.count_if(active & after).alias("n_after"), F.count_if(active & after & now).alias("n_immediate"),
        *[x for side, at in (("before", before), ("after", after)) for x in (F.sum(F.when(answer & at, F.col("correct").cast("int"))).alias(f"_right_{side}"), F.count(F.when(answer & at, F.col("correct"))).alias(f"_marked_{side}"))],
        F.count_if(answer & before).alias("answers_before"), F.count_if(answer & after).alias("answers_after"),
        F.sum(F.when(answer & before, F.col("response_seconds"))).alias("_slow"), F.count(F.when(answer & before, F.col("response_seconds"))).alias("_timed"), F.bool_or(F.col("origin") == "real").alias("any_real"),
    )
    ratio = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    g = part.groupBy("intervention_id").agg(
        F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"), F.sum("n_immediate").alias("n_immediate"),
        ratio("_right_before", "_marked_before").alias("accuracy_before"), ratio("_right_after", "_marked_after").alias("accuracy_after"),
        F.sum("answers_before").alias("answers_before"), F.sum("answers_after").alias("answers_after"), ratio("_slow", "_timed").alias("latency_before"),
        F.collect_set(F.when(F.col("_kind") == "content_opened", F.col("_item"))).alias("opened"), F.collect_set(F.when(F.col("_kind") == "content_closed", F.col("_item"))).alias("closed"),
        F.bool_or("any_real").alias("any_real"),
    )
    counts = ["n_before", "n_after", "n_immediate", "answers_before", "answers_after"]
    d = outcome_windows(deliveries, s).join(g, "intervention_id", "left").na.fill(0, counts)
    # the item last opened strictly before the delivery: an as-of join as a window over both
    opened = events.where("event_type = 'content_opened'").select("learner_id", "us", "event_id", F.lit(1).alias("_k"), "content_id", F.lit(None).cast(dict(deliveries.dtypes)["intervention_id"]).alias("intervention_id"))
    marks = opened.unionByName(deliveries.select("learner_id", F.col("delivered_us").alias("us"), F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("_k"), F.lit(None).cast("string").alias("content_id"), "intervention_id"))
    w = Window.partitionBy("learner_id").orderBy("us", "_k", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tracked = marks.withColumn("tracked", F.last("content_id", True).over(w)).where("_k = 0").select("intervention_id", "tracked")
    ends = events.groupBy("session_id").agg(F.min(F.when(F.col("event_type") == "session_ended", F.col("us"))).alias("ended_us"), F.max("us").alias("last_us"))
    return d.join(tracked, "intervention_id", "left").join(ends, "session_id", "left")


def _measure(name: str, status: Column, direction: Column, before: Column, after: Column, n_before: Column, n_after: Column) -> Column:
    measured = status == "measured"
    return F.struct(
        F.lit(name).alias("measure"), status.alias("status"), F.when(measured, direction).otherwise("not_assessed").alias("direction"),
        before.cast("double").alias("before_value"), after.cast("double").alias("after_value"), n_before.cast("long").alias("before_samples"), n_after.cast("long").alias("after_samples"),
    )


def _enough(a: Column, b: Column, least: int) -> Column:
    return F.when((a >= least) & (b >= least), "measured").otherwise("insufficient_data")


def interaction_measures(s: Settings) -> list[Column]:
    """Activity events a minute, each side with ``outcome_samples`` or more."""
    rate = lambda n, seconds: F.col(n) / (seconds / 60.0)
    b, out = rate("n_before", s.before), []
    for name, n, width in (("immediate_interaction_change", "n_immediate", s.immediate), ("continued_activity", "n_after", s.after)):
        a = rate(n, width)
        ok = F.col("n_before") >= s.outcome_samples
        st = _enough(F.col("n_before"), F.col(n), s.outcome_samples)
        out.append(_measure(name, st, direction_of(b, a, False, s.tolerance, s.slack), F.when(ok, b), F.when(st == "measured", a), F.col("n_before"), F.col(n)))
    return out


def accuracy_measure(s: Settings) -> Column:
    """Share correct before and after; an empty side is insufficient."""
    b, a = F.col("accuracy_before"), F.col("accuracy_after")
    return _measure("accuracy_change", _enough(F.col("answers_before"), F.col("answers_after"), 1), direction_of(b, a, False, s.tolerance, s.slack), b, a, F.col("answers_before"), F.col("answers_after"))


def latency_measure(s: Settings) -> Column:
    """Mean response before against the completion's own; a non-response or a missing side is insufficient."""
    b, a = F.col("latency_before"), F.col("response_seconds")
    ok = b.isNotNull() & a.isNotNull() & ~outcome_class(F.col("outcome")).eqNullSafe("non_response")
    return _measure("response_latency_change", F.when(ok, "measured").otherwise("insufficient_data"), direction_of(b, a, True, s.tolerance, s.slack), b, a, F.col("answers_before"), a.isNotNull().cast("int"))


def persistence_measure() -> Column:
    """The tracked item closed and nothing else touched, or the reverse; both or neither say nothing."""
    none = F.array().cast("array<string>")
    opened, closed, t = F.coalesce("opened", none), F.coalesce("closed", none), F.col("tracked")
    done, others = F.array_contains(closed, t), F.size(F.array_except(F.array_union(opened, closed), F.array(t))) > 0
    st = F.when(t.isNull(), "not_applicable").when(done != others, "measured").otherwise("insufficient_data")
    null = F.lit(None)
    return _measure("task_persistence", st, F.when(done, "improved").otherwise("deteriorated"), null, null, F.lit(0), F.size(F.array_union(opened, closed)))


def continuation_measure() -> Column:
    """The session's end in the after window is bad, an event of it at or after the window's end is neutral."""
    t, e = F.col("delivered_us"), F.col("ended_us")
    inside = (e >= t) & (e < F.col("after_end"))
    st = F.when(e < t, "not_applicable").when(F.coalesce(inside, F.lit(False)) | (F.col("last_us") >= F.col("after_end")), "measured").otherwise("insufficient_data")
    null = F.lit(None)
    return _measure("session_continuation", st, F.when(F.coalesce(inside, F.lit(False)), "deteriorated").otherwise("no_change"), null, null, F.lit(0), F.lit(0))


def trajectory_measure() -> Column:
    """Direction of the latest temporal state in the after window."""
    d = F.col("state_direction")
    code = F.when(d == "worsening", "deteriorated").when(d == "improving", "improved").when(d == "stable", "no_change")
    null = F.lit(None)
    return _measure("subsequent_trajectory", F.when(code.isNotNull(), "measured").otherwise("insufficient_data"), code, null, null, F.lit(0), d.isNotNull().cast("int"))


def latest_state_after(deliveries: DataFrame, states: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(intervention_id, state_direction): of the latest state in [t, after end); ``states(learner_id, us, direction)``."""
    d = outcome_windows(deliveries, s).select("learner_id", "intervention_id", "delivered_us", "after_end")
    j = interval_join(d, states.select("learner_id", "us", "direction"), "learner_id", "delivered_us", "after_end", "us", _us(s.after))
    return j.groupBy("intervention_id").agg(F.max_by("direction", "us").alias("state_direction"))


def measure_outcomes(deliveries: DataFrame, events: DataFrame, states: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Seven rows for each delivery, with response class, origin and completeness."""
    f = window_facts(deliveries, events, s).join(latest_state_after(deliveries, states, s), "intervention_id", "left")
    cells = [*interaction_measures(s), accuracy_measure(s), latency_measure(s), persistence_measure(), continuation_measure(), trajectory_measure()]
    f = f.withColumn("_m", F.array(*cells)).withColumns({
        "response_class": outcome_class(F.col("outcome")), "origin": F.when(F.coalesce("any_real", F.lit(False)), "real").otherwise("synthetic"),
        "complete": F.forall("_m", lambda m: m["status"] == "measured"),
    })
    return f.select("learner_id", "session_id", "intervention_id", "delivered_us", "response_class", "origin", "complete", F.inline("_m"))


def outcome_lists(measured: DataFrame) -> DataFrame:
    """Per delivery the improved and deteriorated measures, in order of name."""
    names = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.col("measure"))))
    return measured.groupBy("intervention_id").agg(names("improved").alias("improved"), names("deteriorated").alias("deteriorated"))


def outcome_coverage(measured: DataFrame) -> DataFrame:
    """Rows by measure and direction and by measure and status, from one grouping."""
    return measured.groupingSets([["measure", "direction"], ["measure", "status"]], "measure", "direction", "status").agg(F.count("*").alias("n"))
