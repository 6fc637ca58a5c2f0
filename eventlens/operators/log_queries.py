"""Queries over the event log: filters, limits, session bounds and cuts.

Events have ``learner_id, session_id, us`` (microseconds), ``event_id`` and ``event_type``;
arrival order is ``(us, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_events(df: DataFrame, learner: str | None = None, session: str | None = None, types: list[str] | None = None, start_us: int | None = None, end_us: int | None = None, origin: str | None = None) -> DataFrame:
    """Q1: rows that meet every given argument; time is half-open [start, end)."""
    if start_us is not None and end_us is not None and start_us > end_us:
        raise ValueError("start lies after end")
    for name, value in (("learner_id", learner), ("session_id", session), ("origin", origin)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if types is not None:
        df = df.where(F.col("event_type").isin(*types))
    if start_us is not None:
        df = df.where(F.col("us") >= start_us)
    if end_us is not None:
        df = df.where(F.col("us") < end_us)
    return df


def first_n(df: DataFrame, n: int, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """Q2: the first n rows in arrival order."""
    return df.orderBy(*order).limit(n)


def session_bounds(df: DataFrame) -> DataFrame:
    """Q3: first and last event and number of events of each session."""
    return df.groupBy("learner_id", "session_id").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n_events"),
        F.min(F.struct("us", "event_id"))["event_id"].alias("first_event"), F.max(F.struct("us", "event_id"))["event_id"].alias("last_event"),
    )


def sessions_in_order(df: DataFrame) -> DataFrame:
    """Q4: sessions of each learner, ranked by their first event, then by id."""
    w = Window.partitionBy("learner_id").orderBy("first_us", "session_id")
    return session_bounds(df).withColumn("session_rank", F.dense_rank().over(w))


def as_of(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Q5: events at or before their learner's cut; ``cuts(learner_id, cut_us)``, one row for each learner."""
    return df.join(cuts.select("learner_id", "cut_us"), "learner_id").where(F.col("us") <= F.col("cut_us"))


def decision_cut(df: DataFrame, min_after: int = 4) -> DataFrame:
    """Q6: where to decide for each learner: in the last session, the answer at index n // 2 of n
    if n >= 2 * min_after, else the session's last event."""
    last = Window.partitionBy("learner_id")
    df = df.withColumn("_s", F.max("session_no").over(last)).where(F.col("session_no") == F.col("_s"))
    answer = F.when(F.col("event_type") == "question_answered", F.struct("us", "event_id"))
    per = df.groupBy("learner_id", "session_id").agg(F.array_sort(F.collect_list(answer)).alias("a"), F.max("us").alias("last_us"))
    n = F.size("a")
    enough = n >= 2 * min_after
    return per.select(
        "learner_id", "session_id", n.alias("n_answers"),
        F.when(enough, F.get(F.col("a"), F.floor(n / 2).cast("int"))["us"]).otherwise(F.col("last_us")).alias("cut_us"),
        F.when(enough, F.lit("middle_answer")).otherwise(F.lit("last_event")).alias("rule"),
    )


def nth_answer_instant(df: DataFrame, i: int) -> DataFrame:
    """Q7: instant of each learner's answer of 0-based index i; learners with fewer are absent."""
    w = Window.partitionBy("learner_id").orderBy("us", "event_id")
    return df.where(F.col("event_type") == "question_answered").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == i + 1).select("learner_id", "us", "event_id")


def frames_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q8: one row: whether two frames hold the same rows, and how many rows each has alone."""
    cols = a.columns
    one = a.select(*cols, F.lit(1).alias("_n")).union(b.select(*cols, F.lit(-1).alias("_n"))).groupBy(*cols).agg(F.sum("_n").alias("d"))
    return one.agg(
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_b")
    ).withColumn("identical", (F.col("only_a") == 0) & (F.col("only_b") == 0))
