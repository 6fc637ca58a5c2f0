"""Which events a statement rests on, as a bounded digest.

A statement names an interval of its learner's events.  Running counts and an exclusive-or of event
hashes along each learner's log make the digest of any interval a difference of two points, so one
sort of the log answers all intervals, and no event is joined to the statements made of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_hash(event_id: Column) -> Column:
    """60 bits of an event id's SHA-256."""
    return F.conv(F.substring(F.sha2(event_id.cast("string"), 256), 1, 15), 16, 10).cast("long")


def interval_digests(asked: DataFrame, events: DataFrame) -> DataFrame:
    """``(learner_id, from_us, to_us)`` -> n_events, events_digest and origin of the learner's events in [from_us, to_us].

    ``events`` has learner_id, us, event_id and origin.  Each distinct interval has one row; an interval
    without events has 0, the digest of nothing (zeros) and origin unknown.
    """
    spans = asked.where("from_us IS NOT NULL AND to_us IS NOT NULL").select("learner_id", "from_us", "to_us").distinct()
    none = F.lit(None).cast("long")
    log = events.select("learner_id", "us", F.lit(1).alias("_turn"), event_hash(F.col("event_id")).alias("_h"), (F.col("origin") == "synthetic").cast("long").alias("_s"), none.alias("from_us"), none.alias("to_us"))
    # a start is met before the events of its instant, an end after them
    ends = spans.select("learner_id", F.inline(F.array(F.struct(F.col("from_us").alias("us"), F.lit(0).alias("_turn")), F.struct(F.col("to_us").alias("us"), F.lit(2).alias("_turn")))), none.alias("_h"), none.alias("_s"), "from_us", "to_us")
    w = Window.partitionBy("learner_id").orderBy("us", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = log.unionByName(ends).withColumns({"_n": F.count("_h").over(w), "_x": F.coalesce(F.bit_xor("_h").over(w), F.lit(0)), "_c": F.coalesce(F.sum("_s").over(w), F.lit(0))}).where("_turn <> 1")
    of = lambda turn, c: F.max(F.when(F.col("_turn") == turn, F.col(c)))
    two = seen.groupBy("learner_id", "from_us", "to_us").agg(*[of(t, c).alias(f"{c}{t}") for t in (0, 2) for c in ("_n", "_x", "_c")])
    n, synthetic = F.col("_n2") - F.col("_n0"), F.col("_c2") - F.col("_c0")
    origin = F.when(n == 0, "unknown").when(synthetic == n, "synthetic").when(synthetic == 0, "real").otherwise("mixed")
    digest = F.lower(F.lpad(F.hex(F.col("_x2").bitwiseXOR(F.col("_x0"))), 15, "0"))
    return two.select("learner_id", "from_us", "to_us", n.alias("n_events"), digest.alias("events_digest"), origin.alias("origin"))


def with_lineage(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence rows with n_events, events_digest and origin of their interval; without one, 0, null and unknown."""
    found = interval_digests(evidence, events)
    j = evidence.join(found, ["learner_id", "from_us", "to_us"], "left").withColumn("origin", F.coalesce("origin", F.lit("unknown")))
    return j.na.fill(0, ["n_events"]).drop("from_us", "to_us")
