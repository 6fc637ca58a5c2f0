"""Registered queries: the events table replayed as a stream; results are read from the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.plans.canon import CANON, events, micros, r6, steady
from eventlens.plans.q_baseline import FOLD, TRACK, deviations
from eventlens.plans.q_context import context_of
from eventlens.plans.q_policy import DEC, decisions, deliveries
from eventlens.settings import SPARSE
from eventlens.sources.shared import shared_path
from eventlens.streaming import processors as P


def source(s, d) -> DataFrame:
    """The events as they arrive: no window over the past is needed for these columns."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("event-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("us"),
        F.concat(F.lit("learner-"), F.col("user_id").cast("string")).alias("learner_id"), F.concat_ws("-", F.lit("session"), "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.when(F.col("event_type") == "purchase", "question_reviewed").when(k > 95, "session_ended").otherwise("interaction").alias("event_type"), F.lit("tap").alias("interaction_type"), F.when(k % 3 != 0, "question-1").alias("question_id"),
        (F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("_t"), F.lit("real").alias("origin"), F.lit("observed").alias("provenance"), F.lit(True).alias("has_stamp"), "value", k.alias("k"),
    ).withColumn("timestamp", F.concat("_t", F.lit("Z"))).drop("_t")


def run(s, out: DataFrame, mode: str = "append", each=None) -> DataFrame:
    """Runs a stream until all input is read; the sink lies in the shared folder."""
    path = shared_path(s, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/out")


def st1(s, d):
    good, bad = P.stream_ingest(source(s, d))
    return run(s, good).select("event_id", F.lit("accepted").alias("sink")).union(run(s, bad).select("event_id", F.lit("rejected").alias("sink")))


#: Parts that the log's span is cut into, one arrival each; what is late comes with the next part.
PARTS = 3


def arrivals(rows: DataFrame, late) -> DataFrame:
    """Adds ``arrival``: the part of the span that the row's instant lies in, and one more where it is late."""
    lo, hi = rows.agg(F.min("us"), F.max("us")).first()
    part = F.floor((F.col("us") - (lo or 0)) * PARTS / ((hi or 0) - (lo or 0) + 1)).cast("int")
    return rows.withColumn("arrival", part + late.cast("int"))


def replay(s, rows: DataFrame, process, mode: str = "append") -> DataFrame:
    """Writes each arrival to the stream's folder and runs the stream on it, from the checkpoint that the one before left.

    The result holds ``arrival``, the run that wrote a row.
    """
    path = shared_path(s, "replay")
    rows.repartition("arrival", "learner_id").write.partitionBy("arrival").parquet(f"{path}/all")
    kind = rows.drop("arrival").schema
    for at in range(PARTS + 1):
        s.read.schema(rows.schema).parquet(f"{path}/all").where(F.col("arrival") == at).drop("arrival").write.mode("append").parquet(f"{path}/in")

        def sink(batch: DataFrame, number: int, at: int = at) -> None:
            batch.withColumns({"arrival": F.lit(at), "batch": F.lit(number)}).write.mode("append").parquet(f"{path}/out")

        out = process(s.readStream.schema(kind).parquet(f"{path}/in"))
        out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/out")


def st2(s, d):
    answers = events(s, d).where("event_type = 'question_answered'").select("learner_id", "us", F.col("response_seconds").alias("value"), "event_id")
    rows = arrivals(answers, F.col("event_id") % 7 == 0).drop("event_id")
    got = replay(s, rows, lambda x: P.stream_baseline(x, SPARSE))
    kept, refused = P.split_refused(got)
    cols = ["learner_id", "us", "n", *r6("centre", "spread")]
    return kept.select(*cols, F.lit(None).cast("string").alias("refused")).union(refused.select(*cols, "refused"))


def st3(s, d):
    dev = deviations(s, d).groupBy("learner_id", "us").agg(F.collect_list(F.struct("dimension", "z")).alias("deviations"))
    rows = arrivals(dev, F.col("us") % 5 == 0)
    got = replay(s, rows, lambda x: P.stream_state(x, SPARSE))
    return got.select("learner_id", "us", "from_state", "to_state", F.col("run").cast("int").alias("run"), "dimension", "direction", "refused")


def _log(s, d) -> DataFrame:
    return events(s, d).withColumn("ts", F.timestamp_micros("us"))


#: What ST4's query compares with C1 to C4, and how each is rounded.
_SEEN = ("event_count", "start_inferred", "has_ended", "content_kind", "content_ref", "content_difficulty", "answer_count", "interventions", "last_intervention_type", "last_outcome", "in_cooldown")
_ROUNDED = ("elapsed_seconds", "position", "recent_accuracy", "recent_response", "seconds_since_last", "cooldown_remaining")


def st4(s, d):
    rows = arrivals(_log(s, d), F.col("event_id") % 7 == 0)
    got = replay(s, rows, lambda x: P.stream_context(x, SPARSE, delay="3650 days"), "update")
    return got.select("session_id", "arrival", *_SEEN, *r6(*_ROUNDED))


def st4_without_ids(s, d):
    path = shared_path(s, "log")
    log = _log(s, d).select("learner_id", "ts", "us", "event_id", "event_type", "correct", "difficulty", "intervention_type")
    log.write.parquet(path)
    stream = s.readStream.schema(log.schema).parquet(path)
    got = run(s, P.stream_sessions(stream), "complete")
    newest = got.agg(F.max("batch")).first()[0]
    return got.where(F.col("batch") == newest).drop("batch").withColumn("elapsed_seconds", F.round("elapsed_seconds", 6))


def st5(s, d):
    path = shared_path(s, "decisions")
    gave = deliveries(s, d).select("learner_id", "session_id", F.col("delivered_us").alias("us"), F.lit(None).cast("long").alias("decision_id"))
    asked = decisions(s, d).select("learner_id", "session_id", F.col("decided_us").alias("us"), F.col("decision_id").cast("long").alias("decision_id"))
    gave.union(asked).repartition(4, "learner_id").write.parquet(path)
    stream = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return run(s, P.stream_caps(stream, SPARSE)).select("decision_id", "in_session", "in_window", F.round("seconds_since_last", 6).alias("seconds_since_last"), "cap")


QUERIES = {"st1_stream_ingest": st1, "st2_stream_baseline": st2, "st3_stream_state": st3, "st4_stream_context": st4, "st4_stream_sessions": st4_without_ids, "st5_stream_caps": st5}

#: Which part of its span a row of ``x`` lies in, and one more where it is late.
_PART = "CAST(floor((us - min(us) OVER ()) * 3 / (max(us) OVER () - min(us) OVER () + 1)) AS INTEGER) + CAST({late} AS INTEGER)"

#: Rows in order of arrival; one that is not later than all before it is refused, the others are numbered.
_ACCEPTED = """SELECT *, {before} AS accepted_before FROM (
  SELECT *, coalesce(us <= max(us) OVER (PARTITION BY learner_id ORDER BY arrival, us{tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS refused FROM {rows})"""

ST2 = CANON.replace("WITH ev0", "WITH RECURSIVE ev0", 1) + f""", arr AS (
  SELECT learner_id, us, response_seconds AS x, {_PART.format(late="event_id % 7 = 0")} AS arrival FROM ev WHERE event_type = 'question_answered'),
seen AS ({_ACCEPTED.format(rows="arr", tie=", x", before="count(*) FILTER (WHERE NOT refused) OVER (PARTITION BY learner_id ORDER BY arrival, us, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")}),
ob AS (SELECT learner_id, us, x, accepted_before AS n FROM seen WHERE NOT refused),
fold AS (
  SELECT learner_id, us, n, x AS centre, CAST(NULL AS DOUBLE) AS spread, [x] AS kept FROM ob WHERE n = 1
  UNION ALL
  SELECT learner_id, us, n, c, 1.4826 * list_aggregate(list_transform(kp, lambda v: abs(v - c)), 'median'), kp
  FROM (SELECT o.learner_id, o.us, o.n, f.centre + 0.05 * CASE WHEN f.spread > 0 THEN greatest(-5 * f.spread, least(5 * f.spread, o.x - f.centre)) ELSE o.x - f.centre END AS c,
          CASE WHEN len(f.kept) + 1 > 6 THEN list_transform(range(2, len(f.kept) + 2, 2), lambda i: list_append(f.kept, o.x)[i]) || CASE WHEN len(f.kept) % 2 = 0 THEN [o.x] ELSE [] END ELSE list_append(f.kept, o.x) END AS kp
        FROM fold f JOIN ob o ON o.learner_id = f.learner_id AND o.n = f.n + 1))
SELECT s.learner_id, s.us, coalesce(f.n, 0) AS n, round(f.centre, 6) AS centre, round(f.spread, 6) AS spread, CASE WHEN refused THEN 'late' END AS refused
FROM seen s LEFT JOIN fold f ON f.learner_id = s.learner_id AND f.n = s.accepted_before"""

ST3 = FOLD.replace("dev AS (", "dev0 AS (", 1) + f""", inst AS (SELECT DISTINCT learner_id, us FROM dev0),
arr AS (SELECT learner_id, us, {_PART.format(late="us % 5 = 0")} AS arrival FROM inst),
seen AS ({_ACCEPTED.format(rows="arr", tie="", before="0")}),
dev AS (SELECT d.* FROM dev0 d JOIN seen s ON s.learner_id = d.learner_id AND s.us = d.us AND NOT s.refused)""" + TRACK[len(FOLD):] + """
SELECT learner_id, us, from_state, state AS to_state, CAST(erun AS INTEGER) AS run, dimension, direction, CAST(NULL AS VARCHAR) AS refused FROM st
UNION ALL SELECT learner_id, us, NULL, NULL, NULL, NULL, NULL, 'late' FROM seen WHERE refused"""


def st4_sql() -> str:
    """C1 to C4 at the end of each session over what has arrived by each run, for the sessions that the run touches."""
    text = CANON + f", evp AS (SELECT *, {_PART.format(late='event_id % 7 = 0')} AS arrival FROM ev)"
    parts = []
    for at in range(PARTS + 1):
        text += f", ev_{at} AS (SELECT * FROM evp WHERE arrival <= {at})" + context_of(f"ev_{at}", f"_{at}")
        parts.append(f"""SELECT session_id, {at} AS arrival, event_count, true AS start_inferred, false AS has_ended, content_kind, content_ref, content_difficulty, CAST(answer_count AS INTEGER) AS answer_count,
  interventions, last_intervention_type, last_outcome, coalesce(since < 43200, false) AS in_cooldown, round(elapsed, 6) AS elapsed_seconds, round(position, 6) AS position, round(recent_accuracy, 6) AS recent_accuracy,
  round(recent_response, 6) AS recent_response, round(since, 6) AS seconds_since_last, CASE WHEN since < 43200 THEN round(43200 - since, 6) END AS cooldown_remaining
FROM fin_{at} WHERE session_id IN (SELECT session_id FROM evp WHERE arrival = {at})""")
    return text + "\n" + "\nUNION ALL ".join(parts)


ORACLES = {
    "st1_stream_ingest": "SELECT 'event-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS event_id, CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS sink FROM events",
    "st2_stream_baseline": ST2,
    "st3_stream_state": ST3,
    "st4_stream_context": st4_sql(),
    "st4_stream_sessions": """SELECT learner_id, min(us) AS first_us, count(*) AS event_count, round((max(us) - min(us)) / 1e6, 6) AS elapsed_seconds,
  count(*) FILTER (WHERE event_type = 'question_answered') AS answers, count(*) FILTER (WHERE event_type = 'question_answered' AND correct) AS correct,
  arg_max(event_type, (us, event_id)) FILTER (WHERE event_type IN ('question_started', 'content_opened')) AS content_event,
  last(difficulty ORDER BY us, event_id) FILTER (WHERE event_type IN ('question_started', 'content_opened')) AS content_difficulty,
  count(*) FILTER (WHERE event_type = 'intervention_started') AS interventions,
  arg_max(intervention_type, (us, event_id)) FILTER (WHERE event_type = 'intervention_started') AS last_intervention_type
FROM ev GROUP BY learner_id, session_no""",
    "st5_stream_caps": DEC + "SELECT decision_id, in_session, in_window, round(since, 6) AS seconds_since_last, CASE WHEN since < 86400 THEN 'in_cooldown' WHEN in_session >= 3 THEN 'session_cap_reached' WHEN in_window >= 5 THEN 'window_cap_reached' END AS cap FROM hist",
}
ORACLES["st4_stream_sessions"] = CANON + ORACLES["st4_stream_sessions"]
ORACLES = {k: steady(v) if k in ("st2_stream_baseline", "st3_stream_state", "st4_stream_context") else v for k, v in ORACLES.items()}
