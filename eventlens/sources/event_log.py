"""Event logs as JSON lines and Parquet, payload decoding, and event documents."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fixed envelope of one event; the payload stays JSON text until ``parse_payload``.
ENVELOPE = "event_id string, learner_id string, session_id string, timestamp string, event_type string, payload string, origin string, provenance string"

#: Fields of each payload; ``!`` marks a required one.
PAYLOADS = {
    "session_started": "platform entry_point",
    "session_ended": "duration_seconds reason",
    "question_started": "question_id! question_type difficulty topic",
    "question_answered": "question_id! correct! response_seconds! attempt_number! answer_value",
    "question_skipped": "question_id! time_on_question_seconds!",
    "question_reviewed": "question_id! previous_answer_correct",
    "video_started": "video_id! duration_seconds playback_rate!",
    "video_paused": "video_id! position_seconds! watch_time_seconds! pause_count!",
    "video_resumed": "video_id! position_seconds! pause_duration_seconds!",
    "video_completed": "video_id! total_watch_time_seconds! completion_ratio!",
    "content_opened": "content_id! content_type",
    "content_closed": "content_id! time_open_seconds!",
    "page_changed": "from_page to_page! navigation_type",
    "interaction": "interaction_type! element_id coordinates value",
    "inactivity_started": "last_interaction_type last_interaction_timestamp",
    "inactivity_ended": "inactivity_duration_seconds! resume_interaction_type",
    "intervention_started": "intervention_id! intervention_type! trigger_probability! trigger_state!",
    "intervention_completed": "intervention_id! outcome! response_seconds",
}

_DOUBLES = {f for v in PAYLOADS.values() for f in v.replace("!", "").split() if f.endswith(("seconds", "ratio", "rate", "probability")) or f == "difficulty"}
_KINDS = {f: T.DoubleType() for f in _DOUBLES} | {"correct": T.BooleanType(), "previous_answer_correct": T.BooleanType(), "attempt_number": T.IntegerType(), "pause_count": T.IntegerType(), "coordinates": T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])}

#: All payload fields in one wide struct.
FIELDS = sorted({f for v in PAYLOADS.values() for f in v.replace("!", "").split()})
PAYLOAD = T.StructType([T.StructField(f, _KINDS.get(f, T.StringType())) for f in FIELDS])


def required(event_type: str) -> list[str]:
    return [f[:-1] for f in PAYLOADS[event_type].split() if f.endswith("!")]


def allowed(event_type: str) -> list[str]:
    return PAYLOADS[event_type].replace("!", "").split()


def by_type(values: dict[str, Column], event_type: Column) -> Column:
    """The value of the row's event type; null for unknown types."""
    out = F.when(F.lit(False), next(iter(values.values())))
    for name, value in values.items():
        out = out.when(event_type == name, value)
    return out


def names(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines log; ``_corrupt`` holds lines that could not be read, blank ones are ignored.

    File order does not survive a distributed read: order by a stored column.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", ENVELOPE + ", ingest_seq long, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("e")).select("e.*")


def log_summary(log: DataFrame) -> DataFrame:
    """One row: events read and lines skipped."""
    bad = F.col("_corrupt").isNotNull()
    return log.agg(F.count_if(~bad).alias("events"), F.count_if(bad).alias("skipped_lines"))


def append_event_log(df: DataFrame, path: str, batch: str, partition: str | None = None) -> bool:
    """Appends a batch as Parquet, by day where ``partition`` names a column (the same for all batches); nothing is rewritten.

    A batch counts once: its rows go to an attempt of their own, and only then is the batch's entry
    created in the manifest, which fails where there is one.  A repeated batch, or one whose writer was lost
    halfway, leaves an attempt that no entry names, and readers pass it over.  Returns whether this attempt counts.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ and -")
    if _exists(spark, f"{path}/manifest/{batch}.json"):
        return False
    w = df.write
    (w.partitionBy(partition) if partition else w).parquet(f"{path}/data/batch={batch}/attempt={attempt}")
    return _create(spark, f"{path}/manifest/{batch}.json", json.dumps({"batch": batch, "attempt": attempt}))


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every batch in the manifest, with ``batch``; attempts that it doesn't name are pruned by their folders."""
    kept = spark.read.schema("batch string, attempt string").json(f"{path}/manifest")
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    same = (rows["batch"].cast("string") == kept["batch"]) & (rows["attempt"].cast("string") == kept["attempt"])
    return rows.join(kept, same, "left_semi").drop("attempt")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = _file(spark, path)
    return files.exists(at)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that isn't there yet; False where another has come first."""
    at, files = _file(spark, path)
    try:
        out = files.create(at, False)
    except Exception:
        if files.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def export_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text for each row, with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def parse_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """S3: adds ``p`` (the wide struct), ``missing`` and ``foreign`` (sorted field names) and ``payload_ok``.

    missing: required fields of the event type that are absent or null; foreign: keys that its
    shape does not have. Unknown types and text that is no JSON object are not ok.
    """
    keys = F.json_object_keys(F.col(payload))
    kind = F.col("event_type")
    # null values are no content
    p = F.from_json(F.col(payload), PAYLOAD)
    have = F.array_compact(F.array(*[F.when(F.col("p")[f].isNotNull(), F.lit(f)) for f in FIELDS]))
    df = df.withColumn("p", p)
    need = by_type({t: names(required(t)) for t in PAYLOADS}, kind)
    may = by_type({t: names(allowed(t)) for t in PAYLOADS}, kind)
    df = df.withColumn("missing", F.array_sort(F.array_except(need, have))).withColumn("foreign", F.array_sort(F.array_except(keys, may)))
    return df.withColumn("payload_ok", F.coalesce((F.size("missing") == 0) & (F.size("foreign") == 0), F.lit(False)))


def root_shape(v: Column) -> Column:
    """Array, envelope, single_event, object, scalar or not_json of a parsed document."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "not_json")
        .when(kind.startswith("ARRAY"), "array")
        .when(~kind.startswith("OBJECT"), "scalar")
        .when(F.try_variant_get(v, "$.events", "array<variant>").isNotNull(), "envelope")
        .when(F.try_variant_get(v, "$.event_type", "string").isNotNull(), "single_event")
        .otherwise("object")
    )


def explode_event_documents(df: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """A row for each item of an array or envelope, or one row without item: keys, root_shape, idx, item (JSON), finding.

    A single event, another object, a scalar and text that is not JSON yield no event but a finding;
    so does each item that is no object, and a collection that is empty or not a list.
    """
    df = df.withColumn("_v", F.try_parse_json(document)).withColumn("root_shape", root_shape(F.col("_v")))
    items = F.when(F.col("root_shape") == "array", F.try_variant_get("_v", "$", "array<variant>")).when(F.col("root_shape") == "envelope", F.try_variant_get("_v", "$.events", "array<variant>"))
    listed = df.select(*keys, "root_shape", F.posexplode_outer(items).alias("idx", "_item"), F.size(items).alias("_n"))
    is_object = F.schema_of_variant("_item").startswith("OBJECT")
    finding = (
        F.when(F.col("root_shape") == "single_event", "single_event_object").when(F.col("root_shape") == "object", "unknown_object").when(F.col("root_shape") == "scalar", "scalar_root")
        .when(F.col("root_shape") == "not_json", "not_json").when(F.col("_item").isNull(), "empty_collection").when(~is_object, "item_not_an_object")
    )
    return listed.select(*keys, "root_shape", "idx", F.when(finding.isNull(), F.to_json("_item")).alias("item"), finding.alias("finding"))
