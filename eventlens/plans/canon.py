"""The given ``events`` table as an event log of learners, for Spark and for DuckDB.

Kinds: view -> question_started, purchase -> question_answered, signup -> intervention_started,
error -> intervention_completed, click -> content_opened, content_closed or interaction.
Answers belong to the learner's last question, completions to the last intervention.
Sessions end after 24 hours without an event.  ``us`` is the instant in microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.sources.shared import saved

TOPICS = ("algebra", "reading", "geometry")
CATALOGUE = ("recap", "micro_question", "pause", "reflection")
REPORTED = ("accepted", "dismissed", "ignored", "timeout", "other")
SESSION_GAP_US = 86_400_000_000


def pick(names: tuple[str, ...], index):
    """The name at a 0-based index column."""
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


#: Frames that the query being built has asked for: (builder, folder) -> frame, or None after the first use.
_held: ContextVar[dict[tuple[str, str], DataFrame | None] | None] = ContextVar("held", default=None)
Builder = Callable[[SparkSession, str], DataFrame]


def one_query(query: Builder) -> Builder:
    """A query in which frames of ``shared`` builders are saved where they are asked for more than once."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _held.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _held.reset(token)

    return run


def shared(build: Builder) -> Builder:
    """Inside a query, the frame is computed for its first use, which may be the only one, and saved for the others.

    ``hold(spark, sf_dir)`` saves it at once, where many uses are to come.
    """

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        held, key = _held.get(), (build.__name__, sf_dir)
        if held is None or key not in held:
            if held is not None:
                held[key] = None
            return build(spark, sf_dir)
        if held[key] is None:
            held[key] = saved(build(spark, sf_dir), build.__name__)
        return held[key]

    def hold(spark: SparkSession, sf_dir: str) -> None:
        held, key = _held.get(), (build.__name__, sf_dir)
        if held is not None and held.get(key) is None:
            held[key] = saved(build(spark, sf_dir), build.__name__)

    get.hold = hold
    return get


@shared
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical event log; arrival order is (us, event_id)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.col("event_type")
    kind = (
        F.when(raw == "view", "question_started").when(raw == "purchase", "question_answered")
        .when(raw == "signup", "intervention_started").when(raw == "error", "intervention_completed")
        .when(F.col("k") < 34, "content_opened").when(F.col("k") < 67, "content_closed").otherwise("interaction")
    )
    e = e.select("event_id", micros(F.col("ts")).alias("us"), F.col("user_id").cast("string").alias("learner_id"), "event_type", "value", k.alias("k"))
    e = e.withColumn("event_type", kind)
    w = Window.partitionBy("learner_id").orderBy("us", "event_id")
    is_ = lambda t: F.col("event_type") == t
    new = F.coalesce((F.col("us") - F.lag("us").over(w) > SESSION_GAP_US).cast("int"), F.lit(0))
    e = e.withColumn("new", new).withColumn("session_no", (1 + F.sum("new").over(w)).cast("int"))
    question = F.when(is_("question_started"), F.concat(F.lit("q"), F.col("k").cast("string")))
    started = F.when(is_("intervention_started"), F.col("event_id"))
    e = e.select(
        "event_id", "us", "learner_id", "session_no", F.concat_ws("-", "learner_id", F.col("session_no").cast("string")).alias("session_id"), "event_type", "k",
        F.last(question, True).over(w).alias("last_question"), F.last(started, True).over(w).alias("last_start"),
        F.when(is_("question_started"), pick(TOPICS, F.col("k") % 3)).alias("topic"),
        F.when(is_("question_started"), F.col("k") / 100.0).alias("difficulty"),
        F.when(is_("question_answered"), F.col("k") >= 40).alias("correct"),
        F.when(is_("question_answered"), F.col("value") / 10).alias("response_seconds"),
        F.when(is_("intervention_started"), pick(CATALOGUE, F.col("k") % 4)).alias("intervention_type"),
        F.when(is_("intervention_completed"), pick(REPORTED, F.col("k") % 5)).alias("outcome"),
        F.when(is_("content_opened") | is_("content_closed"), F.concat(F.lit("c"), (F.col("k") % 10).cast("string"))).alias("content_id"),
        F.when(F.col("learner_id").cast("long") % 5 == 0, "synthetic").when((F.col("learner_id").cast("long") % 5 == 1) & (F.col("k") % 2 == 0), "synthetic").otherwise("real").alias("origin"),
    )
    return e.withColumn("question_id", F.when(is_("question_started") | is_("question_answered"), F.col("last_question"))).withColumn(
        "intervention_id", F.when(is_("intervention_started") | is_("intervention_completed"), F.col("last_start"))
    ).drop("last_question", "last_start")


#: The same log as DuckDB CTEs; a query goes on with ", x AS (...) SELECT ...".
CANON = """
WITH ev0 AS (
  SELECT event_id, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS learner_id, user_id, event_type AS raw, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
ev1 AS (
  SELECT *, CASE raw WHEN 'view' THEN 'question_started' WHEN 'purchase' THEN 'question_answered' WHEN 'signup' THEN 'intervention_started'
                     WHEN 'error' THEN 'intervention_completed'
            ELSE CASE WHEN k < 34 THEN 'content_opened' WHEN k < 67 THEN 'content_closed' ELSE 'interaction' END END AS event_type,
         CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 86400000000 THEN 1 ELSE 0 END AS fresh
  FROM ev0),
ev2 AS (
  SELECT *, CAST(1 + sum(fresh) OVER w AS INTEGER) AS session_no,
         last_value(CASE WHEN raw = 'view' THEN 'q' || k END IGNORE NULLS) OVER w AS lastq,
         last_value(CASE WHEN raw = 'signup' THEN event_id END IGNORE NULLS) OVER w AS lasts
  FROM ev1 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ev AS (
  SELECT event_id, us, learner_id, session_no, learner_id || '-' || session_no AS session_id, event_type, k,
         CASE WHEN raw = 'view' THEN ['algebra', 'reading', 'geometry'][k % 3 + 1] END AS topic,
         CASE WHEN raw = 'view' THEN k / 100.0 END AS difficulty,
         CASE WHEN raw = 'purchase' THEN k >= 40 END AS correct,
         CASE WHEN raw = 'purchase' THEN value / 10 END AS response_seconds,
         CASE WHEN raw = 'signup' THEN ['recap', 'micro_question', 'pause', 'reflection'][k % 4 + 1] END AS intervention_type,
         CASE WHEN raw = 'error' THEN ['accepted', 'dismissed', 'ignored', 'timeout', 'other'][k % 5 + 1] END AS outcome,
         CASE WHEN event_type IN ('content_opened', 'content_closed') THEN 'c' || (k % 10) END AS content_id,
         CASE WHEN user_id % 5 = 0 OR (user_id % 5 = 1 AND k % 2 = 0) THEN 'synthetic' ELSE 'real' END AS origin,
         CASE WHEN raw IN ('view', 'purchase') THEN lastq END AS question_id,
         CASE WHEN raw IN ('signup', 'error') THEN lasts END AS intervention_id
  FROM ev2)
"""


#: Added before rounding on both sides: values such as 0.2245175 would else round up or down by their last bit.
NUDGE = 1.3e-9


def r6(*names: str) -> list:
    """The columns, rounded to 6 places."""
    return [F.round(F.col(n) + NUDGE, 6).alias(n) for n in names]


def steady(sql: str) -> str:
    """The same in a query's SQL, for ``round(..., 6) AS`` and ``round(..., 6) END``."""
    return sql.replace(", 6) AS", " + 1.3e-9, 6) AS").replace(", 6) END", " + 1.3e-9, 6) END")
