"""Versioned models: an append-only registry, the log of their statuses, and scoring by what was in production.

A registered model is (model_id, version): its columns in order, medians, feature set, threshold and digest,
and either the numbers of a logistic model or a saved pipeline.  The status log is ``model_id, version, us,
seq, status``; nothing in it is changed, so which version was in production at an instant can be asked later.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.functions.columns import UNIT
from eventlens.operators.models import Fitted, Logistic, score

REGISTRY = (
    "model_id string, version string, feature_set string, kind string, columns array<string>, medians array<double>, "
    "weights array<double>, intercept double, threshold double, digest string"
)

#: Most versions that scoring takes at once: the registry is a list that people keep, counted before it goes to the tasks.
VERSIONS_MOST = 10_000

#: Parts that the span of the scored rows is cut into, for the join of instants to intervals.
SPANS = 256


def digest(model_id: str, version: str, fitted: Fitted) -> str:
    """SHA-256 over what must not change: identity, feature set, columns and medians in order, numbers."""
    numbers = [repr(float(fitted.reference[c])) for c in fitted.columns]
    if isinstance(fitted.model, Logistic):
        numbers += [repr(float(fitted.model.weights[c])) for c in fitted.columns] + [repr(float(fitted.model.intercept))]
    return hashlib.sha256(UNIT.join([model_id, version, fitted.feature_set, repr(float(fitted.threshold)), *fitted.columns, *numbers]).encode()).hexdigest()


def register(fitted: Fitted, spark: SparkSession, path: str, model_id: str, version: str) -> None:
    """M9: appends a version; one that is there already is refused."""
    if _rows(spark, path, model_id, version):
        raise ValueError(f"{model_id} {version} is registered already")
    plain = isinstance(fitted.model, Logistic)
    if not plain:
        fitted.model.write().save(f"{path}/pipelines/{model_id}/{version}")
    weights = [float(fitted.model.weights[c]) for c in fitted.columns] if plain else None
    row = (
        model_id, version, fitted.feature_set, "logistic" if plain else "pipeline", fitted.columns, [float(fitted.reference[c]) for c in fitted.columns],
        weights, float(fitted.model.intercept) if plain else None, float(fitted.threshold), digest(model_id, version, fitted),
    )
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").parquet(f"{path}/models")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """All registered versions."""
    return spark.read.schema(REGISTRY).parquet(f"{path}/models")


def _rows(spark: SparkSession, path: str, model_id: str, version: str) -> list:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/models")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return registry(spark, path).where((F.col("model_id") == model_id) & (F.col("version") == version)).limit(2).collect()


def load(spark: SparkSession, path: str, model_id: str, version: str, columns: list[str] | None = None, feature_set: str | None = None) -> Fitted:
    """M9: refuses an unknown or doubled version, another feature set or other columns than expected, and a digest that no longer fits."""
    rows = _rows(spark, path, model_id, version)
    if len(rows) != 1:
        raise ValueError(f"{model_id} {version} is registered {len(rows)} times")
    fitted = restored(spark, path, rows[0])
    if digest(model_id, version, fitted) != rows[0]["digest"]:
        raise ValueError("the model is not what was registered")
    if feature_set is not None and fitted.feature_set != feature_set:
        raise ValueError(f"the model takes feature set {fitted.feature_set}")
    if columns is not None and fitted.columns != columns:
        raise ValueError("the model was fitted on other columns")
    return fitted


def restored(spark: SparkSession, path: str, row) -> Fitted:
    """A registry row as a model."""
    columns = list(row["columns"])
    if row["kind"] == "logistic":
        model = Logistic(dict(zip(columns, row["weights"])), row["intercept"])
    else:
        from pyspark.ml import PipelineModel

        model = PipelineModel.load(f"{path}/pipelines/{row['model_id']}/{row['version']}")
    return Fitted(model, columns, dict(zip(columns, row["medians"])), row["feature_set"], row["threshold"])


def in_production(log: DataFrame, status: str = "production") -> DataFrame:
    """(model_id, version, from_us, to_us): when each version was in production; to_us is null while it still is.

    A version leaves by its own next status or when another version of the model is promoted, whichever
    comes first; the later ``seq`` wins at one instant.  Intervals of a model are disjoint and half-open.
    """
    own = Window.partitionBy("model_id", "version").orderBy("us", "seq")
    moved = log.withColumn("_own", F.lead("us").over(own)).where(F.col("status") == status)
    any_ = Window.partitionBy("model_id").orderBy("us", "seq")
    held = moved.withColumn("_next", F.lead("us").over(any_)).withColumn("to_us", F.least("_own", "_next"))
    return held.where("to_us IS NULL OR to_us > us").select("model_id", "version", F.col("us").alias("from_us"), "to_us")


def model_at(df: DataFrame, log: DataFrame, time: str = "us") -> DataFrame:
    """Adds ``version``: the one of the row's ``model_id`` in production at its instant, or null.

    Intervals are unfolded over SPANS parts of the rows' span, and rows meet them on model and part, so
    that one model with all rows is still spread.
    """
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    lo, hi = lo or 0, hi or 0
    width = (hi - lo) // SPANS + 1
    part = lambda c: F.floor((c - lo) / width)
    spans = in_production(log).withColumn("to_us", F.coalesce("to_us", F.lit(hi + 1))).where((F.col("from_us") <= hi) & (F.col("to_us") > lo))
    first, last = part(F.greatest("from_us", F.lit(lo))), part(F.least("to_us", F.lit(hi + 1)) - 1)
    spans = spans.withColumn("_part", F.explode(F.sequence(first, last))).select(F.col("model_id").alias("_m"), "_part", F.col("version").alias("_v"), "from_us", "to_us")
    on = (F.col("model_id") == F.col("_m")) & (part(F.col(time)) == F.col("_part")) & (F.col(time) >= F.col("from_us")) & (F.col(time) < F.col("to_us"))
    return df.join(spans, on, "left").withColumn("version", F.col("_v")).drop("_m", "_part", "_v", "from_us", "to_us")


def score_logistic(df: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``model_id, version`` scored each by its own logistic numbers, in one pass over all versions.

    Adds probability, predicted (by the version's threshold) and refusal: not_in_production without a version,
    unregistered, feature_set:<its own> where the row has another, absent:<columns> for missing values.
    ``columns`` are the frame's design columns.
    """
    kept = models.where("kind = 'logistic'").select("model_id", "version", F.col("feature_set").alias("_set"), F.col("columns").alias("_columns"), "weights", "intercept", "threshold")
    few = kept.limit(VERSIONS_MOST + 1).count() <= VERSIONS_MOST
    j = df.join(F.broadcast(kept) if few else kept, ["model_id", "version"], "left")
    values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    at = lambda c: F.try_element_at(F.col("_x"), c)
    j = j.withColumn("_x", values).withColumn("_absent", F.filter("_columns", lambda c: at(c).isNull() | F.isnan(at(c))))
    own = F.col("feature_set") if "feature_set" in df.columns else F.col("_set")
    why = (
        F.when(F.col("version").isNull(), "not_in_production").when(F.col("_columns").isNull(), "unregistered").when(~own.eqNullSafe(F.col("_set")), F.concat(F.lit("feature_set:"), F.coalesce(own, F.lit("none"))))
        .when(F.size("_absent") > 0, F.concat(F.lit("absent:"), F.array_join("_absent", ",")))
    )
    z = F.aggregate(F.arrays_zip(F.col("_columns").alias("c"), F.col("weights").alias("w")), F.col("intercept"), lambda a, x: a + x["w"] * at(x["c"]))
    j = j.withColumn("refusal", why).withColumn("probability", F.when(F.col("refusal").isNull(), 1 / (1 + F.exp(-z))))
    return j.withColumn("predicted", (F.col("probability") >= F.col("threshold")).cast("int")).drop("_set", "_columns", "weights", "intercept", "threshold", "_x", "_absent")


def score_in_production(df: DataFrame, path: str, log: DataFrame, columns: list[str], time: str = "us") -> DataFrame:
    """M6 over a log of models: each row (``model_id``, instant, design columns) is scored by the version in production then.

    Logistic versions are one expression; each pipeline that was in production scores its own rows.  A row
    of another feature set than its version's is refused, so versions of features never mix in a score.
    """
    spark = df.sparkSession
    models = registry(spark, path)
    rows = model_at(df, log, time)
    used = in_production(log).select("model_id", "version").distinct()
    pipelines = models.where("kind = 'pipeline'").join(used, ["model_id", "version"], "left_semi").limit(VERSIONS_MOST + 1).collect()
    if len(pipelines) > VERSIONS_MOST:
        raise ValueError("too many pipelines were in production")
    mine = lambda r: F.coalesce((F.col("model_id") == r["model_id"]) & (F.col("version") == r["version"]), F.lit(False))
    rest = reduce(lambda c, r: c & ~mine(r), pipelines, F.lit(True))
    parts = [score_logistic(rows.where(rest), models, columns)]
    for r in pipelines:
        parts.append(_by_pipeline(rows.where(mine(r)), restored(spark, path, r)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _by_pipeline(rows: DataFrame, fitted: Fitted) -> DataFrame:
    other: Column = ~F.col("feature_set").eqNullSafe(fitted.feature_set) if "feature_set" in rows.columns else F.lit(False)
    done = score(rows.where(~other).drop("feature_set"), fitted, fitted.threshold)
    if "feature_set" in rows.columns:
        done = done.withColumn("feature_set", F.lit(fitted.feature_set))
    refused = rows.where(other).withColumn("refusal", F.concat(F.lit("feature_set:"), F.coalesce(F.col("feature_set"), F.lit("none"))) if "feature_set" in rows.columns else F.lit(None).cast("string"))
    return done.unionByName(refused, allowMissingColumns=True)
