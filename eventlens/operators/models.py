"""Labels, design frames, training, scoring, metrics, and checks of append-only status logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.medians import block_median
from eventlens.operators.features import CATEGORICAL, FEATURES

#: Categories of the encoded features, one column each.
VOCABULARY = {
    "content_type_encoded": ("question", "video", "reading", "other"),
    "trajectory_encoded": ("improving", "stable", "declining", "other"),
    "baseline_maturity_encoded": ("new", "early", "developing", "established", "other"),
}
INTEGERS = ("session_event_count", "intervention_count", "intervention_cooldown_active")


def next_k_drop_label(df: DataFrame, back: int = 3, ahead: int = 3, drop: float = 0.10, skip: int = 10) -> DataFrame:
    """M1: label of each answer of a session: 1 if the next answers are worse than the last by more than ``drop``.

    The first ``skip`` answers and the last ``ahead`` have none.
    """
    w = Window.partitionBy("learner_id", "session_id").orderBy("us", "event_id")
    a = df.where(F.col("event_type") == "question_answered").withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("learner_id", "session_id"))})
    c = F.col("correct").cast("int")
    a = a.withColumns({"before": F.avg(c).over(w.rowsBetween(-back, -1)), "after": F.avg(c).over(w.rowsBetween(1, ahead))})
    return a.where((F.col("i") >= skip) & (F.col("i") + ahead < F.col("n"))).withColumn("label", (F.col("after") < F.col("before") - drop).cast("int"))


def group_holdout(df: DataFrame, key: str, order: str, every: int = 4, blocks: int = 256) -> DataFrame:
    """M2: adds ``holdout``: every ``every``-th key in order of first appearance; a key is never split.

    Keys are ranked in blocks of time, so that no task holds all of them.
    """
    first = df.groupBy(key).agg(F.min(order).alias("_f"))
    low, high = first.agg(F.min("_f"), F.max("_f")).first()
    span = max(1, ((high or 0) - (low or 0)) // blocks + 1)
    first = first.withColumn("_b", F.floor((F.col("_f") - F.lit(low or 0)) / span))
    sizes = first.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_f", key))
    held = first.join(F.broadcast(before), "_b").select(key, ((F.col("_before") + rank) % every == 0).alias("holdout"))
    return df.join(held, key)


def missing_features(required: tuple[str, ...] = FEATURES) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))


def encode_design(df: DataFrame, required: tuple[str, ...] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """M3: (rows with one column for each number and each category, rejected rows with the names they lack).

    Rows with an absent feature or without a learner are rejected, as are numbers that are not finite or, for
    counts, not whole, and categories outside the vocabulary (listed by name).
    """
    bad = []
    for f in required:
        c = F.col(f)
        if f in VOCABULARY:
            bad.append(F.when(~c.isin(*VOCABULARY[f]), F.lit(f)))
        else:
            wrong = F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
            bad.append(F.when(wrong | (c != F.floor(c)) if f in INTEGERS else wrong, F.lit(f)))
    lacks = F.concat(missing_features(required), F.array_compact(F.array(*bad)), F.when(F.col("learner_id").isNull(), F.array(F.lit("learner_id"))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("lacks", F.array_sort(lacks))
    cells = []
    for f in required:
        cells += [(F.col(f) == v).cast("double").alias(f"{f}={v}") for v in VOCABULARY[f]] if f in VOCABULARY else [F.col(f).cast("double").alias(f)]
    keep = [c for c in df.columns if c not in required and c != "lacks"]
    return df.where(F.size("lacks") == 0).select(*keep, *cells), df.where(F.size("lacks") > 0)


def design_columns(required: tuple[str, ...] = FEATURES) -> list[str]:
    return [c for f in required for c in ([f"{f}={v}" for v in VOCABULARY[f]] if f in CATEGORICAL else [f])]


def column_reference(design: DataFrame, columns: list[str]) -> DataFrame:
    """M4: one row: the median of each column; all columns are one long table, cut into blocks."""
    long = design.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])))
    found = block_median(long, ["name"], "v")
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


@dataclass
class Fitted:
    """A fitted pipeline or its numbers, its columns, the training medians, the feature set it takes and its threshold."""

    model: object
    columns: list[str]
    reference: dict[str, float]
    feature_set: str = "1"
    threshold: float = 0.5


@dataclass(frozen=True)
class Logistic:
    """A logistic model by its numbers, scored as an expression: what ``Fitted.model`` may be without training."""

    weights: dict[str, float]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``, a vector of both classes, as a fitted pipeline does."""
        from pyspark.ml.functions import array_to_vector

        z = sum((F.lit(w) * F.col(f"`{c}`") for c, w in self.weights.items()), F.lit(self.intercept))
        p = 1 / (1 + F.exp(-z))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    def fitted(self, reference: dict[str, float], feature_set: str = "1", threshold: float = 0.5) -> Fitted:
        return Fitted(self, list(self.weights), reference, feature_set, threshold)


def train(design: DataFrame, columns: list[str], label: str = "label", algorithm: str = "logistic", holdout: DataFrame | None = None) -> Fitted:
    """M5: logistic regression on standardised columns, random_forest or gradient_boosting.

    Refuses an empty set, a single row, a single class, and a holdout with other columns.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n, classes = design.agg(F.count("*"), F.count_distinct(label)).first()
    if n < 2 or classes < 2:
        raise ValueError("training needs two rows and two classes")
    if holdout is not None and [c for c in columns if c not in holdout.columns]:
        raise ValueError("the holdout lacks columns")
    kinds = {
        "logistic": [StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label)],
        "random_forest": [RandomForestClassifier(labelCol=label, featuresCol="raw", numTrees=100, minInstancesPerNode=5, seed=7)],
        "gradient_boosting": [GBTClassifier(labelCol=label, featuresCol="raw", maxIter=100, stepSize=0.1, seed=7)],
    }
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error"), *kinds[algorithm]]).fit(design)
    return Fitted(model, columns, column_reference(design, columns).first().asDict())


def logistic_numbers(fitted: Fitted) -> Logistic:
    """A trained logistic pipeline on its own columns: weights and intercept without the standardisation."""
    scaler, fit = fitted.model.stages[1], fitted.model.stages[2]
    weights = [float(w) / float(d) if d else 0.0 for w, d in zip(fit.coefficients, scaler.std)]
    return Logistic(dict(zip(fitted.columns, weights)), float(fit.intercept) - sum(w * float(m) for w, m in zip(weights, scaler.mean)))


def score(df: DataFrame, fitted: Fitted, threshold: float | None = None) -> DataFrame:
    """M6: adds probability and predicted; rows that lack a column's value get neither, and a refusal.

    A frame with ``feature_set`` must hold one version only, the model's: a mixed batch is an error.
    """
    from pyspark.ml.functions import vector_to_array

    threshold = fitted.threshold if threshold is None else threshold
    if lacking := [c for c in fitted.columns if c not in df.columns]:
        raise ValueError(f"feature set mismatch: {lacking}")
    if "feature_set" in df.columns:
        kinds = [r[0] for r in df.select("feature_set").distinct().limit(2).collect()]
        if len(kinds) > 1:
            raise ValueError("a batch mixes versions of the feature set")
        if kinds and kinds != [fitted.feature_set]:
            raise ValueError(f"the model takes feature set {fitted.feature_set}, not {kinds[0]}")
    absent = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`"), F.lit(c)) for c in fitted.columns]))
    df = df.withColumn("absent", absent)
    done = fitted.model.transform(df.where(F.size("absent") == 0)).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, F.col("p").alias("probability"))
    every = done.unionByName(df.where(F.size("absent") > 0), allowMissingColumns=True)
    return every.withColumns({"predicted": (F.col("probability") >= threshold).cast("int"), "refusal": F.when(F.size("absent") > 0, F.concat(F.lit("absent:"), F.array_join("absent", ",")))}).drop("absent")


def bin_index(p: Column, bins: int = 10) -> Column:
    """0-based bin of equal width by its edges; the last is closed.  Edges are i times the width, not floor(p * bins)."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)])
    return F.size(F.filter(edges, lambda e: e <= p)) - 1


def expected_calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """M8: one row ``ece``: null on one class; ``bins`` is at most the number of rows."""
    bins = max(1, min(bins, df.limit(bins).count()))
    g = df.groupBy(bin_index(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"))
    both = (F.sum("sy") > 0) & (F.sum("sy") < F.sum("n"))
    return g.agg(F.when(both, F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"))


def binary_metrics(df: DataFrame, p: str, y: str, threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """M7: one row of metrics; rank metrics are null on one class, precision, recall and f1 use 0 for 0 / 0.

    Ranks are taken on one row for each distinct score, in blocks of scores: no task sorts all of them.
    """
    at = df.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("pos")).withColumn("neg", F.col("n") - F.col("pos")).withColumn("b", F.floor(F.col("p") * 1000))
    blocks = at.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 1001 rows
    blocks = blocks.select("b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bp", "bn")])
    w = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c, b: F.col(b) + F.coalesce(F.sum(c).over(w), F.lit(0))
    r = at.join(F.broadcast(blocks), "b").withColumns({"neg_below": below("neg", "bn_before"), "pos_below": below("pos", "bp_before")})
    totals = df.agg(F.sum(y).cast("long").alias("all_pos"), F.count("*").alias("all_n"))
    r = r.crossJoin(F.broadcast(totals))
    pos_at = F.col("all_pos") - F.col("pos_below")
    n_at = F.col("all_n") - F.col("pos_below") - F.col("neg_below")
    ranks = r.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum(F.col("pos") * pos_at / n_at).alias("ap"))
    said, was = F.col(p) >= threshold, F.col(y) == 1
    tp, fp, fn = F.count_if(said & was), F.count_if(said & ~was), F.count_if(~said & was)
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    base = df.agg(
        F.count("*").alias("n"), F.sum(y).cast("long").alias("positives"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.avg((said == was).cast("int")).alias("accuracy"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
    )
    one = base.crossJoin(ranks).crossJoin(expected_calibration_error(df, p, y, bins))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return one.withColumns({"roc_auc": F.when(both, F.col("u") / (F.col("positives") * (F.col("n") - F.col("positives")))), "pr_auc": F.when(both, F.col("ap") / F.col("positives"))}).drop("u", "ap")


def latest_status(df: DataFrame, key: list[str], seq: str, status: str) -> DataFrame:
    """Current status of each key of an append-only log."""
    return df.groupBy(*key).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("seq"))


def audit_transitions(df: DataFrame, key: list[str], seq: str, status: str, allowed: list[tuple[str, str]], first: str, required: list[str]) -> DataFrame:
    """(key, seq, violation): moves outside the edge list, moves that change nothing, a start at another
    status, and records without a required column."""
    w = Window.partitionBy(*key).orderBy(seq)
    moved = df.withColumn("_from", F.lag(status).over(w))
    edges = df.sparkSession.createDataFrame(allowed, "_from string, _to string").withColumn("_ok", F.lit(True))
    j = moved.join(F.broadcast(edges), (moved["_from"] == edges["_from"]) & (moved[status] == edges["_to"]), "left").drop(edges["_from"])
    why = F.array_compact(F.array(
        F.when(F.col("_from").isNull() & (F.col(status) != first), "wrong_start"), F.when(F.col("_from") == F.col(status), "no_change"),
        F.when(F.col("_from").isNotNull() & (F.col("_from") != F.col(status)) & F.col("_ok").isNull(), "forbidden_move"),
        *[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"missing_{c}") for c in required],
    ))
    return j.select(*key, seq, F.explode(why).alias("violation"))


def monotonic_versions(df: DataFrame, family: str, seq: str, version: str) -> DataFrame:
    """Rows whose numeric version does not rise within the family."""
    v = F.regexp_extract(version, r"_V(\d+)$", 1).try_cast("long")
    w = Window.partitionBy(family).orderBy(seq)
    return df.withColumn("number", v).withColumn("before", F.lag("number").over(w)).where("number <= before").select(family, seq, version, "before")


def promotion_guard(df: DataFrame, status: str, origin: str, guarded: tuple[str, ...] = ("validated", "production")) -> DataFrame:
    """Records trained on synthetic data with a guarded status."""
    return df.where((F.col(origin) == "synthetic") & F.col(status).isin(*guarded))
