"""Calibration, evidence ceilings, confidence, verdicts, and occlusion contributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.models import Fitted, bin_index, binary_metrics
from eventlens.settings import DEFAULT, Settings

#: Fixed values.
MATURITY_CEILINGS = {"new": 0.30, "early": 0.50, "developing": 0.75, "established": 1.0}
REMEDIES = {"refused": "supply_features", "unknown": "recalibrate", "insufficient_data": "collect_evidence", "resolved": "none"}


def reliability_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """A row for each bin, empty ones with zeros: lower, upper, n, mean predicted, observed frequency, gap."""
    g = df.groupBy(bin_index(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed"))
    edges = df.sparkSession.createDataFrame([(i, i * (1.0 / bins), (i + 1) * (1.0 / bins)) for i in range(bins)], "bin int, lower double, upper double")
    j = edges.join(g, "bin", "left").na.fill(0, ["n"]).na.fill(0.0, ["mean_predicted", "observed"])
    return j.withColumn("gap", F.col("observed") - F.col("mean_predicted"))


def calibration_report(df: DataFrame, p: str, y: str, s: Settings = DEFAULT) -> DataFrame:
    """One row: brier and ece together or neither (with a reason), and whether the model can be believed."""
    m = binary_metrics(df, p, y, bins=s.bins).select("n", "brier", "ece")
    none = F.col("ece").isNull()
    return m.select("n", F.when(~none, F.col("brier")).alias("brier"), "ece", F.when(none, "one_class_or_empty").alias("reason"), F.coalesce(F.col("ece") <= s.believable_ece, F.lit(False)).alias("believable"))


def evidence_ceiling(n: Column, s: Settings = DEFAULT) -> Column:
    """0 below the minimum, 1 from full evidence on, logarithmic from one half between."""
    lo, hi = s.minimum_evidence, s.full_evidence
    return F.when(n < lo, 0.0).when(n >= hi, 1.0).otherwise(0.5 + 0.5 * F.ln(n / lo) / math.log(hi / lo))


def maturity_ceiling(m: Column) -> Column:
    """U4."""
    out = F.when(F.lit(False), 0.0)
    for name, v in MATURITY_CEILINGS.items():
        out = out.when(m == name, v)
    return out


def assess_confidence(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds confidence_value (least of assertion, calibration, evidence and maturity ceilings) and binding, the
    first of equals in that order; ``probability, threshold, ece, evidence, maturity``."""
    p = F.col("probability")
    parts = [("assertion", F.when(p >= F.col("threshold"), p).otherwise(1 - p)), ("calibration", 1 - F.col("ece")), ("evidence", evidence_ceiling(F.col("evidence"), s)), ("maturity", maturity_ceiling(F.col("maturity")))]
    least = F.array_min(F.array(*[F.struct(v.cast("double").alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(parts)]))
    return df.withColumn("_c", least).withColumns({"confidence_value": F.col("_c.v"), "binding": F.col("_c.n")}).drop("_c")


def band(v: Column, explained: Column | None = None) -> Column:
    """High from .8, medium from .6, else low; without an explanation low."""
    out = F.when(v >= 0.8, "high").when(v >= 0.6, "medium").otherwise("low")
    return out if explained is None else F.when(explained, out).otherwise("low")


def verdict(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds verdict and remedy; only resolved rows keep their probability. ``refusal, ece, evidence, probability``."""
    v = F.when(F.col("refusal").isNotNull(), "refused").when(F.col("ece").isNull() | (F.col("ece") > s.believable_ece), "unknown").when(F.coalesce(F.col("evidence") < s.minimum_evidence, F.lit(True)), "insufficient_data").otherwise("resolved")
    remedy = F.when(F.lit(False), "")
    for k, r in REMEDIES.items():
        remedy = remedy.when(F.col("verdict") == k, r)
    return df.withColumn("verdict", v).withColumn("remedy", remedy).withColumn("probability", F.when(F.col("verdict") == "resolved", F.col("probability")))


def occlusion_contributions(df: DataFrame, keys: list[str], fitted: Fitted, least: float = 1e-3) -> DataFrame:
    """U8: keys, base probability, contributions (feature, delta; largest first) and omitted features.

    Each column in turn takes its training median; all rows are scored in one job.  Of a feature's columns, the one
    that moves the probability most stands for it.  Sizes count to 12 places, as the last bits of equal ones differ;
    equal ones go by column and name.
    """
    from pyspark.ml.functions import vector_to_array

    cols = fitted.columns
    index = F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1)))
    wide = df.select(*keys, *[F.col(f"`{c}`") for c in cols]).withColumn("_i", index)
    swapped = wide.select(*keys, "_i", *[F.when(F.col("_i") == i, F.lit(float(fitted.reference[c]))).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(cols)])
    p = fitted.model.transform(swapped).select(*keys, "_i", vector_to_array("probability")[1].alias("p"))
    base = F.max(F.when(F.col("_i") == -1, F.col("p")))
    per = p.groupBy(*keys).agg(base.alias("base"), F.array_sort(F.collect_list(F.when(F.col("_i") >= 0, F.struct("_i", "p")))).alias("ps"))
    names = F.array(*[F.lit(c.split("=")[0]) for c in cols])
    each = per.select(*keys, "base", F.inline(F.transform("ps", lambda x: F.struct(F.get(names, x["_i"]).alias("feature"), x["_i"].alias("i"), (x["p"] - F.col("base")).alias("delta")))))
    size = F.round(F.abs("delta"), 12)
    best = each.groupBy(*keys, "base", "feature").agg(F.max_by("delta", F.struct(size, -F.col("i"))).alias("delta"))
    item = F.struct((-size).alias("order"), "feature", "delta")
    return best.groupBy(*keys, "base").agg(F.array_sort(F.collect_list(F.when(F.abs("delta") >= least, item))).alias("contributions"), F.array_sort(F.collect_list(F.when(F.abs("delta") < least, F.col("feature")))).alias("omitted"))


def top_contributions(explained: DataFrame, k: int = 3) -> DataFrame:
    """The first k contributions."""
    return explained.withColumn("contributions", F.slice("contributions", 1, k))
