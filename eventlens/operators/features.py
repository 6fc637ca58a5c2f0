"""Fourteen point-in-time features of a session, at every event or at its end.

Nothing after an event's instant counts.  Absence is null, with an availability and a reason in
the long form; it is never a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.context import KEYS, session_context
from eventlens.settings import DEFAULT, Settings

#: Feature -> (lowest, highest, the context key that it needs, column of the context).
SPEC = {
    "session_elapsed_seconds": (0, 86400, "elapsed_seconds"),
    "session_position": (0, 1, "position"),
    "session_event_count": (0, 100000, "event_count"),
    "content_difficulty": (0, 1, "content_difficulty"),
    "content_type_encoded": (None, None, "content_kind"),
    "performance_recent_accuracy": (0, 1, "recent_accuracy"),
    "performance_recent_response_seconds": (0, 86400, "recent_response"),
    "performance_accuracy_trend": (-1, 1, "answer_count"),
    "performance_response_trend": (-86400, 86400, "answer_count"),
    "intervention_count": (0, 100000, "interventions"),
    "intervention_cooldown_active": (0, 1, "seconds_since_last"),
    "intervention_seconds_since_last": (0, 86400 * 365, "seconds_since_last"),
    "trajectory_encoded": (None, None, "trajectory"),
    "baseline_maturity_encoded": (None, None, "baseline_maturity"),
}
FEATURES = tuple(SPEC)
CATEGORICAL = tuple(f for f in FEATURES if f.endswith("encoded"))


def _code(col: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The group that holds the trimmed, lower-cased value; other values are 'other', null stays null."""
    t, out = F.lower(F.trim(col)), F.when(col.isNull(), F.lit(None).cast("string"))
    for name, values in groups.items():
        out = out.when(t.isin(name, *values), name)
    return out.otherwise("other")


#: Version of the definitions of single features, and of the set.
FEATURE_VERSION, FEATURE_SET = "1", "1"


def content_type_encoded(col: Column) -> Column:
    """F5."""
    return _code(col, {"question": (), "video": (), "reading": ("article", "text")})


def trajectory_encoded(col: Column) -> Column:
    """F13."""
    return _code(col, {"improving": ("recovering",), "stable": ("flat",), "declining": ("deteriorating",)})


def baseline_maturity_encoded(col: Column) -> Column:
    """F14."""
    return _code(col, {"new": ("cold_start",), "early": (), "developing": (), "established": ()})


def _sums(value: Column, s: Settings) -> tuple[Column, Column, Column, Column]:
    """(sum, count) of a value inside the short window and before it, up to the current instant."""
    recent = Window.partitionBy(*KEYS).orderBy("us").rangeBetween(-int(s.short_window * 1e6), Window.currentRow)
    before = Window.partitionBy(*KEYS).orderBy("us").rangeBetween(Window.unboundedPreceding, -int(s.short_window * 1e6) - 1)
    return F.sum(value).over(recent), F.count(value).over(recent), F.sum(value).over(before), F.count(value).over(before)


def _trend(value: Column, s: Settings) -> Column:
    rs, rn, bs, bn = _sums(value, s)
    return F.when((rn >= s.min_samples) & (bn >= s.min_samples), rs / rn - bs / bn)


def _trends(s: Settings) -> dict[str, Column]:
    answered = F.col("event_type") == "question_answered"
    return {"performance_accuracy_trend": _trend(F.when(answered, F.col("correct").cast("int")), s), "performance_response_trend": _trend(F.when(answered, F.col("response_seconds")), s)}


def accuracy_trend(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """F8: mean correctness inside the last ``short_window`` seconds less the mean before it."""
    return df.withColumn("performance_accuracy_trend", _trends(s)["performance_accuracy_trend"])


def response_trend(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """the same for response seconds."""
    return df.withColumn("performance_response_trend", _trends(s)["performance_response_trend"])


def compute_features(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """all features at every event; those whose key is missing are null.

    ``trajectory`` and ``baseline_maturity`` are read where the frame has them.
    """
    for c in ("trajectory", "baseline_maturity"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    c = session_context(df, s).withColumns(_trends(s))
    some = F.col("interventions") > 0
    return c.withColumns({
        "session_elapsed_seconds": F.col("elapsed_seconds"), "session_position": F.col("position"), "session_event_count": F.col("event_count"),
        "content_type_encoded": content_type_encoded(F.col("content_kind")),
        "performance_recent_accuracy": F.col("recent_accuracy"), "performance_recent_response_seconds": F.col("recent_response"),
        "intervention_count": F.when(some, F.col("interventions")),
        "intervention_cooldown_active": F.when(some, F.col("in_cooldown").cast("int")),
        "intervention_seconds_since_last": F.col("seconds_since_last"),
        "trajectory_encoded": trajectory_encoded(F.col("trajectory")), "baseline_maturity_encoded": baseline_maturity_encoded(F.col("baseline_maturity")),
    })


def validate_feature_range(df: DataFrame) -> DataFrame:
    """adds ``out_of_range``: sorted names of numeric features outside their declared range; these become null."""
    bad = {f: ~F.col(f).between(lo, hi) | F.isnan(F.col(f).cast("double")) for f, (lo, hi, _) in SPEC.items() if lo is not None and f in df.columns}
    df = df.withColumn("out_of_range", F.array_sort(F.array_compact(F.array(*[F.when(b, F.lit(f)) for f, b in bad.items()]))))
    return df.withColumns({f: F.when(~F.array_contains("out_of_range", f), F.col(f)) for f in bad})


def features_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """F16: one row for each feature: name, value (text), availability, reason, computed_us (the instant it describes) and
    the versions of the feature and of the set."""
    rejected = F.col("out_of_range") if "out_of_range" in df.columns else F.array().cast("array<string>")
    cells = []
    for f, (_, _, need) in SPEC.items():
        short = F.lit(f in ("performance_accuracy_trend", "performance_response_trend"))
        reason = F.when(F.array_contains(rejected, f), "out_of_range").when(F.col(f).isNull() & short & (F.col("answer_count") > 0), "too_few_answers").when(F.col(f).isNull(), F.lit(f"missing_{need}"))
        state = F.when(F.col(f).isNull(), "insufficient_data").when(F.col("synthetic_only"), "synthetic_only").otherwise("available")
        value = F.col(f).cast("string") if f in CATEGORICAL else F.round(F.col(f).cast("double"), 6).cast("decimal(20,6)").cast("string")
        cells.append(F.struct(F.lit(f).alias("name"), value.alias("value"), state.alias("availability"), reason.alias("reason")))
    return df.select(*keys, F.col("us").alias("computed_us"), F.lit(FEATURE_VERSION).alias("feature_version"), F.lit(FEATURE_SET).alias("feature_set"), F.inline(F.array(*cells)))


def feature_coverage(long: DataFrame) -> DataFrame:
    """rows of each feature and availability, and both totals, from one grouping."""
    return long.cube("name", "availability").agg(F.count("*").alias("n")).select(F.coalesce("name", F.lit("all")).alias("name"), F.coalesce("availability", F.lit("all")).alias("availability"), "n")


def vector_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """F18 of each vector: how many features are available and how many are not."""
    have = sum((F.col(f).isNotNull().cast("int") for f in FEATURES), F.lit(0))
    return df.select(*keys, have.alias("available_count"), (len(FEATURES) - have).alias("insufficient_count"))
