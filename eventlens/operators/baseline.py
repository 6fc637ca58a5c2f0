"""Personal baselines: one running centre and spread for each key and dimension.

Observations are ``keys..., dimension, us, value``.  The robust fold depends on order and is no
associative aggregate: each key's observations are sorted into one task and streamed past a running
state, so a key takes linear time and no memory for its rows.  Without robustness the centre has a
closed form and is a plain sum.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.medians import block_median
from eventlens.settings import DEFAULT, Settings

#: Dimension -> (feature that feeds it, lowest, highest), in canonical order.
DIMENSIONS = {
    "accuracy": ("performance_recent_accuracy", 0.0, 1.0),
    "response_seconds": ("performance_recent_response_seconds", 0.0, 86400.0),
    "session_seconds": ("session_elapsed_seconds", 0.0, 86400.0),
    "content_difficulty": ("content_difficulty", 0.0, 1.0),
}
#: Fixed values.
MATURITIES = ("new", "early", "developing", "established")
BASES = ("population_prior", "partial_personal", "personal", "personal")
MAD_SCALE = 1.4826


def baseline_observations(features: DataFrame, keys: list[str] = ["learner_id"]) -> DataFrame:  # noqa: B006
    """B1: (keys, us, dimension, value, rejected): unavailable values are absent, those outside the range rejected."""
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(f).cast("double").alias("value"), (F.isnan(F.col(f).cast("double")) | ~F.col(f).between(lo, hi)).alias("rejected")) for d, (f, lo, hi) in DIMENSIONS.items()]
    return features.select(*keys, "us", F.inline(F.array(*cells))).where("value IS NOT NULL")


def rejections(observations: DataFrame, keys: list[str]) -> DataFrame:
    """B1: accepted and rejected observations of each key and dimension, and the last reason."""
    reason = F.max_by(F.when(F.col("rejected"), F.concat(F.lit("out_of_range:"), "dimension")), F.when(F.col("rejected"), F.col("us")))
    return observations.groupBy(*keys, "dimension").agg(F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected"), reason.alias("last_reason"))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = DEFAULT.alpha) -> DataFrame:
    """B2: centre of each key, c = x for the first and c += alpha (x - c) for the others, by its closed form."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy(*order))
    weight = F.when(i == 1, F.pow(F.lit(1 - alpha), n - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), n - i))
    return df.withColumn("_w", weight).groupBy(*keys).agg(F.sum(F.col("_w") * F.col(value)).alias("centre"), F.count("*").alias("n"))


def decimate(arr: Column, limit: int) -> Column:
    """While longer than ``limit``: the elements at odd 0-based places, and the newest of an odd number."""
    half = lambda a: F.concat(F.filter(a, lambda x, i: i % 2 == 1), F.when(F.size(a) % 2 == 1, F.slice(a, -1, 1)).otherwise(F.slice(a, 1, 0)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), arr, lambda a, _: F.when(F.size(a) > limit, half(a)).otherwise(a))


def middle(arr: Column) -> Column:
    """Median of an array without nulls; null when empty."""
    s, n = F.sort_array(arr), F.size(arr)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mad_about(arr: Column, centre: Column) -> Column:
    """1.4826 times the median distance from a supplied centre; null under two values."""
    return F.when(F.size(arr) >= 2, MAD_SCALE * middle(F.transform(arr, lambda x: F.abs(x - centre))))


def rms_about(arr: Column, centre: Column) -> Column:
    """Root of the sum of squares about a supplied centre over n - 1; null under two values."""
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))
    return F.when(F.size(arr) >= 2, F.sqrt(total / (F.size(arr) - 1)))


def winsorised_ewma(df: DataFrame, keys: list[str], order: list[str], value: str, s: Settings = DEFAULT, robust: bool = True) -> DataFrame:
    """A row for each observation: keys, order, value, n, centre, spread and retained values.

    A step is clipped to ``step_limit`` times the spread before it, where that is above 0; then
    the spread is taken about the new centre over the retained values.  Without ``robust``: no
    clipping, and the root mean square as spread.
    """
    rows = df.select(*keys, *order, F.col(value).cast("double").alias("value"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in (*order, "value")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for k, x in zip(zip(*(b[c].to_pylist() for c in keys)), b["value"].to_pylist()):
                if k != key or state is None:
                    key, state = k, RunningSpread(s, robust)
                out.append(state.add(x))
            columns = [pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.float64(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "n", "centre", "spread", "retained"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n int, centre double, spread double, retained int"
    return dealt.mapInArrow(fold, kind)


def middle_distance(ordered: list[float], centre: float) -> float:
    """Median distance from the centre of an ascending list: both sides hold ascending distances, so that
    one binary search finds how many of the nearer half lie below the centre."""
    n, p = len(ordered), bisect_left(ordered, centre)
    half = n // 2
    lo, hi = max(0, half - (n - p)), min(p, half)
    while lo < hi:
        i = (lo + hi) // 2
        if centre - ordered[p - 1 - i] < ordered[p + half - i - 1] - centre:
            lo = i + 1
        else:
            hi = i
    i, j = lo, half - lo
    after = min(centre - ordered[p - 1 - i] if i < p else inf, ordered[p + j] - centre if j < n - p else inf)
    if n % 2:
        return after
    return (max(centre - ordered[p - i] if i else 0.0, ordered[p + j - 1] - centre if j else 0.0) + after) / 2


class RunningSpread:
    """Centre and spread of one key.

    Retained values are held in order of arrival and in ascending order; ``add`` inserts into both and
    reads the median distance by binary search.  Only a decimation sorts again.
    """

    def __init__(self, s: Settings, robust: bool):
        self.s, self.robust = s, robust
        self.n, self.centre, self.spread = 0, None, None
        self.kept: list[float] = []
        self.ordered: list[float] = []
        self.mean, self.squares = 0.0, 0.0

    def resume(self, n: int, centre: float | None, spread: float | None, kept: list[float]) -> RunningSpread:
        """The state that was left with these numbers and retained values."""
        self.n, self.centre, self.spread = n, centre, spread
        self._hold(list(kept))
        return self

    def arrived(self) -> list[float]:
        return self.kept

    def _hold(self, kept: list[float]) -> None:
        self.kept, self.ordered = kept, sorted(kept)
        self.mean = sum(kept) / len(kept) if kept else 0.0
        self.squares = sum((x - self.mean) ** 2 for x in kept)

    def add(self, x: float | None) -> tuple[int, float | None, float | None, int]:
        """(n, centre, spread, retained values) with one more value; a null or NaN changes nothing but n."""
        self.n += 1
        if x is None or x != x:
            return self.n, self.centre, self.spread, len(self.kept)
        step = x - self.centre if self.centre is not None else None
        if step is not None and self.robust and self.spread:
            limit = self.s.step_limit * self.spread
            step = max(-limit, min(limit, step))
        self.centre = x if step is None else self.centre + self.s.alpha * step
        self.kept.append(x)
        size = len(self.kept)
        if size > self.s.retained:
            self._hold(self.kept[1::2] + (self.kept[-1:] if size % 2 else []))
            size = len(self.kept)
        else:
            insort(self.ordered, x)
            away = x - self.mean
            self.mean += away / size
            self.squares += away * (x - self.mean)
        if size >= 2 and self.robust:
            self.spread = MAD_SCALE * middle_distance(self.ordered, self.centre)
        elif size >= 2:
            self.spread = ((self.squares + size * (self.mean - self.centre) ** 2) / (size - 1)) ** 0.5
        return self.n, self.centre, self.spread, size


def maturity(n: Column, s: Settings = DEFAULT) -> Column:
    """Name of the maturity of n observations."""
    a, b, c = s.maturity
    return F.when(n < a, MATURITIES[0]).when(n < b, MATURITIES[1]).when(n < c, MATURITIES[2]).otherwise(MATURITIES[3])


def maturity_rank(n: Column, s: Settings = DEFAULT) -> Column:
    a, b, c = s.maturity
    return F.when(n < a, 0).when(n < b, 1).when(n < c, 2).otherwise(3)


def basis(n: Column, s: Settings = DEFAULT) -> Column:
    return F.element_at(F.array(*map(F.lit, BASES)), maturity_rank(n, s) + 1)


def build_priors(observations: DataFrame, value: str = "value") -> DataFrame:
    """(dimension, prior_centre, prior_spread, n_reference) of a cohort: the median, and the scaled
    median distance from it; dimensions without spread give no prior."""
    rows = observations.select("dimension", F.col(value).cast("double").alias("v"))
    mid = block_median(rows, ["dimension"], "v").select("dimension", F.col("median").alias("prior_centre"), F.col("n").alias("n_reference"))
    away = rows.join(F.broadcast(mid), "dimension").select("dimension", F.abs(F.col("v") - F.col("prior_centre")).alias("v"))
    near = block_median(away, ["dimension"], "v").select("dimension", (MAD_SCALE * F.col("median")).alias("prior_spread"))
    return mid.join(near, "dimension").where("prior_spread > 0").select("dimension", "prior_centre", "prior_spread", "n_reference")


def baseline_reference(profile: DataFrame, priors: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ref_centre, ref_spread and ref_source: the personal values, or for new profiles the prior of
    the dimension; without one, unavailable.  Priors have one row for each dimension."""
    new = maturity_rank(F.col("n"), s) == 0
    j = profile.join(F.broadcast(priors.select("dimension", "prior_centre", "prior_spread")), "dimension", "left")
    return j.withColumns({
        "ref_centre": F.when(new, F.col("prior_centre")).otherwise(F.col("centre")), "ref_spread": F.when(new, F.col("prior_spread")).otherwise(F.col("spread")),
        "ref_source": F.when(~new, "personal").when(F.col("prior_centre").isNotNull(), "population_prior").otherwise("unavailable"),
    }).drop("prior_centre", "prior_spread")


def deviation(value: Column, centre: Column, spread: Column, n: Column) -> tuple[Column, Column, Column]:
    """(absolute, standardised, reason): standardised is null with a reason where there is no spread."""
    absolute = value - centre
    reason = F.when(centre.isNull(), "no_reference").when(n < 2, "too_few_values").when(spread.isNull() | (spread == 0), "no_spread")
    return absolute, F.when(reason.isNull(), absolute / spread), reason


def deviations(folded: DataFrame, keys: list[str], exclude_current: bool = False) -> DataFrame:
    """B9 over the fold: each observation against the profile that holds it, or the one before it."""
    if exclude_current:
        w = Window.partitionBy(*keys).orderBy("n")
        folded = folded.withColumns({c: F.lag(c).over(w) for c in ("centre", "spread")}).withColumn("_n", F.col("n") - 1)
    n = F.col("_n") if exclude_current else F.col("n")
    a, z, why = deviation(F.col("value"), F.col("centre"), F.col("spread"), n)
    return folded.withColumns({"absolute": a, "z": z, "reason": why}).drop("_n")


def refuse_late(df: DataFrame, key: str, arrival: list[str], time: str = "us") -> DataFrame:
    """Adds ``refused``: late (not strictly after the latest time that came before) or no_learner."""
    w = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("refused", F.when(F.col(key).isNull(), "no_learner").when(F.col(time) <= F.max(time).over(w), "late"))


def centre_drift(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and dimension the first and last centre, drift and relative drift (null if the first is about 0)."""
    g = folded.groupBy(*keys, "dimension").agg(F.min_by("centre", "n").alias("first_centre"), F.max_by("centre", "n").alias("last_centre"))
    g = g.withColumn("drift", F.col("last_centre") - F.col("first_centre"))
    return g.withColumn("relative_drift", F.when(F.abs("first_centre") > 1e-12, F.col("drift") / F.abs("first_centre")))


def largest_mover(drift: DataFrame, keys: list[str]) -> DataFrame:
    """The dimension of largest relative drift of each key; ties to the lesser name."""
    order = {d: i for i, d in enumerate(DIMENSIONS)}
    idx = F.create_map(*[x for d, i in order.items() for x in (F.lit(d), F.lit(-i))])[F.col("dimension")]
    return drift.where("relative_drift IS NOT NULL").groupBy(*keys).agg(F.max_by("dimension", F.struct(F.abs("relative_drift"), idx)).alias("dimension"))


def baseline_profile(folded: DataFrame, rejected: DataFrame, keys: list[str], s: Settings = DEFAULT, readings: DataFrame | None = None) -> DataFrame:
    """The last state of each key and dimension, with maturity, basis and rejections.

    ``readings(keys, us, origin_label)`` tells where each observation came from: adds ``origins``, the sorted labels
    of those that the profile has taken in.
    """
    last = folded.groupBy(*keys, "dimension").agg(F.max_by(F.struct("centre", "spread", "n", "retained", F.col("us").alias("updated_us")), "n").alias("p")).select(*keys, "dimension", "p.*")
    j = last.join(rejected.select(*keys, "dimension", "rejected"), [*keys, "dimension"], "left").na.fill(0, ["rejected"])
    if readings is not None:
        of = folded.select(*keys, "dimension", "us").join(readings.select(*keys, "us", "origin_label"), [*keys, "us"], "left")
        j = j.join(of.groupBy(*keys, "dimension").agg(F.array_sort(F.collect_set("origin_label")).alias("origins")), [*keys, "dimension"], "left")
    return j.withColumns({"maturity": maturity(F.col("n"), s), "basis": basis(F.col("n"), s)})
