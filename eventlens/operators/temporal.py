"""Temporal state: runs of deviations of one sign, read over the last points of each dimension.

Deviations are ``learner_id, us, dimension, z, n`` (n: observations so far).  The state after each
observation is a function of the last ``points`` points of each dimension: bounded windows, no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.baseline import DIMENSIONS, MAD_SCALE, maturity_rank, middle
from eventlens.settings import DEFAULT, Settings

KEY = ["learner_id", "dimension"]
POINTS = "array<struct<us:bigint,z:double>>"


def recent_points(dev: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``points``: the last points of the dimension, points without z included."""
    w = Window.partitionBy(*KEY).orderBy("us").rowsBetween(-(s.points - 1), Window.currentRow)
    return dev.withColumn("points", F.collect_list(F.struct("us", "z")).over(w))


def measured(points: Column) -> Column:
    """The points that have a z."""
    return F.filter(points, lambda p: p["z"].isNotNull())


def sign_run(zs: Column, s: Settings = DEFAULT) -> Column:
    """struct(run, total) of the newest values of one sign with at least ``material`` size; the total adds the oldest of them first, as the SQL does."""
    none = F.struct(F.lit(0).alias("run"), F.lit(0.0).alias("total"), F.lit(0.0).alias("side"))

    def merge(a: Column, z: Column) -> Column:
        goes = F.abs(z) >= s.material
        on = goes & (a["run"] > 0) & (F.signum(z) == a["side"])  # else the run begins anew
        return F.struct(F.when(on, a["run"] + 1).when(goes, 1).otherwise(0).alias("run"), F.when(on, a["total"] + z).when(goes, z).otherwise(0.0).alias("total"), F.signum(z).alias("side"))

    return F.aggregate(zs, none, merge)


def last_n(arr: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def change_per_observation(zs: Column) -> Column:
    """(last - first) / (n - 1); null under two values."""
    n = F.size(zs)
    return F.when(n >= 2, (F.get(zs, n - 1) - F.get(zs, F.lit(0))) / (n - 1))


def direction(zs: Column) -> Column:
    """T4: worsening away from zero, improving towards it, stable without slope."""
    slope, last = change_per_observation(zs), F.get(zs, F.size(zs) - 1)
    return F.when(slope.isNull(), "insufficient_data").when(slope == 0, "stable").when(F.signum(slope) == F.signum(last), "worsening").otherwise("improving")


def dispersion(zs: Column, n: int = DEFAULT.dispersion_points) -> Column:
    """T5: scaled median distance from the median of the last n values; null under two."""
    last = last_n(zs, n)
    # the median is bound once by a list of one: in the inner function it would be taken anew for each value
    away = F.get(F.transform(F.array(middle(last)), lambda m: middle(F.transform(last, lambda x: F.abs(x - m)))), F.lit(0))
    return F.when(F.size(last) >= 2, MAD_SCALE * away)


def tracks(dev: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A row for each learner, instant and dimension: the dimension's points, maturity and analysis then.

    Adds observed (a z was measured now), zs, run, run_mean, direction, dispersion, run_start and
    run_seconds (T12).  Rows are dealt by learner once, which serves every window and grouping up to the states.
    """
    names = list(DIMENSIONS)
    w = Window.partitionBy(*KEY).orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = recent_points(dev.repartition("learner_id"), s)
    rest = [f for f in seen.schema if f.name not in ("learner_id", "us")]
    # an instant's observations, and a row of nulls for each dimension without one
    known = F.col("dimension").isin(*names) & F.col("learner_id").isNotNull() & F.col("us").isNotNull()
    at = seen.groupBy("learner_id", "us").agg(F.collect_list(F.when(known, F.struct(*[f.name for f in rest]))).alias("_seen"))
    missing = F.array_except(F.array(*map(F.lit, names)), F.transform("_seen", lambda x: x["dimension"]))
    blank = F.transform(missing, lambda d: F.struct(*[(d if f.name == "dimension" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rest]))
    grid = at.select("learner_id", "us", F.inline(F.concat("_seen", blank)))
    grid = grid.withColumn("observed", F.col("z").isNotNull())
    grid = grid.withColumn("points", F.coalesce(F.last("points", True).over(w), F.lit(None).cast(POINTS), F.array().cast(POINTS)))
    grid = grid.withColumn("n", F.coalesce(F.last("n", True).over(w), F.lit(0)))
    g = grid.withColumn("zs", F.transform(measured(F.col("points")), lambda p: p["z"]))
    g = g.withColumn("_r", sign_run(F.col("zs"), s)).withColumn("run", F.col("_r.run")).withColumn("run_mean", F.try_divide("_r.total", "run"))
    g = g.withColumn("_base", F.when(F.col("run") >= 2, last_n(F.col("zs"), F.col("run"))).otherwise(last_n(F.col("zs"), 5)))
    g = g.withColumns({"direction": direction(F.col("_base")), "dispersion": dispersion(F.col("zs"), s.dispersion_points)})
    m = measured(F.col("points"))
    begin = F.when(F.col("run") > 0, F.get(m, F.size(m) - F.col("run"))["us"])
    g = g.withColumn("run_start", begin).withColumn("run_seconds", (F.get(m, F.size(m) - 1)["us"] - F.col("run_start")) / 1e6)
    idx = F.create_map(*[x for i, d in enumerate(names) for x in (F.lit(d), F.lit(i))])[F.col("dimension")]
    return g.withColumn("dimension_index", idx).drop("_r", "_base")


def dominant_dimension(tr: DataFrame) -> DataFrame:
    """Per learner and instant the track of largest (run, size of its mean, dispersion); ties to the first dimension."""
    rank = F.when(F.size("zs") > 0, F.struct("run", F.coalesce(F.abs("run_mean"), F.lit(0.0)).alias("m"), F.coalesce("dispersion", F.lit(0.0)).alias("d"), (-F.col("dimension_index")).alias("i")))
    body = F.struct("dimension", "zs", "run", "run_mean", "direction", "dispersion", "run_start", "run_seconds")
    return tr.groupBy("learner_id", "us").agg(
        F.max_by(body, rank).alias("dominant"), F.sum(F.size("zs")).cast("int").alias("observations"), F.min("n").alias("least_n"), F.bool_or(F.size("zs") > 0).alias("any")
    ).withColumn("dominant", F.when(F.col("any"), F.col("dominant"))).drop("any")


def classify_state(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds state, character and change_kind, in the ladder's order."""
    d = F.col("dominant")
    case = F.when(d.isNull() | (F.size(d["zs"]) < 2), "insufficient_data|flat|none").when(d["run"] == 0, "stable|flat|stable").when(d["run"] < s.run_length, "slight_deviation|isolated|anomaly")
    case = case.when(F.abs(d["run_mean"]) >= s.high_mean, "high_deviation|persistent|trajectory").when(d["direction"] == "worsening", "declining|persistent|trajectory")
    case = case.when(d["direction"] == "improving", "recovering|persistent|recovery").otherwise("increasing_deviation|persistent|trajectory")
    parts = F.split(case, "\\|")
    return df.withColumns({"state": parts[0], "character": parts[1], "change_kind": parts[2]})


def state_evidence(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds weakest_maturity (rank), evidence_run, evidence_seconds, mean_z and evidence_dispersion of the dominant track."""
    d, thin = F.col("dominant"), F.col("state") == "insufficient_data"
    zs = d["zs"]
    return df.withColumns({
        "weakest_maturity": maturity_rank(F.col("least_n"), s),
        "evidence_run": F.when(thin, 0).otherwise(d["run"]), "evidence_seconds": F.when(thin, F.lit(0.0)).otherwise(F.coalesce(d["run_seconds"], F.lit(0.0))),
        "mean_z": F.try_divide(F.aggregate(zs, F.lit(0.0), lambda a, z: a + z), F.size(zs)), "evidence_dispersion": d["dispersion"],
    })


def state_history(dev: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """T14, full form: the state after each observation; direction is carried where nothing can be measured (T10 adds from_state)."""
    dev = dev.select("learner_id", "us", "dimension", "z", "n")
    df = state_evidence(classify_state(dominant_dimension(tracks(dev, s)), s), s)
    w = Window.partitionBy("learner_id").orderBy("us")
    now = F.when(F.col("dominant.direction") != "insufficient_data", F.col("dominant.direction"))
    carried = F.last(now, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("direction", F.coalesce(carried, F.lit("insufficient_data"))).withColumn("from_state", F.lag("state", 1, "insufficient_data").over(w)).withColumn("dimension", F.col("dominant.dimension"))


def state_transitions(history: DataFrame) -> DataFrame:
    """One row for each observation: from, to, at, run."""
    return history.select("learner_id", F.col("from_state"), F.col("state").alias("to_state"), F.col("us").alias("at_us"), F.col("evidence_run").alias("run"))


def temporal_state(history: DataFrame) -> DataFrame:
    """The latest state of each learner."""
    cols = [c for c in history.columns if c not in ("learner_id", "dominant")]
    return history.groupBy("learner_id").agg(F.max_by(F.struct(*cols), "us").alias("s")).select("learner_id", "s.*")


def trajectories(tr: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row where a run reaches ``run_length`` by a z measured now; the newest of each dimension are kept."""
    t = tr.where(F.col("observed") & (F.col("run") == s.run_length) & (F.col("direction") != "insufficient_data"))
    run = last_n(F.col("zs"), s.run_length)
    t = t.select(
        "learner_id", "dimension", F.col("run_start").alias("start_us"), F.col("us").alias("end_us"), "direction", F.get(run, F.lit(0)).alias("first_z"), F.get(run, F.lit(s.run_length - 1)).alias("last_z"),
        F.col("run_mean").alias("mean_z"), F.array_max(F.transform(run, F.abs)).alias("peak_z"), change_per_observation(run).alias("rate"), F.col("run_seconds").alias("duration_seconds"),
    )
    w = Window.partitionBy(*KEY).orderBy(F.desc("end_us"))
    return t.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s.trajectories).drop("_r")


def latest_trajectory(trajectory: DataFrame) -> DataFrame:
    """The newest trajectory of each learner and dimension."""
    rest = [c for c in trajectory.columns if c not in KEY]
    return trajectory.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "end_us").alias("t")).select(*KEY, "t.*")


def track_coverage(dev: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Points of each learner and dimension: kept, dropped, and measurable among those kept."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("us"))
    r = dev.withColumn("_kept", F.row_number().over(w) <= s.points)
    return r.groupBy(*KEY).agg(F.count_if("_kept").alias("kept"), F.count_if(~F.col("_kept")).alias("dropped"), F.count_if(F.col("_kept") & F.col("z").isNotNull()).alias("measurable"))
