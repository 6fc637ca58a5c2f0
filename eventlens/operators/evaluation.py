"""Prediction evaluation: what followed each prediction, verdicts, summaries; and response profiles.

Snapshots are ``prediction_id, learner_id, session_id, predicted_us, target, claim, status, model_version``;
a reading is ``prediction_id, reading_learner, reading_us, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.baseline import DIMENSIONS, baseline_observations, deviation
from eventlens.operators.context import end_of_session
from eventlens.operators.features import compute_features
from eventlens.operators.outcomes import ACTIVITY, interval_join
from eventlens.operators.temporal import state_history, temporal_state
from eventlens.settings import DEFAULT, Settings

#: Claims that count as positive for the decline target.
POSITIVE = ("declining", "increasing_deviation", "high_deviation")

#: Most candidates of a catalogue.
CATALOGUE_MOST = 1000


def prediction_snapshots(predictions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds window_end; resolved predictions only, claims of the vocabulary of their target."""
    ok = F.col("status") == "resolved"
    fits = F.when(F.col("target") == "direction", F.col("claim").isin("worsening", "improving", "stable")).otherwise(F.col("claim").isNotNull())
    return predictions.where(ok & fits).withColumn("window_end", F.col("predicted_us") + int(s.horizon * 1e6))


def admissible_events(snapshots: DataFrame, events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(prediction_id, event columns): activity of the same learner and session inside the half-open window."""
    p = snapshots.select("prediction_id", "learner_id", "predicted_us", "window_end", F.col("session_id").alias("_session"))
    j = interval_join(p, events.where(F.col("event_type").isin(*ACTIVITY)), "learner_id", "predicted_us", "window_end", "us", int(s.horizon * 1e6))
    return j.where(F.col("session_id") == F.col("_session")).drop("_session")


def evidence_counts(snapshots: DataFrame, events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Snapshots with the number of admissible events, 0 where there is none."""
    n = admissible_events(snapshots, events, s).groupBy("prediction_id").agg(F.count("*").alias("evidence"))
    return snapshots.join(n, "prediction_id", "left").na.fill(0, ["evidence"])


def frozen_profiles(snapshots: DataFrame, folded: DataFrame) -> DataFrame:
    """(prediction_id, dimension, centre, spread, n): each learner's profile as it stood at the prediction.

    ``folded`` has a row for each version of a profile (B3: learner_id, dimension, us, centre, spread, n).  An
    as-of join by one sort of a learner's versions and predictions, not a join of each with each.
    """
    asked = snapshots.select("learner_id", F.col("predicted_us").alias("us"), "prediction_id").withColumn("dimension", F.explode(F.array(*map(F.lit, DIMENSIONS))))
    known = folded.select("learner_id", "dimension", "us", F.struct("centre", "spread", "n").alias("_p"))
    w = Window.partitionBy("learner_id", "dimension").orderBy("us", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    held = both.withColumn("_p", F.last("_p", True).over(w)).where("_asks = 1 AND _p IS NOT NULL")
    return held.select("prediction_id", "dimension", "_p.*")


def window_chunks(snapshots: DataFrame, events: DataFrame, s: Settings = DEFAULT, least: int = 3) -> DataFrame:
    """Admissible events with ``chunk``: in time order by max(least, ceil(n / 2)); predictions with fewer than two chunks' events have none."""
    w = Window.partitionBy("prediction_id")
    n = F.count("*").over(w)
    chunk = F.floor((F.row_number().over(w.orderBy("us", "event_id")) - 1) / F.greatest(F.lit(least), F.ceil(n / 2)))
    j = admissible_events(snapshots, events, s).withColumns({"chunk": chunk, "_n": n}).where(F.col("_n") >= 2 * least)
    return j.withColumn("_c", F.count("*").over(Window.partitionBy("prediction_id", "chunk"))).where(F.col("_c") >= least).drop("_n", "_c")


def post_window_reading(snapshots: DataFrame, events: DataFrame, folded: DataFrame, s: Settings = DEFAULT, least: int = 3) -> DataFrame:
    """(prediction_id, reading_learner, reading_us, value, state, direction, observations) of what followed a prediction.

    A new temporal state, from in-window events only: each chunk is a session of its own, whose features are
    held against the learner's profile frozen at the prediction, in all four dimensions.  ``value`` is
    the direction where the target is one, else the state; it is insufficient_data where nothing can be
    measured (no profile, no spread).  Predictions whose events make no two chunks have no row.
    """
    parts = window_chunks(snapshots, events, s, least)
    key = F.concat_ws(":", F.col("prediction_id").cast("string"), F.col("chunk").cast("string"))
    vectors = end_of_session(compute_features(parts.withColumn("session_id", key), s))
    seen = baseline_observations(vectors, ["prediction_id"]).where("NOT rejected")
    z = seen.join(frozen_profiles(snapshots, folded), ["prediction_id", "dimension"], "left")
    dev = z.select(F.col("prediction_id").alias("learner_id"), "us", "dimension", deviation(F.col("value"), F.col("centre"), F.col("spread"), F.col("n"))[1].alias("z"), F.coalesce("n", F.lit(0)).alias("n"))
    state = temporal_state(state_history(dev, s)).select(F.col("learner_id").alias("prediction_id"), F.col("us").alias("reading_us"), "state", "direction", "observations")
    about = snapshots.select("prediction_id", F.col("learner_id").alias("reading_learner"), "target")
    return about.join(state, "prediction_id").withColumn("value", F.when(F.col("target") == "direction", F.col("direction")).otherwise(F.col("state"))).drop("target")


def ground_truth(snapshots: DataFrame, readings: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds truth (confirmed / refuted / insufficient_data / not_assessable) and truth_reason, in the ladder's order.

    Snapshots carry ``evidence``; only resolved ones reach an assessment.
    """
    j = snapshots.join(readings, "prediction_id", "left")
    case = (
        F.when(~F.col("status").eqNullSafe("resolved"), "not_assessable|not_resolved").when(F.col("evidence") < s.evaluation_samples, "insufficient_data|too_few_events")
        .when(F.col("reading_us").isNull(), "not_assessable|no_reading").when(F.col("reading_learner") != F.col("learner_id"), "not_assessable|other_learner")
        .when(F.col("reading_us") < F.col("predicted_us"), "not_assessable|before_prediction").when(F.col("reading_us") >= F.col("window_end"), "not_assessable|outside_window")
        .when(F.col("value").isNull() | (F.col("value") == "insufficient_data"), "not_assessable|uncharacterised").when(F.col("claim") == F.col("value"), "confirmed|equal").otherwise("refuted|different")
    )
    return j.withColumns({"truth": F.split(case, "\\|")[0], "truth_reason": F.split(case, "\\|")[1]})


def evaluate(truths: DataFrame) -> DataFrame:
    """E5: adds verdict, and for the decline target the cell of the confusion matrix."""
    verdict = F.when(F.col("truth") == "confirmed", "correct").when(F.col("truth") == "refuted", "incorrect").otherwise("not_assessable")
    said, was = F.col("claim").isin(*POSITIVE), F.col("value").isin(*POSITIVE)
    cell = F.when(said & was, "tp").when(said, "fp").when(was, "fn").otherwise("tn")
    return truths.withColumn("verdict", verdict).withColumn("cell", F.when((F.col("target") == "decline") & (F.col("verdict") != "not_assessable"), cell))


def intervention_response(outcomes: DataFrame, *more: Column, of: tuple[str, ...] = ()) -> DataFrame:
    """(intervention_id, of..., response) from the measures of each delivery, and more aggregates of them.

    ``of`` names columns that a delivery's rows have in common: as keys they need no buffer of texts, which would sort the rows.
    """
    up, down = F.bool_or(F.col("direction") == "improved"), F.bool_or(F.col("direction") == "deteriorated")
    case = F.when(~F.bool_or(F.col("status") == "measured"), "insufficient_data").when(up & down, "mixed").when(up, "improvement").when(down, "deterioration").otherwise("no_change")
    return outcomes.groupBy("intervention_id", *of).agg(case.alias("response"), *more)


def _summary() -> list[Column]:
    n = lambda c: F.count_if(c)
    cell = lambda x: n(F.col("cell") == x)
    tp, fp, tn, fn = (cell(x) for x in ("tp", "fp", "tn", "fn"))
    right, wrong = n(F.col("verdict") == "correct"), n(F.col("verdict") == "incorrect")
    responses = [n(F.col("response") == r).alias(f"response_{r}") for r in ("improvement", "deterioration", "no_change", "mixed", "insufficient_data")]
    return [
        F.count("*").alias("n"), right.alias("n_correct"), wrong.alias("n_incorrect"), n(F.col("verdict") == "not_assessable").alias("n_not_assessable"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.try_divide(right + wrong, F.count("*")).alias("coverage"), F.try_divide(right, right + wrong).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(fn, fn + tp).alias("fnr"), F.count_distinct("learner_id").alias("learners"), *responses,
    ]


def summarise(records: DataFrame) -> DataFrame:
    """One row: counts, coverage and rates, null where the denominator is 0."""
    return records.agg(*_summary())


def summarise_by(records: DataFrame, keys: tuple[str, ...] = ("learner_id", "model_version", "target", "response")) -> DataFrame:
    """The same for each value of each key and for all, from one scan: (grouping, value, ...); null values are dropped."""
    cells = [F.struct(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("value")) for k in keys]
    each = records.withColumn("_g", F.explode(F.array(*cells, F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value"))))).select("*", F.col("_g.grouping").alias("grouping"), F.col("_g.value").alias("group_value"))
    return each.where("group_value IS NOT NULL").groupBy("grouping", "group_value").agg(*_summary())


def response_observation(outcomes: DataFrame) -> DataFrame:
    """(learner_id, intervention_id, response_direction): of subsequent_trajectory, else of session_continuation."""
    of = lambda m: F.max(F.when((F.col("measure") == m) & (F.col("direction") != "not_assessed"), F.col("direction")))
    d = F.coalesce(of("subsequent_trajectory"), of("session_continuation"))
    case = F.when(d == "improved", "positive").when(d == "no_change", "neutral").when(d == "deteriorated", "negative").otherwise("not_assessable")
    return outcomes.groupBy("learner_id", "intervention_id").agg(case.alias("response_direction"))


def response_profiles(observations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """R2: counts, status (collecting / active) and half-even success rate of each learner, candidate and context."""
    n = lambda d: F.count_if(F.col("response_direction") == d)
    g = observations.groupBy("learner_id", "candidate", "context").agg(F.count("*").alias("observations"), n("positive").alias("positive"), n("neutral").alias("neutral"), n("negative").alias("negative"))
    assessable = F.col("positive") + F.col("neutral") + F.col("negative")
    active = F.col("observations") >= s.profile_min
    return g.withColumn("status", F.when(active, "active").otherwise("collecting")).withColumn("success_rate", F.when(active & (assessable > 0), F.bround(F.col("positive") / assessable, 4)))


def rank_candidates(profiles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each learner and context's candidates by success rate (0.5 unless active), then in catalogue order.

    The catalogue is what may be offered: a bounded list, counted before it goes to the tasks.  Each
    learner and context is one row with its profiles in a map, and the list is unfolded beside it.
    """
    offered = catalogue.orderBy("priority").limit(CATALOGUE_MOST + 1).collect()
    if len(offered) > CATALOGUE_MOST:
        raise ValueError(f"a catalogue has at most {CATALOGUE_MOST} candidates")
    rate = F.when(F.col("status") == "active", F.col("success_rate"))
    known = profiles.groupBy("learner_id", "context").agg(F.map_from_entries(F.collect_list(F.struct("candidate", rate.alias("r")))).alias("_rates"))
    cells = F.array(*[F.struct(F.lit(r["candidate"]).alias("candidate"), F.lit(r["priority"]).alias("priority")) for r in offered])
    each = known.select("learner_id", "context", "_rates", F.inline(cells))
    scored = each.withColumn("score", F.coalesce(F.try_element_at("_rates", F.col("candidate")), F.lit(0.5)))
    w = Window.partitionBy("learner_id", "context").orderBy(F.desc("score"), "priority")
    return scored.withColumn("rank", F.row_number().over(w)).select("learner_id", "context", "candidate", "score", "rank")


def profiles_for(profiles: DataFrame, learner: str) -> DataFrame:
    """One learner's profiles, ordered."""
    return profiles.where(F.col("learner_id") == learner).orderBy("candidate", "context")
