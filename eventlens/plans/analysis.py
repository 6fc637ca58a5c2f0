"""The whole chain for every learner, as one plan that is dealt by learner once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators import authority as A
from eventlens.operators import baseline as B
from eventlens.operators import evaluation as E
from eventlens.operators import features as X
from eventlens.operators import log_queries as Q
from eventlens.operators import models as M
from eventlens.operators import outcomes as O
from eventlens.operators import policy as P
from eventlens.operators import temporal as T
from eventlens.operators import uncertainty as U
from eventlens.operators.context import is_last
from eventlens.settings import DEFAULT, Settings
from eventlens.sources.shared import saved


@dataclass(frozen=True)
class Learning:
    """What a model learns from: features that a row must have, the label's answers before and after, and the share held out."""

    required: tuple[str, ...] = X.FEATURES
    back: int = 3
    ahead: int = 3
    skip: int = 10
    every: int = 4
    algorithm: str = "logistic"
    threshold: float = 0.5


def labelled(vectors: DataFrame, how: Learning) -> DataFrame:
    """Design rows of the answers before each learner's cut, with M1's label over the learner's answers, and ``holdout`` by learner.

    The label is read beside the features of its own row: no join brings both together.
    """
    answers = vectors.select("learner_id", F.col("learner_id").alias("session_id"), "event_id", "us", "event_type", "correct", *how.required)
    rows = M.next_k_drop_label(answers, back=how.back, ahead=how.ahead, skip=how.skip).select("learner_id", "event_id", "us", "label", *how.required)
    return M.group_holdout(M.encode_design(rows, how.required)[0], "learner_id", "us", how.every)


def fitted_before(rows: DataFrame, how: Learning) -> M.Fitted:
    """A model trained on the learners that aren't held out."""
    fitted = M.train(rows.where("NOT holdout").drop("holdout"), M.design_columns(how.required), algorithm=how.algorithm)
    fitted.threshold = how.threshold
    return fitted


def calibration(rows: DataFrame, fitted: M.Fitted, s: Settings) -> DataFrame:
    """One row ``ece`` of the model on the learners held out; null on one class or without such rows."""
    held = M.score(rows.where("holdout").drop("holdout"), fitted).where("probability IS NOT NULL")
    return M.expected_calibration_error(held, "probability", "label", s.bins)


def scored(last: DataFrame, fitted: M.Fitted, required: tuple[str, ...]) -> DataFrame:
    """(learner_id, probability, refusal) of each learner's last vector; features that it lacks are named."""
    good, bad = M.encode_design(last.select("learner_id", *required), required)
    refused = bad.select("learner_id", F.lit(None).cast("double").alias("probability"), F.concat(F.lit("absent:"), F.array_join("lacks", ",")).alias("refusal"))
    return M.score(good, fitted).select("learner_id", "probability", "refusal").unionByName(refused)


def remembered(deliveries: DataFrame, past: DataFrame, cuts: DataFrame, history: DataFrame, contexts: DataFrame, s: Settings) -> DataFrame:
    """Authority memory: how learners responded to deliveries whose windows ended before the cut, in their context."""
    m = O.measure_outcomes(deliveries, past, history, s)
    each = E.intervention_response(m, of=("learner_id", "response_class", "delivered_us"))
    outcome = F.when(F.col("response") == "improvement", "improved").when(F.col("response") == "deterioration", "deteriorated").when(F.col("response_class") == "non_response", "no_response")
    each = each.select("learner_id", outcome.alias("outcome"), (F.col("delivered_us") + int(s.after * 1e6)).alias("recorded_us"))
    kept = each.join(cuts.select("learner_id", "cut_us"), "learner_id").where("recorded_us <= cut_us AND outcome IS NOT NULL")
    return kept.join(contexts.select("learner_id", "context"), "learner_id").select("learner_id", "context", "outcome", F.lit(1.0).alias("weight"), "recorded_us")


def timed(events: DataFrame) -> DataFrame:
    """Deliveries with the time to their completion."""
    return P.delivery_history(events).withColumn("response_seconds", (F.col("completed_us") - F.col("delivered_us")) / 1e6)


def evaluated(decisions: DataFrame, folded: DataFrame, events: DataFrame, s: Settings) -> DataFrame:
    """Each decision's claim of a direction against what followed it, read by the profile frozen at the decision."""
    claims = decisions.select(F.col("decision_id").alias("prediction_id"), "learner_id", "session_id", F.col("decided_us").alias("predicted_us"), F.lit("direction").alias("target"), F.col("direction").alias("claim"), F.col("verdict").alias("status"))
    snapshots = E.evidence_counts(E.prediction_snapshots(claims, s), events, s)
    return E.evaluate(E.ground_truth(snapshots, E.post_window_reading(snapshots, events, folded, s), s))


def analyse(
    events: DataFrame, contexts: DataFrame, s: Settings = DEFAULT, min_after: int = 4, catalogue: tuple[P.Candidate, ...] = P.CATALOGUE, model: M.Fitted | None = None, how: Learning = Learning(),
    permitted: tuple[str, ...] = A.PERMITTED,
) -> dict[str, DataFrame]:
    """Phase A reads events up to each learner's cut only: features, baseline, state, score, confidence, decision, action.
    Phase B measures what followed deliveries and decisions, without touching A.

    ``contexts`` has a row for each learner: context, risk, reversible, high_stakes, high_impact and
    expires_us (null: the settings' expiry after the decision); learners without one get no decision.
    Without ``model`` one is trained on the answers before the cuts; either is calibrated on the
    learners held out, and its threshold is the decisions' own.  How learners responded before bounds authority.
    """
    dealt = events.repartition("learner_id")
    cuts = saved(Q.decision_cut(dealt, min_after), "cuts")
    every = X.compute_features(Q.as_of(dealt, cuts).drop("cut_us"), s).withColumn("_last", is_last())
    read = {*how.required, *(f for f, _, _ in B.DIMENSIONS.values())} - {*events.columns}
    every = saved(every.select(*events.columns, *sorted(read), "_last"), "features")
    past = every.select(*events.columns)
    vectors = every.where("_last").drop("_last")
    folded = saved(B.winsorised_ewma(B.baseline_observations(vectors).where("NOT rejected"), ["learner_id", "dimension"], ["us"], "value", s), "folded")
    history = saved(T.state_history(B.deviations(folded, ["learner_id", "dimension"]), s), "history")
    state = T.temporal_state(history)
    rows = saved(labelled(every, how), "labelled")
    model = model or fitted_before(rows, how)
    last = vectors.groupBy("learner_id").agg(F.max_by(F.struct("session_id", *how.required), F.struct("us", "event_id")).alias("v")).select("learner_id", "v.*")
    j = cuts.select("learner_id", F.col("cut_us").alias("decided_us")).join(last.select("learner_id", "session_id"), "learner_id").join(scored(last, model, how.required), "learner_id")
    j = j.join(contexts, "learner_id").join(state.select("learner_id", "state", "direction", "observations", "weakest_maturity"), "learner_id", "left")
    maturity = F.element_at(F.array(*map(F.lit, B.MATURITIES)), F.coalesce("weakest_maturity", F.lit(0)) + 1)
    j = j.withColumns({"decision_id": F.xxhash64("learner_id"), "threshold": F.lit(model.threshold), "evidence": F.coalesce("observations", F.lit(0)), "maturity": maturity})
    j = j.withColumn("ece", F.lit(calibration(rows, model, s).first()["ece"]).cast("double"))
    j = U.assess_confidence(U.verdict(j, s), s)
    j = j.withColumn("confidence", F.when(F.col("confidence_value").isNotNull(), U.band(F.col("confidence_value"))))
    j = saved(j, "assessed")
    deliveries = saved(timed(past), "deliveries")
    decided = saved(P.decide(j, deliveries, catalogue, s), "decided")
    memory = saved(remembered(deliveries, past, cuts, history, contexts, s), "memory")
    held = A.authority_level(A.clamp_authority(A.decayed_authority(memory, decided, s), s), s)
    expires = F.coalesce("expires_us", F.col("decided_us") + int(s.expiry * 1e6))
    final = saved(A.delivery_status(A.final_action(held.withColumn("expires_us", expires), s, permitted=permitted)), "decisions")
    outcomes = O.measure_outcomes(timed(events), events, history, s)
    return {"decisions": final, "history": history, "outcomes": outcomes, "responses": E.intervention_response(outcomes), "evaluations": evaluated(final, folded, events, s)}
