"""Registered queries: intervention policy and authority, over decisions that the log's closings stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import authority as A
from eventlens.operators import policy as P
from eventlens.plans.canon import CANON, events, pick, r6, steady
from eventlens.settings import SPARSE

TYPES = (P.Candidate("recap", 0, "medium"), P.Candidate("micro_question", 1, "low", ("declining", "high_deviation")), P.Candidate("pause", 2, "high"), P.Candidate("reflection", 3, "high"))


def deliveries(s, d):
    return P.delivery_history(events(s, d))


def decisions(s, d):
    k = F.col("k")
    return events(s, d).where("event_type = 'content_closed'").select(
        F.col("event_id").alias("decision_id"), "learner_id", "session_id", F.col("us").alias("decided_us"), "k",
        F.when(k % 7 == 0, "insufficient_data").otherwise("resolved").alias("verdict"), (0.5 + (k % 25) / 50.0).alias("probability"), F.lit(0.5).alias("threshold"),
        F.when(k % 11 == 0, "low").when(k % 2 == 0, "medium").otherwise("high").alias("confidence"), (k % 13 + 2).alias("evidence"),
        F.when(k % 10 == 0, "insufficient_data").when(k % 10 == 1, "stable").when(k % 10 < 5, "declining").when(k % 10 < 8, "high_deviation").otherwise("increasing_deviation").alias("state"),
        pick(("free_practice", "graded_assessment", "exam_hall", "lab"), k % 4).alias("context"),
    )


def history(s, d):
    return P.decision_history(decisions(s, d), deliveries(s, d), TYPES, SPARSE)


def decided(s, d):
    return P.decide(decisions(s, d), deliveries(s, d), TYPES, SPARSE)


def memory(s, d):
    k = F.col("k")
    return events(s, d).where("event_type = 'intervention_completed'").select(
        "event_id", "learner_id", "session_id", pick(("free_practice", "graded_assessment", "exam_hall", "lab"), k % 4).alias("context"), pick(("improved", "disputed", "deteriorated", "no_response", "odd"), k % 5).alias("outcome"),
        F.when(k % 3 == 0, 0.5).otherwise(1.0).alias("weight"), F.col("us").alias("recorded_us"), pick(("recap", "micro_question", "pause"), k % 3).alias("action"),
    )


def authorised(s, d, of=None):
    a = A.clamp_authority(A.decayed_authority(memory(s, d), decided(s, d) if of is None else of, SPARSE), SPARSE)
    c = F.col("context")
    a = a.withColumns({"risk": F.when(c == "exam_hall", "high").when(c == "graded_assessment", "medium").otherwise("low"), "reversible": c != "exam_hall", "high_stakes": (c == "graded_assessment") & (F.col("k") % 3 == 0)})
    return A.authority_level(a, SPARSE)


def final(s, d, of=None):
    a = authorised(s, d, of).withColumn("expires_us", F.when(F.col("k") % 17 == 0, F.col("decided_us")).otherwise(F.col("decided_us") + int(SPARSE.expiry * 1e6))).withColumn("high_impact", F.col("k") % 6 == 0)
    return A.final_action(a, SPARSE, permitted=("recap", "micro_question", "pause"))


def per_type(s, d, *cols):
    return history(s, d).select("decision_id", F.inline("candidates")).select("decision_id", F.col("type"), *cols)


def feedback(s, d):
    k = F.col("k")
    return events(s, d).where("event_type = 'interaction'").select("event_id", pick(("confirmed", "disputed", "corrected", "override", "shrug"), k % 5).alias("verdict"), F.when(k % 9 == 0, " ").otherwise("lab").alias("context"), F.when(k % 5 == 2, F.when(k % 4 != 0, F.lit("stable"))).alias("corrected_reading"))


def chain(s, d):
    return A.hash_chain(memory(s, d), "learner_id", ["recorded_us", "event_id"], ["event_id", "outcome", "context"])


QUERIES = {
    "p1_delivery_history": lambda s, d: deliveries(s, d).select("intervention_id", "intervention_type", "session_id", "delivered_us", "outcome", "completed_us"),
    "p2_outcome_class": lambda s, d: events(s, d).select("event_id", P.outcome_class(F.concat(F.lit(" "), F.upper("outcome"))).alias("class")),
    "p3_history_as_of": lambda s, d: P.history_as_of(deliveries(s, d), decisions(s, d)).groupBy("decision_id").agg(
        F.count("*").alias("n"), F.max("delivered_us").alias("last_us"), F.min("delivered_us").alias("first_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", "intervention_id"))), lambda x: x["intervention_id"].cast("string")), ",").alias("ids"),
    ),
    "p4_deliveries_in_window": lambda s, d: history(s, d).select("decision_id", "in_window"),
    "p5_deliveries_in_session": lambda s, d: history(s, d).select("decision_id", "in_session", "total_delivered"),
    "p6_seconds_since_last": lambda s, d: history(s, d).select("decision_id", *r6("seconds_since_last")),
    "p7_trailing_run": lambda s, d: per_type(s, d, "run"),
    "p8_consecutive_non_responses": lambda s, d: per_type(s, d, F.col("declined").cast("int").alias("declined")),
    "p9_retired_types": lambda s, d: P.retired_types(history(s, d), SPARSE).select("decision_id", F.array_join("retired", ",").alias("retired")),
    "p10_measured_outcomes": lambda s, d: per_type(s, d, "responses", "non_responses"),
    "p11_eligible_candidates": lambda s, d: P.eligible_candidates(history(s, d), SPARSE).select("decision_id", F.inline("judged")).select("decision_id", "type", F.array_join("why", ",").alias("why")),
    "p12_decide": lambda s, d: decided(s, d).select("decision_id", "decision", "reason"),
    "p13_restraints_long": lambda s, d: P.restraints_long(decided(s, d), SPARSE, TYPES).select("decision_id", "kind", "binding", *r6("limit", "observed", "margin")),
    "p14_select_candidate": lambda s, d: decided(s, d).where("decision = 'intervene'").select("decision_id", "selected", F.array_join("excluded", ",").alias("excluded")),
    "p15_blame": lambda s, d: P.eligible_candidates(history(s, d), SPARSE).where(F.forall("judged", lambda c: F.size(c["why"]) > 0)).select("decision_id", P.blame(F.col("judged")).alias("blame")),
    "a1_decayed_authority": lambda s, d: A.decayed_authority(memory(s, d), decisions(s, d), SPARSE).select("decision_id", "entries", *r6("penalties", "credits", "decayed")),
    "a2_confidence_cap": lambda s, d: decisions(s, d).select("decision_id", A.confidence_cap(F.when(F.col("k") % 5 != 0, F.col("confidence"))).alias("cap")),
    "a3_clamp_authority": lambda s, d: authorised(s, d).select("decision_id", "bound_by", *r6("authority")),
    "a4_authority_level": lambda s, d: authorised(s, d).select("decision_id", "level", F.array_join("level_reasons", ",").alias("reasons")),
    "a5_action_permissions": lambda s, d: A.action_permissions(authorised(s, d), ["decision_id"]).where("action in ('recap', 'data_export', 'grade_modification', 'hint')").select("decision_id", "action", "permission", "approver", "reason", F.array_join("steps", ";").alias("steps")),
    "a6_final_action": lambda s, d: final(s, d).select("decision_id", "final", "final_reason"),
    "a7_feedback_effects": lambda s, d: A.feedback_effects(feedback(s, d)).select("event_id", "status", "memory_outcome"),
    "a8_memory_counts": lambda s, d: A.memory_counts(memory(s, d)),
    "a8_memory_by_action": lambda s, d: A.memory_by_action(memory(s, d)),
    "a9_hash_chain": lambda s, d: chain(s, d).select("learner_id", "place", "entry_hash"),
    "a10_verify_chain": lambda s, d: A.verify_chain(chain(s, d).withColumn("payload", F.when((F.col("place") == 5) & F.col("learner_id").endswith("7"), "changed").otherwise(F.col("payload"))), "learner_id"),
    "a11_retain_last_n": lambda s, d: A.retain_last_n(memory(s, d), "learner_id", "recorded_us", 5).select("event_id"),
    "a12_delivery_status": lambda s, d: A.delivery_status(final(s, d)).select("decision_id", "delivery_status", "gate"),
    "a13_intervention_id": lambda s, d: decisions(s, d).select("decision_id", A.intervention_id(F.col("learner_id"), F.col("session_id"), F.lit("recap"), F.col("decided_us").cast("string")).alias("id")),
}

DEC = CANON + """, dels AS (
  SELECT a.learner_id, a.session_id, a.event_id AS intervention_id, a.intervention_type, a.us AS delivered_us, c.outcome, c.us AS completed_us
  FROM ev a LEFT JOIN (SELECT * FROM ev WHERE event_type = 'intervention_completed' AND intervention_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY intervention_id ORDER BY us, event_id) = 1) c ON c.intervention_id = a.event_id
  WHERE a.event_type = 'intervention_started'),
decs AS (
  SELECT event_id AS decision_id, learner_id, session_id, us AS decided_us, k, CASE WHEN k % 7 = 0 THEN 'insufficient_data' ELSE 'resolved' END AS verdict, 0.5 + (k % 25) / 50.0 AS probability,
    CASE WHEN k % 11 = 0 THEN 'low' WHEN k % 2 = 0 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN k % 11 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 3 END AS crank, k % 13 + 2 AS evidence,
    CASE WHEN k % 10 = 0 THEN 'insufficient_data' WHEN k % 10 = 1 THEN 'stable' WHEN k % 10 < 5 THEN 'declining' WHEN k % 10 < 8 THEN 'high_deviation' ELSE 'increasing_deviation' END AS state,
    ['free_practice', 'graded_assessment', 'exam_hall', 'lab'][k % 4 + 1] AS context
  FROM ev WHERE event_type = 'content_closed'),
pairs AS (SELECT d.decision_id, d.decided_us, d.session_id AS dsession, x.*, CASE outcome WHEN 'accepted' THEN 'response' WHEN 'dismissed' THEN 'non_response' WHEN 'ignored' THEN 'non_response' WHEN 'timeout' THEN 'non_response' WHEN 'other' THEN 'unclassified' ELSE 'not_reported' END AS class,
  row_number() OVER (PARTITION BY decision_id ORDER BY delivered_us DESC, intervention_id DESC) AS back, row_number() OVER (PARTITION BY decision_id, intervention_type ORDER BY delivered_us DESC, intervention_id DESC) AS tback
  FROM decs d JOIN dels x ON x.learner_id = d.learner_id AND x.delivered_us <= d.decided_us),
hist AS (
  SELECT d.*, coalesce(n, 0) AS total_delivered, coalesce(w, 0) AS in_window, coalesce(g, 0) AS in_session, (d.decided_us - last_us) / 1e6 AS since
  FROM decs d LEFT JOIN (
    SELECT decision_id, count(*) AS n, count(*) FILTER (WHERE delivered_us > decided_us - 604800000000) AS w, count(*) FILTER (WHERE session_id = dsession) AS g, max(delivered_us) AS last_us
    FROM pairs GROUP BY 1) p USING (decision_id)),
cat(type, priority, floor, states) AS (VALUES ('recap', 0, 2, NULL), ('micro_question', 1, 1, ['declining', 'high_deviation']), ('pause', 2, 3, NULL), ('reflection', 3, 3, NULL)),
cand AS (
  SELECT d.decision_id, d.state, d.crank, c.type, c.priority, c.floor, c.states,
    coalesce(min(p.back) FILTER (WHERE p.intervention_type <> c.type), max(p.back) + 1, 1) - 1 AS run,
    coalesce(min(p.tback) FILTER (WHERE p.intervention_type = c.type AND p.class <> 'non_response') - 1, max(p.tback) FILTER (WHERE p.intervention_type = c.type), 0) AS declined,
    count(*) FILTER (WHERE p.intervention_type = c.type AND p.class = 'response') AS responses, count(*) FILTER (WHERE p.intervention_type = c.type AND p.class = 'non_response') AS non_responses
  FROM decs d CROSS JOIN cat c LEFT JOIN pairs p USING (decision_id) GROUP BY ALL),
judg AS (SELECT *, list_filter([CASE WHEN declined >= 2 THEN 'retired' END, CASE WHEN run >= 2 THEN 'repeated' END, CASE WHEN crank < floor THEN 'confidence' END, CASE WHEN states IS NOT NULL AND NOT list_contains(states, state) THEN 'not_applicable' END], lambda x: x IS NOT NULL) AS why FROM cand),
jd AS (
  SELECT decision_id, min(priority) FILTER (WHERE len(why) = 0) AS best, bool_or(list_contains(why, 'retired')) AS b1, bool_or(list_contains(why, 'repeated')) AS b2, bool_or(list_contains(why, 'confidence')) AS b3,
    count(*) FILTER (WHERE list_contains(why, 'retired')) AS n1, count(*) FILTER (WHERE list_contains(why, 'repeated')) AS n2, count(*) FILTER (WHERE list_contains(why, 'confidence')) AS n3, count(*) FILTER (WHERE list_contains(why, 'not_applicable')) AS n4
  FROM judg GROUP BY 1),
dcd AS (
  SELECT h.*, j.*exclude(decision_id), CASE WHEN b1 THEN 'type_retired' WHEN b2 THEN 'repeated_type_limit' WHEN b3 THEN 'confidence_too_low' ELSE 'no_eligible_candidate' END AS blame,
    CASE WHEN verdict <> 'resolved' THEN 'not_resolved' WHEN probability < 0.65 THEN 'probability_below_floor' WHEN crank < 1 THEN 'confidence_too_low' WHEN state = 'insufficient_data' THEN 'state_insufficient' WHEN state = 'stable' THEN 'state_not_indicated'
      WHEN evidence < 5 THEN 'minimum_evidence_not_met' WHEN since < 86400 THEN 'in_cooldown' WHEN in_session >= 3 THEN 'session_cap_reached' WHEN in_window >= 5 THEN 'window_cap_reached'
      WHEN best IS NULL THEN CASE WHEN b1 THEN 'type_retired' WHEN b2 THEN 'repeated_type_limit' WHEN b3 THEN 'confidence_too_low' ELSE 'no_eligible_candidate' END END AS reason
  FROM hist h JOIN jd j USING (decision_id)),
mem AS (SELECT event_id, learner_id, ['free_practice', 'graded_assessment', 'exam_hall', 'lab'][k % 4 + 1] AS context, ['improved', 'disputed', 'deteriorated', 'no_response', 'odd'][k % 5 + 1] AS outcome, CASE WHEN k % 3 = 0 THEN 0.5 ELSE 1.0 END AS weight, us AS recorded_us FROM ev WHERE event_type = 'intervention_completed'),
auth0 AS (
  SELECT d.decision_id, count(m.event_id) AS entries, coalesce(sum(CASE WHEN outcome <> 'improved' THEN m.weight * power(2.0, -greatest(0, (decided_us - recorded_us) / 1e6) / 604800.0) * CASE WHEN outcome = 'disputed' THEN 0.12 ELSE 0.05 END END), 0.0) AS penalties,
    coalesce(sum(CASE WHEN outcome = 'improved' THEN m.weight * power(2.0, -greatest(0, (decided_us - recorded_us) / 1e6) / 604800.0) * 0.30 END), 0.0) AS credits
  FROM decs d LEFT JOIN mem m ON m.learner_id = d.learner_id AND m.context = d.context AND m.recorded_us <= d.decided_us GROUP BY 1),
auth1 AS (SELECT *, least(0.6, 0.6 - penalties + credits) AS decayed FROM auth0),
auth AS (
  SELECT *, least(greatest(decayed, 0.05), cap) AS authority, CASE WHEN cap < greatest(decayed, 0.05) THEN 'confidence' WHEN decayed < 0.05 THEN 'floor' WHEN decayed < 0.6 THEN 'memory' ELSE 'initial' END AS bound_by,
    list_filter([CASE WHEN context = 'exam_hall' THEN 'irreversible' END, CASE WHEN context = 'graded_assessment' AND k % 3 = 0 THEN 'high_stakes' END, CASE WHEN context = 'exam_hall' THEN 'high_risk' END], lambda x: x IS NOT NULL) AS human
  FROM (SELECT d.*, a.*exclude(decision_id), CASE confidence WHEN 'low' THEN 0.35 WHEN 'medium' THEN 0.7 ELSE 1.0 END AS cap FROM dcd d JOIN auth1 a USING (decision_id))),
lev AS (
  SELECT *, list_filter([CASE WHEN authority < 0.5 THEN 'low_authority' END, CASE WHEN context = 'graded_assessment' THEN 'medium_risk' END], lambda x: x IS NOT NULL) AS lim FROM auth),
lvl AS (SELECT *, CASE WHEN len(human) > 0 THEN 'human_required' WHEN len(lim) > 0 THEN 'restricted' ELSE 'allowed' END AS level FROM lev),
fina AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'refused|not_selected' WHEN k % 17 = 0 THEN 'refused|expired' WHEN level = 'human_required' THEN 'deferred|human_required' WHEN level <> 'allowed' THEN 'refused|level_not_allowed'
     WHEN best = 3 THEN 'refused|action_not_permitted' WHEN k % 6 = 0 AND authority < 0.75 THEN 'refused|high_impact' ELSE 'allowed|cleared' END AS f FROM lvl)
"""

_REC = DEC.replace("WITH ev0", "WITH RECURSIVE ev0", 1) + """, ent AS (SELECT learner_id, row_number() OVER (PARTITION BY learner_id ORDER BY recorded_us, event_id) AS place, '{"context":"' || context || '","event_id":' || event_id || ',"outcome":"' || outcome || '"}' AS payload FROM mem),
chain AS (
  SELECT learner_id, place, sha256(':' || payload) AS entry_hash FROM ent WHERE place = 1
  UNION ALL SELECT e.learner_id, e.place, sha256(c.entry_hash || ':' || e.payload) FROM chain c JOIN ent e ON e.learner_id = c.learner_id AND e.place = c.place + 1)
"""

_KINDS = "CASE reason WHEN 'probability_below_floor' THEN 0 WHEN 'state_insufficient' THEN 2 WHEN 'state_not_indicated' THEN 2 WHEN 'minimum_evidence_not_met' THEN 3 WHEN 'in_cooldown' THEN 4 WHEN 'session_cap_reached' THEN 5 WHEN 'window_cap_reached' THEN 6 WHEN 'confidence_too_low' THEN 1 ELSE 99 END"

ORACLES = {
    "p1_delivery_history": DEC + "SELECT intervention_id, intervention_type, session_id, delivered_us, outcome, completed_us FROM dels",
    "p2_outcome_class": CANON + "SELECT event_id, CASE outcome WHEN 'accepted' THEN 'response' WHEN 'other' THEN 'unclassified' ELSE CASE WHEN outcome IS NULL THEN 'not_reported' ELSE 'non_response' END END AS class FROM ev",
    "p3_history_as_of": DEC + "SELECT decision_id, count(*) AS n, max(delivered_us) AS last_us, min(delivered_us) AS first_us, array_to_string(list(intervention_id ORDER BY back), ',') AS ids FROM pairs GROUP BY 1",
    "p4_deliveries_in_window": DEC + "SELECT decision_id, in_window FROM hist",
    "p5_deliveries_in_session": DEC + "SELECT decision_id, in_session, total_delivered FROM hist",
    "p6_seconds_since_last": DEC + "SELECT decision_id, round(since, 6) AS seconds_since_last FROM hist",
    "p7_trailing_run": DEC + "SELECT decision_id, type, CAST(run AS INTEGER) AS run FROM cand",
    "p8_consecutive_non_responses": DEC + "SELECT decision_id, type, CAST(declined AS INTEGER) AS declined FROM cand",
    "p9_retired_types": DEC + "SELECT decision_id, coalesce(string_agg(type, ',' ORDER BY type) FILTER (WHERE declined >= 2), '') AS retired FROM cand GROUP BY 1",
    "p10_measured_outcomes": DEC + "SELECT decision_id, type, responses, non_responses FROM cand",
    "p11_eligible_candidates": DEC + "SELECT decision_id, type, array_to_string(why, ',') AS why FROM judg",
    "p12_decide": DEC + "SELECT decision_id, CASE WHEN reason IS NULL THEN 'intervene' ELSE 'no_intervention' END AS decision, reason FROM dcd",
    "p13_restraints_long": DEC + f""", b AS (SELECT *, {_KINDS} AS pos FROM dcd WHERE verdict = 'resolved'),
r AS (
  SELECT decision_id, 'probability_floor' AS kind, 0.65 AS lim, probability AS obs, probability - 0.65 AS mar, pos = 0 AS binding FROM b
  UNION ALL SELECT decision_id, 'confidence_floor', 1, crank, crank - 1, pos = 1 FROM b
  UNION ALL SELECT decision_id, 'state_rule', 1, (state NOT IN ('stable', 'insufficient_data'))::INT, (state NOT IN ('stable', 'insufficient_data'))::INT - 1, pos = 2 FROM b
  UNION ALL SELECT decision_id, 'minimum_evidence', 5, evidence, evidence - 5, pos = 3 FROM b
  UNION ALL SELECT decision_id, 'cooldown', 86400, since, since - 86400, pos = 4 FROM b WHERE pos >= 4
  UNION ALL SELECT decision_id, 'session_cap', 3, in_session, 3 - in_session - 1, pos = 5 FROM b WHERE pos >= 5
  UNION ALL SELECT decision_id, 'window_cap', 5, in_window, 5 - in_window - 1, pos = 6 FROM b WHERE pos >= 6
  UNION ALL SELECT decision_id, 'type_retired', 0, n1, -n1, coalesce(reason = 'type_retired', false) FROM b WHERE pos = 99 AND n1 > 0
  UNION ALL SELECT decision_id, 'repeated_type_limit', 0, n2, -n2, coalesce(reason = 'repeated_type_limit', false) FROM b WHERE pos = 99 AND n2 > 0
  UNION ALL SELECT decision_id, 'candidate_confidence', 0, n3, -n3, false FROM b WHERE pos = 99 AND n3 > 0
  UNION ALL SELECT decision_id, 'candidate_applicability', 0, n4, -n4, coalesce(reason = 'no_eligible_candidate', false) FROM b WHERE pos = 99 AND n4 > 0)
SELECT decision_id, kind, binding, round(CAST(lim AS DOUBLE), 6) AS "limit", round(CAST(obs AS DOUBLE), 6) AS observed, round(CAST(mar AS DOUBLE), 6) AS margin FROM r""",
    "p14_select_candidate": DEC + "SELECT decision_id, ['recap', 'micro_question', 'pause', 'reflection'][best + 1] AS selected, array_to_string(list_filter(['recap', 'micro_question', 'pause', 'reflection'], lambda t: t <> ['recap', 'micro_question', 'pause', 'reflection'][best + 1]), ',') AS excluded FROM dcd WHERE reason IS NULL",
    "p15_blame": DEC + "SELECT decision_id, blame FROM dcd WHERE best IS NULL",
    "a1_decayed_authority": DEC + "SELECT decision_id, entries, round(penalties, 6) AS penalties, round(credits, 6) AS credits, round(decayed, 6) AS decayed FROM auth1",
    "a2_confidence_cap": DEC + "SELECT decision_id, CASE WHEN k % 5 = 0 THEN 0.0 WHEN confidence = 'low' THEN 0.35 WHEN confidence = 'medium' THEN 0.7 ELSE 1.0 END::DOUBLE AS cap FROM decs",
    "a3_clamp_authority": DEC + "SELECT decision_id, bound_by, round(authority, 6) AS authority FROM auth",
    "a4_authority_level": DEC + "SELECT decision_id, level, array_to_string(CASE WHEN len(human) > 0 THEN human ELSE lim END, ',') AS reasons FROM lvl",
    "a5_action_permissions": DEC + f""", w AS (SELECT *, CASE WHEN context = 'exam_hall' THEN 'irreversible' WHEN context = 'graded_assessment' AND k % 3 = 0 THEN 'high_stakes' ELSE 'never_autonomous' END AS why, context = 'graded_assessment' AND k % 3 = 0 AS hs FROM lvl)
SELECT decision_id, 'data_export' AS action, 'withheld' AS permission, 'data_protection_officer' AS approver, why AS reason, '{';'.join(A.ESCALATION['data_export'])}' AS steps FROM w
UNION ALL SELECT decision_id, 'grade_modification', 'withheld', 'course_coordinator', CASE WHEN hs THEN why ELSE 'never_self_service' END, '{';'.join(A.ESCALATION['grade_modification'])}' FROM w
UNION ALL SELECT decision_id, unnest(['recap', 'hint']), CASE WHEN level = 'allowed' THEN 'permitted' ELSE 'needs_approval' END, NULL, NULL, '' FROM lvl WHERE level <> 'human_required'""",
    "a8_memory_by_action": DEC + ", m AS (SELECT m.*, ['recap', 'micro_question', 'pause'][k % 3 + 1] AS action FROM mem m JOIN (SELECT event_id, k FROM ev) USING (event_id)) SELECT learner_id, context, action, outcome, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS weight FROM m GROUP BY GROUPING SETS ((learner_id, context, action, outcome), (learner_id, context, action))",
    "a6_final_action": DEC + "SELECT decision_id, split_part(f, '|', 1) AS final, split_part(f, '|', 2) AS final_reason FROM fina",
    "a7_feedback_effects": CANON + "SELECT event_id, CASE WHEN k % 9 = 0 OR k % 5 = 4 OR (k % 5 = 2 AND k % 4 = 0) THEN 'rejected' WHEN k % 5 = 0 THEN 'recorded' ELSE 'remembered' END AS status, CASE WHEN NOT (k % 9 = 0 OR k % 5 IN (0, 4) OR (k % 5 = 2 AND k % 4 = 0)) THEN 'disputed' END AS memory_outcome FROM ev WHERE event_type = 'interaction'",
    "a8_memory_counts": DEC + "SELECT learner_id, context, outcome, count(*) AS n, CAST(grouping(learner_id, context, outcome) AS INTEGER) AS level FROM mem GROUP BY GROUPING SETS ((learner_id, context, outcome), (learner_id, context), (learner_id), ())",
    "a9_hash_chain": _REC + "SELECT learner_id, CAST(place AS INTEGER) AS place, entry_hash FROM chain",
    "a10_verify_chain": DEC + "SELECT learner_id, count(*) AS entries, CAST(CASE WHEN ends_with(learner_id, '7') AND count(*) >= 5 THEN 5 END AS INTEGER) AS first_break, NOT (ends_with(learner_id, '7') AND count(*) >= 5) AS intact FROM mem GROUP BY 1",
    "a11_retain_last_n": DEC + "SELECT event_id FROM mem QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY recorded_us DESC) <= 5",
    "a12_delivery_status": DEC + "SELECT decision_id, CASE WHEN reason IS NOT NULL THEN 'not_selected' WHEN f = 'allowed|cleared' THEN 'delivered' ELSE 'selected_not_delivered' END AS delivery_status, CASE WHEN reason IS NOT NULL THEN 'policy' WHEN starts_with(f, 'deferred') THEN 'human_approval' WHEN starts_with(f, 'refused') THEN 'safety' END AS gate FROM fina",
    "a13_intervention_id": DEC + "SELECT decision_id, 'intervention-' || substr(sha256(learner_id || chr(31) || session_id || chr(31) || 'recap' || chr(31) || decided_us), 1, 24) AS id FROM decs",
}
ORACLES = {k: steady(v) for k, v in ORACLES.items()}
