"""Learner intelligence: roll-ups, evidence and gaps, access, and answers to batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.lineage import with_lineage
from eventlens.settings import DEFAULT, Settings

#: The scope of each kind of evidence, and the scopes of each role.
KIND_SCOPE = {
    "provenance": "sources", "event": "evidence", "context": "evidence", "feature": "engine", "baseline": "engine", "temporal": "engine",
    "prediction": "engine", "uncertainty": "engine", "policy": "engine", "authority": "authority", "intervention": "interventions",
    "outcome": "outcomes", "evaluation": "outcomes", "subject": "evidence", "change": "engine", "fusion": "engine",
}
ROLES = {
    "student": ("profile", "evidence", "missing_data", "sources"),
    "teacher": ("profile", "evidence", "engine", "interventions", "outcomes", "authority", "missing_data", "sources"),
    "admin": ("profile", "evidence", "engine", "interventions", "outcomes", "authority", "missing_data", "sources"),
}
#: Subject names that a question may hold, and the ordered word lists of the intents: the first hit wins.
SUBJECTS = ("algebra", "geometry", "reading", "maths", "math", "science")
INTENTS = (
    ("autonomy", ("autonom", "can the ai", "act", "allowed", "authority", "how far")),
    ("authority", ("permitted", "authority to", "allowed to", "what can", "what may", "permission")),
    ("outcome", ("what happened after", "has an intervention", "intervention been delivered", "did it work", "was it effective", "outcome")),
    ("explanation", ("why has", "why did", "why have", "why the", "why this", "reason for", "cause of")),
    ("intervention", ("intervention", "recap", "prompt was", "prompts were", "delivered")),
    ("explain", ("why", "explain", "reason", "cause")),
    ("gaps", ("gaps", "evidence is missing", "evidence missing", "missing evidence", "which evidence", "lack evidence", "what evidence is lacking")),
    ("missing", ("missing", "don't know", "do we know", "unknown", "insufficient", "unavailable", "not know", "lack")),
    ("change", ("changed", "change", "trend", "trajectory", "over time", "progress", "recover")),
    ("current_state", ("current state", "current status", "current situation", "state right now", "latest state", "how is the student doing", "what is the state")),
    ("comparison", ("compare", "agree", "disagree", "contradict", "signals", "consisten", "align", "both subjects")),
    ("subject", ("algebra", "geometry", "reading", "math", "mathematics", "performance in", "performing in", "subject performance")),
    ("timeline", ("timeline", "chronolog", "sequence", "history of events", "day by day")),
    ("evidence", ("evidence", "sources", "provenance", "what do we know", "data points", "what is known")),
    ("profile", ("tell me about", "overview", "profile", "describe", "summari", "who is", "about this student", "student")),
)
#: Kinds without which an intent has no answer, and the kinds that an answer quotes.
REQUIRED = {
    "profile": ("event",), "evidence": ("event",), "timeline": ("event",), "explain": ("temporal", "uncertainty"), "explanation": ("change", "temporal", "uncertainty"), "autonomy": ("authority",), "authority": ("authority",),
    "current_state": ("temporal",), "change": ("change",), "comparison": ("fusion", "subject"), "subject": ("subject",), "intervention": ("intervention",), "outcome": ("intervention", "outcome"),
}
QUOTED = {
    "profile": ("event", "subject", "change"), "explain": ("temporal", "prediction", "uncertainty", "policy", "provenance"), "explanation": ("temporal", "change", "prediction", "uncertainty", "policy", "provenance"), "missing": ("event", "baseline", "provenance"),
    "autonomy": ("authority", "policy", "intervention", "provenance"), "authority": ("authority", "policy", "intervention", "provenance"), "current_state": ("temporal",), "change": ("change", "fusion"), "comparison": ("fusion", "subject"),
    "subject": ("subject",), "intervention": ("intervention",), "outcome": ("outcome", "intervention"), "timeline": ("event", "context"), "evidence": ("event", "context", "provenance"),
}
GRADES = ("unknown", "low", "medium", "high")
#: How a class of evidence came about.
PROVENANCE = {"observed": "observed", "derived": "derived_from_events", "predicted": "model_output", "system_generated": "decision_layer", "unavailable": "none"}
#: Priority of each type of gap.
GAP_PRIORITY = {"missing": 1, "stale": 2, "low_coverage": 3, "low_quality": 4, "conflicting": 5, "unvalidated": 6, "not_applicable": 7, "privilege_restricted": 8}


def _pairs(table: dict[str, tuple[str, ...]], a: str, b: str, spark) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, vs in table.items() for v in vs], f"{a} string, {b} string")


def _case(col: Column, values: dict[str, Column | str | tuple]) -> Column:
    out = F.when(F.lit(False), next(iter(values.values())) if isinstance(next(iter(values.values())), Column) else F.lit(None))
    for k, v in values.items():
        out = out.when(col == k, v)
    return out


def session_readings(events: DataFrame) -> DataFrame:
    """Per session with answers: answered, correct, mean response and mean difficulty (of the last start of the
    question in the session, 0.5 when unknown)."""
    w = Window.partitionBy("learner_id", "session_id", "question_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = events.withColumn("_d", F.last(F.when(F.col("event_type") == "question_started", F.col("difficulty")), True).over(w)).where("event_type = 'question_answered'")
    return a.groupBy("learner_id", "session_id").agg(
        F.count("*").alias("answered"), F.count_if("correct").alias("n_correct"), F.avg("response_seconds").alias("mean_response"), F.avg(F.coalesce("_d", F.lit(0.5))).alias("mean_difficulty"), F.min("us").alias("first_us"),
    ).withColumn("accuracy", F.col("n_correct") / F.col("answered"))


def subject_rollups(events: DataFrame, now_us: int, s: Settings = DEFAULT) -> DataFrame:
    """Per learner and subject (topic of the latest start of the question, else unknown): answers, accuracy,
    accuracy of the last third, last seen, sessions, sufficient, stale."""
    w = Window.partitionBy("learner_id", "question_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = events.withColumn("_t", F.last(F.when(F.col("event_type") == "question_started", F.struct("topic", "difficulty")), True).over(w)).where("event_type = 'question_answered'")
    a = a.withColumn("subject", F.coalesce("_t.topic", F.lit("unknown"))).withColumn("_d", F.coalesce("_t.difficulty", F.lit(0.5)))
    by = Window.partitionBy("learner_id", "subject")
    a = a.withColumn("_n", F.count("*").over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("us"), F.desc("event_id"))))
    c = F.col("correct").cast("int")
    g = a.groupBy("learner_id", "subject").agg(
        F.count("*").alias("answered"), F.sum(c).alias("n_correct"), F.avg(c).alias("accuracy"), F.avg(F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 3)), c)).alias("recent"),
        F.avg("_d").alias("mean_difficulty"), F.max("us").alias("last_us"), F.count_distinct("session_id").alias("sessions"),
    )
    return g.withColumns({"sufficient": (F.col("answered") >= s.subject_answers) & (F.col("sessions") >= s.subject_sessions), "stale": (now_us - F.col("last_us")) / 1e6 > s.stale_after, "signal": subject_signal(F.col("recent"), F.col("accuracy"), s)})


def subject_signal(recent: Column, overall: Column, s: Settings = DEFAULT) -> Column:
    """I3."""
    d = F.round(recent - overall, 9)
    return F.when(d <= -s.subject_step, "declining").when(d >= s.subject_step, "improving").otherwise("stable")


def classify_change(readings: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """I4: per learner the change over quarters of the sessions, in order; early and late means of response and difficulty."""
    w = Window.partitionBy("learner_id").orderBy("first_us", "session_id")
    r = readings.withColumns({"_j": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("learner_id"))})
    r = r.withColumn("_q", F.ceil(4 * F.col("_j") / F.col("_n")).cast("int"))
    q = lambda i: F.avg(F.when(F.col("_q") == i, F.col("accuracy")))
    half = lambda late, of: F.avg(F.when((F.col("_j") > F.floor(F.col("_n") / 2)) == F.lit(late), F.col(of)))
    halves = [half(late, f"mean_{of}").alias(f"{name}_{of}") for of in ("response", "difficulty") for name, late in (("early", False), ("late", True))]
    g = r.groupBy("learner_id").agg(F.count("*").alias("sessions"), *[q(i).alias(f"q{i}") for i in (1, 2, 3, 4)], F.stddev_pop("accuracy").alias("sigma"), *halves)
    d = lambda a, b: F.round(F.col(a) - F.col(b), 9)
    x = s.subject_step
    change = F.when(F.col("sessions") < 4, "insufficient_evidence").when((d("q1", "q2") >= x) & (d("q3", "q4") <= -x), "recovering").when(d("q1", "q4") >= x, "declining").when(d("q4", "q1") >= x, "improving").when(F.col("sigma") > s.volatile, "volatile").otherwise("stable")
    return g.withColumn("change", change)


def subject_fusion(rollups: DataFrame) -> DataFrame:
    """Per learner whether the sufficient subjects agree."""
    ok = F.col("sufficient")
    down, up = F.bool_or(ok & (F.col("signal") == "declining")), F.bool_or(ok & (F.col("signal") == "improving"))
    case = F.when(~F.bool_or(ok), "unavailable").when(down & up, "contradictory").when(down, "supporting").otherwise("neutral")
    return rollups.groupBy("learner_id").agg(case.alias("agreement"), F.array_sort(F.collect_list(F.when(ok, F.concat_ws(":", "subject", "signal")))).alias("signals"))


def evidence_rows(
    df: DataFrame, kind: str, statement: Column, reliability: Column | str, source: str, subject: Column | None = None, klass: str = "derived",
    over: tuple[Column, Column] | None = None, version: Column | None = None,
) -> DataFrame:
    """Rows of one stage: evidence_id, learner_id, kind, class, reliability, statement, provenance, source, version, ts_us, subject.

    ``over`` is the interval of events that the statement rests on; it refers to the interval's end.
    """
    grade = F.lit(reliability) if isinstance(reliability, str) else reliability
    subject = F.lit(None).cast("string") if subject is None else subject
    lo, hi = over or (F.lit(None).cast("long"), F.lit(None).cast("long"))
    return df.select(
        F.concat_ws(":", F.lit(kind), "learner_id", F.coalesce(subject, F.lit(""))).alias("evidence_id"), "learner_id", F.lit(kind).alias("kind"), F.lit(klass).alias("class"), grade.alias("reliability"),
        statement.alias("statement"), F.lit(PROVENANCE[klass]).alias("provenance"), F.lit(source).alias("source"), (F.lit(f"{source}/1") if version is None else version).alias("version"), hi.alias("ts_us"),
        subject.alias("subject"), lo.alias("from_us"), hi.alias("to_us"),
    )


def latest(df: DataFrame, *order: str) -> DataFrame:
    """The last row of each learner."""
    w = Window.partitionBy("learner_id").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def evidence_table(stages: dict[str, DataFrame]) -> DataFrame:
    """One long table of what the stages say of each learner, of 16 kinds, with the events that each row rests on.

    ``stages``: events, counts (with first_us, last_us), rollups, change, fusion, states (us), and of each
    learner's last decision session contexts (answer_count, event_count, us, elapsed_seconds), features
    (available, required, us, elapsed_seconds), decisions (verdict, probability, threshold, confidence,
    evidence, reason, selected, level, context, delivery_status, decided_us), outcomes (measured, measures,
    response, from_us, to_us; null without one) and evaluations (verdict, predicted_us, window_end,
    model_version; null without one).  Adds n_events, events_digest and origin.
    """
    return with_lineage(statements(stages), stages["events"])


def statements(stages: dict[str, DataFrame]) -> DataFrame:
    """I6 before its lineage: the rows with the interval (from_us, to_us) that each rests on."""
    begin = stages["counts"].select("learner_id", F.col("first_us").alias("_first"), F.col("last_us").alias("_last"))
    from_start = lambda df: df.join(begin, "learner_id", "left")
    st, d, o, e = from_start(stages["states"]), from_start(stages["decisions"]), stages["outcomes"], stages["evaluations"]
    rollups, fusion, counts, change = (from_start(stages[x]) for x in ("rollups", "fusion", "counts", "change"))
    resolved, text = F.col("verdict") == "resolved", F.format_string
    claim = F.when(resolved, text("probability %.2f against %.2f: %s", "probability", "threshold", F.when(F.col("probability") >= F.col("threshold"), "at risk").otherwise("stable")))
    maturity = F.element_at(F.array(*map(F.lit, ("new", "early", "developing", "established"))), F.col("weakest_maturity") + 1)
    upto = lambda c: (F.col("_first"), F.col(c))
    whole, state, decided = upto("_last"), upto("us"), upto("decided_us")
    session = (F.col("us") - F.round(F.col("elapsed_seconds") * 1e6).cast("long"), F.col("us"))
    window, claimed = (F.col("from_us"), F.col("to_us")), (F.col("predicted_us"), F.col("window_end") - 1)
    parts = [
        evidence_rows(counts, "event", text("%d events in %d sessions", "n_events", "n_sessions"), "high", "log", klass="observed", over=whole),
        evidence_rows(counts, "provenance", text("origin %s", "origin_label"), "high", "log", klass="observed", over=whole),
        evidence_rows(stages["contexts"], "context", text("session %s: %d recent answers, %d events", "session_id", "answer_count", "event_count"), "medium", "context", over=session),
        evidence_rows(stages["features"], "feature", text("%d of %d features available", "available", "required"), F.when(F.col("available") == F.col("required"), "high").otherwise("medium"), "features", over=session),
        evidence_rows(st, "baseline", text("baseline %s from %d observations", maturity, "observations"), "high", "baseline", over=state),
        evidence_rows(rollups.where("sufficient"), "subject", text("%s: %d of %d correct", "subject", "n_correct", "answered"), F.when(F.col("stale"), "low").otherwise("medium"), "rollup", F.col("subject"), over=upto("last_us")),
        evidence_rows(change.where("change <> 'insufficient_evidence'"), "change", text("change %s", "change"), "medium", "sessions", over=whole),
        evidence_rows(fusion.where("agreement <> 'unavailable'"), "fusion", text("subjects are %s", "agreement"), F.when(F.col("agreement") == "contradictory", "low").otherwise("medium"), "rollup", over=whole),
        evidence_rows(st.where("state <> 'insufficient_data'"), "temporal", text("state %s, %s", "state", "direction"), F.when(F.col("weakest_maturity") >= 2, "high").otherwise("medium"), "baseline", over=state),
        # a refusal is certain; what the model says is not
        evidence_rows(d, "prediction", F.coalesce(claim, text("prediction refused: %s", "verdict")), F.when(resolved, "low").otherwise("high"), "model", klass="predicted", over=decided),
        evidence_rows(d, "uncertainty", text("verdict %s, confidence %s, %d evidence units", "verdict", "confidence", "evidence"), "medium", "model", klass="predicted", over=decided),
        evidence_rows(d, "policy", F.when(F.col("selected").isNotNull(), text("selected %s", "selected")).otherwise(text("no intervention: %s", "reason")), "high", "policy", over=decided),
        evidence_rows(d, "authority", text("level %s in %s", "level", "context"), "high", "authority", klass="system_generated", over=decided),
        evidence_rows(d, "intervention", text("delivery status %s", "delivery_status"), "high", "policy", klass="system_generated", over=decided),
        evidence_rows(o.where("measures IS NOT NULL"), "outcome", text("measured %d of %d: %s", "measured", "measures", "response"), F.when(F.col("measured") == F.col("measures"), "high").otherwise("medium"), "outcomes", klass="observed", over=window),
        evidence_rows(o.where("measures IS NULL"), "outcome", F.lit("no outcome was measured"), "medium", "outcomes", klass="unavailable"),
        evidence_rows(e.where("verdict IS NOT NULL"), "evaluation", text("last prediction %s", "verdict"), "high", "evaluation", over=claimed, version=F.col("model_version")),
        evidence_rows(e.where("verdict IS NULL"), "evaluation", F.lit("no prediction was evaluated"), "medium", "evaluation", klass="unavailable"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gap_table(stages: dict[str, DataFrame]) -> DataFrame:
    """gap_id, learner_id, gap, gap_type, priority (by type), subject; ``stages`` as for evidence_table."""
    def rows(df: DataFrame, gap: str, kind: str, subject: Column | None = None) -> DataFrame:
        subject = F.lit(None).cast("string") if subject is None else subject
        return df.select(F.concat_ws(":", F.lit(gap), "learner_id", F.coalesce(subject, F.lit(""))).alias("gap_id"), "learner_id", F.lit(gap).alias("gap"), F.lit(kind).alias("gap_type"), F.lit(GAP_PRIORITY[kind]).alias("priority"), subject.alias("subject"))

    rollups, fusion, named = stages["rollups"], stages["fusion"], F.col("subject") != "unknown"
    parts = [
        rows(stages["decisions"].where("verdict <> 'resolved'"), "refused_prediction", "low_coverage"),
        rows(stages["states"].where("weakest_maturity < 3"), "immature_baseline", "unvalidated"),
        rows(stages["outcomes"].where("measures IS NULL"), "no_outcome", "missing"),
        rows(stages["evaluations"].where("verdict IS NULL"), "no_evaluation", "missing"),
        rows(stages["change"].where("change = 'insufficient_evidence'"), "too_few_sessions", "low_coverage"),
        rows(fusion.where("agreement = 'unavailable'"), "no_subject", "not_applicable"),
        rows(rollups.where(named & ~F.col("sufficient")), "low_coverage", "low_coverage", F.col("subject")),
        rows(rollups.where(named & F.col("sufficient") & F.col("stale")), "stale_subject", "stale", F.col("subject")),
        rows(fusion.where("agreement = 'contradictory'"), "conflicting", "conflicting"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scoped(evidence: DataFrame) -> DataFrame:
    spark = evidence.sparkSession
    return evidence.join(F.broadcast(spark.createDataFrame(list(KIND_SCOPE.items()), "kind string, scope string")), "kind")


def visible_evidence(evidence: DataFrame, roles: list[str]) -> DataFrame:
    """I8: a row for each piece of evidence and role that may see it."""
    grants = _pairs({r: ROLES[r] for r in roles}, "role", "scope", evidence.sparkSession)
    return _scoped(evidence).join(F.broadcast(grants), "scope").drop("scope")


def restricted_gaps(evidence: DataFrame, role: str) -> DataFrame:
    """One gap for each learner and kind that has evidence but is withheld from the role."""
    grants = _pairs({role: ROLES[role]}, "role", "scope", evidence.sparkSession)
    held = _scoped(evidence).join(F.broadcast(grants), "scope", "left_anti").select("learner_id", "kind").distinct()
    return held.select("learner_id", F.lit("privilege_restricted").alias("gap"), "kind")


def authorise_requests(requests: DataFrame) -> DataFrame:
    """Adds allowed and denial: unknown and absent roles are denied, students but for their own id."""
    role = F.lower(F.trim("role"))
    why = F.when(role.isNull() | (role == ""), "no_role").when(~role.isin(*ROLES), "unknown_role").when((role == "student") & F.col("requester_id").isNull(), "no_identity").when((role == "student") & (F.col("requester_id") != F.col("learner_id")), "other_learner")
    return requests.withColumn("denial", why).withColumn("allowed", why.isNull())


def classify_intent(question: Column) -> Column:
    """The first intent that has a word in the question, else unknown."""
    q, out = F.lower(F.coalesce(question, F.lit(""))), F.when(F.lit(False), "")
    for name, words in INTENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        out = out.when(hit, name)
    return out.otherwise("unknown")


def resolve_subject(question: Column) -> tuple[Column, Column]:
    """(subjects named, all / one / ambiguous)."""
    q = F.lower(F.coalesce(question, F.lit("")))
    named = F.array_compact(F.array(*[F.when(F.contains(q, F.lit(x)), F.lit(x)) for x in SUBJECTS]))
    n = F.size(named)
    return named, F.when(n == 0, "all").when(n == 1, "one").otherwise("ambiguous")


def sufficiency(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds sufficiency of each request (role, learner_id, intent) from the kinds that exist and those it may see."""
    spark = evidence.sparkSession
    kinds = evidence.groupBy("learner_id").agg(F.collect_set("kind").alias("kinds"))
    may = spark.createDataFrame([(r, [k for k, sc in KIND_SCOPE.items() if sc in scopes]) for r, scopes in ROLES.items()], "role string, may array<string>")
    need = spark.createDataFrame([(i, list(REQUIRED.get(i, ()))) for i, _ in INTENTS], "intent string, need array<string>")
    none = F.array().cast("array<string>")
    j = requests.join(kinds, "learner_id", "left").join(F.broadcast(may), "role", "left").join(F.broadcast(need), "intent", "left")
    have, need_, may_ = F.coalesce("kinds", none), F.coalesce("need", none), F.coalesce("may", none)
    case = F.when(F.col("intent") == "unknown", "unsupported").when(F.size(F.array_except(need_, have)) > 0, "missing_data").when(F.size(F.array_except(need_, may_)) > 0, "privilege_restricted").otherwise("ok")
    return j.withColumn("sufficiency", case).drop("kinds", "may", "need")


def select_evidence(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request columns, evidence columns): visible evidence of the intent's kinds; a subject question that names
    subjects gets theirs alone."""
    spark = evidence.sparkSession
    kinds = _pairs(QUOTED, "intent", "kind", spark)
    named, _ = resolve_subject(F.col("question"))
    r = requests.withColumn("_named", named).join(F.broadcast(kinds), "intent")
    seen = visible_evidence(evidence, list(ROLES))
    j = r.join(seen, ["learner_id", "role", "kind"])
    return j.where((F.col("intent") != "subject") | (F.size("_named") == 0) | F.array_contains("_named", F.coalesce("subject", F.lit("")))).drop("_named")


def _rank(col: Column) -> Column:
    return _case(col, {g: F.lit(i) for i, g in enumerate(GRADES)})


def answer_quality(selected: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per request the worst reliability and the confidence; predicted or unavailable evidence makes it low.

    Of ``requests``, those without any evidence have low reliability and unknown confidence.
    """
    g = selected.groupBy("request_id").agg(F.min(_rank(F.col("reliability"))).alias("_g"), F.bool_or(F.col("class").isin("predicted", "unavailable")).alias("_p"), F.count("*").alias("n_evidence"))
    grade = F.get(F.array(*map(F.lit, GRADES)), F.col("_g"))
    got = g.select("request_id", grade.alias("reliability"), F.when(F.col("_p"), "low").otherwise(grade).alias("confidence"), "n_evidence")
    if requests is None:
        return got
    return requests.select("request_id").join(got, "request_id", "left").na.fill({"reliability": "low", "confidence": "unknown", "n_evidence": 0})


def answer_type(selected: DataFrame) -> DataFrame:
    """Per request the type of claim and the limitations, in order."""
    has = lambda c: F.bool_or(c)
    g = selected.groupBy("request_id", "intent").agg(has(F.col("class") == "predicted").alias("p"), has(F.col("class") == "observed").alias("o"), has(F.col("class") == "derived").alias("d"), has(F.col("reliability") == "low").alias("low"))
    kind = F.when(F.col("p"), "prediction").when(F.col("d") & F.col("o"), "mixed").when(F.col("d"), "inference").otherwise("observation")
    limits = F.array_compact(F.array(F.when(F.col("low"), "low_reliability"), F.when(F.col("d"), "derived_from_log"), F.when(F.col("intent").isin("autonomy", "authority"), "scope_of_envelope")))
    return g.select("request_id", kind.alias("answer_type"), limits.alias("limitations"))


def _listed(values: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The key's list, empty for another key."""
    none = F.array().cast("array<string>")
    cells = [x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else none)]
    return F.coalesce(F.try_element_at(F.create_map(*cells), F.coalesce(key, F.lit(""))), none)


#: What an answer keeps of each piece of evidence.
ITEM = ("evidence_id", "kind", "class", "reliability", "statement", "source", "version", "origin", "n_events", "events_digest", "subject")


def answer_questions(requests: DataFrame, evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """I16: one row for each request: status (answered, refused or denied), reason and text, which only quotes
    stored statements, gaps and fixed lines; and of an answer its type, reliability, confidence, limitations,
    sources, versions, origin, and ``rests_on``: each quoted piece of evidence with its number and digest of events.

    A learner's evidence is one array (a row for each kind and subject), which meets each request once.
    """
    held = evidence.groupBy("learner_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("_items"))
    per = gaps.groupBy("learner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "gap_id", "gap"))), lambda x: x["gap"]), "\n").alias("gap_lines"))
    r = authorise_requests(requests.withColumn("intent", classify_intent(F.col("question")))).withColumn("role", F.lower(F.trim("role")))
    j = r.join(held, "learner_id", "left").join(per, "learner_id", "left")
    kinds_of = {role: tuple(k for k, scope in KIND_SCOPE.items() if scope in scopes) for role, scopes in ROLES.items()}
    named, _ = resolve_subject(F.col("question"))
    j = j.withColumns({"_may": _listed(kinds_of, F.col("role")), "_need": _listed(REQUIRED, F.col("intent")), "_want": _listed(QUOTED, F.col("intent")), "_named": named})
    have = F.coalesce(F.transform("_items", lambda x: x["kind"]), F.array().cast("array<string>"))
    enough = (
        F.when(F.col("intent") == "unknown", "unsupported").when(F.size(F.array_except("_need", have)) > 0, "missing_data").when(F.size(F.array_except("_need", "_may")) > 0, "privilege_restricted").otherwise("ok")
    )
    j = j.withColumn("_enough", enough)
    status = F.when(~F.col("allowed"), "denied").when(F.col("_enough") != "ok", "refused").otherwise("answered")
    reason = F.when(~F.col("allowed"), F.col("denial")).when(F.col("_enough") != "ok", F.col("_enough"))
    about = lambda x: (F.col("intent") != "subject") | (F.size("_named") == 0) | F.array_contains("_named", F.coalesce(x["subject"], F.lit("")))
    quoted = F.filter("_items", lambda x: F.array_contains("_may", x["kind"]) & F.array_contains("_want", x["kind"]) & about(x))
    j = j.withColumns({"status": status, "reason": reason}).withColumn("_q", F.when(F.col("status") == "answered", F.coalesce(quoted, F.array().cast(j.schema["_items"].dataType))))
    of = lambda c: F.transform("_q", lambda x: x[c])
    some = F.size("_q") > 0
    has = lambda c, *values: F.exists("_q", lambda x: x[c].isin(*values))
    worst = F.when(has("reliability", "low") | ~some, "low").when(has("reliability", "medium"), "medium").otherwise("high")
    kind = F.when(has("class", "predicted"), "prediction").when(has("class", "derived") & has("class", "observed"), "mixed").when(has("class", "derived"), "inference").otherwise("observation")
    limits = F.array_compact(F.array(F.when(has("reliability", "low"), "low_reliability"), F.when(has("class", "derived"), "derived_from_log"), F.when(F.col("intent").isin("autonomy", "authority") & some, "scope_of_envelope")))
    origins = F.array_distinct(F.filter(of("origin"), lambda x: x != "unknown"))
    gap_text = F.coalesce(F.concat(F.lit("Data gaps relevant to this question:\n"), "gap_lines"), F.lit("No known data gaps for this learner."))
    text = F.when(F.col("intent").isin("gaps", "missing"), gap_text).otherwise(F.concat(F.lit("Evidence:\n"), F.array_join(of("statement"), "\n")))
    answered = F.col("status") == "answered"
    out = {
        "answer": text, "answer_type": F.when(some, kind), "reliability": worst, "confidence": F.when(~some, "unknown").when(has("class", "predicted", "unavailable"), "low").otherwise(worst), "limitations": limits,
        "sources": F.array_sort(F.array_distinct(of("source"))), "versions": F.array_sort(F.array_distinct(of("version"))),
        "origin": F.when(F.size(origins) == 0, "unknown").when(F.size(origins) == 1, origins[0]).otherwise("mixed"),
        "rests_on": F.transform("_q", lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["n_events"].alias("n_events"), x["events_digest"].alias("events_digest"))),
    }
    return j.select(*requests.columns, "intent", "status", "reason", *[F.when(answered, c).alias(n) for n, c in out.items()])


@dataclass(frozen=True)
class Rule:
    """A category holds where every condition (stage, name, test, operand) does; tests are of TESTS."""

    category: str
    kind: str
    stage: str
    conditions: tuple[tuple[str, str, str, str], ...]


#: What explains an outcome, by which layer, and whether it bound the result or only narrows its meaning.
RULES = (
    Rule("input_rejected", "constraint", "events", (("events", "answered", "zero", ""),)),
    Rule("insufficient_data", "constraint", "baseline", (("baseline", "maturity", "in", "new"),)),
    Rule("insufficient_data", "constraint", "baseline", (("temporal", "state", "in", "insufficient_data"),)),
    Rule("baseline_adaptation", "caveat", "baseline", (("baseline", "maturity", "not_in", "new"), ("events", "answered", "positive", ""), ("baseline", "relative_drift", "set", ""))),
    Rule("temporal_state_logic", "caveat", "temporal", (("temporal", "character", "in", "isolated|flat"), ("temporal", "state", "not_in", "insufficient_data"), ("events", "answered", "positive", ""))),
    Rule("prediction_refusal", "constraint", "prediction", (("prediction", "refusal", "set", ""),)),
    Rule("uncertainty_limit", "constraint", "uncertainty", (("uncertainty", "verdict", "in", "resolved"), ("uncertainty", "binding", "in", "calibration|evidence|maturity"), ("uncertainty", "ceiling", "below_one", ""))),
    Rule("uncertainty_limit", "constraint", "uncertainty", (("uncertainty", "verdict", "not_in", "resolved"),)),
    Rule("policy_restriction", "constraint", "policy", (("policy", "decision", "in", "no_intervention"), ("policy", "reason", "not_in", "not_resolved"))),
    Rule("authority_restriction", "constraint", "authority", (("policy", "decision", "in", "intervene"), ("authority", "level", "not_in", "allowed"))),
    Rule("safety_restriction", "constraint", "safety", (("policy", "decision", "in", "intervene"), ("safety", "final_reason", "in", "expired|action_not_permitted|high_impact"))),
)


def stage_log(decisions: DataFrame, columns: dict[str, dict[str, Column]]) -> DataFrame:
    """(decision_id, stage, name, value): what each stage reported of a decision, as text, nulls left out."""
    cells = [F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("name"), c.cast("string").alias("value")) for stage, named in columns.items() for name, c in named.items()]
    return decisions.select("decision_id", F.inline(F.array(*cells))).where("value IS NOT NULL")


def diagnose(log: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(decision_id, category, kind, stage, evidence): which layers explain each decision of a stage log, else no_restriction.

    The rules are a table that the log is matched with: a rule holds where all its conditions have met an
    entry.  A category is named once, with the entries (stage.name=value) that its rules rest on.
    """
    spark = log.sparkSession
    rows = [(i, r.category, r.kind, r.stage, len(r.conditions), *c) for i, r in enumerate(rules) for c in r.conditions]
    table = spark.createDataFrame(rows, "rule int, category string, kind string, layer string, size int, stage string, name string, test string, operand string")
    value, number, listed = F.col("value"), F.col("value").try_cast("double"), F.split("operand", "\\|")
    met = (
        F.when(F.col("test") == "in", F.array_contains(listed, value)).when(F.col("test") == "not_in", ~F.array_contains(listed, value)).when(F.col("test") == "set", F.lit(True))
        .when(F.col("test") == "zero", number == 0).when(F.col("test") == "positive", number > 0).when(F.col("test") == "below_one", number < 1)
    )
    held = log.join(F.broadcast(table), ["stage", "name"]).where(met)  # a few rules
    fired = held.groupBy("decision_id", "rule", "category", "kind", "layer", "size").agg(F.count("*").alias("n"), F.collect_set(F.concat("stage", F.lit("."), "name", F.lit("="), "value")).alias("seen")).where("n = size")
    found = fired.groupBy("decision_id", "category", "kind", F.col("layer").alias("stage")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), ",").alias("evidence"))
    free = log.select("decision_id").distinct().join(found.where("kind = 'constraint'").select("decision_id").distinct(), "decision_id", "left_anti")
    return found.unionByName(free.select("decision_id", F.lit("no_restriction").alias("category"), F.lit("constraint").alias("kind"), F.lit("policy").alias("stage"), F.lit("").alias("evidence")))
