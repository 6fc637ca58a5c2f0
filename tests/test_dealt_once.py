"""States are dealt by learner once; the windows of deliveries meet in plain sums; responses need no sort."""

from pyspark.sql import functions as F

from eventlens.operators import evaluation as E
from eventlens.operators import outcomes as O
from eventlens.operators import temporal as T
from eventlens.operators.baseline import DIMENSIONS
from eventlens.settings import SPARSE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def seen(spark):
    """Deviations with two of one instant, an instant of another dimension only, absent z and a row without learner."""
    rows = [(str(i % 3), i // 2 * 10, d, None if (i + j) % 4 == 0 else ((i * 7 + j * 3) % 11 - 5) / 2.0, i) for i in range(24) for j, d in enumerate(DIMENSIONS) if (i + j) % 3]
    rows += [("1", 30, "accuracy", 1.5, 3), ("1", 35, "other", 1.0, 1), (None, 50, "accuracy", 2.0, 2)]
    return spark.createDataFrame(rows, "learner_id string, us long, dimension string, z double, n int")


def test_states_deal_rows_once(spark):
    text = plan(T.state_history(seen(spark), SPARSE))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_tracks_hold_a_row_for_each_instant_and_dimension(spark):
    """The same rows as a grid of instants and dimensions joined with what was seen."""
    dev = seen(spark)
    got = T.tracks(dev, SPARSE).select("learner_id", "us", "dimension", "z", "observed")
    grid = dev.select("learner_id", "us").distinct().withColumn("dimension", F.explode(F.array(*map(F.lit, DIMENSIONS))))
    want = grid.join(dev, ["learner_id", "us", "dimension"], "left").select("learner_id", "us", "dimension", "z", F.col("z").isNotNull().alias("observed"))
    assert got.count() == want.count() and not got.exceptAll(want).count()


def test_facts_collect_items_from_sums(spark):
    day = 86_400_000_000
    events = spark.createDataFrame(
        [
            ("a", "s", None, 1, 9 * day, "question_answered", True, 2.0, None, "real"), ("a", "s", None, 2, 9 * day + 5, "question_answered", False, 4.0, None, "real"),
            ("a", "s", None, 3, 10 * day + 1, "content_opened", None, None, "x", "real"), ("a", "s", None, 4, 10 * day + 2, "content_opened", None, None, "x", "synthetic"),
            ("a", "s", None, 5, 10 * day + 3, "content_opened", None, None, None, "real"), ("a", "s", None, 6, 10 * day + 4, "content_closed", None, None, "y", "real"),
            ("a", "s", None, 7, 11 * day + 1, "question_answered", True, None, None, "real"), ("a", "s", None, 8, 9 * day + 7, "content_opened", None, None, "z", "real"),
        ],
        "learner_id string, session_id string, intervention_id long, event_id long, us long, event_type string, correct boolean, response_seconds double, content_id string, origin string",
    )
    deliveries = spark.createDataFrame([("a", "s", 1, 10 * day, None, None), ("b", "t", 2, day, None, None)], "learner_id string, session_id string, intervention_id long, delivered_us long, outcome string, response_seconds double")
    facts = O.window_facts(deliveries, events, SPARSE)
    a, b = facts.orderBy("intervention_id").collect()
    assert (a["n_before"], a["n_after"], a["n_immediate"], a["answers_before"], a["answers_after"]) == (3, 4, 3, 2, 1)
    assert (a["accuracy_before"], a["accuracy_after"], a["latency_before"], a["any_real"], a["tracked"]) == (0.5, 1.0, 3.0, True, "z")
    assert (a["opened"], a["closed"]) == (["x"], ["y"])
    assert (b["n_before"], b["answers_after"], b["accuracy_before"], b["opened"], b["any_real"]) == (0, 0, None, None, None)
    # what collects the items takes aggregated rows, not those of the join
    lines = [line.strip(" :+-") for line in facts._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    above = next(i for i, line in enumerate(lines) if line.startswith("Aggregate") and "collect_set" in line)
    assert next(line for line in lines[above + 1 :] if not line.startswith("Project")).startswith("Aggregate")


def test_responses_by_keys_are_not_sorted(spark):
    rows = [(1, "a", "response", "improved", "measured"), (1, "a", "response", "no_change", "measured"), (2, "a", None, "not_assessed", "insufficient_data")]
    m = spark.createDataFrame(rows, "intervention_id long, learner_id string, response_class string, direction string, status string")
    got = E.intervention_response(m, of=("learner_id", "response_class"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "response", "improvement"), (2, "a", None, "insufficient_data")]
    assert "SortAggregate" not in plan(got)
