"""Values on a boundary, as the queries' SQL decides them."""

import pytest
from pyspark.sql import functions as F

from eventlens.functions.columns import fixed_places
from eventlens.operators import models as M
from eventlens.operators import outcomes as O
from eventlens.operators import policy as P
from eventlens.operators import temporal as T
from eventlens.operators import uncertainty as U
from eventlens.plans.canon import r6
from eventlens.plans.q_baseline import FOLD, ORACLES
from eventlens.settings import DEFAULT, SPARSE


@pytest.mark.parametrize("settings,want", [(SPARSE, "deteriorated"), (DEFAULT, "no_change")])
def test_accuracy_that_falls_by_the_tolerance(spark, settings, want):
    """0.8 - 0.75 is a little more than 0.05 in doubles: the sparse settings compare plainly, the default allows for that."""
    row = spark.createDataFrame([(0.8, 0.75, 5, 4)], "accuracy_before double, accuracy_after double, answers_before long, answers_after long")
    assert row.select(O.accuracy_measure(settings)["direction"]).first()[0] == want


def test_direction_without_slack(spark):
    got = spark.createDataFrame([(0.95, 1.0)], "b double, a double").select(O.direction_of(F.col("b"), F.col("a"), False, 0.05, SPARSE.slack), O.direction_of(F.col("b"), F.col("a"), False, 0.05)).first()
    assert tuple(got) == ("improved", "no_change")


def test_contributions_that_differ_in_their_last_bits(spark):
    """Equal to 12 places: by name."""
    fitted = M.Logistic({"z": 0.3 + 1e-14, "a": 0.3}, 0.1).fitted({"z": 0.0, "a": 0.0})
    explained = U.occlusion_contributions(spark.createDataFrame([(1, 1.0, 1.0)], "id int, z double, a double"), ["id"], fitted)
    assert [c["feature"] for c in explained.first()["contributions"]] == ["a", "z"]
    assert [c["feature"] for c in U.top_contributions(explained, 1).first()["contributions"]] == ["a"]


@pytest.mark.parametrize("x", [0.14625, 3.24625, 0.03125, 0.09375, 12345.5, 1234567.00005, 0.0, 0.99995, 1e-9])
def test_fixed_places_as_printf(spark, x):
    assert spark.range(1).select(fixed_places(F.lit(x), 4)).first()[0] == f"{x:.4f}"


def test_all_deliveries_before_a_decision(spark):
    gave = spark.createDataFrame([("a", i, 10 * i) for i in range(70)] + [("b", 99, 0)], "learner_id string, intervention_id long, delivered_us long")
    asked = spark.createDataFrame([("a", 1, 690), ("a", 2, 689), ("b", 3, -1)], "learner_id string, decision_id long, decided_us long")
    got = P.history_as_of(gave, asked).collect()
    assert sorted((r["decision_id"], r["back"], r["intervention_id"]) for r in got) == sorted([(1, 70 - i, i) for i in range(70)] + [(2, 69 - i, i) for i in range(69)])


#: 0.1 + 0.2 + 0.3 equals 0.2 + 0.2 + 0.2 in doubles, 0.3 + 0.2 + 0.1 is less: runs of equal mean when the oldest are added first.
TIED = {"accuracy": [0.2, 0.2, 0.2], "response_seconds": [0.1, 0.2, 0.3]}


def tied(spark, sign):
    """Deviations of two dimensions whose means tie, so that dispersion decides; ``sign`` turns the second."""
    rows = [("a", i * 1_000_000, d, z * (sign if d == "response_seconds" else 1), i + 1) for d, zs in TIED.items() for i, z in enumerate(zs)]
    return spark.createDataFrame(rows, "learner_id string, us long, dimension string, z double, n int")


def by_sql(name, dev):
    """A query's SQL over the given deviations."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE given (learner_id VARCHAR, us BIGINT, dimension VARCHAR, z DOUBLE, n INTEGER)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in dev.collect()])
    assert ORACLES[name].startswith(FOLD)
    return sorted(con.execute("WITH dev AS (SELECT * FROM given)" + ORACLES[name][len(FOLD) :]).fetchall())


@pytest.mark.parametrize("sign", [1, -1])
def test_dominant_dimension_adds_a_run_as_its_sql(spark, sign):
    dev = tied(spark, sign)
    got = T.dominant_dimension(T.tracks(dev, SPARSE)).select("learner_id", "us", "dominant.dimension", "dominant.run").collect()
    assert sorted(map(tuple, got)) == by_sql("t6_dominant_dimension", dev)
    assert max(got, key=lambda r: r["us"])["dimension"] == "response_seconds"


@pytest.mark.parametrize("sign", [1, -1])
def test_evidence_is_that_of_the_dimension_its_sql_chooses(spark, sign):
    dev = tied(spark, sign)
    got = T.state_history(dev, SPARSE).select("learner_id", "us", "weakest_maturity", "observations", "evidence_run", *r6("evidence_seconds", "mean_z", "evidence_dispersion")).collect()
    assert sorted(map(tuple, got)) == by_sql("t8_state_evidence", dev)
    assert max(got, key=lambda r: r["us"])["evidence_dispersion"] == pytest.approx(0.14826)


@pytest.mark.parametrize("zs,run", [([], 0), ([0.001], 0), ([1.0, 0.001, 2.0], 1), ([-1.0, 1.0, 2.0], 2), ([1.0, -0.001], 0), ([-3.0, -2.0, -1.0], 3), ([0.01, -0.01], 1)])
def test_newest_run(spark, zs, run):
    got = spark.createDataFrame([(zs,)], "zs array<double>").select(T.sign_run(F.col("zs"), SPARSE)["run"].alias("run"), T.sign_run(F.col("zs"), SPARSE)["total"].alias("total")).first()
    assert tuple(got) == (run, sum(zs[len(zs) - run :], 0.0))
