"""Training against a plain fit, the registry's refusals, and scoring by what was in production."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import models as M
from eventlens.operators import registry as R


def plain_fit(x, y, rounds=50):
    """Logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return w


def test_training_equals_a_plain_fit(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(3, 2, 400), rng.normal(-100, 30, 400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 3 + (x[:, 1] + 100) / 40)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    fitted = M.train(df, ["a", "b"])
    want = plain_fit(x, y)
    numbers = M.logistic_numbers(fitted)
    assert [numbers.intercept, numbers.weights["a"], numbers.weights["b"]] == pytest.approx(want, rel=1e-3)
    by_model = M.score(df, fitted).select("a", "probability").orderBy("a").collect()
    by_numbers = M.score(df, numbers.fitted(fitted.reference)).select("a", "probability").orderBy("a").collect()
    assert [r["probability"] for r in by_model] == pytest.approx([r["probability"] for r in by_numbers], abs=1e-6)
    for bad in (df.limit(0), df.limit(1), df.where("label = 1")):
        with pytest.raises(ValueError):
            M.train(bad, ["a", "b"])


def test_registry_refuses(spark, tmp_path):
    path, plain = str(tmp_path), M.Logistic({"a": 1.0, "b": -2.0}, 0.5)
    R.register(plain.fitted({"a": 0.0, "b": 1.0}, "7", 0.4), spark, path, "m", "V1")
    with pytest.raises(ValueError, match="already"):
        R.register(plain.fitted({"a": 0.0, "b": 1.0}), spark, path, "m", "V1")
    got = R.load(spark, path, "m", "V1", ["a", "b"], "7")
    assert (got.model, got.threshold, got.reference) == (plain, 0.4, {"a": 0.0, "b": 1.0})
    for args in (("m", "V2"), ("x", "V1")):
        with pytest.raises(ValueError, match="0 times"):
            R.load(spark, path, *args)
    with pytest.raises(ValueError, match="feature set"):
        R.load(spark, path, "m", "V1", ["a", "b"], "8")
    with pytest.raises(ValueError, match="columns"):
        R.load(spark, path, "m", "V1", ["b", "a"])
    R.registry(spark, path).withColumns({"version": F.lit("V9"), "intercept": F.lit(9.0)}).write.mode("append").parquet(f"{path}/models")
    with pytest.raises(ValueError, match="not what was registered"):
        R.load(spark, path, "m", "V9")


def test_mixed_feature_sets_are_an_error(spark):
    fitted = M.Logistic({"a": 1.0}, 0.0).fitted({"a": 0.0}, "2", 0.7)
    df = spark.createDataFrame([(1.0, "2"), (0.0, "2"), (None, "2")], "a double, feature_set string")
    assert [(r["predicted"], r["refusal"]) for r in M.score(df, fitted).orderBy(F.desc("a")).collect()] == [(1, None), (0, None), (None, "absent:a")]
    with pytest.raises(ValueError, match="mixes"):
        M.score(df.union(spark.createDataFrame([(1.0, "1")], df.schema)), fitted)
    with pytest.raises(ValueError, match="not 1"):
        M.score(df.withColumn("feature_set", F.lit("1")), fitted)


def test_intervals_of_production(spark):
    log = [("m", "V1", 10, 0, "production"), ("m", "V2", 20, 1, "validated"), ("m", "V2", 30, 2, "production"), ("m", "V2", 40, 3, "retired"), ("m", "V3", 50, 4, "production"), ("m", "V1", 50, 5, "production"), ("n", "V1", 0, 6, "production")]
    df = spark.createDataFrame(log, "model_id string, version string, us long, seq int, status string")
    assert sorted(map(tuple, R.in_production(df).collect()), key=repr) == sorted([("m", "V1", 10, 30), ("m", "V2", 30, 40), ("m", "V1", 50, None), ("n", "V1", 0, None)], key=repr)
    rows = spark.createDataFrame([("m", t) for t in (9, 10, 29, 30, 39, 40, 49, 50, 900)] + [("n", 0), ("x", 5), (None, 5), ("m", None)], "model_id string, us long")
    got = {(r["model_id"], r["us"]): r["version"] for r in R.model_at(rows, df).collect()}
    assert got == {("m", 9): None, ("m", 10): "V1", ("m", 29): "V1", ("m", 30): "V2", ("m", 39): "V2", ("m", 40): None, ("m", 49): None, ("m", 50): "V1", ("m", 900): "V1", ("n", 0): "V1", ("x", 5): None, (None, 5): None, ("m", None): None}
    assert R.model_at(rows.limit(0), df).count() == 0


def test_pipelines_and_numbers_score_their_own_time(spark, tmp_path):
    path = str(tmp_path)
    rng = np.random.default_rng(5)
    train = spark.createDataFrame([(float(x), int(x + rng.normal() > 0)) for x in rng.normal(size=200)], "a double, label int")
    trained = M.train(train, ["a"], algorithm="random_forest")
    trained.feature_set = "2"
    R.register(M.Logistic({"a": 2.0}, 0.0).fitted({"a": 0.0}, "1", 0.9), spark, path, "m", "V1")
    R.register(trained, spark, path, "m", "V2")
    log = spark.createDataFrame([("m", "V1", 0, 0, "production"), ("m", "V2", 100, 1, "production")], "model_id string, version string, us long, seq int, status string")
    rows = spark.createDataFrame([("m", 5, 1.0, "1"), ("m", 6, 2.0, "1"), ("m", 7, 1.0, "2"), ("m", 8, None, "1"), ("m", 100, 3.0, "2"), ("m", 101, 3.0, "1"), ("m", 102, None, "2"), ("z", 5, 1.0, "1")], "model_id string, us long, a double, feature_set string")
    got = {r["us"] if r["model_id"] == "m" else "z": r for r in R.score_in_production(rows, path, log, ["a"]).collect()}
    assert got[5]["probability"] == pytest.approx(1 / (1 + np.exp(-2))) and (got[5]["predicted"], got[6]["predicted"]) == (0, 1)
    assert {k: got[k]["refusal"] for k in got} == {5: None, 6: None, 7: "feature_set:2", 8: "absent:a", 100: None, 101: "feature_set:1", 102: "absent:a", "z": "not_in_production"}
    alone = M.score(spark.createDataFrame([(3.0,)], "a double"), R.load(spark, path, "m", "V2", ["a"], "2")).first()["probability"]
    assert got[100]["probability"] == pytest.approx(alone) and got[100]["version"] == "V2" and got[100]["predicted"] == 1
