"""The whole chain reads the log and measures outcomes once."""

import os

import pytest

from eventlens.plans import analysis, canon, q_intelligence, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["i19_pipeline", "i19_trained"])
def test_chain_takes_each_step_once(spark, monkeypatch, name):
    """One saved frame is built from the given table, one from the measures of deliveries, and labels meet their features without a join by event."""
    plans = []

    def kept(df, name="saved", save=canon.saved):
        plans.append((name, df.inputFiles(), df._jdf.queryExecution().optimizedPlan().toString()))
        return save(df, name)

    for module in (analysis, canon, q_intelligence):
        monkeypatch.setattr(module, "saved", kept)
    queries()[name](spark, SF)
    assert [kind for kind, files, _ in plans if any(f.endswith("events.parquet") for f in files)] == ["events"]
    assert sum(plan.count("Generate inline(_m#") for _, _, plan in plans) == 1
    label = next(plan for kind, _, plan in plans if kind == "labelled")
    assert not [line for line in label.splitlines() if "Join" in line and "event_id" in line]
