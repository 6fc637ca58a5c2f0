"""Steps that several parts of a query need are computed once."""

import os

import pytest

from eventlens.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_rows_are_checked_once(spark):
    """The findings and verdicts are read from what was saved of the checked rows, not from the events again."""
    assert not [f for f in queries()["v10_dataset_findings"](spark, SF).inputFiles() if f.endswith("events.parquet")]
