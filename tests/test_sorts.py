"""The context and features of a session from few sorts, with the results of a plain reading."""

import os
import random

import pytest

from eventlens.operators import context as C
from eventlens.plans import queries
from eventlens.settings import SPARSE

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_features_take_three_sorts(spark):
    """One for the log, one by intervention and answer, one in time order: each holds a task's rows in memory."""
    plan = queries()["f16_features_long"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") <= 3


def test_performance_and_interventions_as_read_row_by_row(spark):
    """Completions before their start, without a start or an id, of other sessions; other events with an id; nulls."""
    rnd, rows = random.Random(5), []
    kinds = ("question_answered", "intervention_started", "intervention_completed", "interaction", None)
    for i in range(600):
        kind = rnd.choice(kinds)
        rows.append((i, rnd.choice("ab"), rnd.choice("xy"), 1000000 * rnd.randrange(200), kind, rnd.choice(("i1", "i2", "i3", None)), rnd.choice(("recap", "pause")), rnd.choice(("accepted", "ignored", None)), rnd.choice((True, False, None)), rnd.choice((1.0, 2.5, 4.0, 8.0, None))))
    names = "event_id long, learner_id string, session_id string, us long, event_type string, intervention_id string, intervention_type string, outcome string, correct boolean, response_seconds double"
    df = spark.createDataFrame(rows, names)
    got = {r["event_id"]: r for r in C.intervention_status(C.recent_performance(df, SPARSE), SPARSE).collect()}
    ends = {r["event_id"] for r in C.end_of_session(df).collect()}
    assert len(got) == len(rows)
    for row in rows:
        mine = sorted((r for r in rows if r[1:3] == row[1:3]), key=lambda r: (r[3], r[0]))
        seen = [r for r in mine if (r[3], r[0]) <= (row[3], row[0])]
        answers = [r for r in seen if r[4] == "question_answered"][-SPARSE.recent_answers:]
        starts = [r for r in seen if r[4] == "intervention_started"]
        last = starts[-1] if starts else None
        done = [r for r in mine if r[4] == "intervention_completed" and last and last[5] is not None and r[5] == last[5]][:1]
        g = got[row[0]]
        assert (g["answer_count"], g["correct_count"]) == (len(answers), sum(bool(r[8]) for r in answers))
        slow = None if not answers or any(r[9] is None for r in answers) else sum(r[9] for r in answers) / len(answers)
        assert g["recent_response"] == slow
        assert (g["interventions"], g["last_intervention_type"], g["last_intervention_us"]) == (len(starts), last and last[6], last and last[3])
        assert g["last_outcome"] == (done[0][7] if done and (done[0][3], done[0][0]) <= (row[3], row[0]) else None)
        assert (row[0] in ends) == (mine[-1] is row)
