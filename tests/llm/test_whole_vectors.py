"""Recall where windows are small beside the table."""

import numpy as np
from pyspark.sql import functions as F

from docutally.llm import hilbert


def test_recall_holds_when_windows_are_many(llm):
    x = np.random.default_rng(5).normal(size=(3000, 32))
    frame = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["id"]) for r in hilbert.nearest(frame, F.col("id") % 20 == 0, 20, window=64, sample=64).collect()}
    want = set()
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-score)[:20]}
    assert len(got & want) >= 0.9 * len(want)


def test_reach_is_no_more_than_needed():
    truth = [(0, 1), (0, 2)]
    near = {(0, 0): 40, (0, 1): 41, (0, 2): 90, (1, 0): 7, (1, 1): 60, (1, 2): 7}
    assert hilbert._reach(near, truth, 2, 1.0) == (2, 1)
    assert hilbert._reach(near, truth, 1, 1.0) == (1, 50)
    assert hilbert._reach({}, [], 2, 1.0) == (1, 0)
