"""Searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docutally.llm import hilbert, maxscore

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, None, "x") for i, v in vectors], SCHEMA).repartition(3)


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector that is a quarter of all
    odd = [(2000, None), (2050, []), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [math.inf] + [0.0] * 15), (None, rows[0][1]), (2250, [0.0] * 16), (2300, [1.0, 2.0])]
    return rows + odd + [rows[50]]


def usable(rows, zero):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            fine[i] = np.array(v, dtype=np.float64)
    return fine


def brute(fine, queries, k, score):
    out = []
    for q in queries:
        found = sorted((-score(fine[q], v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [128, 16384])
def test_maxscore_is_exact(llm, shard):
    rows = vectors()
    fine = {i: np.floor(256 * v).astype(np.int64) for i, v in usable(rows, True).items()}
    got = maxscore.top_k(table(llm, rows), F.col("id") % 50 == 0, 5, shard_rows=shard, block_rows=16)
    want = brute(fine, [i for i in fine if i % 50 == 0], 5, lambda a, b: int(a @ b))
    assert sorted(map(tuple, got.collect())) == want


def test_nearest_recall_and_scores(llm):
    rows = vectors()
    fine = usable(rows, False)
    queries = [i for i in fine if i % 20 == 0]
    got = sorted(map(tuple, hilbert.nearest(table(llm, rows), F.col("id") % 20 == 0, 20, window=200).collect()))

    def dot(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist()):
            total += x * y
        return total

    assert all(s == dot(fine[q], fine[i]) for q, _, i, s in got)
    want = {(q, i) for q, _, i, _ in brute(fine, queries, 20, dot)}
    assert len(want & {(q, i) for q, _, i, _ in got}) >= 0.9 * len(want)
    assert [r[:2] for r in got] == [(q, n) for q in sorted(queries) for n in range(1, 1 + sum(r[0] == q for r in got))]
    whole = sorted(map(tuple, hilbert.nearest(table(llm, rows), F.col("id") % 20 == 0, 20).collect()))
    assert whole == brute(fine, queries, 20, dot)


def test_hilbert_curve_moves_one_cell_at_a_time():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_empty_and_few(llm):
    none = table(llm, []).limit(0)
    assert maxscore.top_k(none, F.col("id") % 50 == 0).count() == 0 and hilbert.nearest(none, F.col("id") % 20 == 0).count() == 0
    few = table(llm, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert [r["id"] for r in hilbert.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [1, 2]
    assert [r["id"] for r in maxscore.top_k(few, F.col("id") == 0).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("shard", [16, 16384])
def test_maxscore_with_very_large_components(llm, shard):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(200 + i, [v, -1.0, float(i), 0.5]) for i, v in enumerate([1e8, -1e8, 1.2e7, 1e15, -1e17, 3e37, -3e37])]
    rows += [(i, [c * 10.0**8 for c in v]) for i, v in ((300, rows[1][1]), (350, rows[50][1]), (400, rows[9][1]))]
    frame = table(llm, rows)
    exact = {r["vec_id"]: [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in r["embedding"]] for r in frame.collect()}
    assert max(map(abs, exact[205])) == 2**63 - 1

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -maxscore.HIGHEST), maxscore.HIGHEST)

    got = maxscore.top_k(frame, F.col("id") % 50 == 0, 5, shard_rows=shard, block_rows=2)
    assert sorted(map(tuple, got.collect())) == brute(exact, [i for i in exact if i % 50 == 0], 5, score)
