"""Approximate nearest neighbours over several shifted Hilbert curves.

Method: vectors are projected to a few dimensions by a random rotation, once per curve, shifted
by a random offset and put in the order of a Hilbert curve. Spark range-partitions and sorts every
curve; places along a curve are cut into windows of ``window`` rows. A query is compared with its
own window and ``reach`` neighbouring ones to either side on some of the curves; the hits of all curves are
merged and reranked by the exact measure on the original vectors.

Number of curves and reach follow from the table: the true neighbours of ``SAMPLE`` queries are found by brute
force, and the cheapest pair is taken with which ``RECALL`` of them meet their query. On vectors without
structure that comes to most of the table on one curve, on others to a few windows at any size.

Scale: the sort is a range partitioning per curve, so no task sees a whole curve; places come from
row counts per partition. A task holds one window and the queries that reach it, in slices. Work is queries x
curves x windows reached: in proportion to the input where neighbours lie near each other on a curve, up to queries x
rows where they do not. The driver sees the sample's vectors, neighbours and windows only.
Equal vectors are told apart by id, so a vector that is a third of the table fills many windows.

Defined results: see ``vectors.usable``; zero vectors take no part either; a query never finds its own
id; with fewer than k candidates all are returned; vectors of different lengths never meet; ties go to the smaller
id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docutally.llm.common import written
from docutally.llm.vectors import best, matrix, usable

CURVES = 5
WINDOW = 8192
#: Queries whose true neighbours are looked up, and the share of these that must be met.
SAMPLE, RECALL = 128, 0.98
#: Dimensions that a curve runs through, and bits of each: together at most 63.
PROJECTED, BITS = 6, 10


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows) with ``bits`` bits per coordinate.

    The points' coordinates become the curve's transposed index by undoing rotations from the
    highest bit down; the bits are then interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        low = q - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curve: int, seed: int = 7) -> np.ndarray:
    """Hilbert keys of unit-scaled vectors on one curve: rotate, shift, cut into cells."""
    rng = np.random.default_rng([seed, curve, vectors.shape[1]])
    m = min(PROJECTED, vectors.shape[1])
    basis, _ = np.linalg.qr(rng.normal(size=(vectors.shape[1], m)))
    flat = vectors @ basis * np.sqrt(vectors.shape[1])  # spread of about one in each direction
    shift = rng.uniform(0, 1, m)
    cells = np.clip((flat + 4 + shift) / 9 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def _top(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int):
    """(query id, ids, scores) of the ``k`` largest inner products for each query."""
    for at in range(0, len(q), 128):
        rough = q[at : at + 128] @ x.T
        for own, vec, near in zip(asked[at : at + 128], q[at : at + 128], rough):
            near[ids == own] = -np.inf
            size = min(len(near), k + 1)
            floor = np.partition(near, len(near) - size)[len(near) - size]
            # All within rounding of the last place are scored anew, component by component.
            some = np.flatnonzero((near >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else near > -np.inf) & (ids != own))
            exact = np.zeros(len(some))
            for d in range(x.shape[1]):
                exact += vec[d] * x[some, d]
            top = best(exact, ids[some], k)
            yield own, ids[some[top]], exact[top]


def _true_neighbours(rows: DataFrame, is_query: Column, k: int, sample: int) -> list[tuple[int, int]]:
    """(query, neighbour) of the ``k`` nearest of a bounded sample of queries, by brute force."""
    asked = {}
    for r in rows.filter(is_query).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "dim", "vec").collect():
        asked.setdefault(r["dim"], []).append((r["id"], r["vec"]))
    asked = {dim: (np.array([i for i, _ in own]), np.array([v for _, v in own])) for dim, own in asked.items()}

    def search(batches):
        for batch in batches:
            ids, dims, vecs = batch.column("id").to_numpy(), batch.column("dim").to_numpy(), batch.column("vec")
            for dim in set(np.unique(dims).tolist()) & asked.keys():
                at = np.flatnonzero(dims == dim)
                x = vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for own, found, score in _top(ids[at], x, *asked[dim], k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), own)), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

    hits = rows.mapInArrow(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return [tuple(r) for r in hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id").collect()]


def _reach(windows: dict[tuple[int, int], int], truth: list[tuple[int, int]], curves: int, recall: float) -> tuple[int, int]:
    """(curves, windows to either side) with which ``recall`` of the pairs meet, at the least work.

    ``windows`` has the window of each (curve, id).
    """
    if not truth:
        return 1, 0
    apart = np.array([[abs(windows[c, q] - windows[c, i]) for q, i in truth] for c in range(curves)])
    last = max(windows.values())
    ways = []
    for n in range(1, curves + 1):
        reach = int(np.sort(apart[:n].min(axis=0))[int(np.ceil(recall * len(truth))) - 1])
        ways.append((n * min(2 * reach + 1, last + 1), n, reach))
    return min(ways)[1:]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, window: int = WINDOW, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` largest inner products found for each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = usable(vectors, id_col, vector_col).filter(F.exists("vec", lambda x: x != 0))

    def keyed(batches):
        for batch in batches:
            ids, dims = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            vecs = batch.column("vec")
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = vecs.take(pa.array(at))
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(curve_keys(unit, c)), pa.array(ids[at]), part],
                        names=["dim", "curve", "key", "id", "vec"],
                    )

    spread = rows.mapInArrow(keyed, "dim int, curve int, key long, id long, vec array<double>")
    line = spread.repartitionByRange("dim", "curve", "key", "id").sortWithinPartitions("dim", "curve", "key", "id")
    placed = written(line.withColumn("row", F.monotonically_increasing_id()), "hilbert")
    part, row = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    # Rows before each (partition, dim, curve), counted within the curve: one number per partition and curve.
    sizes = placed.groupBy("dim", "curve", part.alias("part")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    before = sizes.select("dim", "curve", "part", "first", (F.sum("n").over(Window.partitionBy("dim", "curve").orderBy("part")) - F.col("n")).alias("before"))
    cut = placed.withColumn("part", part).join(before, ["dim", "curve", "part"]).withColumn("window", F.floor((row - F.col("first") + F.col("before")) / window).cast("int"))
    truth = _true_neighbours(placed.filter("curve = 0").select("id", "dim", "vec"), is_query, k, sample)
    wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted({i for pair in truth for i in pair})], "id long")
    spots = {(r["curve"], r["id"]): r["window"] for r in cut.join(F.broadcast(wanted), "id").select("curve", "id", "window").collect()}
    used, reach = _reach(spots, truth, curves, recall)
    cut = cut.filter(F.col("curve") < used)
    kept = cut.select("dim", "curve", "window", "id", "vec")
    last = cut.groupBy("dim").agg(F.max("window").alias("last"))
    around = F.sequence(F.greatest(F.lit(0), F.col("window") - reach), F.least("last", F.col("window") + reach))
    posed = cut.filter(is_query).join(F.broadcast(last), "dim").select("dim", "curve", F.explode(around).alias("window"), "id", "vec").toDF("dim", "curve", "window", "id", "vec")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def search(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = key[0].as_py()
        ids, x = left.column("id").to_numpy(), matrix(left, "vec", dim)
        asked, q = right.column("id").to_numpy(), matrix(right, "vec", dim)
        found = [(np.full(len(near), own), near, score) for own, near, score in _top(ids, x, asked, q, k)]
        return pa.table([np.concatenate([f[i] for f in found]) for i in range(3)], schema=schema)

    keys = ("dim", "curve", "window")
    hits = kept.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_hilbert(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    found = nearest(table(prepare(spark), sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
