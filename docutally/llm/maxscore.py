"""Exact top-k search by MaxScore over sharded inverted indexes of integer vectors.

Method: a vector component with its sign is a term, so a vector is in the postings of (dimension,
sign) for each non-zero component. A query asks for the terms that agree with its own signs;
all other components can only lower a score. Each term has an upper bound on what it adds. Terms
are sorted by bound; the longest tail whose bounds together stay below the current k-th score is
non-essential: a vector found in no essential posting cannot enter the result. Essential postings
are traversed, the non-essential terms are probed only for vectors that are still competitive, and
survivors are scored in full. The threshold starts at the k-th score among the heads of the strongest
postings and rises block by block. Shards return their k best, which are merged.

Scale: vectors are dealt into shards of about ``shard_rows`` rows and queries into blocks of about
``block_rows``; a task holds one shard and one block. What is shuffled is vectors x query blocks plus
queries x shards, and k rows per query and shard come back. Equal vectors spread by id.

Vectors whose products might leave 64 bits are searched apart, by the same method on Python integers; all others stay on
machine integers whatever else lies in their shard.

Defined results: see ``vectors.usable`` for vectors that take no part; a query never finds its own
id; fewer than k candidates give all of them; vectors of different lengths never meet; ties go to
the smaller id; empty tables give an empty result; other columns are ignored. Components beyond 64 bits count as
the nearest 64-bit integer, and so do scores (from -HIGHEST to HIGHEST), which may tie there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docutally.llm.vectors import best, bucket, matrix, usable

#: Vectors between two updates of the threshold.
BLOCK = 4096
#: The largest score told apart; its negative is the smallest.
HIGHEST = 2**63 - 1


def machine_sized(x: np.ndarray) -> np.ndarray:
    """Rows whose products with one another, and all sums of these, fit 64 bits with room to spare."""
    limit = math.isqrt(2**61 // max(x.shape[1], 1))
    return ((x <= limit) & (x >= -limit)).all(axis=1)


class Shard:
    """Postings of one shard: per (dimension, sign) the places in order of falling impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.postings = {}
        for d in range(x.shape[1]):
            order = np.argsort(-x[:, d], kind="stable")
            column = x[order, d]
            positive, negative = np.searchsorted(-column, 0), np.searchsorted(-column, 0, side="right")
            self.postings[d, 1] = order[:positive]
            self.postings[d, -1] = order[negative:][::-1]

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best vectors for the query."""
        terms = [(d, 1 if q[d] > 0 else -1) for d in np.flatnonzero(q)]
        lists = [self.postings[t] for t in terms]
        bounds = np.array([abs(int(q[d])) * abs(int(self.x[p[0], d])) if len(p) else 0 for (d, _), p in zip(terms, lists)], dtype=self.x.dtype)
        order = np.argsort(-bounds, kind="stable")
        found = self._exact(own, q, np.unique(np.concatenate([lists[i][: 2 * k] for i in order[:8]])) if len(order) else np.zeros(0, np.int64), k)
        tails = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        # Essential terms: the shortest head after which the rest of the bounds stays below the k-th score.
        floor = self._floor(found, k)
        essential = int(np.argmax(tails < floor)) if floor is not None and (tails < floor).any() else len(order)
        reached = np.zeros(len(self.ids), dtype=bool)
        partial = np.zeros(len(self.ids), dtype=self.x.dtype)
        for i in order[:essential]:
            d, _ = terms[i]
            partial[lists[i]] += q[d] * self.x[lists[i], d]
            reached[lists[i]] = True
        # With no bound yet, or one that a vector without any shared term may reach, all vectors are candidates.
        candidates = np.flatnonzero(reached) if floor is not None and tails[essential] < floor else np.arange(len(self.ids))
        for at in range(0, len(candidates), BLOCK):
            part = candidates[at : at + BLOCK]
            floor = self._floor(found, k)
            upper = partial[part]
            for j in range(essential, len(order)):
                if floor is not None:
                    alive = upper + tails[j] >= floor
                    part, upper = part[alive], upper[alive]
                d, sign = terms[order[j]]
                upper = upper + np.maximum(q[d] * self.x[part, d], 0)
            if floor is not None:
                part = part[upper >= floor]
            found = self._merged(found, self._exact(own, q, part, k), k)
        return found

    def _exact(self, own, q, places, k):
        places = places[self.ids[places] != own]
        scores = self.x[places] @ q
        if scores.dtype == object:
            scores = np.array([min(max(s, -HIGHEST), HIGHEST) for s in scores], dtype=np.int64)
        top = best(scores, self.ids[places], k)
        return self.ids[places[top]], scores[top]

    @staticmethod
    def _merged(a, b, k):
        ids, at = np.unique(np.concatenate([a[0], b[0]]), return_index=True)
        scores = np.concatenate([a[1], b[1]])[at]
        top = best(scores, ids, k)
        return ids[top], scores[top]

    @staticmethod
    def _floor(found, k):
        return int(found[1][-1]) if len(found[1]) == k and found[1][-1] > -HIGHEST else None


def search_shard(ids: np.ndarray, x: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores) of the best ``k`` of a shard for each query, or ``k`` of either kind of vector."""
    small, short = machine_sized(x), machine_sized(queries)
    parts = [(small, short, np.int64)] if small.all() and short.all() else [(small, short, np.int64), (~small, short, object), (np.ones(len(x), bool), ~short, object)]
    out = []
    for held, posed, kind in parts:
        if held.any() and posed.any():
            shard = Shard(ids[held], x[held].astype(kind))
            found = [(q, *shard.search(q, v, k)) for q, v in zip(own[posed].tolist(), queries[posed].astype(kind))]
            out += [(np.full(len(i), q, np.int64), i, s) for q, i, s in found]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, block_rows: int = 1024) -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` highest integer inner products of each query row.

    ``is_query`` is a condition on the column ``id``. Components are taken as floor(256 * x).
    """
    rows = usable(vectors, id_col, vector_col).select("id", "dim", F.transform("vec", lambda x: F.floor(x * 256).cast("long")).alias("vec"))
    total, asked = usable(vectors, id_col, vector_col).agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_rows))
    kept = rows.select("dim", bucket(F.col("id"), shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "vec")
    posed = rows.filter(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), bucket(F.col("id"), blocks).alias("block"), "id", "vec")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(key, left, right):
        dim = key[0].as_py()
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        found = search_shard(left.column("id").to_numpy(), matrix(left, "vec", dim), right.column("id").to_numpy(), matrix(right, "vec", dim), k)
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema) if found else schema.empty_table()

    keys = ("dim", "shard", "block")
    found = kept.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score long")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op5_maxscore(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    found = top_k(table(prepare(spark), sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
