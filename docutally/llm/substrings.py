"""Byte-level removal of long repeated strings by joins of fingerprints at sampled anchors.

A string of ``length`` bytes counts as repeated if it starts at two places of all texts, the same text
included. Every byte that such a string covers is removed.

Method: there is no suffix array: no sort of suffixes and no doubling of ranks, whose rows for all positions would
not fit the disk limit. Positions carry 64-bit content hashes (called ranks here) of strings of fixed lengths; Spark
joins them, drops those that are unique and goes on to the next length, up to the threshold. Equality of two
strings is always decided by two hashes together:

* Places are sampled first: each window of ``length`` bytes is represented by its anchor, the leftmost
  smallest ``GRAM``-byte hash inside. Equal windows have the same anchor at the same distance.
* Starts are ranked in blocks of ``BLOCK`` neighbours at equal distance from an anchor, by what all
  windows of the block share (*core*, about ``length - BLOCK`` bytes) and by all that they cover
  (*full*). Unique core: no window of the block is repeated. Repeated full: all are.
* Only blocks in between, where a repeat begins or ends, are taken apart, one copy of each; a start
  is then ranked by the pair (rank of its first half, rank of the half at offset ``length / 2``).

Scale: about one block row for 80 bytes of text, counted with map-side folding and joined back, so that
a string which stands in a third of all documents is split like any other join. Texts move twice,
compressed: to the blocks that are taken apart and to the final cut. Lists per document are bounded by
the document. Documents are told apart by a 64-bit hash of id and text.

Defined results: null text counts as empty; rows that repeat id and text are two documents (and so
repeat each other); null ids are kept; texts shorter than ``length`` are never cut; an empty table gives
an empty result; other columns are ignored unless asked for in ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docutally.llm import hashing as H
from docutally.llm.common import discard, packed, text_or_empty, unpacked, written

LENGTH = 400
GRAM = 64
BLOCK = 64


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int):
    """(text, core, full, first start, starts) of all blocks of one buffer; starts count from their text's begin."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    spans = H.Spans(data)
    at = np.arange(len(data) - gram + 1)
    anchor = H.window_minima(spans(at, at + gram), length - gram + 1)
    owner = H.text_of(offsets, len(data))
    start = np.flatnonzero(owner[: len(anchor)] == owner[length - 1 :])
    anchor = anchor[start]
    if not len(start):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[start[1:]] != owner[start[:-1]])])
    low, high, anchor = start[new], start[np.r_[new[1:], len(start)] - 1], anchor[new]
    first, last = (anchor - high) // block, (anchor - low) // block
    count = last - first + 1
    number = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor, text = np.repeat(anchor, count), np.repeat(owner[low], count)
    near, far = anchor - number * block, anchor - np.minimum((number + 1) * block - 1, length - gram)
    core = H.mix(spans(near, far + length) + number.astype(np.uint64))
    low, high = np.maximum(far, offsets[text]), np.minimum(near, offsets[text + 1] - length)
    full = H.mix(spans(low, high + length) + (anchor - low).astype(np.uint64))
    return text, core, full, low - offsets[text], high - low + 1


def repeated_ranges(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Rows (key, ranges): the byte ranges (low, high) that repeated strings cover, for documents that have any.

    ``key`` is xxhash64(id, text). Ranges may overlap.
    """
    texts = docs.select(F.xxhash64(id_col, text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("_text"))
    row = pa.schema([("key", pa.int64()), ("core", pa.int64()), ("full", pa.int64()), ("low", pa.int32()), ("n", pa.int32())])

    def blocks(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, last, data, offsets in H.buffers(batch.column("_text").to_pylist()):
                text, core, full, low, n = _blocks(data, offsets, length, gram, block)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first:last][text]), pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32))], schema=row)

    # Round 1: blocks whose core is unique drop out.
    ranked = written(texts.mapInArrow(blocks, "key long, core long, full long, low int, n int"), "ranks")
    # Written first, so that both sides of the join are plain shuffles and a core with very many rows is split.
    cores = written(ranked.groupBy("core").count().filter("count > 1").select("core"), "cores")
    shared = written(ranked.join(cores.hint("merge"), "core"), "ranks")
    discard(ranked, cores)
    # Round 2: blocks that are repeated as a whole are settled.
    classes = shared.groupBy("core", "full").agg(F.count("*").alias("copies"), F.min(F.struct("key", "low", "n")).alias("one"))
    classes = written(classes, "ranks")
    whole = shared.join(classes.filter("copies > 1").select("core", "full"), ["core", "full"]).select("key", "low", (F.col("low") + F.col("n") + (length - 1)).alias("high"))
    # Round 3: cores with several wholes; one block of each is taken apart.
    several = classes.groupBy("core").count().filter("count > 1").select("core")
    apart = classes.join(several, "core").select(F.col("one.key").alias("key"), F.struct(F.col("one.low").alias("low"), F.col("one.n").alias("n"), (F.col("copies") == 1).alias("open")).alias("block"))
    lists = apart.groupBy("key").agg(F.collect_set("block").alias("blocks"))
    half = length // 2
    pair = pa.schema([("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("low", pa.int32()), ("open", pa.bool_())])

    def starts(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, last, data, offsets in H.buffers(unpacked(batch.column("packed"))):
                text, todo = H.listed(batch.column("blocks"), first, last)
                low, n, open_ = (todo.field(f).to_numpy(zero_copy_only=False) for f in ("low", "n", "open"))
                low = low + offsets[text]
                at = np.flatnonzero(H.covered(low, low + n, len(data)))
                wanted = H.covered(low[open_], (low + n)[open_], len(data))[at]
                spans = H.Spans(data)
                left, right = spans(at, at + half), spans(at + half, at + length)
                text = H.text_of(offsets, len(data))[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys[first:last][text]), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array((at - offsets[text]).astype(np.int32)), pa.array(wanted)], schema=pair)

    pairs = written(packed(texts, "_text").join(lists, "key").mapInArrow(starts, "key long, left long, right long, low int, open boolean"), "ranks")
    # As with the cores: a start that very many documents share is split between tasks.
    again = written(pairs.groupBy("left", "right").count().filter("count > 1").select("left", "right"), "again")
    single = pairs.filter("open").join(again.hint("merge"), ["left", "right"]).select("key", "low", (F.col("low") + length).alias("high"))
    ranges = written(whole.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges")
    discard(shared, classes, pairs, again)
    return ranges


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep=(), with_text: bool = False, **sampling) -> DataFrame:
    """Rows (id_col, *keep, n_bytes, n_removed, n_spans, kept_sha256) and, on demand, the kept text.

    Texts that a cut leaves with half a character lose the rest of it in ``kept_text``, never in the digest.
    """
    ranges = repeated_ranges(docs, length, id_col, text_col, **sampling)
    rows = docs.select(F.xxhash64(id_col, text_or_empty(text_col)).alias("_key"), F.col(id_col).alias("_id"), F.struct(*keep).alias("_keep") if keep else F.lit(0).alias("_keep"), text_or_empty(text_col).alias("_text"))
    joined = packed(rows, "_text").join(ranges.withColumnRenamed("key", "_key"), "_key", "left").select("_id", "_keep", "packed", "ranges")
    schema = docs.select(F.col(id_col).alias("_id")).schema
    schema = schema.add("_keep", rows.schema["_keep"].dataType).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept_text", "string")

    def cut(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for first, last, data, offsets in H.buffers(unpacked(batch.column("packed"))):
                text, ranges_of = H.listed(batch.column("ranges"), first, last)
                low, high = (ranges_of.field(f).to_numpy() + offsets[text] for f in ("low", "high"))
                covered = H.covered(low, high, len(data))
                begins = covered.copy()
                begins[1:] &= ~covered[:-1]
                # A text that begins covered begins a run, whatever the one before ends with.
                head = offsets[:-1][offsets[:-1] < len(data)]
                begins[head] = covered[head]
                gone, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (covered, begins))
                kept, at = data[~covered].tobytes(), offsets - gone
                kept = [kept[a:b] for a, b in zip(at[:-1], at[1:])]
                rows = (np.diff(offsets), np.diff(gone), np.diff(runs), (hashlib.sha256(k).hexdigest() for k in kept), (k.decode("utf-8", "ignore") if with_text else None for k in kept))
                for column, values in zip(out, rows):
                    column.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_keep"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=[f.name for f in schema])

    done = joined.mapInArrow(cut, schema)
    texts = ["kept_text"] if with_text else []
    return done.select(F.col("_id").alias(id_col), *[F.col("_keep")[c].alias(c) for c in keep], "n_bytes", "n_removed", "n_spans", "kept_sha256", *texts)


def op4_suffix_array(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    return remove_repeats(table(prepare(spark), sf_dir, "documents"))


OP4_SQL = """
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
runs AS (SELECT rid, i, md5(array_slice(b, i, i + 399)) AS g FROM (SELECT *, unnest(range(1, greatest(octet_length(b) - 398, 1))) AS i FROM texts)),
again AS (SELECT g FROM runs GROUP BY g HAVING count(*) > 1),
marked AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM runs SEMI JOIN again USING (g)),
spans AS (
  SELECT rid, min(i) AS low, max(i) + 400 AS high FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS island FROM marked) GROUP BY rid, island),
sums AS (SELECT rid, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
kept AS (
  SELECT rid, string_agg(hex(array_slice(b, low, high - 1)), '' ORDER BY low) AS h FROM (
    SELECT rid, coalesce(lag(high) OVER (PARTITION BY rid ORDER BY low), 1) AS low, low AS high FROM spans
    UNION ALL SELECT rid, max(high), 9000000000000 FROM spans GROUP BY rid) JOIN texts USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM texts LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""
