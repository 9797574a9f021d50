"""Word-level removal of repeated passages by joins of path hashes at three depths of a suffix tree.

A window is ``length`` consecutive words of one document. Every word covered by a window whose words
also start in a document with a smaller id is removed, so the first document keeps the passage.

Method: the suffixes of all documents are split into groups by the words they begin with; a group is
the subtree below that prefix. Prefixes grow only where suffixes still share them: first the
``PREFIX`` words at sampled places, then nodes two levels down. A node is a row keyed by
the hash of its path and holds the smallest document id below it; Spark partitions nodes by
path, so a group never has to fit one task, and a passage that stands in a third of all documents is one node folded on
the map side. The depths are fixed (``PREFIX``, a block's core, its full words and ``length``), whatever a group's size; no tree is
built and no node deeper than a block's full words, since whether a window repeats is settled at ``length``.

* Sampled places: each window is represented by its anchor, the leftmost smallest ``PREFIX``-word hash
  inside. Groups with a single suffix are leaves and drop out.
* Starts at equal distance from an anchor are taken in blocks of ``BLOCK``. The *core* node is what all windows
  of a block share, the *full* node below it all that they cover. A full node with a smaller
  document settles the block; a core node without one drops it.
* Only starts of blocks in between are followed to their own node at depth ``length``.

Two 64-bit path hashes decide about equality at every level.

Scale: about one row for five words in the first round, counted with map-side folding and joined back;
later rounds have the repeated part only. Texts move compressed, to lists bounded by the document.

Defined results: null text counts as no words; a null id counts as larger than any other; rows that share
an id never remove each other's words; texts of fewer than ``length`` words are never cut; an empty
table gives an empty result; other columns are ignored unless asked for in ``keep``.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docutally.llm import hashing as H
from docutally.llm.common import discard, packed, text_or_empty, unpacked, written

LENGTH = 13
PREFIX = 4
BLOCK = 5
#: Stands for a null id.
LAST = (1 << 63) - 1


def _anchors(grams: np.ndarray, owner: np.ndarray, length: int, prefix: int):
    """(anchor, first start, last start) for the runs of windows with one anchor, over the words of one buffer."""
    none = np.zeros(0, np.int64)
    if len(owner) < length:
        return none, none, none
    anchor = H.window_minima(grams, length - prefix + 1)
    start = np.flatnonzero(owner[: len(anchor)] == owner[length - 1 :])
    if not len(start):
        return none, none, none
    anchor = anchor[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[start[1:]] != owner[start[:-1]])])
    return anchor[new], start[new], start[np.r_[new[1:], len(start)] - 1]


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """Rows (key, ranges): word ranges (low, high) to remove, for documents that have any.

    ``key`` is xxhash64(id, text). Ranges may overlap.
    """
    text = text_or_empty(text_col)
    texts = docs.select(F.xxhash64(id_col, text).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text.alias("_text"))
    # Distances from an anchor are at most length - prefix; a multiple of 256 keeps them apart at any length.
    wide = 256 * -(-(length - prefix + 1) // 256)
    suffix = pa.schema([("path", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])

    def suffixes(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, last, data, offsets in H.buffers(batch.column("_text").to_pylist()):
                starts, ends, first_word = H.words(data, offsets)
                owner = H.text_of(first_word, len(starts))
                grams = H.sequences(H.Spans(data)(starts, ends), prefix)
                anchor, low, high = _anchors(grams, owner, length, prefix)
                text = owner[anchor]
                # Anchor and the distances of its first and last start, in one number.
                place = ((anchor - first_word[text]) * wide + (anchor - low)) * wide + (anchor - high)
                yield pa.RecordBatch.from_arrays([pa.array(grams[anchor].view(np.int64)), pa.array(keys[first:last][text]), pa.array(place)], schema=suffix)

    sampled = written(texts.select("key", "_text").mapInArrow(suffixes, "path long, key long, place long"), "suffixes")
    # Written first, so that both sides of the join are plain shuffles and a prefix with very many suffixes is split.
    groups = written(sampled.groupBy("path").count().filter("count > 1").select("path"), "groups")
    lists = sampled.join(groups.hint("merge"), "path").groupBy("key").agg(F.collect_set("place").alias("places"))
    carried = packed(texts, "_text")
    node = pa.schema([("core", pa.int64()), ("full", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("n", pa.int32())])

    def blocks(batches):
        for batch in batches:
            keys, docs_of = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            for begin, end, data, offsets in H.buffers(unpacked(batch.column("packed"))):
                text, place = H.listed(batch.column("places"), begin, end)
                place = place.to_numpy()
                starts, ends, first_word = H.words(data, offsets)
                sums = Sequences(H.Spans(data)(starts, ends))
                anchor, far, near = place // wide**2 + first_word[text], place // wide % wide, place % wide
                first, last = near // block, far // block
                count = last - first + 1
                number = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                anchor, text = np.repeat(anchor, count), np.repeat(text, count)
                near, far = anchor - number * block, anchor - np.minimum((number + 1) * block - 1, length - prefix)
                core = H.mix(sums(near, far + length) + number.astype(np.uint64))
                low, high = np.maximum(far, first_word[text]), np.minimum(near, first_word[text + 1] - length)
                full = H.mix(sums(low, high + length) + (anchor - low).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(keys[begin:end][text]), pa.array(docs_of[begin:end][text]), pa.array((low - first_word[text]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32))],
                    schema=node,
                )

    shared = written(carried.join(lists, "key").mapInArrow(blocks, "core long, full long, key long, doc long, low int, n int"), "nodes")
    discard(sampled, groups)
    deep = shared.groupBy("core", "full").agg(F.min("doc").alias("deep_first"))
    cores = shared.groupBy("core").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("core", "first")
    placed = written(shared.join(cores, "core").join(deep, ["core", "full"]), "nodes")
    discard(shared)
    whole = placed.filter("deep_first < doc").select("key", "low", (F.col("low") + F.col("n") + (length - 1)).alias("high"))
    # One that is first below its full node may still share single windows with a smaller document.
    apart = placed.filter("deep_first = doc").select("key", F.struct("low", "n", (F.col("first") < F.col("doc")).alias("open")).alias("block"))
    apart = apart.groupBy("key").agg(F.collect_set("block").alias("blocks"))
    window = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("open", pa.bool_())])

    def windows(batches):
        for batch in batches:
            keys, docs_of = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            for begin, end, data, offsets in H.buffers(unpacked(batch.column("packed"))):
                text, todo = H.listed(batch.column("blocks"), begin, end)
                low, n, open_ = (todo.field(f).to_numpy(zero_copy_only=False) for f in ("low", "n", "open"))
                starts, ends, first_word = H.words(data, offsets)
                sums = Sequences(H.Spans(data)(starts, ends))
                low = low + first_word[text]
                at = np.flatnonzero(H.covered(low, low + n, len(starts)))
                wanted = H.covered(low[open_], (low + n)[open_], len(starts))[at]
                text = H.text_of(first_word, len(starts))[at]
                half = length // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums(at, at + half).view(np.int64)), pa.array(sums(at + half, at + length).view(np.int64)), pa.array(keys[begin:end][text]), pa.array(docs_of[begin:end][text]), pa.array((at - first_word[text]).astype(np.int32)), pa.array(wanted)],
                    schema=window,
                )

    single = written(carried.join(apart, "key").mapInArrow(windows, "left long, right long, key long, doc long, low int, open boolean"), "nodes")
    firsts = single.groupBy("left", "right").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("left", "right", "first")
    ends = single.filter("open").join(firsts, ["left", "right"]).filter("first < doc").select("key", "low", (F.col("low") + length).alias("high"))
    ranges = written(whole.unionByName(ends).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges")
    discard(placed, single)
    return ranges


class Sequences:
    """Hashes of runs of word hashes, any length from two reads."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * H._power("up", len(words)), out=self.sums[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return H.mix((self.sums[high] - self.sums[low]) * H._power("down", len(self.sums))[low] + (high - low).astype(np.uint64))


def remove_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **sampling) -> DataFrame:
    """Rows (id_col, n_words, n_removed, kept_sha256) and, on demand, the kept words joined by one space."""
    ranges = repeated_windows(docs, length, id_col, text_col, **sampling)
    rows = docs.select(F.xxhash64(id_col, text_or_empty(text_col)).alias("_key"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    joined = packed(rows, "_text").join(ranges.withColumnRenamed("key", "_key"), "_key", "left").select("_id", "packed", "ranges")
    schema = docs.select(F.col(id_col).alias("_id")).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            raws = unpacked(batch.column("packed"))
            for begin, end, _, _ in H.buffers(raws):
                words = [raw.split() for raw in raws[begin:end]]
                first_word = np.cumsum([0, *map(len, words)])
                text, todo = H.listed(batch.column("ranges"), begin, end)
                low, high = (todo.field(f).to_numpy() + first_word[text] for f in ("low", "high"))
                covered = H.covered(low, high, first_word[-1])
                gone, stays = np.diff(np.concatenate([[0], np.cumsum(covered)])[first_word]), (~covered).tobytes()
                kept = [b" ".join(compress(w, stays[a : a + len(w)]) if g else w) for w, a, g in zip(words, first_word, gone)]
                rows = (np.diff(first_word), gone, (hashlib.sha256(k).hexdigest() for k in kept), (k.decode("utf-8", "replace") if with_text else None for k in kept))
                for column, values in zip(out, rows):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[f.name for f in schema])

    done = joined.mapInArrow(cut, schema)
    return done.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    return remove_passages(table(prepare(spark), sf_dir, "documents"))


OP10_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS rank, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT rid, rank, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM texts)),
earliest AS (SELECT g, min(rank) AS least FROM runs GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM runs JOIN earliest USING (g) WHERE least < rank),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
