"""Packing of documents into training sequences, neighbours found by a sharded BM25 index.

Method: documents are tokenised and closed by ``END``. Whole windows are cut off their front; what is left, the
tail, is shorter than a window. Tails are dealt into shards of about ``SHARD`` documents; similar texts meet in one shard
(smallest hash of their token pairs), and a shard that a group of copies would swell is split. Each shard
has an inverted index with BM25 weights by the whole corpus's document frequencies and mean length. Seeds are taken
longest first and looked up with all their terms, in their own shard only; the index returns their unused
neighbours, which fill the window greedily. The first that does not fit is cut at a multiple of ``CUT``
tokens, and its rest starts the next window, so every tail is cut once at most and padding stays
below ``CUT`` tokens a window.

Tokens are those of the tokenizer file; the same vocabulary's rank file is used to encode, which is several
times as fast (the tests compare both).

Scale: one pass over the texts, which leave the task as checksums and term counts (1-2 KB a document); one shuffle into
shards of bounded size. Global are two counts, a mean and one frequency for each entry of the vocabulary.

Defined results: null text counts as empty, that is one ``END``; rows that share an id are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docutally.llm import hashing as H
from docutally.llm.common import text_or_empty, worker_cache, written

WINDOW = 2048
CUT = 128
SHARD = 2048
END = 1
#: BM25's two constants.
K1, B = 1.2, 0.75


def encoder(vocabulary: str = "byte_bpe_50k.tiktoken", special: str = "<|endoftext|>"):
    """text -> ids (uint32), the ids of the tokenizer file with the same vocabulary; loaded once a worker."""
    have = worker_cache().get(vocabulary)
    if have is None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
        have = worker_cache()[vocabulary] = lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    return have


def tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut: int = CUT) -> DataFrame:
    """One row per document: checksums of its whole windows, and its tail's length, checksums and terms.

    ``heads[i]`` and ``rests[i]`` are the checksums of the tail's first ``i * cut`` tokens and of the others.
    """
    out = pa.schema([("tokens", pa.int64()), ("wholes", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("likeness", pa.int64())])

    def encode(batches):
        ids_of = encoder()
        for batch in batches:
            rows = {name: [] for name in out.names}
            for text in batch.column("_text").to_pylist():
                ids = np.append(ids_of(text), np.uint32(END)).astype("<u4")
                whole = len(ids) // window
                tail = ids[whole * window :]
                raw = tail.tobytes()
                steps = range(0, len(raw) + 1, 4 * cut)
                heads, crc = [0], 0
                for at in steps[:-1]:
                    crc = zlib.crc32(raw[at : at + 4 * cut], crc)
                    heads.append(crc)
                terms, counts = np.unique(tail, return_counts=True)
                pairs = ids[:-1].astype(np.uint64) * np.uint64(1 << 32) + ids[1:].astype(np.uint64)
                rows["tokens"].append(len(ids))
                rows["wholes"].append([zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(whole)])
                rows["heads"].append(heads)
                rows["rests"].append([zlib.crc32(raw[at:]) for at in steps])
                rows["terms"].append(terms.astype("<u4").tobytes())
                rows["counts"].append(counts.astype("<u4").tobytes())
                rows["likeness"].append(int((H.mix(pairs).min() if len(pairs) else np.uint64(0)) >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(rows[f.name], f.type) for f in out)], names=["doc", *out.names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, tokens long, wholes array<long>, heads array<long>, rests array<long>, terms binary, counts binary, likeness long"
    return docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("_text")).mapInArrow(encode, schema)


@dataclass(frozen=True)
class Corpus:
    """Tails of the whole corpus: how many, their mean length, and how many hold each term (by term)."""

    n: int
    mean: float
    df: np.ndarray


class Index:
    """BM25 postings over the tails of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, corpus: Corpus | None = None):
        self.n = len(terms)
        every = np.concatenate(terms) if terms else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        tf = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        order = np.argsort(every, kind="stable")
        self.terms, first, self.df = np.unique(every[order], return_index=True, return_counts=True)
        self.bounds = np.append(first, len(every))
        n, df = (corpus.n, corpus.df[self.terms]) if corpus else (self.n, self.df)
        mean = corpus.mean if corpus else lengths.mean() if self.n else 0
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(mean, 1))
        self.docs = doc[order]
        self.weights = np.repeat(idf, self.df) * tf[order] * (K1 + 1) / (tf[order] + norm[self.docs])
        self.own = terms
        # Terms of many tails are kept as rows, which add up faster than postings.
        common = np.flatnonzero(self.df > max(16, self.n // 8))
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        for i, t in enumerate(common):
            part = slice(self.bounds[t], self.bounds[t + 1])
            self.rows[i, self.docs[part]] = self.weights[part]

    def neighbours(self, seed: int) -> np.ndarray:
        """Tails that share a term with the seed, best first by all its terms; ties to the earlier one."""
        at = np.searchsorted(self.terms, self.own[seed])
        row = self.row[at]
        score = self.rows[row[row >= 0]].sum(axis=0)
        at = at[(row < 0) & (self.df[at] > 1)]
        n = self.df[at]
        postings = np.repeat(self.bounds[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score += np.bincount(self.docs[postings], self.weights[postings], self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def corpus_of(drawn: DataFrame, window: int) -> Corpus:
    """What BM25 needs of all tails; at most one row for each entry of the vocabulary comes to the driver."""

    def count(batches):
        for batch in batches:
            terms = [np.frombuffer(t, "<u4") for t in batch.column("terms").to_pylist()]
            term, df = np.unique(np.concatenate([*terms, np.zeros(0, "<u4")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df)], names=["term", "df"])

    n, mean = drawn.agg(F.count("*"), F.coalesce(F.avg(F.col("tokens") % window), F.lit(0.0))).first()
    got = drawn.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = (got.column(c).to_numpy() for c in ("term", "df"))
    every = np.zeros(term.max() + 1 if len(term) else 0, np.int64)
    every[term] = df
    return Corpus(n, mean, every)


def fill(lengths: np.ndarray, neighbours, window: int, cut: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, first cut, last cut); last cut -1 is the tail's end.

    ``neighbours(seed)`` returns tails in the order in which they may join the seed's window; after
    them any unused tail may, the longest first.
    """
    unused = lengths > 0
    order = np.argsort(-lengths, kind="stable")
    windows, rest, at = [], None, 0
    while True:
        if rest is None:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                return windows
            seed = int(order[at])
            unused[seed] = False
            now, room = [(seed, 0, -1)], window - int(lengths[seed])
        else:
            seed, first = rest
            now, room, rest = [(seed, first, -1)], window - int(lengths[seed]) + first * cut, None
        queue = neighbours(seed) if room else order[:0]
        queue = queue[unused[queue]]
        for stage in (queue, order[at:]):
            for tail in stage:
                if room < 1 or rest is not None:
                    break
                if not unused[tail]:
                    continue
                n = int(lengths[tail])
                if n <= room:
                    now.append((int(tail), 0, -1))
                    room -= n
                elif room >= cut:
                    now.append((int(tail), 0, room // cut))
                    rest = (int(tail), room // cut)
                    room -= room // cut * cut
                else:
                    continue
                unused[tail] = False
            if room < cut:
                # What is left can only take a very short tail; the longest-first list is not walked for it.
                break
        windows.append(now)


def numbered(sizes: DataFrame, span: int = 4096) -> DataFrame:
    """``sizes`` (bucket, parts) with ``first``, the number of parts of all buckets before.

    Sums of ``span`` buckets each are added up in one task, and within a span by itself.
    """
    spans = sizes.groupBy(F.floor(F.col("bucket") / span).alias("span")).agg(F.sum("parts").alias("all"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sizes.withColumn("span", F.floor(F.col("bucket") / span)).join(spans, "span")
    return dealt.withColumn("first", F.col("start") + F.coalesce(F.sum("parts").over(within), F.lit(0))).drop("span", "start")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut: int = CUT, shard: int = SHARD) -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece."""
    drawn = written(tails(docs, id_col, text_col, window, cut), "tails")
    corpus = corpus_of(drawn, window)
    buckets = max(1, -(-corpus.n // shard))
    # Numbers of rows depend on the files of the written table only; with them repeated rows spread as well.
    dealt = drawn.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod("likeness", F.lit(buckets)))
    sizes = numbered(dealt.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / shard).alias("parts")))
    dealt = dealt.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("doc", "tokens", "row"), "parts"))
    dealt = dealt.withColumn("group", F.col("first") + F.col("part"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = docs.select(F.col(id_col).alias("doc")).schema
    for name in names:
        schema = schema.add(name, "long")

    def place(key, table):
        table = table.sort_by([("doc", "ascending"), ("tokens", "ascending"), ("likeness", "ascending")])
        tokens = table.column("tokens").to_numpy()
        lengths = tokens % window
        terms = [np.frombuffer(t, "<u4") for t in table.column("terms").to_pylist()]
        counts = [np.frombuffer(t, "<u4") for t in table.column("counts").to_pylist()]
        heads, rests, wholes = (table.column(c).to_pylist() for c in ("heads", "rests", "wholes"))
        base, sequence, rows = key[0].as_py() << 23, 0, []
        for i, crcs in enumerate(wholes):
            for j, crc in enumerate(crcs):
                rows.append((i, j * window, window, crc, base + sequence, 0))
                sequence += 1
        for pieces in fill(lengths, Index(terms, counts, lengths, corpus).neighbours, window, cut):
            offset = 0
            for i, first, last in pieces:
                start = int(tokens[i] - lengths[i]) + first * cut
                length = (int(lengths[i]) if last < 0 else last * cut) - first * cut
                rows.append((i, start, length, rests[i][first] if last < 0 else heads[i][last], base + sequence, offset))
                offset += length
            sequence += 1
        i, start, length, crc, sequences, offset = (np.array(c, np.int64) for c in zip(*rows))
        return pa.table([table.column("doc").take(pa.array(i)), *(pa.array(c) for c in (start, length, crc, tokens[i], sequences, offset))], names=["doc", *names])

    done = dealt.drop("bucket", "part", "parts", "first", "row").groupBy("group").applyInArrow(place, schema)
    return done.select(F.col("doc").alias(id_col), *names)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    return pack(table(prepare(spark), sf_dir, "documents"))
