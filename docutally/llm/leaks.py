"""Benchmark decontamination by a broadcast set of word n-grams, in DataFrame functions only.

Method: a window is a run of ``length`` normalised words of a benchmark item (an item of fewer words is one window). The distinct windows are
a hash set that is broadcast. Each document's word runs, of the lengths that occur, are looked up in it by a broadcast hash join on the run itself,
so that a hit of the hash is verified on the words. Documents keep the word spans that windows cover and the items they come
from; :func:`remove_leaks` cuts the spans or drops the documents.

Scale: documents are read once and texts are not shuffled. Runs are made and looked up within one stage, ``PART_WORDS`` words of a document at a time; only hits
leave it, and one row per document. The set is broadcast in blocks of at most ``BLOCK_BYTES`` (measured): a benchmark of up to one
block needs one pass over the documents, a larger one a pass per block. A window that many items share is one row of the set; its items are joined once per
document, after hits are folded.

Defined results: null texts have no words; A-Z count as a-z; rows that share an id are judged each on its own text, repeated rows each alike; a
null document id is a value like any other; items that repeat an id count once; an item with a null id marks its words but is not listed;
an empty table of documents gives an empty result, an empty benchmark leaves every document clean. Other columns are
carried only where ``keep`` names them, whatever their names.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally.llm.common import text_or_empty, written

LENGTH = 10
#: Runs of these characters are words: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: So many words of a document begin the runs that are made at a time.
PART_WORDS = 2048
#: Largest block of the window set that is broadcast, by its own measure (text and 100 bytes a row).
BLOCK_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The normalised words of a text in order."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _runs(of: Column, length, starts: Column) -> Column:
    """The first ``starts`` runs of ``length`` consecutive words, as texts."""
    numbers = F.sequence(F.lit(1), starts)
    return F.when(starts >= 1, F.transform(numbers, lambda i: F.array_join(F.slice(of, i, length), " "))).otherwise(F.array().cast("array<string>"))


def window_set(items: DataFrame, length: int = LENGTH, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows: gram_id, n, gram; owners: gram_id, item), both written once.

    The windows include the empty one, of no words, which every document holds; it has no owner.
    """
    own = items.select(F.col(item_col).cast("string").alias("item"), words(text_or_empty(text_col)).alias("w"))
    own = own.withColumn("n", F.least(F.size("w"), F.lit(length))).where("n > 0")
    runs = own.select("item", "n", F.explode_outer(_runs(F.col("w"), F.col("n"), F.size("w") - F.col("n") + 1)).alias("gram"))
    runs = written(runs.distinct(), "item-windows")
    empty = items.sparkSession.createDataFrame([(0, "")], "n int, gram string")
    grams = empty.unionByName(runs.select("n", "gram").distinct())
    windows = written(grams.select(F.monotonically_increasing_id().alias("gram_id"), "n", "gram"), "window-set")
    owners = runs.join(windows.select("gram_id", "gram"), "gram").select("gram_id", "item").where(F.col("item").isNotNull())
    return windows, written(owners, "window-owners")


def _hits(rows: DataFrame, windows: DataFrame, lengths: list[int], length: int, part_words: int) -> DataFrame:
    """Rows (_row, _id, n_words, at, n, gram_id): places of the windows, from word 1; the empty window once per row."""
    rows = rows.select("_row", "_id", words(F.col("_text")).alias("_words"))
    last = F.greatest(F.ceil(F.size("_words") / part_words).cast("int") - 1, F.lit(0))
    part = lambda p: F.struct(p.alias("_part"), F.slice("_words", p * part_words + 1, part_words + length - 1).alias("_held"))
    rows = rows.select("_row", "_id", F.size("_words").alias("n_words"), F.transform(F.sequence(F.lit(0), last), part).alias("_parts"))
    # Outer, since a plain generator would copy its whole argument into a filter below.
    rows = rows.select("_row", "_id", "n_words", F.inline_outer("_parts"))
    held = F.col("_held")
    count = {k: F.greatest(F.least(F.size(held) - (k - 1), F.lit(part_words)), F.lit(0)) for k in lengths}
    empty = F.when(F.col("_part") == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    grams = F.concat(empty, *[_runs(held, k, count[k]) for k in lengths])
    starts = F.struct(F.size(empty), *[count[k] for k in lengths])
    rows = rows.select("_row", "_id", "n_words", "_part", starts.alias("_starts"), grams.alias("_grams"))
    each = rows.select("_row", "_id", "n_words", "_part", "_starts", F.posexplode_outer("_grams").alias("_pos", "gram"))
    met = each.join(F.broadcast(windows), "gram")
    # A window of n words stands behind the empty one and all longer runs in its list.
    before = F.lit(0)
    at = F.when(F.col("n") == 0, 0)
    for i, k in enumerate(lengths):
        before = before + F.col("_starts")[f"col{i + 1}"]
        at = at.when(F.col("n") == k, F.col("_part") * part_words + F.col("_pos") + 1 - before)
    return met.select("_row", "_id", "n_words", at.alias("at"), "n", "gram_id")


def _covered(places: Column) -> Column:
    """Numbers (from 1, ascending) of the words that places (at, n) cover."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1)))))


def _as_runs(covered: str) -> Column:
    """Maximal runs (start, stop) of ascending numbers, counted from 0."""
    c = F.col(covered)
    first = F.filter(c, lambda p, i: (i == 0) | (F.get(c, i - 1) != p - 1))
    last = F.filter(c, lambda p, i: (i == F.size(c) - 1) | (F.get(c, i + 1) != p + 1))
    return F.zip_with(first, last, lambda a, b: F.struct((a - 1).alias("start"), b.alias("stop")))


def find_leaks(docs: DataFrame, items: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep=(), block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """Rows (id_col, *keep, n_words, spans, items): covered word spans and the ids (as sorted strings) of items with occurring windows."""
    others = [c for c in keep if c not in (id_col, "n_words", "spans", "items")]
    windows, owners = window_set(items, length, item_col, item_text)
    size = windows.agg(F.sum(F.octet_length("gram") + 100).alias("bytes"), F.collect_set("n").alias("lengths")).first()
    lengths = sorted((k for k in size["lengths"] if k), reverse=True)  # at most ``length`` numbers
    blocks = max(1, math.ceil(size["bytes"] / block_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *([F.struct(*others).alias("_keep")] if others else []))
    if blocks > 1 or others:
        rows = written(rows, "leak-rows")  # read several times, with the same numbers
    block = F.when(F.col("n") == 0, 0).otherwise(F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    parts = [windows if blocks == 1 else windows.where(block == b) for b in range(blocks)]
    hits = reduce(DataFrame.unionAll, [_hits(rows, part, lengths, length, part_words) for part in parts])
    real = F.col("n") > 0
    folded = hits.groupBy("_row").agg(
        F.first("_id").alias("_id"),
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(real, F.struct("at", "n"))).alias("_places"),
        F.collect_set(F.when(real, F.col("gram_id"))).alias("_grams"),
    )
    folded = folded.select("_row", "_id", "n_words", "_grams", _covered(F.col("_places")).alias("_covered"))
    folded = written(folded.select("_row", "_id", "n_words", "_grams", _as_runs("_covered").alias("spans")), "leak-hits")
    owned = folded.select("_row", F.explode("_grams").alias("gram_id")).join(owners, "gram_id").select("_row", "item").distinct()
    lists = owned.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = folded.join(lists, "_row", "left")
    if others:
        out = out.join(rows.select("_row", "_keep"), "_row")
    none = F.array().cast("array<string>")
    return out.select(F.col("_id").alias(id_col), *[F.col("_keep")[c].alias(c) for c in others], "n_words", "spans", F.coalesce("items", none).alias("items"))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands between them; what stands around a span stays."""
    gaps = F.split(text, ANY_CASE_WORD, -1)
    found = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    tokens = F.flatten(F.zip_with(gaps, found, lambda g, w: F.array(g, F.coalesce(w, F.lit("")))))

    def piece(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["stop"])
        stop = F.coalesce(F.get(spans, k)["start"], F.size(found))
        return F.array_join(F.slice(tokens, 2 * start + 1, 2 * (stop - start) + 1), "")

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), ""))


def remove_leaks(docs: DataFrame, items: DataFrame, drop_documents: bool = False, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` without leaked spans, or without documents that hold any. Columns stay as they are; null texts stay null."""
    taken = {c.lower() for c in docs.columns}
    whole = next(c for c in (f"_whole{i}" for i in range(len(taken) + 1)) if c not in taken)
    found = find_leaks(docs.withColumn(whole, F.struct(*docs.columns)), items, length, id_col, text_col, item_col, item_text, [whole], block_bytes, part_words)
    if drop_documents:
        return found.where(F.size("spans") == 0).select(*[F.col(whole)[c].alias(c) for c in docs.columns])
    cut = without_spans(F.col(whole)[text_col], F.col("spans"))
    return found.select(*[(cut if c == text_col else F.col(whole)[c]).alias(c) for c in docs.columns])


def op12_leaks(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    prepare(spark)
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP12_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
runs AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM texts CROSS JOIN (SELECT DISTINCT n FROM grams))),
hits AS (SELECT rid, i, n, item FROM runs JOIN grams USING (n, gram)),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS place FROM hits) GROUP BY rid),
listed AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""
