"""Token counts that follow edits, without encoding a document anew.

Method: a document is cut into leaves of about ``LEAF`` characters at places where the tokenizer's own
pre-tokens begin whatever stands further off (see ``SURE``), so the counts of leaves add up. A segment tree holds
sums over the leaves. An edit touches the leaves it overlaps; these and one non-empty leaf of context on either side
are joined, edited, cut again and encoded; the sums on their paths to the root are renewed. The root is the document's
count. Where the leaves of a region have grown to twice their size they are split, and the tree is put together again
from the sums of its leaves, which encodes nothing.

Kept trees: :func:`trees` encodes a table once and returns each document with its leaves' lengths and counts, to be
written. :func:`edited` reads such rows and a batch of edits, encodes touched leaves only and returns the rows of the
next batch, in the same columns.

Scale: map-only, a document and its edits are one row. A batch encodes a few leaves per edit; besides that it reads and
writes texts and two numbers per leaf. A run of one kind of character (letters, digits) is one pre-token and so never cut,
however long it is.

Defined results: null text counts as empty; edits outside the text are moved to its nearest end; null or
negative lengths remove nothing and null insertions add nothing; edits apply in the given order, each to the text
as the ones before have left it; no edits or a null list change nothing; rows that share an id are counted each; an empty
table gives an empty result. :func:`trees` keeps further columns, but not those named like its own.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from docutally.llm.common import text_or_empty, written
from docutally.llm.packing import encoder

LEAF = 128
#: Letters that every version of the character tables knows as such.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Marks that are neither letters, digits nor spaces; without the apostrophe of contractions and the marks of the special token.
_MARK = r'!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~、。！？，；：「」『』（）'
#: Places where a pre-token begins: a space between a visible character and a letter, and changes between a letter and a
#: digit or from a letter to a mark.
SURE = re.compile(f"(?<=\\S)(?= [A-Za-z])|(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}])")
KEPT = ("leaf_chars", "leaf_tokens")
NUMBERS = ("n_edits", "tokens_before", "tokens_after", "chars_after", "chars_encoded")


def cuts(text: str, parts: int) -> list[str]:
    """``text`` in ``parts`` pieces of like length (some may be empty), cut where a pre-token surely begins."""
    out, at = [], 0
    for left in range(parts, 1, -1):
        found = SURE.search(text, at + max(1, (len(text) - at) // left))
        to = found.start() if found else len(text)
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


class CountTree:
    """Segment tree of token counts over the leaves of one document."""

    def __init__(self, text: str, count, kept: tuple[list[int], list[int]] | None = None):
        """A new tree, or the one whose leaves had ``kept`` lengths and token counts."""
        self.count, self.encoded = count, 0
        if kept and kept[0]:
            ends = list(itertools.accumulate(kept[0]))
            self.leaves = [text[end - n : end] for end, n in zip(ends, kept[0])]
            self._grow(kept[1])
        else:
            self.leaves = cuts(text, max(1, len(text) // LEAF))
            self._grow([count(leaf) for leaf in self.leaves])

    def _grow(self, tokens: list[int]) -> None:
        """All sums over leaves whose counts are known."""
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        pad = [0] * (self.size - len(self.leaves))
        self.tokens = [0] * self.size + tokens + pad
        self.chars = [0] * self.size + [len(leaf) for leaf in self.leaves] + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def kept(self) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the leaves; empty leaves are left out."""
        at = [self.size + i for i, leaf in enumerate(self.leaves) if leaf]
        return [self.chars[i] for i in at], [self.tokens[i] for i in at]

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and the position inside it."""
        i = 1
        while i < self.size:
            i *= 2
            if position >= self.chars[i] and self.chars[i + 1]:
                position -= self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), position

    def edit(self, position: int, removed: int, inserted: str) -> None:
        position = min(max(position or 0, 0), self.chars[1])
        removed = min(max(removed or 0, 0), self.chars[1] - position)
        first, inside = self.leaf_at(position)
        last, _ = self.leaf_at(position + removed)
        low, high = first - 1, last + 1
        while low > 0 and not self.leaves[low]:
            low -= 1
        while high < len(self.leaves) - 1 and not self.leaves[high]:
            high += 1
        low, high = max(low, 0), min(high, len(self.leaves) - 1)
        before = sum(len(leaf) for leaf in self.leaves[low:first]) + inside
        text = "".join(self.leaves[low : high + 1])
        text = text[:before] + (inserted or "") + text[before + removed :]
        self.encoded += len(text)
        parts = high - low + 1
        if len(text) > 2 * LEAF * parts and SURE.search(text, LEAF):
            fresh = [leaf for leaf in cuts(text, len(text) // LEAF) if leaf]
            known = self.tokens[self.size : self.size + len(self.leaves)]
            self.leaves[low : high + 1] = fresh
            self._grow(known[:low] + [self.count(leaf) for leaf in fresh] + known[high + 1 :])
            return
        self.leaves[low : high + 1] = cuts(text, parts)
        touched = set()
        for i in range(low, high + 1):
            self.tokens[self.size + i], self.chars[self.size + i] = self.count(self.leaves[i]), len(self.leaves[i])
            touched.add((self.size + i) // 2)
        while touched and 0 not in touched:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched}


def _counter():
    ids = encoder()
    return lambda text: len(ids(text)) if text else 0


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (null texts empty) with ``leaf_chars`` and ``leaf_tokens``, the leaves of each text's tree."""
    rows = docs.drop(*KEPT).withColumn(text_col, text_or_empty(text_col))
    schema = StructType([*rows.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in KEPT)])

    def build(batches):
        count = _counter()
        for batch in batches:
            kept = [CountTree(text, count).kept() for text in batch.column(text_col).to_pylist()]
            arrays = [pa.array([k[i] for k in kept], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *KEPT])

    return rows.mapInArrow(build, schema)


def edited(kept: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Rows (id_col, text_col, leaf_chars, leaf_tokens, n_edits, tokens_before, tokens_after, chars_after, chars_encoded).

    ``kept`` holds rows of :func:`trees` or of an earlier call, and in ``edits_col`` an array of (position, removed,
    inserted), in characters. The first four columns are what the next batch needs; ``chars_encoded`` is what the
    edits had encoded again.
    """
    kind = kept.schema[id_col].dataType.simpleString()
    names = ["_id", "_text", *KEPT, *NUMBERS]

    def run(batches):
        count = _counter()
        for batch in batches:
            rows = []
            for text, edits, chars, tokens in zip(*(batch.column(c).to_pylist() for c in ("_text", "_edits", *KEPT))):
                if edits:
                    tree = CountTree(text, count, (chars, tokens))
                    before = tree.total
                    for e in edits:
                        tree.edit(e["position"], e["removed"], e["inserted"])
                    rows.append(("".join(tree.leaves), *tree.kept(), len(edits), before, tree.total, tree.chars[1], tree.encoded))
                else:
                    rows.append((text, chars, tokens, 0, sum(tokens), sum(tokens), len(text), 0))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * len(NUMBERS)]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    rows = kept.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(edits_col).alias("_edits"), *KEPT)
    done = rows.mapInArrow(run, f"_id {kind}, _text string, {KEPT[0]} array<int>, {KEPT[1]} array<int>, " + ", ".join(f"{n} long" for n in NUMBERS))
    return done.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), *KEPT, *NUMBERS)


def count_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Rows (id_col, n_edits, tokens_before, tokens_after, chars_after, chars_encoded) of one batch on new documents.

    The trees are written first, as a later batch would find them.
    """
    kept = written(trees(docs.select(id_col, text_col, edits_col), id_col, text_col), "trees")
    return edited(kept, id_col, text_col, edits_col).select(id_col, *NUMBERS)


def op3_edit_counts(spark, sf_dir: str) -> DataFrame:
    """Three edits to each document: a cut, an exchange and an insertion at places drawn from its id."""
    from docutally.llm.common import prepare, table

    docs = table(prepare(spark), sf_dir, "documents")
    text = text_or_empty("text")

    def edit(k, removed, inserted):
        place = F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length(text) + 1).cast("int")
        return F.struct(place.alias("position"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    drawn = F.array(edit(1, 40, F.lit("")), edit(2, 7, F.lit(" revised, ")), edit(3, 0, F.substring(text, 1, 60)))
    return count_edits(docs.select("doc_id", "text", drawn.alias("edits")))
