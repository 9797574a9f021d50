"""Fill-in-the-middle examples: a text is cut at unit borders and its parts are put in another order.

Units are runs of ASCII letters and single other code points. Method (SWAR, eight bytes a step): the UTF-8 bytes of
an Arrow batch are viewed as 64-bit words. The bytes that end a unit are marked by arithmetic on whole words (a byte
ends a unit unless it and its successor are letters, or its successor continues a code point). ``bitwise_count`` gives
the marks per word and a running sum of them. A unit's end is found by searching the running sum for its word and by
adding up the eight lanes of that word (a multiplication) to select inside it. Units are never listed.

Scale: map-only, one pass over the texts, no shuffle. Memory is a few times one Arrow batch. What a row becomes depends on its id and text alone, so a
lost task gives the same rows again.

Defined results: null text counts as empty and stays plain (output is the empty text); a text that contains a mark stays
plain; a null id counts as an id without digits; rows that repeat are each rearranged, alike; an empty table gives an empty result; other columns
are taken along only where ``keep`` names them, whatever their names (names of the result win).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally.llm.common import text_or_empty

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are rearranged, and of a hundred rearranged ones so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20

_LANES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)


def _lanes(byte: int) -> np.uint64:
    return np.uint64(int(_LANES) * byte)


def letters(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that is an ASCII letter."""
    low = (words | _lanes(0x20)) & ~_HIGH
    # No lane carries: each is at most 0x7F before the sum.
    return (low + _lanes(0x80 - ord("a"))) & ~(low + _lanes(0x80 - ord("z") - 1)) & ~words & _HIGH


def continuations(words: np.ndarray) -> np.ndarray:
    """High bit of every byte 10xxxxxx."""
    return words & ~(words << np.uint64(1)) & _HIGH


def _successor(marks: np.ndarray) -> np.ndarray:
    """At each byte the mark of the byte after it (the first byte is the lowest lane)."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


class Units:
    """Rank and select over the unit ends of texts that lie end to end; ``offsets`` has their borders."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.stops = offsets[:-1], offsets[1:]
        words = np.zeros(len(data) // 8 + 1, dtype="<u8")
        words.view(np.uint8)[: len(data)] = data
        letter = letters(words)
        self.ends = ~((letter & _successor(letter)) | _successor(continuations(words))) & _HIGH
        # The next text does not prolong the last unit of this one.
        last = self.stops[self.stops > self.starts] - 1
        np.bitwise_or.at(self.ends, last >> 3, np.uint64(0x80) << (last & 7).astype(np.uint64) * np.uint64(8))
        self.sums = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.sums[1:])
        self.first = self.rank(self.starts)
        self.counts = self.rank(self.stops) - self.first

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Unit ends before each byte position."""
        word = at >> 3
        below = (np.uint64(1) << (at & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        return self.sums[word] + np.bitwise_count(self.ends[word] & below)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Bytes that the first ``units`` units of each text take."""
        wanted = self.first + units
        word = np.maximum(np.searchsorted(self.sums, wanted, side="left") - 1, 0)
        inside = (wanted - self.sums[word]).astype(np.uint64)
        running = (self.ends[word] >> np.uint64(7)) * _LANES
        reached = ((running | _HIGH) - inside * _LANES) & _HIGH
        at = word * 8 + 9 - np.bitwise_count(reached)
        return np.where(units > 0, at - self.starts, 0)


def _string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string column without nulls."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut_batch(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    units = Units(*_string_bytes(text))
    a, b = (np.asarray(h.to_numpy(zero_copy_only=False), dtype=np.int64) % (units.counts + 1) for h in (one, two))
    return pa.StructArray.from_arrays([pa.array(units.counts), pa.array(units.cut(np.minimum(a, b))), pa.array(units.cut(np.maximum(a, b)))], names=["n", "first", "second"])


def rearrange(docs: DataFrame, salt: str = "1", rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, marks=MARKS, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Rows (id_col, *keep, n, form, prefix, middle, suffix, output): units, form (plain, psm or spm), parts (null if plain) and example.

    Cuts and form follow from the SHA-256 of ``salt:id``, so they are the same in every run.
    """
    cut = F.arrow_udf(_cut_batch, "n bigint, first bigint, second bigint")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    others = [c for c in keep if c not in (id_col, "n", "form", "prefix", "middle", "suffix", "output")]
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*others).alias("_keep") if others else F.lit(None).alias("_keep"), text_or_empty(text_col).alias("_text"), digest.alias("_digest"))
    rows = rows.withColumn("_cut", cut(F.col("_text"), draws[0], draws[1]))
    text = F.col("_text")
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (draws[2] % 100 >= rearranged), "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("_form", form)
    raw = text.cast("binary")

    def part(start: Column, stop: Column | None) -> Column:
        length = F.lit(2**31 - 1) if stop is None else (stop - start).cast("int")
        return F.when(F.col("_form") != "plain", F.substring(raw, (start + 1).cast("int"), length).cast("string"))

    first, second = F.col("_cut.first"), F.col("_cut.second")
    rows = rows.withColumns({"_prefix": part(F.lit(0).cast("bigint"), first), "_middle": part(first, second), "_suffix": part(second, None)})
    psm = F.concat(F.lit(marks[0]), "_prefix", F.lit(marks[1]), "_suffix", F.lit(marks[2]), "_middle")
    spm = F.concat(F.lit(marks[1]), "_suffix", F.lit(marks[0]), "_prefix", F.lit(marks[2]), "_middle")
    output = F.when(F.col("_form") == "plain", text).when(F.col("_form") == "psm", psm).otherwise(spm)
    return rows.select(
        F.col("_id").alias(id_col),
        *[F.col("_keep")[c].alias(c) for c in others],
        F.col("_cut.n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix").alias("prefix"),
        F.col("_middle").alias("middle"),
        F.col("_suffix").alias("suffix"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, marks=MARKS) -> Column:
    """The original text, from an example and its form alone. Each mark stands once in a rearranged example."""
    pattern = "|".join(f"\\Q{m}\\E" for m in marks)
    parts = F.split(output, pattern, -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    made = rearrange(table(prepare(spark), sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_DRAW = "('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {0}, 8))::BIGINT"
OP11_SQL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4
  FROM documents),
cuts AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
