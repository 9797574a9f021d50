"""Cleaning pipeline over ``documents``: toxicity, near-dedup, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of ``docs``, whatever further columns there are and whatever
their names: a row travels through an operator as one struct under a name of its own. A stage works on all rows that
the one before has kept. Null texts come out of the third stage as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docutally.llm import minhash, packing, secrets, substrings, toxicity
from docutally.llm.common import prepare, table, written

#: Word-shingle similarity in percent from which documents count as near-duplicates.
SIMILAR = 80
#: Bytes from which a string that stands at several places is cut: passages of over 50 short words are caught.
REPEATED = 250
#: Column that holds the whole row inside an operator.
ROW = "_docutally_row"
#: Columns that the stages on texts make anew.
NEW = ("text", "n_chars")


def boxed(docs: DataFrame, without=()) -> DataFrame:
    """(doc_id, text, the row as one struct): no other column name can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in without]).alias(ROW))


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the boxed rows, some of them changed."""
    return rows.select(*[(changed[c] if c in changed else F.col(ROW)[c]).alias(c) for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    prepare(spark)
    scored = toxicity.scores(boxed(docs), table(spark, sf_dir, "labels"), keep=[ROW])
    return unboxed(scored.filter(F.col("score") < toxicity.THRESHOLD), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the first by id and row hash (null ids last), and all single ones.

    Rows are told apart even where they share an id, so that a repeated row stays once and a row is not dropped for
    another of its id. Rows without a word are all kept.
    """
    prepare(spark)
    # A node per row, in the order of the ids; written, so that it is the same for every later read.
    lined = docs.select(F.struct(*docs.columns).alias(ROW), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("hash"))
    line = ["last", "id", "hash"]
    placed = lined.repartitionByRange(*line).sortWithinPartitions(*line).select(ROW, F.monotonically_increasing_id().alias("node"))
    placed = written(placed, "rows")
    nodes = placed.select("node", F.col(ROW)["text"].alias("text"))
    kept = minhash.near_duplicates(nodes, percent=SIMILAR, id_col="node").filter("kept").select("node")
    return unboxed(placed.join(kept.hint("merge"), "node", "left_semi"), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEATED`` bytes that stand at several places of the remaining corpus."""
    prepare(spark)
    # Shorter samples than for 400 bytes: fewer of them, the same result.
    cut = substrings.remove_repeats(boxed(docs, NEW), REPEATED, keep=[ROW], with_text=True, gram=32)
    return unboxed(cut, docs.columns, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    prepare(spark)
    found = secrets.find_secrets(boxed(docs, NEW), keep=[ROW])
    masked = secrets.redacted(F.col("text"), F.col("spans"))
    return unboxed(found, docs.columns, text=masked, n_chars=F.length(masked).cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    prepare(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]
#: SQL cannot express the learned scores; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
