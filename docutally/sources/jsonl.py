"""JSONL and whole-file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docutally.operators.dataset import is_test_row
from docutally.operators.prep import training_example
from docutally.schemas import PAIR, TRAIN
from docutally.session import cleaned, fresh_path


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    # Blank lines are skipped; a line that is not JSON stops the job.
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PAIR)


def read_train(spark: SparkSession, path: str) -> DataFrame:
    """Training rows; a row without a prompt or a completion stops the job."""

    def required(name: str):
        message = F.lit(f"training row without {name}")
        return F.when(F.col(name).isNull(), F.raise_error(message)).otherwise(F.col(name)).alias(name)

    # Both checks hold even where a query later reads one column only.
    whole = _read(spark, path, TRAIN).filter(required("prompt").isNotNull() & required("completion").isNotNull())
    return whole.select(required("prompt"), required("completion"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, raw_text) per file below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"))


def _write(rows: DataFrame, path: str, append: bool) -> None:
    # A null field is written as null, so a label keeps all its keys. Every line repeats keys, every prompt its instructions:
    # compressed, the files take a small part of the space.
    with cleaned(rows.sparkSession):
        rows.write.mode("append" if append else "overwrite").options(ignoreNullFields="false", compression="gzip").json(path)


def write_pairs(pairs: DataFrame, path: str, append: bool = False) -> None:
    """Write labelled pairs; ``append`` adds to what earlier runs accumulated."""
    _write(pairs.select("raw_text", "invoice"), path, append)


def write_train(pairs: DataFrame, path: str) -> None:
    """Write pairs as prompt and completion rows."""
    _write(training_example(pairs).select("prompt", "completion"), path, append=False)


def write_test(pairs: DataFrame, path: str) -> None:
    _write(pairs.select("raw_text", "invoice"), path, append=False)


def write_splits(pairs: DataFrame, train_path: str, test_path: str, test_split: float, made: bool = False) -> None:
    """Split accumulated pairs by text hash and rewrite the train and test files.

    The pairs are made once: both files read what was written. Pairs that are a written table already (``made``) are read as they are.
    """
    if not made:
        kept = fresh_path(pairs.sparkSession, "pairs")
        write_pairs(pairs, kept)
        pairs = read_pairs(pairs.sparkSession, kept)
    is_test = is_test_row("raw_text", test_split)
    write_train(pairs.where(~is_test), train_path)
    write_test(pairs.where(is_test), test_path)
