"""The labelled dataset as a job that can be broken off and run again.

``runs/run=<n>``   every attempt of a run with its status and the digest of its text
``train``, ``test``  the kept rows of all runs, split by text hash

A run counts once its folder is complete. What earlier runs have kept, its history, is read from their digests, and the splits
are made of what all complete runs have kept; so attempts, history and splits cannot part. A run that was broken off is written anew under
the same number, and splits that are missing or old are made again by the next run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docutally import fixed_values as fv
from docutally.operators.dataset import kept_attempts, text_digest, with_status
from docutally.session import TEXTS, Folder, cleaned
from docutally.sources import jsonl

STATUSES = ["error", "roundtrip", "duplicate", "kept"]
#: Attempts get their status in at most so many slices of at least so many bytes, and what a slice was made of goes before the next one.
SLICES, SLICE_BYTES = 6, 64_000_000


def complete_runs(spark: SparkSession, path: str) -> list[int]:
    names = Folder(spark, f"{path}/runs").names()
    return sorted(int(n.removeprefix("run=")) for n in names if Folder(spark, f"{path}/runs/{n}/_SUCCESS").exists())


def runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """All attempts of the complete runs, with ``run``."""
    folders = [f"{path}/runs/run={n}" for n in complete_runs(spark, path)]
    schema = T.StructType([*schema.fields, T.StructField("run", T.IntegerType())])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/runs").parquet(*folders)


def build(attempts: DataFrame, path: str, failed: Column, passed: Column, order: str = "attempt_id", test_split: float = fv.TEST_SPLIT, check: bool = True) -> DataFrame:
    """Add one run of attempts (``order``, raw_text, invoice, ...) and return its counters (status, n).

    Statuses are decided in the order error, roundtrip, duplicate (of this run or of the history), kept. With ``check`` off the
    round trip is skipped: every attempt without an error passes.
    """
    spark = attempts.sparkSession
    number = max(complete_runs(spark, path), default=-1) + 1
    # Costly to make and read twice, so attempts are written first.
    stage = attempts.withColumns({"_failed": failed, "_passed": passed if check else F.lit(True)})
    _write(stage, f"{path}/_attempts")
    made = spark.read.schema(stage.schema).parquet(f"{path}/_attempts")
    schema = T.StructType([*attempts.schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("status", T.StringType())])
    history = runs(spark, path, schema).where("status = 'kept'").select("digest")
    columns = ("raw_text", order, F.col("_failed"), F.col("_passed"))
    orders = kept_attempts(made, *columns, history)
    _write(orders, f"{path}/_kept")
    kept = spark.read.schema(orders.schema).parquet(f"{path}/_kept")
    Folder(spark, f"{path}/runs/run={number}").delete()
    slices = _slices(spark, f"{path}/_attempts")
    for i, files in enumerate(slices, 1):
        decided = with_status(spark.read.schema(stage.schema).parquet(*files), kept, *columns)
        part = decided.withColumn("digest", text_digest("raw_text")).select(*attempts.columns, "digest", "status")
        # The run is complete with its last slice only.
        _write(part, f"{path}/runs/run={number}", mode="append", complete=i == len(slices))
        for file in files:
            Folder(spark, file).delete()
    for name in ("_attempts", "_kept"):
        Folder(spark, f"{path}/{name}").delete()
    write_splits(spark, path, schema, test_split)
    counted = runs(spark, path, schema).where(F.col("run") == number).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def _write(rows: DataFrame, path: str, mode: str = "overwrite", complete: bool = True) -> None:
    """Write without shuffle files left behind. With ``complete`` off the folder does not count as complete yet."""
    marked = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": str(complete).lower()}
    with cleaned(rows.sparkSession):
        rows.write.mode(mode).options(**TEXTS, **marked).parquet(path)


def _slices(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a table in groups, see ``SLICES``."""
    folder = Folder(spark, path)
    files = list(zip(folder.names(".parquet"), folder.sizes(".parquet"), strict=True))
    least = max(SLICE_BYTES, sum(size for _, size in files) / SLICES)
    groups, held = [[]], 0
    for name, size in files:
        if groups[-1] and held >= least:
            groups, held = [*groups, []], 0
        groups[-1].append(f"{path}/{name}")
        held += size
    return groups if files else [[path]]


def write_splits(spark: SparkSession, path: str, schema, test_split: float = fv.TEST_SPLIT) -> None:
    """Make train and test of all kept rows anew; where nothing was ever kept there are none."""
    kept = runs(spark, path, schema).where("status = 'kept'").select("raw_text", "invoice")
    if kept.take(1):
        jsonl.write_splits(kept, f"{path}/train", f"{path}/test", test_split, made=True)
