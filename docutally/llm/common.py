"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docutally.session import Folder, configure, fresh_path

#: Spark's own setting: the shuffle files of a query go when it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for passes over long texts: small Arrow batches, each a few MB."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read back: cuts lineage, runs costly steps once.

    Empty frames keep their schema. The files survive the loss of executors. The shuffle files of the steps before go with
    the end of the write, so that disk holds one step at a time.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    back = spark.read.schema(rows.schema).parquet(path)
    back.written_to = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what :func:`written` has written for these frames. Nothing may read them any more."""
    for rows in frames:
        Folder(rows.sparkSession, rows.written_to).delete()


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def worker_cache() -> dict:
    """Objects kept for the life of a Python worker, such as loaded tokenizers."""
    return vars(sys.modules.setdefault("_docutally_worker", types.ModuleType("_docutally_worker")))


def packed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the column ``text`` replaced by its compressed UTF-8 bytes, for cheap shuffles."""
    schema = rows.drop(text).schema.add("packed", "binary")
    names = [f.name for f in schema]

    def pack(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = pa.array([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), data], names=names)

    return rows.mapInArrow(pack, schema)


def unpacked(column) -> list[bytes]:
    """The bytes of an Arrow column made by :func:`packed`."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(b) for b in column.to_pylist()]
