"""Session settings and the shared working folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Work per row is high here: let small shuffles keep one partition per core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    # Texts may be long: what a Python worker is handed at a time must not grow with the table.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


#: Spark's own setting: the shuffle files of a query go when it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    # Functions of this package travel to the executors with the query; nothing to install there.
    cloudpickle.register_pickle_by_value(sys.modules["docutally"])
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall back to a
    temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docutally-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under :func:`shared_dir` that no earlier call has returned."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Options of written tables of texts and answers: hardly any value repeats, so collecting them in dictionaries costs more time than the
#: rest of the write; zstd takes about two thirds of the usual codec's space.
TEXTS = {"compression": "zstd", "parquet.enable.dictionary": "false"}


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, so that disk holds those of one step at a time."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


class Folder:
    """A path of a file system that Spark reaches, for what data frames cannot ask."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self, ending: str = "") -> list[str]:
        """Names inside the folder with this ending; none where it does not exist."""
        if not self.exists():
            return []
        return [n for f in self._fs.listStatus(self._path) if (n := f.getPath().getName()).endswith(ending)]

    def sizes(self, ending: str = "") -> list[int]:
        """Bytes of the files inside the folder with this ending; none where it does not exist."""
        return [f.getLen() for f in self._fs.listStatus(self._path) if f.getPath().getName().endswith(ending)] if self.exists() else []

    def delete(self) -> None:
        self._fs.delete(self._path, True)
