"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    ``lower`` has a fast path for pure ASCII; other rows go through ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of this process is used only where it is unset and all is local, as in
    tests: other machines would not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="grainline-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """A table written to the shared folder as Parquet, smaller than a checkpoint, until dropped.

    ``most`` rows make a file at most: a writer holds a file's rows and a reader up to 4096 of a
    file at once, so rows of megabytes need files of their own.
    """

    def __init__(self, df: DataFrame, most: int = 0):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/grainline-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", most).parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """What batches have left allocated goes back to the system: idle workers are kept beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(step):
    """A step over Arrow batches that gives memory back after each of them and at its end."""

    def run(batches):
        try:
            for out in step(batches):
                yield out
                _give_back()
        finally:
            _give_back()

    return run


def wrapped(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows as one column beside ``keys``, so that no column of theirs clashes with a name of ours."""
    return docs.select(F.struct("*").alias("_row"), *(c.alias(n) for n, c in keys.items()))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
