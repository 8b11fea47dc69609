"""Event windows, the same for batch tables and for streams with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def utc(df: DataFrame) -> DataFrame:
    """The table's time has no zone; watermarks need one."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc(spark.read.parquet(f"{sf_dir}/events.parquet"))


def tumbling(df: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    counts = df.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str) -> DataFrame:
    counts = df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def streamed(spark: SparkSession, sf_dir: str, width: str, watermark: str = "10 minutes") -> DataFrame:
    """Run the windows as a stream over the table's files until all are read.

    Results are written as Parquet by ``foreachBatch`` in update mode, a folder for
    each batch, so that a batch that is run again replaces itself. The last version
    of a window counts. The folder is below ``spark.checkpoint.dir`` where that is set.
    """
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = utc(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"))
    counts = tumbling(source.withWatermark("ts", watermark), width)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b{number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out/*")
    newest = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("_r"))
    return newest.select("window_start", "event_type", "_r.n", "_r.total")
