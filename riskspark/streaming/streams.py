"""Streaming forms: first sight of an address, counts in tumbling, sliding and session windows.

State is bounded by watermarks; files of the source are read as they arrive or, with ``availableNow``, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workspace


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of one table as a stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    stream = spark.readStream.schema(schema)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else stream.parquet(path)


def dedup_stream(rows: DataFrame, keys: list[str], time: str, *, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(rows: DataFrame, time: str, by: list[str], *, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per window of ``size``, tumbling, or sliding by ``slide``."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").cast("bigint").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def session_counts(rows: DataFrame, time: str, by: list[str], *, gap: str, delay: str = "1 hour") -> DataFrame:
    """Counts per session: runs of rows of one key with gaps below ``gap``."""
    return rows.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").cast("bigint").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Everything there is now, through a sink and a checkpoint in the shared folder, as a table.

    Windows are emitted when the watermark has passed them; ``availableNow`` ends with a batch that advances it,
    so the last windows within the delay stay open, as in any stream.
    """
    spark = stream.sparkSession
    at = workspace(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
