"""Windowed distinct counts on streams: the registers of a sketch are a max, so windows and watermarks apply as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cardinality
from tessera.sources.shared import new_path


def windowed_registers(events: DataFrame, item: Column, m: int, window: str = "1 day", lateness: str = "2 days", time: str = "ts") -> DataFrame:
    """(window_start, bucket, reg) of a batch or a stream; late rows beyond the watermark are dropped on streams."""
    rows = events.withColumn("at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", lateness)
    rows = cardinality.hashed(rows.where(item.isNotNull()), item, m)
    regs = rows.groupBy(F.window("at", window).alias("w"), "bucket").agg(F.max(F.col("lz") + 1).cast("int").alias("reg"))
    return regs.select(F.col("w.start").alias("window_start"), "bucket", "reg")


def windowed_moment_counts(events: DataFrame, item: str, window: str = "1 day", lateness: str = "2 days", time: str = "ts") -> DataFrame:
    """(window_start, item, cnt): the counts a moment sketch is linear in, per window."""
    rows = events.withColumn("at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", lateness)
    return rows.groupBy(F.window("at", window).alias("w"), F.col(item).alias("item")).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), "item", "cnt")


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A file-source stream over a parquet table (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    at = path.rstrip("/")
    folder, _, name = at.rpartition("/")
    is_file = not any(True for _ in _children(spark, at))
    if is_file:
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(at)


def _children(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [] if fs.getFileStatus(at).isFile() else list(fs.listStatus(at))


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now; each micro-batch writes its result to the shared folder, and the last (in mode
    ``complete``) or all of them are read back. No row passes the driver."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{number:09d}")
        written.append(number)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    parts = sorted(set(written))[-1:] if mode == "complete" else sorted(set(written))
    return spark.read.schema(stream.schema).parquet(*(f"{path}/rows/{k:09d}" for k in parts))
