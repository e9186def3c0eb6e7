"""Sources and sinks: benchmark files, matrices from files of frames or metadata, CSV results, run settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BENCH_SCHEMA = "video string, pixels long, projection string, seconds double"


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """A headered benchmark CSV with typed columns."""
    return spark.read.csv(path, header=True, schema=BENCH_SCHEMA)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """Headered CSV, sorted if asked for."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def pivot(df: DataFrame, row: str = "projection", column: str = "pixels", value: str = "seconds") -> DataFrame:
    """(row, cells): a map from column value to the first cell value."""
    cells = df.groupBy(row, column).agg(F.min(value).alias("v"))
    return cells.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "v")))).alias("cells"))


def best_by(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row of least ``value`` for each key; ties go to the smallest ``tie``."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(value, tie)))
    return ranked.where("_r = 1").drop("_r")


def read_frames(spark: SparkSession, path: str, height: int, width: int, column_major: bool = True) -> DataFrame:
    """(i, row): raw grayscale frames of one byte a pixel from binary files, a row a frame in file and frame order.

    Files hold a frame's rows one after the other; a matrix row holds its columns one after the other if ``column_major``.

    Video and ``.mat`` decoding are left to the tools that own those formats; their frames come in as such files or as
    Parquet rows (see ``read_matrix``).
    """
    size = height * width

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                px = np.frombuffer(content, np.uint8)
                frames = px[: len(px) // size * size].reshape(-1, height, width)
                frames = (frames.transpose(0, 2, 1) if column_major else frames).reshape(-1, size)
                yield pd.DataFrame({"path": p, "frame": np.arange(len(frames)), "row": list(frames.astype(float))})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame long, row array<double>")
    starts = rows.groupBy("path").agg(F.count("*").alias("n")).withColumn("at", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(starts.select("path", "at")), "path").select((F.col("at") + F.col("frame")).alias("i"), "row")


def write_frames(spark: SparkSession, path: str, frames) -> None:
    """One binary file of small uint8 frames (frames x height x width), through the file system of the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(frames.tobytes()))
    out.close()


def read_matrix(spark: SparkSession, path: str, id_column: str, vector: str) -> DataFrame:
    """(i, row) from Parquet."""
    return spark.read.parquet(path).select(F.col(id_column).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("row"))


def int_list(text: str) -> list[int]:
    """Comma-separated integers; ValueError if there are none."""
    out = [int(x) for x in text.split(",") if x.strip()]
    if not out:
        raise ValueError("an empty list")
    return out


@dataclass
class Sweep:
    """Settings of a sketch-and-solve run; lists become a parameter table."""

    rows: int = 10_000
    columns: int = 50
    k1: list[int] = field(default_factory=lambda: [512])
    k2: list[int] = field(default_factory=lambda: [128])
    repeats: int = 1
    noise: float = 0.1
    seed: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        cells = [(a, b, r) for a in self.k1 for b in self.k2 if b <= a for r in range(self.repeats)]
        return spark.createDataFrame(cells, "k1 int, k2 int, repeat int")
