"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2048
FILE_ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset in local mode, as in tests, a temporary one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of ``taken`` has, whatever its case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Python workers of this session get at most ``rows`` texts at once; Spark's default is ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _free(spark)
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    _free(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """Store a table of about ``rows`` short rows in files of ``FILE_ROWS``, however many shuffle partitions there are.

    The rows are made in all partitions and dealt to the files by a shuffle, so no task has more to make for it.
    """
    parts = max(1, -(-rows // FILE_ROWS))
    return stored(df.repartition(parts).coalesce(parts))


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that only results which are stored themselves were made of."""
    for table in tables:
        path = getattr(table, "_tessera_path", None)
        if path:
            _drop(table.sparkSession, path)


def _free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans nothing refers to any more; it does so when the JVM collects them."""
    gc.collect()
    spark._jvm.System.gc()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session or its gateway has ended before
        pass
