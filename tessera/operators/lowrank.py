"""Low-rank plus sparse decomposition of a row table, with a choice of random projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import matvec
from tessera.operators import linalg, projections
from tessera.sources.shared import checkpointed, stored


def frames_mean(rows: DataFrame) -> DataFrame:
    """(pixel, mean): the mean frame over time."""
    return linalg.to_coo(rows).groupBy(F.col("j").alias("pixel")).agg(F.avg("v").alias("mean"))


def _range_basis(rows: DataFrame, start: np.ndarray, power: int) -> np.ndarray:
    """An orthonormal basis of the range of (X'X)**power applied to ``start``; one pass of partial sums a power."""
    y = start
    for _ in range(power):

        def run(batches, y=y):
            total = None
            for b in batches:
                if len(b):
                    x = np.stack(b["row"].to_numpy())
                    part = x.T @ (x @ y)
                    total = part if total is None else total + part
            if total is not None:
                i, j = np.divmod(np.arange(total.size), total.shape[1])
                yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total.ravel()})

        sums = rows.select("row").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        y = linalg.to_numpy(sums, start.shape)
    return np.linalg.qr(y)[0]


def decompose(rows: DataFrame, columns: int, rank: int = 1, card: int | None = None, power: int = 1, max_iter: int = 20, tol: float = 1e-3, kind: str = "gaussian", seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((i, row, low, sparse), RMSE by iteration) with X = low + sparse + noise.

    Each iteration projects X - sparse to rank ``rank`` by a randomised range finder and keeps the ``card`` largest entries of
    what is left as the new sparse part. ``card`` None keeps all: then one iteration is exact. The cut for ``card`` entries is a
    value found by a distributed top-k; ties at it are broken by place.
    """
    projections.kind_of(kind)
    spark = rows.sparkSession
    now = rows.select("i", "row").withColumn("sparse", F.transform("row", lambda _: F.lit(0.0)))
    errors: list[float] = []
    for t in range(max_iter):
        start = projections.sample_matrix(spark, kind, columns, rank, seed + t)
        rest = now.select("i", F.zip_with("row", "sparse", lambda a, b: a - b).alias("row"))
        q = _range_basis(rest, start, power)
        low = linalg.times(now.withColumn("x", F.col("row")).withColumn("row", F.zip_with("row", "sparse", lambda a, b: a - b)), q @ q.T, "low")
        left = low.select("i", F.col("x").alias("row"), "low", F.zip_with("x", "low", lambda a, b: a - b).alias("rest"))
        if card is None:
            now = left.select("i", "row", "low", F.col("rest").alias("sparse"))
        else:
            left = stored(left)
            top = linalg.hard_threshold(left.select("i", F.posexplode("rest").alias("j", "v")), card)
            kept = top.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("kept"))
            joined = left.join(kept, "i", "left")
            now = joined.select("i", "row", "low", F.transform("rest", lambda v, j: F.coalesce(F.try_element_at("kept", j), F.lit(0.0)) + 0.0 * v).alias("sparse"))
        now = checkpointed(now)
        fit = F.zip_with(F.zip_with("low", "sparse", lambda a, b: a + b), F.col("row"), lambda a, b: (a - b) * (a - b))
        errors.append(now.agg(F.sqrt(F.sum(F.aggregate(fit, F.lit(0.0), lambda s, v: s + v)) / F.sum(F.size("row"))).alias("e")).first()["e"])
        if errors[-1] <= tol:
            break
    return now, errors


def low_rank_step(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    """(i, row): rows projected on a basis (columns x rank), by array expressions alone."""
    from tessera.functions.vectors import literal_matrix

    return rows.select("i", matvec(literal_matrix(basis @ basis.T), F.col("row")).alias("row"))


def captured(rows: DataFrame, columns: int, kind: str, rank: int = 1, power: int = 1, seed: int = 0) -> DataFrame:
    """(energy): the squared norm of the rows' projections on the range found from a test matrix of the given kind."""
    q = _range_basis(rows, projections.sample_matrix(rows.sparkSession, kind, columns, rank, seed), power)
    return linalg.times(rows, q, "p").agg(F.sum(F.aggregate("p", F.lit(0.0), lambda s, v: s + v * v)).alias("energy"))
