"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix. DataFrame functions only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._store import fresh

BLOCK_ROWS = 200_000
MAX_BLOCKS = 4096


def hypergeometric(rng: random.Random, draws: int, good: int, bad: int) -> int:
    """A draw of the number of good items among ``draws`` taken from ``good + bad``, by inversion from the mode.

    Probabilities are doubles: the law is exact to about 1e-16 times the logarithms of the factorials, 1e-6 at 10**9 items.
    The counts drawn are whole numbers, so shard sizes are exact in any case.

    The expected number of steps is of the order of the standard deviation, for counts of any size.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(total, draws))
    u = rng.random() - p
    if u <= 0:
        return mode
    left, right, pl, pr = mode, mode, p, p
    while left > low or right < high:
        if right < high:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row sums ``blocks``, column sums ``shards``; distributed as the counts of a uniform random permutation."""
    rng = random.Random(seed)
    left, out = list(shards), []
    for size in blocks:
        row, draws, rest = [], size, sum(left)
        for j, cap in enumerate(left):
            rest -= cap
            x = hypergeometric(rng, draws, cap, rest) if draws else 0
            row.append(x)
            left[j] -= x
            draws -= x
        out.append(row)
    return out


def shuffle_shards(rows: DataFrame, key: list[Column], n_shards: int, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0 within a shard).

    The rows are one uniform random permutation, dealt to shards whose counts differ by one at most. Blocks (by a
    hash of ``key``) stand for the input partitions, so a task that runs again deals as before. Three steps: draw how
    many rows each block gives each shard; rank the rows of a block by a keyed hash and cut the ranking by those
    counts; in the shard, deal rows into sub-blocks and rank again, a sub-block's slots following its predecessor's.
    Driver memory: at most ``MAX_BLOCKS`` counts twice. No task holds more than a block. Rows with equal keys are
    interchangeable. An empty table gives an empty table. Clashing input columns ``shard`` and ``slot`` are replaced; others
    may have any name.
    """
    rows = rows.drop("shard", "slot")
    hashed, block, rank, ends, sub, offset, place, b_side, j_side, s_side = fresh(rows.columns, "hashed", "block", "rank", "ends", "sub", "offset", "place", "b_side", "j_side", "s_side")
    named = rows.withColumn(hashed, F.xxhash64(*key, F.lit(seed)))
    total_blocks = min(MAX_BLOCKS, max(n_shards, 1, math.ceil(rows.count() / block_rows)))
    named = named.withColumn(block, F.pmod(F.col(hashed), F.lit(total_blocks)).cast("int"))
    sizes = {r["b"]: r["n"] for r in named.groupBy(F.col(block).alias("b")).agg(F.count("*").alias("n")).collect()}
    blocks = [sizes.get(b, 0) for b in range(total_blocks)]
    total = sum(blocks)
    shards = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix(blocks, shards, seed)
    bounds = [(b, [sum(row[: j + 1]) for j in range(n_shards)]) for b, row in enumerate(matrix)]

    # permute locally, then exchange by the drawn counts
    bounds = rows.sparkSession.createDataFrame(bounds, f"{b_side} int, {ends} array<long>")
    order = lambda salt: F.xxhash64(F.col(hashed), F.lit(salt), F.lit(seed))
    ranked = named.withColumn(rank, F.row_number().over(W.partitionBy(block).orderBy(order(1), hashed)))
    dealt = ranked.join(F.broadcast(bounds), F.col(block) == F.col(b_side))
    dealt = dealt.withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(rank))).cast("int"))

    # permute again within the shard: sub-blocks are uniform and independent, ranks in them are by another hash
    subs = max(1, min(MAX_BLOCKS // n_shards, math.ceil(total / n_shards / block_rows)))
    dealt = dealt.withColumn(sub, F.pmod(order(2), F.lit(subs)).cast("int"))
    if subs == 1:
        offsets = [(j, 0, 0) for j in range(n_shards)]
    else:
        counted = {(r["shard"], r["s"]): r["n"] for r in dealt.groupBy("shard", F.col(sub).alias("s")).agg(F.count("*").alias("n")).collect()}
        offsets = [(j, s, sum(counted.get((j, q), 0) for q in range(s))) for j in range(n_shards) for s in range(subs)]
    start = rows.sparkSession.createDataFrame(offsets, f"{j_side} int, {s_side} int, {offset} long")
    final = dealt.withColumn(place, F.row_number().over(W.partitionBy("shard", sub).orderBy(order(3), hashed)))
    final = final.join(F.broadcast(start), (F.col("shard") == F.col(j_side)) & (F.col(sub) == F.col(s_side)))
    return final.select(*rows.columns, "shard", (F.col(offset) + F.col(place) - 1).alias("slot"))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``: counts at most one apart, order uniform.

    Exact counts and whole groups exclude each other where a group of equal texts holds a third of the rows, so equal
    texts are spread like other rows. Null text: size 1 and checksum 0.
    """
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shuffle_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
