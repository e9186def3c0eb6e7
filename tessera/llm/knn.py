"""Exact top-k inner-product search as a Voronoi join: pivots group both sides, bounds from cell summaries prune."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._store import bounded_batches, stored

MAX_PIVOTS = 256
BLOCK_QUERIES = 256
CHUNK_ROWS = 32768
MAX_BLOCKS = 1 << 16
SLACK = 1e-6
_KINDS = {1: "<i2", 2: "<i4", 3: "<f8"}


def integers(column: str | Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as double; null where the vector or a component is null or not finite."""
    c = F.col(column) if isinstance(column, str) else column
    whole = F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row and its distance to the cell's pivot."""
    square = (pivots**2).sum(1)
    cell = np.concatenate([(square - 2 * x[s : s + 8192] @ pivots.T).argmin(1) for s in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where all sums stay below 2**53, else in Python integers cut to 64 bits."""
    top = (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(v).T, -(2**63), 2**63 - 1).astype(np.int64)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row by (score desc, id asc)."""
    if len(score) > 4 * k:
        cut = -np.partition(-score, k - 1)[k - 1]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _pack(ids: np.ndarray, x: np.ndarray) -> bytes:
    """Ids and integer vectors, each number as narrow as the largest needs."""
    top = np.abs(x).max(initial=0)
    kind = next(k for k, bound in ((1, 2**15), (2, 2**31), (3, np.inf)) if top < bound)
    return bytes([kind]) + len(ids).to_bytes(7, "little") + ids.astype("<i8").tobytes() + x.astype(_KINDS[kind]).tobytes()


def _unpack(payloads, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids, rows = [np.zeros(0, np.int64)], [np.zeros((0, dim))]
    for p in payloads:
        n = int.from_bytes(p[1:8], "little")
        ids.append(np.frombuffer(p, "<i8", n, 8))
        rows.append(np.frombuffer(p, _KINDS[p[0]], n * dim, 8 + 8 * n).reshape(n, dim).astype(np.float64))
    return np.concatenate(ids), np.concatenate(rows)


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order where each is followed by its nearest one left, so that blocks hold cells close together."""
    left, out = list(range(1, len(pivots))), [0]
    while left:
        far = ((pivots[left] - pivots[out[-1]]) ** 2).sum(1)
        out.append(left.pop(int(far.argmin())))
    return np.array(out)


def _rows_of(data: DataFrame, is_query: Column, id_column: str, vector: str) -> DataFrame:
    rows = data.select(F.col(id_column).cast("long").alias("id"), integers(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())


def replicate(assigned: DataFrame, tests: list[tuple], pivots, dim: int, chunks: int) -> DataFrame:
    """(block, chunk, payload): the rows each block needs, packed by block and batch.

    ``tests`` holds (block, cell, radius, cut), in order of blocks; a row goes to a block once, if one of the block's cells can't
    rule it out.
    """
    held = assigned.sparkSession.sparkContext.broadcast(tests)

    def run(batches):
        blocks = np.array([t[0] for t in held.value], np.int64)
        cells = np.array([t[1] for t in held.value], np.int64)
        radius, cut = (np.array([t[k] for t in held.value]) for k in (2, 3))
        at = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        ends = np.append(at[1:], len(blocks))
        for b in batches:
            x, norm = _matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            near = x @ pivots.value.T
            chunk = xxhash.xxh3_64_intdigest(ids.tobytes()) % chunks
            out: list[tuple[int, bytes]] = []
            for s, z in zip(at, ends, strict=True):
                high = near[:, cells[s:z]] + norm[:, None] * radius[s:z]
                need = (high + SLACK * (1 + np.abs(high)) >= cut[s:z]).any(1)
                if need.any():
                    out.append((int(blocks[s]), _pack(ids[need], x[need])))
                if len(out) >= 64 or (out and z == len(blocks)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int32()), pa.array([chunk] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary())],
                        ["block", "chunk", "payload"],
                    )
                    out = []

    return assigned.select("id", "v", "norm").mapInArrow(run, "block int, chunk int, payload binary")


def voronoi_topk(data: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, the k other rows of highest integer inner product.

    Pivots: at most ``max_pivots`` rows taken by a hash. Every row goes to its nearest pivot's cell; queries, in an order
    of cells where neighbours are close, are cut into blocks of about ``BLOCK_QUERIES``. Summaries: of a cell, the k smallest
    distances to its pivot; of a block's share of a cell, pivot, radius and largest norm. For a query q of that share
    and a row v, with p the pivot, p.v - r|v| <= q.v <= p.v + r|v|; the k-th largest lower bound over the summaries of rows
    that are no queries is a threshold that no k-th score of the share can fall below. A row is replicated to a block,
    once, only if its upper bound reaches the threshold of one of the block's shares. Blocks are solved in chunks of rows,
    so no task holds a whole block's rows; a block's queries go to a chunk as one packed row. k rows a chunk go on.

    Rows without id or with a vector that is null or has null or non-finite components take no part; shorter vectors
    count as padded with zeros. Rows with a query's own id are not its candidates; repeated rows count each. Equal
    scores rank by id. Without queries or candidates the result is empty.
    """
    spark = data.sparkSession
    bounded_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    plan = _plan(data, is_query, k, id_column, vector, max_pivots)
    if plan is None:
        return empty
    assigned, queries, tests, pivots, dim, chunks = plan
    sent = replicate(assigned, tests, pivots, dim, chunks)

    def pack(batches):
        for b in batches:
            x, ids = _matrix(b.column(2), dim), b.column(1).to_numpy(zero_copy_only=False)
            block = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[g[0]]) for g in groups], pa.int32()), pa.array([_pack(ids[g], x[g]) for g in groups], pa.binary())], ["block", "payload"]
            )

    packed = queries.select("block", "id", "v").repartition("block").mapInArrow(pack, "block int, payload binary")
    asked = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "payload")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), np.int64)]
        if len(left) and len(right):
            (own, q), (ids, v) = _unpack(left["payload"], dim), _unpack(right["payload"], dim)
            for s in range(0, len(q), 64):
                score = exact_scores(q[s : s + 64], v)
                for j, i in enumerate(own[s : s + 64]):
                    others = np.flatnonzero(ids != i)
                    best = others[_top(score[j][others], ids[others], k)]
                    digest = xxhash.xxh3_64_intdigest(q[s + j].tobytes()) - 2**63
                    out.append(np.column_stack([np.full(len(best), i), np.full(len(best), digest), ids[best], score[j][best]]))
        return pd.DataFrame(np.concatenate(out).astype(np.int64), columns=["query_id", "query", "vec_id", "score"])

    keys = ["block", "chunk"]
    local = asked.groupBy(keys).cogroup(sent.groupBy(keys)).applyInPandas(solve, "query_id long, query long, vec_id long, score long")
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _plan(data: DataFrame, is_query: Column, k: int, id_column: str, vector: str, max_pivots: int):
    """(rows with cell and norm, queries with block, tests of the blocks, pivots, dimension, chunks), or None without queries."""
    spark = data.sparkSession
    rows = _rows_of(data, is_query, id_column, vector)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return None
    n, dim = size["n"], max(1, size["d"])
    n_pivots = max(1, min(max_pivots, math.isqrt(n) // 2))
    hashed = rows.select("v", F.xxhash64("id", "v").alias("h")).where(F.pmod("h", F.lit(n)) < 4 * n_pivots)
    sample = hashed.orderBy("h").limit(n_pivots).collect() or rows.limit(1).collect()
    pivots = np.unique(np.array([list(r["v"]) + [0.0] * (dim - len(r["v"])) for r in sample]), axis=0)
    pivots = pivots[_chain(pivots)]
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            cell, far = _nearest(x, held.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(np.sqrt((x**2).sum(1)))], ["id", "v", "q", "cell", "far", "norm"]
            )

    assigned = stored(rows.mapInArrow(assign, "id long, v array<double>, q boolean, cell int, far double, norm double"))

    # summaries; a cell's k nearest rows are found in two steps so that no task sorts a whole cell
    part = W.partitionBy("cell", "part").orderBy("far")
    whole = W.partitionBy("cell").orderBy("far")
    close = assigned.where(~F.col("q")).select("cell", "far", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 50_000))).alias("part"))
    close = close.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    near = {r["cell"]: sorted(r["fars"]) for r in close.groupBy("cell").agg(F.collect_list("far").alias("fars")).collect()}

    queries = assigned.where("q").select("id", "v", "cell", "far", "norm").distinct()
    per_cell = sorted((r["cell"], r["n"]) for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect())
    if not per_cell:
        return None
    total = sum(m for _, m in per_cell)
    width = max(BLOCK_QUERIES, math.ceil(total / MAX_BLOCKS))
    first = np.cumsum([0, *(m for _, m in per_cell)]).tolist()
    places = spark.createDataFrame([(c, m, f) for (c, m), f in zip(per_cell, first, strict=False)], "cell int, m long, f long")
    # a query's place among those of its cell is drawn by hash: blocks are even without ranking a hot cell's queries
    place = F.col("f") + F.pmod(F.xxhash64("id", "v"), F.col("m"))
    queries = stored(queries.join(F.broadcast(places), "cell").select("id", "v", "cell", "far", "norm", F.floor(place / width).cast("int").alias("block")))

    away = np.array([(j, far) for j, fars in near.items() for far in fars]).reshape(-1, 2)
    spots, fars = away[:, 0].astype(np.int64), away[:, 1]
    lengths = np.linalg.norm(pivots, axis=1)

    def test(block: int, cell: int, r: float, norm: float) -> tuple[int, int, float, float]:
        low = (pivots[spots] @ pivots[cell]) - r * lengths[spots] - norm * fars
        cut = -np.partition(-low, k - 1)[k - 1] if len(low) >= k else -np.inf
        return block, cell, r, cut - SLACK * (1 + abs(cut)) if np.isfinite(cut) else cut

    shares = queries.groupBy("block", "cell").agg(F.max("far").alias("r"), F.max("norm").alias("norm")).collect()  # MAX_BLOCKS + MAX_PIVOTS at most
    tests = [test(s["block"], s["cell"], s["r"], s["norm"]) for s in sorted(shares, key=lambda s: (s["block"], s["cell"]))]
    return assigned, queries, tests, held, dim, max(1, math.ceil(n / CHUNK_ROWS))


def op1_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return voronoi_topk(data, F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
