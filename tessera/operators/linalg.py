"""Matrices as tables: coordinates ``(i, j, v)`` or rows ``(i, row)``; products are joins or partial sums near the data."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import release

BLOCK_ROWS = 512


def to_rows(df: DataFrame, id_column: str, vector: str, *keep: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("row"), *keep)


def to_coo(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("row").alias("j", "v"))


def from_coo(coo: DataFrame) -> DataFrame:
    """Rows of a dense coordinate table, in column order."""
    ordered = F.array_sort(F.collect_list(F.struct("j", "v")))
    return coo.groupBy("i").agg(F.transform(ordered, lambda e: e["v"]).alias("row"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two coordinate tables: an equi-join on the inner index and a sum."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def cross_gram(rows: DataFrame, left: str = "row", right: str = "row") -> DataFrame:
    """(i, j, v): sum over rows of left[i] * right[j]; a task sends one small matrix, whatever its number of rows."""

    def run(batches):
        total = None
        for b in batches:
            if len(b):
                part = np.stack(b["a"].to_numpy()).T @ np.stack(b["b"].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            i, j = np.divmod(np.arange(total.size), total.shape[1])
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total.ravel()})

    parts = rows.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInPandas(run, "i int, j int, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_numpy(coo: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A small matrix on the driver; for sizes fixed by the number of columns, never of rows."""
    out = np.zeros(shape)
    for r in coo.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def times(rows: DataFrame, matrix: np.ndarray, out: str = "row") -> DataFrame:
    """Rows times a small dense matrix (columns x k), in Arrow batches by BLAS, without a shuffle."""
    import pyarrow as pa

    names = rows.columns
    at = names.index("row")
    fields = [f for f in rows.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<double>"
    keep = [k for k, f in enumerate(rows.schema.fields) if f.name != out]

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(at).flatten()).reshape(b.num_rows, -1)
            y = x @ matrix
            offsets = pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32)[: b.num_rows + 1])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], [*(names[k] for k in keep), out])

    return rows.mapInArrow(run, schema)


def double_center(d: DataFrame) -> DataFrame:
    """-1/2 C D C of a full square coordinate table, from row, column and overall averages."""
    rows = d.groupBy("i").agg(F.avg("v").alias("ri"))
    cols = d.groupBy("j").agg(F.avg("v").alias("cj"))
    mean = d.agg(F.avg("v").alias("m"))
    out = d.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(mean))
    return out.select("i", "j", (-0.5 * (F.col("v") - F.col("ri") - F.col("cj") + F.col("m"))).alias("v"))


def _signature_distance(x: np.ndarray, y: np.ndarray, positive: int | None) -> np.ndarray:
    def squared(a, b):
        return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)

    if positive is None or x.shape[1] < positive:
        return np.sqrt(squared(x, y))
    return np.sqrt(np.maximum(squared(x[:, :positive], y[:, :positive]) - squared(x[:, positive:], y[:, positive:]), 0))


def pairwise(rows: DataFrame, positive: int | None = None, vectors: tuple[str, ...] = ("row",), n_rows: int | None = None) -> DataFrame:
    """(a, b, d0, d1..) for a < b: distances of all pairs under each vector column, block against block.

    ``positive``: the first so many dimensions count positive, the rest negative (pseudo-Euclidean), floored at 0.
    """
    n = rows.count() if n_rows is None else n_rows
    blocks = max(1, -(-n // BLOCK_ROWS))
    keyed = rows.select("i", *vectors).withColumn("p", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    left = keyed.withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(blocks - 1))))
    # new names on this side: both come from one table, and a cogroup tells columns apart by their source
    right = keyed.select(F.col("i").alias("i_"), *(F.col(v).alias(f"{v}_") for v in vectors), F.col("p").alias("q_"))
    right = right.withColumn("p_", F.explode(F.sequence(F.lit(0), F.col("q_"))))
    names = [f"d{k}" for k in range(len(vectors))]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], **{n: [] for n in names}})
        a, b = np.repeat(x["i"].to_numpy(), len(y)), np.tile(y["i_"].to_numpy(), len(x))
        keep = a < b if x["p"].iloc[0] == x["q"].iloc[0] else a != b
        out = {"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}
        for name, v in zip(names, vectors, strict=True):
            out[name] = _signature_distance(np.stack(x[v].to_numpy()), np.stack(y[f"{v}_"].to_numpy()), positive).ravel()[keep]
        return pd.DataFrame(out)

    schema = "a long, b long, " + ", ".join(f"{n} double" for n in names)
    return left.groupBy("p", "q").cogroup(right.groupBy("p_", "q_")).applyInPandas(run, schema)


PAIR_BLOCK_ROWS = 1 << 14
PAIR_TILE_ROWS = 256  # a tile's distances stay in a cache
CANCELS = 1e-4


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all of y: by one product, and by differences where that would cancel."""
    with np.errstate(invalid="ignore", over="ignore"):
        nx, ny = (x * x).sum(1), (y * y).sum(1)
        s = x @ (-2 * y.T)
        s += nx[:, None]
        s += ny
        if s.size and not s.min() > CANCELS * (nx.max() + ny.max()):  # close pairs, or what is not finite
            i, j = np.nonzero(~(s > CANCELS * nx[:, None] + CANCELS * ny))
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                s[a, b] = ((x[a] - y[b]) ** 2).sum(1)
        return np.sqrt(s, out=s)


def pair_blocks(rows: DataFrame) -> DataFrame:
    """Rows (i, row) in one copy for each pair (p, q) of blocks that theirs, ``own``, is in; null ids and vectors take no part.

    There are as many blocks as give every core a few pairs of them, more from ``PAIR_BLOCK_ROWS`` rows a block on. Vectors
    travel in the type the table holds.
    """
    there = rows.select("i", "row").where(F.col("i").isNotNull() & F.col("row").isNotNull())
    n = there.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // PAIR_BLOCK_ROWS), min(math.isqrt(8 * cores), -(-n // BLOCK_ROWS)))
    own = there.withColumn("own", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    to = own.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = to.select(F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), "own", "i", "row")
    return keyed.repartition(blocks * (blocks + 1) // 2, "p", "q")


Tiles = Iterator[list[np.ndarray]]


def over_pairs(blocks: DataFrame, fold: Callable[[Tiles], dict], schema: str, maps: Sequence[np.ndarray | None] = (None,)) -> DataFrame:
    """The rows that ``fold`` makes of all pairs of two blocks, from ``pair_blocks``; no pair leaves its task.

    ``fold`` gets the pairs a tile at a time, every pair of different ids once: a flat array of distances under each of
    ``maps``, which are matrices that vectors are mapped by, or None. It gives columns by name, longs and doubles.
    """
    import pyarrow as pa

    kinds = pa.schema([(c, pa.int64() if kind == "long" else pa.float64()) for c, kind in (f.split() for f in schema.split(","))])

    def run(table: pa.Table) -> pa.Table:
        own, ids = table.column("own").to_numpy(), table.column("i").to_numpy()
        vectors = table.column("row").combine_chunks()
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        width = len(values) // len(ids)
        if (vectors.value_lengths().to_numpy() != width).any():
            raise ValueError("vectors of different lengths")
        x = values.reshape(len(ids), width).astype(float)
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        order = np.lexsort((ids, own))  # the same tiles in every pass, so the same distances to the last bit
        sides = []
        for block in (p, q):
            at = order[own[order] == block]
            sides.append((ids[at], [x[at] if m is None else x[at] @ m for m in maps]))

        def tiles() -> Tiles:
            (a, left), (b, right) = sides
            for s in range(0, len(a), PAIR_TILE_ROWS):
                for t in range(s if p == q else 0, len(b), PAIR_TILE_ROWS):
                    cut, keep = (slice(s, s + PAIR_TILE_ROWS), slice(t, t + PAIR_TILE_ROWS)), None
                    if p == q:
                        keep = a[cut[0], None] < b[cut[1]]
                    found = [distances(u[cut[0]], v[cut[1]]) for u, v in zip(left, right, strict=True)]
                    yield [d.ravel() if keep is None else d[keep] for d in found]

        return pa.table(fold(tiles()), schema=kinds)

    return blocks.groupBy("p", "q").applyInArrow(run, schema)


ALL_BITS = (1 << 64) - 1
HISTOGRAM_BITS = 14
LISTED = 1 << 20


def _histogram(low: int, last: int, shift: int) -> Callable[[Tiles], dict]:
    """Counts of the bits of distances: in bins of 2^shift from ``low`` to ``last``, of what is below (-1), above (-2).

    The bits of doubles without sign are in the order of the values; nan comes last, as in SQL.
    """

    def fold(tiles: Tiles) -> dict:
        bins = ((last - low) >> shift) + 1
        dense = bins <= 1 << HISTOGRAM_BITS
        counts, listed, total, below = np.zeros(bins if dense else 0, np.int64), [np.zeros(0, np.int64)], 0, 0
        for (d,) in tiles:
            bits = d.view(np.uint64)
            total += len(bits)
            if low or last < ALL_BITS:
                below += np.count_nonzero(bits < low)
                bits = bits - np.uint64(low)  # what is below wraps round, to more than any span
                bits = bits[bits <= np.uint64(last - low)]
            at = (bits >> np.uint64(shift)).view(np.int64)
            if dense:
                counts += np.bincount(at, minlength=bins)
            else:
                listed.append(at)
        if dense:
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(np.concatenate(listed), return_counts=True)
        return {"bin": np.concatenate([found, [-1, -2]]), "n": np.concatenate([counts, [below, total - below - counts.sum()]])}

    return fold


def _place(blocks: DataFrame, rank: Callable[[int], int]) -> tuple[int, float, float | None]:
    """(n, value, next): the number of distances, the one in place rank(n) from 0, and the one in the place after it.

    ``next`` is None where the last pass did not hold it.

    Passes over all pairs count distances in ever narrower bins, until the bin of place k has at most ``LISTED``, whose
    values are counted one by one. Each pass stands on its own counts; should place k have left the bin (another
    processor may round otherwise), the range moves.
    """
    low, last, shift = 0, ALL_BITS, 64 - HISTOGRAM_BITS
    while True:
        counted = over_pairs(blocks, _histogram(low, last, shift), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        got = {int(r["bin"]): int(r["n"]) for r in counted.collect()}
        del counted
        release(blocks.sparkSession)
        below, above = got.pop(-1, 0), got.pop(-2, 0)
        bins = np.array(sorted(got), np.int64)
        n = np.array([got[v] for v in bins.tolist()], np.int64)
        upto = below + np.cumsum(n)
        total = below + above + int(n.sum())
        if not total:
            return 0, math.nan, None
        k = rank(total)
        if k < below:
            low, last = 0, low - 1
        elif k >= total - above:
            low, last = last + 1, ALL_BITS
        else:
            at, follows = np.searchsorted(upto, [k, k + 1], side="right").tolist()
            if shift == 0:
                values = (bins.view(np.uint64) + np.uint64(low)).view(float).tolist()
                return total, values[at], values[follows] if follows < len(values) else None
            low, last = low + (int(bins[at]) << shift), min(last, low + (int(bins[at] + 1) << shift) - 1)
            if n[at] <= LISTED:
                shift = 0
                continue
        shift = max(0, (last - low).bit_length() - HISTOGRAM_BITS)


def pair_quantile(rows: DataFrame, q: float = 0.5) -> float | None:
    """The exact quantile of the distances of all pairs of rows (i, row), between two of them by its part; None without pairs."""
    blocks = pair_blocks(rows)
    n, a, b = _place(blocks, lambda n: math.floor((n - 1) * q))
    if not n:
        return None
    part = (n - 1) * q - math.floor((n - 1) * q)
    if part and b is None:
        b = _place(blocks, lambda n: math.floor((n - 1) * q) + 1)[1]
    return a + (b - a) * part if part and a != b else a


SORT_ROWS = 1 << 20


def hard_threshold(coo: DataFrame, card: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """The ``card`` entries of largest magnitude (ties by place); the rest are zero, so absent.

    At most ``sort_rows`` entries are sorted in one place. Beyond that the cut is narrowed by quantiles of what is open: what
    stands surely before it is kept where it is, and ties at one magnitude are cut by i and then by j in the same way. ``coo``
    is read once a step, so it should be a stored table.
    """
    keys = [-F.abs("v"), F.col("i"), F.col("j")]
    kept, band, need = F.lit(False), F.lit(True), card
    for key in keys:
        while True:
            rest = coo.where(band)
            edge = rest.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
            if need <= 0:
                return coo.where(kept).select("i", "j", "v")
            if edge["n"] <= need:
                return coo.where(kept | band).select("i", "j", "v")
            if edge["n"] <= sort_rows:
                last = rest.orderBy(*keys).limit(need).select("i", "j", "v")
                return coo.where(kept).select("i", "j", "v").unionByName(last)
            if edge["low"] == edge["high"]:
                break
            share, error = need / edge["n"], 2e-3
            ranks = [max(0.0, share - error), min(1.0, share + error)]
            low, high = rest.agg(F.percentile_approx(key, ranks, 1000).alias("q")).first()["q"]
            below, upto = rest.agg(F.count_if(key < low), F.count_if(key <= high)).first()
            if below > need or upto < need or (low == edge["low"] and high == edge["high"]):
                low, high = edge["low"], edge["low"] + (edge["high"] - edge["low"]) / 2  # quantiles too coarse: halve
                below, upto = 0, rest.agg(F.count_if(key <= high)).first()[0]
                if upto < need:
                    kept, need, band = kept | (band & (key <= high)), need - upto, band & (key > high)
                    continue
            kept, need, band = kept | (band & (key < low)), need - below, band & (key >= low) & (key <= high)
    return coo.where(kept | band).orderBy(*keys).limit(card).select("i", "j", "v")  # repeated places only


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def relative_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(error): Frobenius norm of a - b over that of a, for coordinate tables; absent entries are 0."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.agg((F.sqrt(F.sum((x - y) * (x - y))) / F.sqrt(F.sum(x * x))).alias("error"))


def kron(a: DataFrame, b: DataFrame, n2: int) -> DataFrame:
    """The Kronecker product of 1-based coordinate tables, b of order n2."""
    y = b.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("v").alias("v2"))
    return a.crossJoin(F.broadcast(y)).select(((F.col("i") - 1) * n2 + F.col("i2")).alias("i"), ((F.col("j") - 1) * n2 + F.col("j2")).alias("j"), (F.col("v") * F.col("v2")).alias("v"))
