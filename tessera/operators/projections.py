"""Random projections: two sparse Johnson-Lindenstrauss families, seven dense test matrices, distortion, learned maps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.hashing import gaussian, h32, key, md5_mod, sign, uniform
from tessera.functions.vectors import squared_norm
from tessera.operators import linalg


def sparse_dims(epsilon: float = 0.1, delta: float = 0.1) -> tuple[int, int]:
    """(k, s): target dimension and non-zeros a column of the first family."""
    k = max(1, int(8 * math.log(1 / delta) / epsilon**2))
    s = max(int(2 * math.log(1 / delta) / (2 * epsilon - epsilon**2)), int(4 * math.log(1 / delta) / epsilon))
    return k, min(k, s)


def sparse_dims_wide(epsilon: float = 0.1, delta: float = 0.1) -> tuple[int, int]:
    """(k, s) of the second family."""
    return max(10, int(20 * math.log(1 / delta) / epsilon**2)), max(2, int(4 * math.log(1 / delta) / epsilon))


def pairs_dim(n: int, epsilon: float = 0.5) -> int:
    return max(1, int(2 * math.log(n) / epsilon**2))


def block_matrix(spark: SparkSession, d: int, k: int, s: int, remainder: bool = False) -> DataFrame:
    """(r, j, v): each coordinate has one non-zero in each of s blocks, placed and signed by the digest of "j_b".

    ``remainder``: the last block takes what k leaves over (the second family); there s > k counts as k blocks of one.
    """
    if remainder and k < s:
        s = k
    width = k // s
    grid = spark.range(d).select(F.col("id").cast("int").alias("j")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(s - 1))))
    name = key(F.col("j"), F.col("b"))
    size = F.when(F.col("b") == s - 1, k - (s - 1) * width).otherwise(width) if remainder else F.lit(width)
    place = F.col("b") * width + md5_mod(name, size.cast("long"))
    low = h32(name, 3)  # bit 8 of the whole digest is in its last 32 bits
    signed = F.when(F.shiftright(low, 8) % 2 == 0, 1.0).otherwise(-1.0)
    return grid.select(place.cast("int").alias("r"), "j", (signed / math.sqrt(s)).alias("v"))


def graph_matrix(spark: SparkSession, d: int, k: int, s: int) -> DataFrame:
    """(r, j, v): s distinct rows a coordinate, those of smallest digest, with signs from the digest."""
    grid = spark.range(d).select(F.col("id").cast("int").alias("j")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    name = key(F.col("j"), F.col("r"))
    ranked = grid.withColumn("n", F.row_number().over(W.partitionBy("j").orderBy(F.md5(name), "r"))).where(F.col("n") <= min(s, k))
    return ranked.select("r", "j", (sign(name) / math.sqrt(s)).alias("v"))


def make_sparse(spark: SparkSession, d: int, epsilon: float = 0.1, delta: float = 0.1, construction: str = "block", wide: bool = False) -> tuple[DataFrame, int, int]:
    """(matrix, k, s) of a family and construction."""
    if construction not in ("block", "graph"):
        raise ValueError("construction must be 'block' or 'graph'")
    k, s = (sparse_dims_wide if wide else sparse_dims)(epsilon, delta)
    made = block_matrix(spark, d, k, s, wide) if construction == "block" else graph_matrix(spark, d, k, s)
    return made, k, s


def dense(matrix: DataFrame, d: int, k: int) -> np.ndarray:
    """The d x k transposed matrix on the driver; its size is that of the map, not of the data."""
    out = np.zeros((d, k))
    for r in matrix.collect():
        out[r["j"], r["r"]] += r["v"]
    return out


def transform(rows: DataFrame, matrix: DataFrame, d: int, k: int, out: str = "row") -> DataFrame:
    """Rows (i, row) mapped by a coordinate matrix (r, j, v)."""
    return linalg.times(rows, dense(matrix, d, k), out)


def column_sparsity(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("j").agg(F.count("*").alias("nnz"))


def sparsity(matrix: DataFrame, d: int, k: int) -> DataFrame:
    return matrix.agg((F.count("*") / (k * d)).alias("ratio"))


def norm_distortion(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """(i, distortion): squared norm after over before; 0 for a zero vector."""
    both = rows.select("i", squared_norm("row").alias("a")).join(mapped.select("i", squared_norm("row").alias("b")), "i")
    return both.select("i", F.when(F.col("a") > 0, F.col("b") / F.col("a")).otherwise(0.0).alias("distortion"))


def pair_distortion(both: DataFrame, epsilon: float) -> DataFrame:
    """Statistics of distance ratios over all pairs of rows (i, row, mapped), and the share beyond epsilon."""
    ratio = linalg.pairwise(both, vectors=("row", "mapped")).where("d0 > 0").select((F.col("d1") / F.col("d0")).alias("q"))
    return ratio.agg(F.count("*").alias("pairs"), F.avg("q").alias("mean_ratio"), F.min("q").alias("min_ratio"), F.max("q").alias("max_ratio"), F.avg((F.abs(F.col("q") - 1) > epsilon).cast("double")).alias("violations"))


KINDS = ("gaussian", "rademacher", "achlioptas", "sparse_jl", "srht", "srft", "block_sparse")
ALIASES = {"sparsejl": "sparse_jl", "sjlt": "sparse_jl", "fjlt": "srht", "blocksparse": "block_sparse"}


def kind_of(name: str) -> str:
    """The projection of a name or alias, whatever its case; ValueError for others."""
    found = ALIASES.get(name.lower(), name.lower())
    if found not in KINDS:
        raise ValueError(f"unknown projection: {name}")
    return found


def next_pow2(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def entries(spark: SparkSession, kind: str, n: int, rank: int, seed: int = 0) -> DataFrame:
    """(i, j, v) of an n x rank test matrix; every entry is a function of (seed, kind, i, j)."""
    kind = kind_of(kind)
    grid = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rank - 1))))
    name = key(seed, kind, F.col("i"), F.col("j"))
    if kind == "gaussian":
        return grid.select("i", "j", gaussian(name).alias("v"))
    if kind == "rademacher":
        return grid.select("i", "j", sign(name).cast("double").alias("v"))
    if kind == "achlioptas":
        u = uniform(name)
        return grid.select("i", "j", F.when(u < 1 / 6, math.sqrt(3)).when(u < 1 / 3, -math.sqrt(3)).otherwise(0.0).alias("v"))
    if kind == "sparse_jl":
        s = max(1, n // 50)
        order = W.partitionBy("j").orderBy(F.md5(name), "i")
        return grid.withColumn("n", F.row_number().over(order)).where(F.col("n") <= s).select("i", "j", (sign(name) / math.sqrt(s)).alias("v"))
    if kind == "block_sparse":
        width = min(256, n)
        start = F.floor(uniform(key(seed, kind, F.col("j"))) * (n - width + 1)).cast("int")
        return grid.withColumn("a", start).where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("a") + width)).select("i", "j", (sign(name) / math.sqrt(width)).alias("v"))
    size = next_pow2(n)
    pick = F.floor(uniform(key(seed, kind, "pick", F.col("j"))) * size).cast("int")
    flip = sign(key(seed, kind, "sign", F.col("i"))).cast("double")
    if kind == "srht":
        value = F.when(F.bit_count(F.col("i").bitwiseAND(pick)) % 2 == 0, flip).otherwise(-flip)
    else:
        value = flip * F.cos(2 * math.pi * F.col("i") * pick / size)
    return grid.select("i", "j", (value / math.sqrt(rank)).alias("v"))


def sample_matrix(spark: SparkSession, kind: str, n: int, rank: int, seed: int = 0) -> np.ndarray:
    return linalg.to_numpy(entries(spark, kind, n, rank, seed), (n, rank))


def project(rows: DataFrame, kind: str, n: int, rank: int, seed: int = 0) -> DataFrame:
    return linalg.times(rows, sample_matrix(rows.sparkSession, kind, n, rank, seed))


# ---- maps of dissimilarities


def synthetic_dissimilarity(points: DataFrame, kind: str = "simplex") -> DataFrame:
    """(i, j, v) of squared dissimilarities, both triangles and the zero diagonal, from rows (i, row).

    ``simplex``: squared distance plus half the fourth power of the last coordinates' difference; ``balls``: squared gap
    between balls whose radius is half the last coordinate's magnitude.
    """
    if kind not in ("simplex", "balls"):
        raise ValueError("kind must be 'simplex' or 'balls'")
    last = points.select(F.col("i").alias("x"), F.element_at("row", -1).alias("z"))
    pairs = linalg.pairwise(points).join(last.select(F.col("x").alias("a"), F.col("z").alias("za")), "a").join(last.select(F.col("x").alias("b"), F.col("z").alias("zb")), "b")
    if kind == "simplex":
        v = F.col("d0") * F.col("d0") + 0.5 * F.pow(F.col("za") - F.col("zb"), 4)
    else:
        v = F.pow(F.greatest(F.lit(0.0), F.col("d0") - F.abs("za") / 2 - F.abs("zb") / 2), 2)
    up = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), v.alias("v"))
    return up.unionByName(linalg.transpose(up)).unionByName(points.select("i", F.col("i").alias("j"), F.lit(0.0).alias("v")))


def _square(d: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A dissimilarity table on the driver: for a few thousand objects, as their eigenvectors need."""
    ids = sorted(r["i"] for r in d.select("i").distinct().collect())
    at = {x: k for k, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in d.collect():
        out[at[r["i"]], at[r["j"]]] = r["v"]
    return out, ids


def _gaussian_map(rows: int, k: int, seed: str) -> np.ndarray:
    import hashlib

    def unit(i, j, c):
        return (int(hashlib.md5(f"{seed}_{i}_{j}".encode()).hexdigest()[8 * c : 8 * c + 8], 16) + 0.5) / 4294967296.0

    u = np.array([[[unit(i, j, c) for c in (0, 1)] for j in range(k)] for i in range(rows)]).reshape(rows, k, 2)
    return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1]) / math.sqrt(k)


def pseudo_euclidean(d: DataFrame, epsilon: float = 0.5, seed: int = 0) -> tuple[DataFrame, tuple[int, int], dict]:
    """Rows (i, row) with k positive and k negative dimensions, the signature (k, k) and the counts of eigenvalues.

    The positive and the negative eigenspaces are scaled by the root of the eigenvalues and projected on their own.
    """
    square, ids = _square(d)
    gram, _ = _square(linalg.double_center(d))
    del square
    values, vectors = np.linalg.eigh(gram)
    k = pairs_dim(len(ids), epsilon)
    parts, counts = [], {}
    for name, mask in (("positive", values > 1e-10), ("negative", values < -1e-10)):
        x = vectors[:, mask] * np.sqrt(np.abs(values[mask]))
        counts[name] = int(mask.sum())
        parts.append(x @ _gaussian_map(x.shape[1], k, f"{seed}_{name}") if x.shape[1] else np.zeros((len(ids), k)))
    points = np.hstack(parts)
    out = d.sparkSession.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, points, strict=True)], "i long, row array<double>")
    return out, (k, k), counts


def power_distance(d: DataFrame, epsilon: float = 0.5, seed: int = 0) -> tuple[DataFrame, float]:
    """Rows (i, row) and the radius: D + 4 r^2 (J - I) is Euclidean for r = sqrt(|least eigenvalue| / 2)."""
    gram, ids = _square(linalg.double_center(d))
    least = float(np.linalg.eigvalsh(gram)[0])
    radius = math.sqrt(abs(least) / 2) if least < 0 else 0.0
    lifted = d.withColumn("v", F.when(F.col("i") != F.col("j"), F.col("v") + 4 * radius**2).otherwise(F.col("v")))
    gram, _ = _square(linalg.double_center(lifted))
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-10
    x = vectors[:, keep] * np.sqrt(values[keep])
    points = x @ _gaussian_map(x.shape[1], pairs_dim(len(ids), epsilon), f"{seed}_power")
    return d.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, points, strict=True)], "i long, row array<double>"), radius


def preservation(original: DataFrame, embedded: DataFrame, o: Column, e: Column) -> DataFrame:
    """Relative errors |o - e| / (o + 1e-10) of distances joined by (a, b)."""
    err = original.join(embedded, ["a", "b"]).select((F.abs(o - e) / (o + 1e-10)).alias("x"))
    return err.agg(F.max("x").alias("max_error"), F.avg("x").alias("mean_error"), F.stddev_pop("x").alias("std_error"))


def map_preservation(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The errors of ``preservation`` over the distances of all pairs of rows (i, row) and of their images under a d x k matrix.

    A pair of blocks gives one row: number, mean, sum of squares about it and maximum.
    """

    def fold(tiles) -> dict:
        n, mean, m2, top = 0, 0.0, 0.0, []
        with np.errstate(invalid="ignore"):
            for o, e in tiles:
                if len(o):
                    x = np.abs(o - e) / (o + 1e-10)
                    here = x.mean()
                    m2 += ((x - here) ** 2).sum() + (here - mean) ** 2 * n * len(x) / (n + len(x))
                    n += len(x)
                    mean += (here - mean) * len(x) / n
                    top.append(x.max())
            return {"n": [n], "mean": [mean], "m2": [m2], "top": [np.max(top)]} if n else {c: [] for c in ("n", "mean", "m2", "top")}

    parts = linalg.over_pairs(linalg.pair_blocks(rows), fold, "n long, mean double, m2 double, top double", (None, matrix))
    all_ = parts.agg(F.sum("n").alias("n"), F.max("top").alias("max_error"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_error"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    spread = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean_error")) * (p["mean"] - F.col("mean_error")))
    return all_.select("max_error", "mean_error", F.sqrt(spread / F.col("n")).alias("std_error"))


# ---- learned maps


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its series below a + 1 and a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    lg = np.vectorize(math.lgamma, otypes=[float])(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(np.where(x > 0, a * np.log(x) - x - lg, -np.inf))
    low = (x > 0) & (x < a + 1)
    term = total = 1 / a
    for n in range(1, 400):
        term = term * x / (a + n)
        total = total + term
        if np.all(term[low] < total[low] * 1e-14):
            break
    out[low] = (front * total)[low]
    high = x >= a + 1
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full_like(b, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 400):
            an = -n * (n - aa)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1)


def violation(mapped: np.ndarray, var: float, k: int, epsilon: float) -> np.ndarray:
    """Chance that a squared norm leaves (1 -+ epsilon) when the map has this mean image (squared norm) and variance."""
    df = k + 2 * mapped / max(var, 1e-12)
    scale = max(var, 1e-12) / k
    inside = gamma_p(df / 2, (1 + epsilon) / scale / 2) - gamma_p(df / 2, (1 - epsilon) / scale / 2)
    return np.minimum(1.0, 1 - inside)


def learn_map(rows: DataFrame, d: int, k: int, epsilon: float | None = None, steps: int = 30, rate: float = 0.01, seed: int = 0) -> tuple[np.ndarray, float, list[dict]]:
    """(mean matrix k x d, variance, history) that minimise the summed chance of violation plus half the variance.

    The objective sees the matrix through the squared norms n_x of its images, so its gradient is 2 M sum_x f'(n_x) x x':
    a weighted Gram matrix, one pass of partial sums a step. The start is a small hash-Gaussian matrix: at zero the
    gradient vanishes.
    """
    n = rows.count()
    eps = math.sqrt(math.log(max(n, 2)) / k) if epsilon is None else epsilon
    m = 0.1 * _gaussian_map(k, d, f"{seed}_learn")
    var, history = 1.0, []

    def step(m: np.ndarray, var: float):
        def run(batches):
            total, gram, slope = 0.0, np.zeros((d, d)), 0.0
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["row"].to_numpy())
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                image = ((x @ m.T) ** 2).sum(1)
                f = violation(image, var, k, eps)
                h = 1e-4
                df = (violation(image + h, var, k, eps) - violation(np.maximum(image - h, 0), var, k, eps)) / (2 * h)
                total += f.sum()
                slope += ((violation(image, var + h, k, eps) - violation(image, max(var - h, 1e-6), k, eps)) / (2 * h)).sum()
                gram += (x * df[:, None]).T @ x
            yield pd.DataFrame({"j": np.arange(d * d + 2), "v": np.concatenate([[total, slope], gram.ravel()])})

        got = {r["j"]: r["v"] for r in rows.select("row").mapInPandas(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
        return got[0], got[1], np.array([got[j + 2] for j in range(d * d)]).reshape(d, d)

    for t in range(steps):
        total, slope, gram = step(m, var)
        grad, grad_var = 2 * m @ gram / n, slope / n + 0.5
        size = math.sqrt(float((grad**2).sum()) + grad_var**2)
        history.append({"step": t, "objective": total + var / 2, "gradient": size, "variance": var, "norm": float(np.linalg.norm(m))})
        if size < 1e-4 and var < 1e-3:
            break
        m = m - rate * grad * k
        var = max(1e-6, var - rate * grad_var)
    return m, var, history


def max_distortion(rows: DataFrame, matrices: dict[int, np.ndarray]) -> DataFrame:
    """(trial, distortion): the largest | |Mx|^2 / k - |x|^2 | of each d x k matrix, all trials in one pass."""

    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["row"].to_numpy())
                base = (x**2).sum(1)
                rows = [(t, float(np.abs(((x @ m) ** 2).sum(1) / m.shape[1] - base).max())) for t, m in matrices.items()]
                yield pd.DataFrame(rows, columns=["trial", "distortion"])

    return rows.select("row").mapInPandas(run, "trial long, distortion double").groupBy("trial").agg(F.max("distortion").alias("distortion"))
