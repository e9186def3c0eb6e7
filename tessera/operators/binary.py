"""Binary matrix factorization: D = T A with T of zeros and ones. Enumeration is spread over rows, linear algebra is small."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import literal_matrix, squared_distance


def patterns(spark: SparkSession, r: int) -> DataFrame:
    """(u, bits): all 0/1 vectors of length r in lexicographic order."""
    return spark.range(1 << r).select(F.col("id").alias("u"), F.transform(F.sequence(F.lit(r - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", F.col("id"), k).bitwiseAND(F.lit(1)).cast("int")).alias("bits"))


def _pivots(m: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns of a maximal independent set, by Gram-Schmidt with pivoting."""
    rest, out = m.astype(float).copy(), []
    scale = max(1.0, float(np.abs(m).max(initial=0)))
    while len(out) < min(m.shape):
        norms = np.linalg.norm(rest, axis=0)
        k = int(norms.argmax())
        if norms[k] <= tol * scale * max(m.shape):
            break
        q = rest[:, k] / norms[k]
        out.append(k)
        rest -= np.outer(q, q @ rest)
    return out


def _combine(r: int) -> np.ndarray:
    return np.array([[(u >> (r - 1 - k)) & 1 for k in range(r)] for u in range(1 << r)], float)


def exact_vertices(spark: SparkSession, d: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """The binary points of the affine hull of the columns of ``d``, as columns in lexicographic order.

    An affine point is fixed by its values in rank many rows, and those are 0 or 1: 2**rank candidates, tried in parallel.
    """
    p = d[:, :1]
    centred = d - p
    cols = _pivots(centred)
    r = len(cols)
    if r == 0:
        return p[:, :1].astype(int) if np.all((np.abs(p) < tol) | (np.abs(p - 1) < tol)) else np.zeros((len(d), 0), int)
    rows = _pivots(centred[:, cols].T)
    z = centred[:, cols] @ np.linalg.inv(centred[np.ix_(rows, cols)])
    base = p[:, 0]
    if r > 24:
        return _bounded_vertices(z, base, rows)

    def run(batches):
        for b in batches:
            u = (b["id"].to_numpy()[:, None] >> np.arange(r - 1, -1, -1)) & 1
            x = (u - base[rows]) @ z.T + base
            ok = ((np.abs(x) < 1e-8) | (np.abs(x - 1) < 1e-8)).all(1)
            if ok.any():
                yield pd.DataFrame({"v": [[int(round(c)) for c in row] for row in x[ok]]})

    found = spark.range(0, 1 << r, 1, max(1, (1 << r) >> 12)).mapInPandas(run, "v array<int>").distinct().collect()
    return np.array(sorted(tuple(f["v"]) for f in found), int).reshape(len(found), len(d)).T


def _bounded_vertices(z: np.ndarray, base: np.ndarray, rows: list[int]) -> np.ndarray:
    """The same points as an integer programme, by fixing one value at a time: a branch ends where a coordinate can reach
    neither 0 nor 1 any more."""
    shift = base - z @ base[rows]
    weight = -np.sort(-np.abs(z), axis=0).sum(0)
    order = np.argsort(-weight)
    low = np.concatenate([np.cumsum(np.minimum(z[:, order], 0)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(z), 1))], 1)
    high = np.concatenate([np.cumsum(np.maximum(z[:, order], 0)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(z), 1))], 1)
    found, stack = [], [(0, shift)]
    while stack:
        k, x = stack.pop()
        least, most = x + low[:, k] - 1e-8, x + high[:, k] + 1e-8
        if not (((least <= 0) & (most >= 0)) | ((least <= 1) & (most >= 1))).all():
            continue
        if k == len(order):
            found.append(tuple(int(round(v)) for v in x))
            continue
        stack += [(k + 1, x), (k + 1, x + z[:, order[k]])]
    return np.array(sorted(set(found)), int).reshape(len(set(found)), len(z)).T


def factor_exact(spark: SparkSession, d: np.ndarray, affine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(T, A) with d = T A, columns of A summing to one if ``affine``; ValueError without binary points."""
    v = exact_vertices(spark, d)
    if not v.shape[1]:
        raise ValueError("no binary vertices")
    lifted = np.vstack([v, np.ones(v.shape[1])]) if affine else v
    t = v[:, _pivots(lifted)]
    left = np.vstack([t, np.ones(t.shape[1])]) if affine else t
    right = np.vstack([d, np.ones(d.shape[1])]) if affine else d
    return t, np.linalg.lstsq(left, right, rcond=None)[0]


def approximate_vertices(spark: SparkSession, d: np.ndarray, r: int) -> np.ndarray:
    """r binary columns nearest to the affine hull of the best rank r-1 fit: candidates rounded and ranked by distance."""
    mean = d.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(d - mean, full_matrices=False)
    k = max(1, min(r - 1, int((s > 1e-12).sum())))
    basis = u[:, :k]
    rows = _pivots(basis.T)
    z = basis @ np.linalg.inv(basis[rows])
    base = mean[:, 0]

    def run(batches):
        for b in batches:
            bits = (b["id"].to_numpy()[:, None] >> np.arange(k - 1, -1, -1)) & 1
            x = (bits - base[rows]) @ z.T + base
            whole = (x > 0.5).astype(int)
            yield pd.DataFrame({"u": b["id"], "v": whole.tolist(), "delta": np.linalg.norm(x - whole, axis=1)})

    made = spark.range(0, 1 << k, 1, max(1, (1 << k) >> 12)).mapInPandas(run, "u long, v array<int>, delta double")
    best = made.groupBy("v").agg(F.min(F.struct("delta", "u")).alias("m")).orderBy("m").limit(r).collect()
    return np.array([b["v"] for b in best], int).T


def project_simplex(x: np.ndarray) -> np.ndarray:
    """Columns projected on the probability simplex."""
    s = -np.sort(-x, axis=0)
    c = (np.cumsum(s, 0) - 1) / np.arange(1, len(x) + 1)[:, None]
    k = (s > c).sum(0) - 1
    return np.maximum(x - c[k, np.arange(x.shape[1])], 0)


def solve_weights(t: np.ndarray, d: np.ndarray, nonnegative: bool = False, simplex: bool = False, steps: int = 2000) -> np.ndarray:
    """A of least ||d - t A||, free, non-negative or with columns on the simplex, by accelerated projected gradient."""
    a = np.linalg.lstsq(t.astype(float), d, rcond=None)[0]
    if not (nonnegative or simplex):
        return a
    project = project_simplex if simplex else (lambda x: np.maximum(x, 0))
    gram, right = t.T @ t, t.T @ d
    rate = 1 / max(np.linalg.norm(gram, 2), 1e-12)
    a = y = project(a)
    k = 1.0
    for _ in range(steps):
        new = project(y - rate * (gram @ y - right))
        nk = (1 + math.sqrt(1 + 4 * k * k)) / 2
        y = new + (k - 1) / nk * (new - a)
        if np.abs(new - a).max() < 1e-12:
            break
        a, k = new, nk
    return new


def assign(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(i, u, loss): for each row (i, row) the 0/1 pattern u of least squared error against pattern times ``weights``.

    Each row is compared with all patterns where it is: as array expressions for few patterns, in Arrow batches for many.
    """
    fits = _combine(len(weights)) @ weights
    if fits.size <= 1024:
        loss = F.transform(literal_matrix(fits), lambda f, u: F.struct(F.round(squared_distance("row", f), 12).alias("loss"), u.cast("long").alias("u")))
        return rows.select("i", F.array_min(loss).alias("m")).select("i", "m.u", "m.loss")

    def run(batches):
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.iloc[s : s + 256]
                x = np.stack(part["row"].to_numpy())
                loss = np.full(len(x), np.inf)
                best = np.zeros(len(x), np.int64)
                for t in range(0, len(fits), 4096):
                    d = np.round(((x[:, None, :] - fits[t : t + 4096][None]) ** 2).sum(2), 12)
                    at = d.argmin(1)
                    less = d[np.arange(len(x)), at] < loss
                    loss[less], best[less] = d[np.arange(len(x)), at][less], at[less] + t
                yield pd.DataFrame({"i": part["i"], "u": best, "loss": loss})

    return rows.select("i", "row").mapInPandas(run, "i long, u long, loss double")


def block_optimise(rows: DataFrame, r: int, t: np.ndarray, max_iter: int = 20, tol: float = 1e-8, nonnegative: bool = False, simplex: bool = False) -> tuple[DataFrame, np.ndarray, list[float]]:
    """((i, u, loss), A, losses): alternates weights from sums over rows with the exhaustive assignment of rows."""
    losses: list[float] = []
    local = {x["i"]: x["row"] for x in rows.select("i", "row").limit(1).collect()}
    d = len(next(iter(local.values())))
    table = None
    current = rows.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(t.tolist())], "i long, t array<double>")
    weights = np.zeros((r, d))
    for _ in range(max_iter):

        def sums(batches):
            tt, td = np.zeros((r, r)), np.zeros((r, d))
            for b in batches:
                if len(b):
                    x, y = np.stack(b["t"].to_numpy()), np.stack(b["row"].to_numpy())
                    tt += x.T @ x
                    td += x.T @ y
            yield pd.DataFrame({"j": np.arange(r * r + r * d), "v": np.concatenate([tt.ravel(), td.ravel()])})

        got = {x["j"]: x["v"] for x in rows.join(current, "i").select("row", "t").mapInPandas(sums, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([got[j] for j in range(r * r + r * d)])
        gram, right = flat[: r * r].reshape(r, r), flat[r * r :].reshape(r, d)
        values, vectors = np.linalg.eigh(gram)
        root = (vectors * np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
        weights = solve_weights(root, np.linalg.solve(root, right), nonnegative, simplex)
        table = assign(rows, weights)
        losses.append(table.agg(F.sum("loss").alias("s")).first()["s"])
        bits = patterns(rows.sparkSession, r)
        current = table.join(F.broadcast(bits), "u").select("i", F.col("bits").cast("array<double>").alias("t"))
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) < tol:
            break
    return table, weights, losses


def factor_approximate(rows: DataFrame, r: int, refine: bool = True, nonnegative: bool = False, simplex: bool = False) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Approximate factors of a row table with few columns' worth of rows on the driver for the starting vertices only."""
    collected = {x["i"]: x["row"] for x in rows.collect()}
    order = sorted(collected)
    t = approximate_vertices(rows.sparkSession, np.array([collected[i] for i in order], float), r)
    if t.shape[1] < r:
        r = t.shape[1]
    return block_optimise(rows, r, t, 20 if refine else 1, 1e-8, nonnegative, simplex)


def match_columns(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each column of a the column of b it is matched with, one to one, of greatest summed correlation (few columns)."""
    n = a.shape[1]
    return match(np.nan_to_num(np.corrcoef(a.T, b.T)[:n, n:]))


def correlations(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """left x right correlations of columns, from one aggregate."""
    row = df.agg(*(F.corr(x, y).alias(f"c_{i}_{j}") for i, x in enumerate(left) for j, y in enumerate(right))).first()
    return np.nan_to_num(np.array([[row[f"c_{i}_{j}"] for j in range(len(right))] for i in range(len(left))], float))


def match(gain: np.ndarray) -> list[int]:
    """For each row of a gain matrix its column, one to one, of greatest sum; over the sets of columns in use."""
    n = len(gain)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(n):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (score, chosen) in best.items():
            for j in range(gain.shape[1]):
                if not used >> j & 1:
                    s = (score + gain[i, j], [*chosen, j])
                    key = used | 1 << j
                    if key not in nxt or s[0] > nxt[key][0]:
                        nxt[key] = s
        best = nxt
    return max(best.values())[1]
