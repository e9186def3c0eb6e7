"""Gaussian processes, kernel search and black-box minimisation: one candidate a group, side by side on the executors."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import kernels as Kn
from tessera.functions.hashing import key, uniform
from tessera.operators import linalg
from tessera.operators.sensing import normal_cdf


@dataclass
class GaussianProcess:
    """Exact regression for a few thousand points: Cholesky factor of K + noise I, jitter raised tenfold until it exists."""

    kernel: Kn.Kernel
    noise: float = 0.1
    x: np.ndarray | None = None
    y: np.ndarray | None = None
    factor: np.ndarray | None = None
    alpha: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        k = self.kernel.matrix(self.x, self.x) + self.noise * np.eye(len(self.y))
        jitter = 1e-6
        for _ in range(10):
            try:
                self.factor = np.linalg.cholesky(k + jitter * np.eye(len(k)))
                break
            except np.linalg.LinAlgError:
                jitter *= 10
        else:
            values, vectors = np.linalg.eigh(k)
            self.factor = np.linalg.cholesky((vectors * np.maximum(values, 1e-6)) @ vectors.T + 1e-8 * np.eye(len(k)))
        self.alpha = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, self.y))
        return self

    def predict(self, x: np.ndarray, kernel: Kn.Kernel | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance (1e-10 at least), of the whole process or of one additive component."""
        k = (kernel or self.kernel).matrix(np.asarray(x, float), self.x)
        v = np.linalg.solve(self.factor, k.T)
        own = np.array([(kernel or self.kernel).matrix(p[None], p[None])[0, 0] for p in np.asarray(x, float)])
        return k @ self.alpha, np.maximum(own - (v**2).sum(0), 1e-10)

    def evidence(self) -> float:
        n = len(self.y)
        return float(-0.5 * self.y @ self.alpha - np.log(np.diag(self.factor)).sum() - 0.5 * n * math.log(2 * math.pi))

    def bic(self) -> float:
        return -2 * self.evidence() + (len(self.kernel.get()) + 1) * math.log(len(self.y))

    def optimise(self, start: np.ndarray, steps: int = 40) -> float:
        """Quasi-Newton ascent of the evidence in the log-parameters and log-noise, with central differences."""

        def loss(p: np.ndarray) -> float:
            if np.abs(p).max() > 12:
                return 1e10
            self.kernel.set(p[:-1])
            self.noise = math.exp(p[-1])
            try:
                value = -self.fit(self.x, self.y).evidence()
            except (np.linalg.LinAlgError, FloatingPointError, OverflowError):
                return 1e10
            return value if math.isfinite(value) else 1e10

        def slope(p: np.ndarray) -> np.ndarray:
            e = 1e-4 * np.eye(len(p))
            return np.array([(loss(p + d) - loss(p - d)) / 2e-4 for d in e])

        p = np.asarray(start, float)
        best, g, h = loss(p), slope(p), np.eye(len(p))
        for _ in range(steps):
            move = -h @ g
            size = np.linalg.norm(move)
            move = move if size <= 1 else move / size
            t = 1.0
            while t > 1e-4 and loss(p + t * move) > best - 1e-4 * t * abs(float(g @ move)):
                t /= 2
            if t <= 1e-4:
                break
            s = t * move
            p = p + s
            new, ng = loss(p), slope(p)
            y = ng - g
            if (sy := float(s @ y)) > 1e-10:
                i = np.eye(len(p))
                h = (i - np.outer(s, y) / sy) @ h @ (i - np.outer(y, s) / sy) + np.outer(s, s) / sy
            if best - new < 1e-5:
                best, g = new, ng
                break
            best, g = new, ng
        self.kernel.set(p[:-1])
        self.noise = math.exp(p[-1])
        self.fit(self.x, self.y)
        return best


def fit_all(spark: SparkSession, kernels: list[Kn.Kernel], x: np.ndarray, y: np.ndarray, restarts: int = 2, steps: int = 30, noise: float = 0.1) -> list[dict]:
    """The best fit of each kernel: one task a kernel and restart; starts are the kernel's own parameters, then shaken ones."""
    data = spark.sparkContext.broadcast((np.asarray(x, float), np.asarray(y, float)))
    jobs = spark.createDataFrame([(k, r, bytearray(pickle.dumps(kernel))) for k, kernel in enumerate(kernels) for r in range(restarts + 1)], "k int, r int, kernel binary")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        kernel = pickle.loads(row["kernel"])
        xs, ys = data.value
        gp = GaussianProcess(kernel, noise).fit(xs, ys)
        start = np.array([*kernel.get(), math.log(noise)])
        if row["r"]:
            start = start + 0.5 * np.random.default_rng([int(row["k"]), int(row["r"])]).standard_normal(len(start))
        loss = gp.optimise(start, steps)
        return pd.DataFrame({"k": [row["k"]], "r": [row["r"]], "loss": [loss], "bic": [gp.bic()], "noise": [gp.noise], "kernel": [pickle.dumps(kernel)]})

    done = jobs.groupBy("k", "r").applyInPandas(run, "k int, r int, loss double, bic double, noise double, kernel binary")
    best = done.groupBy("k").agg(F.min_by(F.struct("loss", "bic", "noise", "kernel"), F.struct("loss", "r")).alias("b"))
    return [{"kernel": pickle.loads(bytes(r["b"]["kernel"])), "loss": r["b"]["loss"], "bic": r["b"]["bic"], "noise": r["b"]["noise"]} for r in best.orderBy("k").collect()]


def expansions(kernel: Kn.Kernel, dims: int = 1) -> list[Kn.Kernel]:
    """Sums and products of a kernel with every base kernel of every dimension."""
    bases = [f(dim=d) for d in range(dims) for f in (Kn.SquaredExponential.of, Kn.Periodic.of, Kn.Linear.of, Kn.RationalQuadratic.of)]
    return [op for b in bases for op in (kernel.copy() + b.copy(), kernel.copy() * b.copy())]


def search(spark: SparkSession, x: np.ndarray, y: np.ndarray, depth: int = 2, restarts: int = 1, steps: int = 20) -> tuple[dict, list[dict]]:
    """(best, history): greedy growth of a kernel by BIC, a job a depth; stops where no expansion is better."""
    dims = np.asarray(x).shape[1]
    candidates = [f(dim=d) for d in range(dims) for f in (Kn.SquaredExponential.of, Kn.Periodic.of, Kn.Linear.of, Kn.RationalQuadratic.of)]
    best, history = None, []
    for level in range(depth):
        found = min(fit_all(spark, candidates, x, y, restarts, steps), key=lambda f: f["bic"])
        history.append({"depth": level, "kernel": str(found["kernel"]), "bic": found["bic"]})
        if best is not None and found["bic"] >= best["bic"]:
            break
        best = found
        candidates = expansions(best["kernel"], dims)
    return best, history


def decompose(gp: GaussianProcess, x: np.ndarray) -> list[tuple[int, str, float, float, float]]:
    """(component number, kernel, x, mean, deviation) of every additive component at the first coordinate of x."""
    out = []
    for c, kernel in enumerate(gp.kernel.components()):
        mean, var = gp.predict(x, kernel)
        out += [(c, str(kernel), float(p[0]), float(m), float(math.sqrt(v))) for p, m, v in zip(x, mean, var, strict=True)]
    return out


def sample_prior(kernel: Kn.Kernel, x: np.ndarray, normals: np.ndarray, jitter: float = 1e-6) -> np.ndarray:
    """points x draws: the factor of the kernel matrix times independent standard normals of that shape."""
    return np.linalg.cholesky(kernel.matrix(x, x) + jitter * np.eye(len(x))) @ normals


def prior_table(spark: SparkSession, kernel: Kn.Kernel, x: np.ndarray, n: int, seed: int = 0) -> DataFrame:
    """(i, draw, y) of n draws at a few points; normals are functions of (seed, point, draw)."""
    from tessera.functions.hashing import gaussian, key

    grid = spark.range(len(x) * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("draw"))
    z = np.zeros((len(x), n))
    for r in grid.select("i", "draw", gaussian(key("prior", seed, F.col("i"), F.col("draw"))).alias("z")).collect():  # points x draws
        z[r["i"], r["draw"]] = r["z"]
    y = sample_prior(kernel, x, z)
    return spark.createDataFrame([(i, t, float(y[i, t])) for i in range(len(x)) for t in range(n)], "i int, draw int, y double")


# ---- kernels between the rows of a table


def gram(points: DataFrame, kernel: Kn.Kernel) -> DataFrame:
    """(a, b, k) for all ordered pairs of rows (i, row): a stated square, block by block in the join."""
    a, b = points.select(F.col("i").alias("a"), F.col("row").alias("x")), points.select(F.col("i").alias("b"), F.col("row").alias("y"))
    return a.crossJoin(b).select("a", "b", kernel.column(F.col("x"), F.col("y")).alias("k"))


def frobenius(points: DataFrame, kernel: Kn.Kernel, other: Kn.Kernel) -> DataFrame:
    """(distance) between two kernel matrices over the rows."""
    d = gram(points, kernel).withColumnRenamed("k", "k1").join(gram(points, other).withColumnRenamed("k", "k2"), ["a", "b"])
    return d.agg(F.sqrt(F.sum((F.col("k1") - F.col("k2")) * (F.col("k1") - F.col("k2")))).alias("distance"))


def predict_table(points: DataFrame, gp: GaussianProcess) -> DataFrame:
    """(i, mean, std) for rows (i, row): the fitted process is broadcast, its size is that of the training points."""
    held = points.sparkSession.sparkContext.broadcast(gp)

    def run(batches):
        for b in batches:
            if len(b):
                mean, var = held.value.predict(np.stack(b["row"].to_numpy()))
                yield pd.DataFrame({"i": b["i"], "mean": mean, "std": np.sqrt(var)})

    return points.select("i", "row").mapInPandas(run, "i long, mean double, std double")


def zscore(df: DataFrame, value: str) -> DataFrame:
    stats = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def seasonal_series(spark: SparkSession, n: int, trend: float, season: float, period: float, growth: float = 0.0) -> DataFrame:
    """(t, y): a line plus a sine whose height may grow."""
    t = F.col("id").cast("double")
    return spark.range(n).select(t.alias("t"), (trend * t + season * (1 + growth * t) * F.sin(2 * math.pi * t / period)).alias("y"))


# ---- black-box minimisation


def expected_improvement(mean: Column, std: Column, best: float | Column, xi: float = 0.01) -> Column:
    """Of a smaller value; 0 where the deviation is."""
    gain = best - mean - xi
    z = gain / std
    pdf = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return F.when(std < 1e-10, 0.0).otherwise(gain * normal_cdf(z) + std * pdf)


def latin_hypercube(spark: SparkSession, n: int, bounds: list[tuple[float, float]], seed: int = 0) -> DataFrame:
    """(i, x): in every dimension one point in each of n equal cells, in an order drawn by digests."""
    grid = spark.range(n).select(F.col("id").alias("i")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1))))
    name = key(seed, F.col("d"), F.col("i"))
    cell = F.row_number().over(W.partitionBy("d").orderBy(F.md5(name), "i")) - 1
    low = F.element_at(F.array(*(F.lit(float(a)) for a, _ in bounds)), F.col("d") + 1)
    high = F.element_at(F.array(*(F.lit(float(b)) for _, b in bounds)), F.col("d") + 1)
    placed = grid.withColumn("v", low + (cell + uniform(key("u", name))) / n * (high - low))
    return placed.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda e: e["v"]).alias("x"))


def length_scale(points: DataFrame) -> DataFrame:
    """(length): the median distance of all pairs; null if there are none."""
    return points.sparkSession.createDataFrame([(linalg.pair_quantile(points),)], "length double")


@dataclass
class Settings:
    budget: int = 30
    initial: int = 10
    candidates: int = 500
    kernels: int = 12
    interval: int = 10
    noise: float = 1e-4
    seed: int = 0
    fixed: bool = False
    history: list[dict] = field(default_factory=list)


def latent(codes: np.ndarray, evidences: np.ndarray, k: int = 2) -> np.ndarray:
    """Kernels in a plane: code and evidence, standardised, on their first principal directions."""
    x = np.hstack([codes, evidences[:, None]]).astype(float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    return x @ v[:k].T


def minimise(spark: SparkSession, f: Callable[[np.ndarray], float], bounds: list[tuple[float, float]], s: Settings) -> tuple[np.ndarray, float, list[dict]]:
    """(point, value, history): Latin hypercube, then expected improvement under a Gaussian process.

    Every ``interval`` evaluations the kernel is chosen anew, by evidence over a space of sum-of-product kernels, all fitted
    side by side; ``fixed`` keeps the squared exponential.
    """
    start = latin_hypercube(spark, s.initial, bounds, s.seed).orderBy("i").collect()
    x = np.array([r["x"] for r in start])
    y = np.array([f(p) for p in x])
    codes = Kn.kernel_space(s.kernels, s.seed)
    first = x[:20]
    scale = float(np.median(np.linalg.norm(first[:, None] - first[None], axis=2)[np.triu_indices(len(first), 1)])) or 1.0
    kernel, name, history = Kn.base("SE", scale), "SE", []
    low, width = np.array([b[0] for b in bounds]), np.array([b[1] - b[0] for b in bounds])
    while len(y) < s.budget:
        z = (y - y.mean()) / (y.std() or 1.0)
        if not s.fixed and (len(y) - s.initial) % s.interval == 0:
            evidences = _evidences(spark, codes, scale, x, z, s.noise)
            if np.isfinite(evidences).any():
                pick = int(np.nanargmax(np.where(np.isfinite(evidences), evidences, -np.inf)))
                kernel, name = Kn.from_code(codes[pick], scale), str(Kn.from_code(codes[pick]))
        gp = GaussianProcess(kernel, s.noise).fit(x, z)
        u = np.random.default_rng([s.seed, len(y)]).random((s.candidates, len(bounds)))
        cand = low + u * width
        mean, var = gp.predict(cand)
        std = np.sqrt(var)
        gain = z.min() - mean - 0.01
        q = gain / std
        phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in q])
        ei = np.where(std < 1e-10, 0, gain * phi + std * np.exp(-0.5 * q**2) / math.sqrt(2 * math.pi))
        point = cand[int(ei.argmax())]
        x, y = np.vstack([x, point]), np.append(y, f(point))
        history.append({"query": len(y), "best": float(y.min()), "kernel": name})
    best = int(y.argmin())
    return x[best], float(y[best]), history


def _evidences(spark: SparkSession, codes, scale: float, x: np.ndarray, y: np.ndarray, noise: float) -> np.ndarray:
    data = spark.sparkContext.broadcast((x, y))
    rows = spark.createDataFrame([(i, list(c)) for i, c in enumerate(codes)], "i long, code array<int>").repartition(max(1, min(len(codes), 64)), "i")

    def run(batches):
        for b in batches:
            out = []
            for code in b["code"]:
                gp = GaussianProcess(Kn.from_code(code, scale), noise).fit(*data.value)
                out.append(gp.evidence() / len(data.value[1]))
            yield pd.DataFrame({"i": b["i"], "e": out})

    got = {r["i"]: r["e"] for r in rows.mapInPandas(run, "i long, e double").collect()}
    return np.array([got[i] for i in range(len(codes))], float)
