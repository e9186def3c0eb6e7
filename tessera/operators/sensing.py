"""Sparse signal recovery: denoisers as expressions, message passing by joins, one-bit measurements."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import gaussian, key, uniform


def soft_threshold(r: Column, tau: Column | float) -> Column:
    return F.signum(r) * F.greatest(F.abs(r) - tau, F.lit(0.0))


def soft_derivative(r: Column, tau: Column | float) -> Column:
    return F.when(F.abs(r) > tau, 1.0).otherwise(0.0)


def gauss_bernoulli(r: Column, var: Column | float, rho: float, sigma_x: float = 1.0) -> Column:
    """Posterior mean under (1 - rho) at zero plus rho times N(0, sigma_x^2), seen through noise of variance ``var``."""
    v = F.lit(var) if isinstance(var, (int, float)) else var
    total = v + sigma_x**2
    odds = math.log(rho / (1 - rho)) + 0.5 * F.ln(v / total) + 0.5 * r * r * (1 / v - 1 / total)
    weight = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))
    return weight * r * sigma_x**2 / total


def gauss_bernoulli_derivative(r: Column, var: Column | float, rho: float, sigma_x: float = 1.0, eps: float = 1e-6) -> Column:
    return (gauss_bernoulli(r + eps, var, rho, sigma_x) - gauss_bernoulli(r - eps, var, rho, sigma_x)) / (2 * eps)


def bernoulli(r: Column, var: Column | float, rho: float, value: float = 1.0) -> Column:
    """Posterior mean of a signal that is ``value`` with chance rho and zero otherwise."""
    v = F.lit(var) if isinstance(var, (int, float)) else var
    odds = math.log(rho / (1 - rho)) + (2 * r * value - value**2) / (2 * v)
    return value / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def gaussian_matrix(spark: SparkSession, m: int, n: int, seed: int = 0) -> DataFrame:
    """(row, col, v): m x n with independent entries of variance 1/n."""
    grid = spark.range(m).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.withColumn("v", gaussian(key("a", seed, F.col("row"), F.col("col"))) / math.sqrt(n))


def seeded_matrix(spark: SparkSession, m: int, n: int, blocks: int, width: int, seed: int = 0) -> DataFrame:
    """Spatially coupled: blocks on a ring, entries only up to ``width`` blocks apart, damped by 1 + distance."""
    full = gaussian_matrix(spark, m, n, seed)
    gap = F.abs(F.floor(F.col("row") * blocks / m) - F.floor(F.col("col") * blocks / n))
    ring = F.least(gap, blocks - gap)
    return full.where(ring <= width).withColumn("v", F.col("v") * math.sqrt(n) / math.sqrt(m) / (1 + ring))


def sparse_signal(spark: SparkSession, n: int, rho: float, seed: int = 0) -> DataFrame:
    """(col, x): Gaussian with chance rho, zero otherwise."""
    u = uniform(key("x", seed, F.col("id")))
    return spark.range(n).select(F.col("id").cast("int").alias("col"), F.when(u < rho, gaussian(key("g", seed, F.col("id")))).otherwise(0.0).alias("x"))


def measure(a: DataFrame, x: DataFrame) -> DataFrame:
    """(row, y): the product of a coordinate matrix and a vector."""
    return a.join(x, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def signs(y: DataFrame, task: str = "onebit_cs", seed: int = 0) -> DataFrame:
    """(row, y) with y = +1 or -1: the sign of the measurement, or a draw of the logistic law at it."""
    if task not in ("logistic", "onebit_cs"):
        raise ValueError("task must be 'logistic' or 'onebit_cs'")
    up = F.col("y") >= 0 if task == "onebit_cs" else uniform(key("l", seed, F.col("row"))) < 1 / (1 + F.exp(-F.col("y")))
    return y.select("row", F.when(up, 1.0).otherwise(-1.0).alias("y"))


def amp_step(a: DataFrame, y: DataFrame, x: DataFrame, z: DataFrame, delta: float, denoise, derivative) -> tuple[DataFrame, DataFrame]:
    """One step of message passing: ((col, x), (row, z)).

    r = A'z + x, x' = eta(r), z' = y - A x' + z mean(eta'(r)) / delta, with the variance taken as the mean of z^2. Both
    products are join-aggregates; scalars are cross-joined from one-row aggregates.
    """
    var = z.agg(F.avg(F.col("z") * F.col("z")).alias("var"))
    back = a.join(z, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("z")).alias("g"))
    r = x.join(back, "col", "left").select("col", F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.coalesce("g", F.lit(0.0)) + F.col("x"))).alias("r")).crossJoin(F.broadcast(var))
    new_x = r.select("col", denoise(F.col("r"), F.col("var")).alias("x"))
    onsager = r.agg((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(derivative(F.col("r"), F.col("var"))))) / delta).alias("b"))
    fit = measure(a, new_x).withColumnRenamed("y", "ax")
    new_z = y.join(fit, "row", "left").join(z, "row").crossJoin(F.broadcast(onsager))
    return new_x, new_z.select("row", (F.col("y") - F.coalesce("ax", F.lit(0.0)) + F.col("z") * F.col("b")).alias("z"))


def denoiser(kind: str, rho: float | None, sigma_x: float = 1.0, scale: float = 1.0):
    """(eta, eta') as functions of (r, variance): ``soft`` or ``bayesian``."""
    if kind == "soft":
        tau = lambda var: scale * F.sqrt(var)
        return (lambda r, var: soft_threshold(r, tau(var))), (lambda r, var: soft_derivative(r, tau(var)))
    if kind == "bayesian":
        if rho is None:
            raise ValueError("the Bayesian denoiser needs rho")
        return (lambda r, var: gauss_bernoulli(r, var, rho, sigma_x)), (lambda r, var: gauss_bernoulli_derivative(r, var, rho, sigma_x))
    raise ValueError(f"unknown denoiser: {kind}")


def amp_dense(a: np.ndarray, y: np.ndarray, kind: str = "soft", rho: float | None = None, sigma_x: float = 1.0, scale: float = 1.1, max_iter: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Message passing for one problem that fits a worker: many of them run side by side in a grouped map."""
    if kind not in ("soft", "bayesian"):
        raise ValueError(f"unknown denoiser: {kind}")
    if kind == "bayesian" and rho is None:
        raise ValueError("the Bayesian denoiser needs rho")
    m, n = a.shape
    x, z, history = np.zeros(n), y.copy(), []

    def eta(r, var):
        if kind == "soft":
            return np.sign(r) * np.maximum(np.abs(r) - scale * math.sqrt(var), 0)
        total = var + sigma_x**2
        odds = math.log(rho / (1 - rho)) + 0.5 * math.log(var / total) + 0.5 * r**2 * (1 / var - 1 / total)
        return r * sigma_x**2 / total / (1 + np.exp(-np.clip(odds, -500, 500)))

    for _ in range(max_iter):
        var = float(np.clip(np.mean(z**2), 1e-12, 1e10))
        r = np.clip(a.T @ z + x, -1e6, 1e6)
        new = eta(r, var)
        b = float(np.clip(np.mean((eta(r + 1e-6, var) - eta(r - 1e-6, var)) / 2e-6), 0, 1))
        z = y - a @ new + z * b * n / m
        change = float(np.linalg.norm(new - x) / max(np.linalg.norm(new), 1e-12))
        x = new
        history.append(float(np.linalg.norm(y - a @ x)))
        if change < tol or not np.isfinite(change) or np.abs(x).max() > 1e10:
            break
    return x, history


def phase_grid(spark: SparkSession, n: int, deltas: list[float], rhos: list[float], trials: int, kind: str = "bayesian") -> DataFrame:
    """(delta, rho, success): share of trials recovered to a normalised error below 0.01, a cell and trial a row."""
    cells = spark.createDataFrame([(d, r, t) for d in deltas for r in rhos for t in range(trials)], "delta double, rho double, trial int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, r, t in group.itertuples(index=False):
            rng = np.random.default_rng([int(d * 1000), int(r * 1000), t])
            m = max(1, int(d * n))
            a = rng.standard_normal((m, n)) / math.sqrt(m)
            x = np.where(rng.random(n) < r, rng.standard_normal(n), 0.0)
            got, _ = amp_dense(a, a @ x, kind, rho=r)
            out.append((d, r, float(((got - x) ** 2).sum() < 0.01 * max((x**2).sum(), 1e-12))))
        return pd.DataFrame(out, columns=["delta", "rho", "ok"])

    done = cells.groupBy("delta", "rho", "trial").applyInPandas(run, "delta double, rho double, ok double")
    return done.groupBy("delta", "rho").agg(F.avg("ok").alias("success"))


def state_evolution(spark: SparkSession, delta: float, rho: float, sigma_w: float = 0.0, steps: int = 20) -> DataFrame:
    """(t, mse): the predicted error of the soft-threshold recursion, as a recursive query."""
    tau = f"sqrt(2 * ln(1 / {rho!r}D)) * sqrt(s2)"
    return spark.sql(f"""
        WITH RECURSIVE e(t, mse) AS (
          SELECT 0, {rho!r}D
          UNION ALL
          SELECT t + 1, {rho!r}D * s2 * exp(-pow({tau}, 2) / (2 * s2)) FROM (SELECT t, {sigma_w**2!r}D + mse / {delta!r}D AS s2 FROM e WHERE t < {steps})
        ) SELECT t, mse FROM e""")


# ---- one-bit measurements and the diffusion prior


def schedule(spark: SparkSession, steps: int, low: float = 1e-4, high: float = 0.02) -> DataFrame:
    """(t, beta, alpha_bar): a linear noise schedule and the running product of 1 - beta, from prefix sums of logarithms."""
    beta = [low + (high - low) * t / (steps - 1) for t in range(steps)]
    bars = np.exp(np.cumsum(np.log1p(-np.array(beta))))
    return spark.createDataFrame([(t, b, float(a)) for t, (b, a) in enumerate(zip(beta, bars, strict=True))], "t int, beta double, alpha_bar double")


def smoothing_weights(radius: int, sigma: float) -> list[float]:
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def smooth(signal: Column, radius: int = 2, sigma: float = 1.0) -> Column:
    """Gaussian smoothing of an array column, mirrored at both ends without repeating the end value."""
    n = F.size(signal)
    weights = smoothing_weights(radius, sigma)

    def place(i: Column, k: int) -> Column:
        j = F.abs(i + k)
        return F.when(j >= n, 2 * n - 2 - j).otherwise(j)

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((F.get(signal, place(i, k)) * w for k, w in zip(range(-radius, radius + 1), weights, strict=True)), F.lit(0.0)))


def noise_estimate(signal: Column, radius: int = 2, sigma: float = 1.0) -> Column:
    return F.zip_with(signal, smooth(signal, radius, sigma), lambda a, b: a - b)


def tweedie(x: Column, noise: Column, alpha_bar: float) -> Column:
    """The denoised signal: (x - sqrt(1 - alpha_bar) noise) / sqrt(alpha_bar)."""
    return F.zip_with(x, noise, lambda a, e: (a - math.sqrt(1 - alpha_bar) * e) / math.sqrt(alpha_bar))


def logistic_loss(y: Column, fit: Column) -> Column:
    """-log P(y) for y in -1, +1 under a logistic link, without overflow."""
    s = y * fit
    return F.greatest(-s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s)))


def normal_cdf(x: Column | str) -> Column:
    """The standard normal distribution function by its power series, cut at 8 deviations; null where x is null or NaN.

    Spark has no erf. The absolute error stays below 1e-14.
    """
    x = F.col(x) if isinstance(x, str) else x
    z = F.greatest(F.least(x.cast("double"), F.lit(8.0)), F.lit(-8.0))
    start = F.struct(z.alias("t"), z.alias("s"))

    def add(a: Column, k: Column) -> Column:
        t = a["t"] * z * z / (2 * k + 3)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(139)), start, add)["s"]
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total)


def probit_loss(y: Column, fit: Column, sigma: float) -> Column:
    """-log Phi(y fit / sigma), the probability held above 1e-10."""
    return -F.ln(F.greatest(normal_cdf(y * fit / sigma), F.lit(1e-10)))


def _minimise(gradient, x: np.ndarray, z: np.ndarray, mu: float, rate: float, steps: int, memory: int = 5) -> tuple[np.ndarray, float]:
    """(x, data loss) after limited-memory quasi-Newton steps on data term plus mu/2 |x - z|^2, halved while the sum rises."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    g, loss = gradient(x)
    value, full = loss + mu / 2 * float((x - z) @ (x - z)), g + mu * (x - z)
    used = 1
    while used < steps:
        step, taken = full.copy(), []
        for s, y in reversed(pairs):
            a = (s @ step) / (s @ y)
            taken.append(a)
            step -= a * y
        step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else rate
        for (s, y), a in zip(pairs, reversed(taken), strict=True):
            step += (a - (y @ step) / (s @ y)) * s
        size = 1.0
        while used < steps:
            new = x - size * step
            g, new_loss = gradient(new)
            used += 1
            new_value, new_full = new_loss + mu / 2 * float((new - z) @ (new - z)), g + mu * (new - z)
            if new_value <= value:
                break
            size /= 2
        else:
            break
        if (new - x) @ (new_full - full) > 1e-12:
            pairs = [*pairs[1 - memory :], (new - x, new_full - full)]
        x, value, full, loss = new, new_value, new_full, new_loss
    return x, loss


def recovery_error(x: np.ndarray, truth: np.ndarray) -> float:
    """Mean squared error of directions: signs carry no size."""
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    return float(((unit(x) - unit(truth)) ** 2).mean())


def one_bit_reconstruct(a: DataFrame, y: DataFrame, n: int, steps: int = 20, lam: float = 0.02, task: str = "logistic", sigma: float = 1.0, inner: int = 10, total: int = 1000) -> tuple[np.ndarray, list[dict]]:
    """Plug-and-play recovery of x from signs: (x, history).

    Alternates a quasi-Newton solve of the data term plus mu/2 |x - z|^2 with Tweedie's denoising of x at falling noise levels.
    Measurements stay distributed: rows (row, a array, y) give the gradient as partial sums, n numbers a task.
    """
    if task not in ("logistic", "onebit_cs"):
        raise ValueError("task must be 'logistic' or 'onebit_cs'")
    rows = a.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda e: e["v"]).alias("a")).join(y, "row").select("a", "y").cache()
    betas = np.linspace(1e-4, 0.02, total)
    bars = np.cumprod(1 - betas)

    def gradient(x: np.ndarray) -> tuple[np.ndarray, float]:
        def run(batches):
            g, loss = np.zeros(n), 0.0
            for b in batches:
                if not len(b):
                    continue
                m, s = np.stack(b["a"].to_numpy()), b["y"].to_numpy()
                t = s * (m @ x)
                if task == "logistic":
                    loss += float(np.logaddexp(0, -t).sum())
                    g += m.T @ (-s / (1 + np.exp(np.clip(t, -500, 500))))
                else:
                    phi = np.maximum([0.5 * math.erfc(-v / sigma / math.sqrt(2)) for v in t], 1e-10)
                    loss -= float(np.log(phi).sum())
                    g += m.T @ (-s * np.exp(-0.5 * (t / sigma) ** 2) / math.sqrt(2 * math.pi) / sigma / phi)
            yield pd.DataFrame({"j": np.arange(n + 1), "v": np.append(g, loss)})

        got = {r["j"]: r["v"] for r in rows.mapInPandas(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
        return np.array([got[j] for j in range(n)]), got[n]

    x = z = np.zeros(n)
    weights, history = np.array(smoothing_weights(2, 1.0)), []
    for t in np.linspace(total - 1, 0, steps).astype(int):
        mu = lam * bars[t] / (1 - bars[t])
        rate = 1.0 / (1.0 + mu)
        x, loss = _minimise(lambda v: gradient(v), x, z, mu, rate, inner)  # noqa: B023
        soft = np.convolve(np.pad(x, 2, mode="reflect"), weights, mode="valid") if n > 2 else x
        z = (x - math.sqrt(1 - bars[t]) * (x - soft)) / math.sqrt(bars[t])
        history.append({"t": int(t), "mu": float(mu), "loss": loss, "norm": float(np.linalg.norm(z))})
    rows.unpersist()
    return z, history
