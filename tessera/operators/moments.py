"""Frequency moments and entropy by compressed counting: maximally skewed stable sketches, exact aggregates beside them.

The sketch is linear: x_j = sum over items of count times a stable variable of (item, j), so states add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import key, uniform
from tessera.operators.cardinality import minimise


def _check(alpha: float) -> None:
    if not 0 < alpha <= 2:
        raise ValueError("alpha must be in (0, 2]")


def item_counts(df: DataFrame, item: str) -> DataFrame:
    return df.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("cnt"))


def exact_moment(counts: DataFrame, alpha: float) -> DataFrame:
    return counts.agg(F.sum(F.pow(F.col("cnt").cast("double"), F.lit(alpha))).alias("moment"))


def shannon_entropy(counts: DataFrame) -> DataFrame:
    """Natural-log entropy of the shares, without a second pass: ln F1 - sum(c ln c) / F1."""
    c = F.col("cnt").cast("double")
    return counts.agg(F.sum(c).alias("f1"), F.sum(c * F.ln(c)).alias("s")).select((F.ln("f1") - F.col("s") / F.col("f1")).alias("entropy"))


def tsallis(moment: Column, f1: Column, alpha: float) -> Column:
    """(1 - F_alpha / F1**alpha) / (alpha - 1): tends to Shannon's entropy as alpha tends to 1."""
    return (1 - moment / F.pow(f1, F.lit(alpha))) / (alpha - 1)


def stable(name: Column, alpha: float) -> Column:
    """A maximally skewed stable variable by Chambers, Mallows and Stuck, for alpha other than 1."""
    rho = math.pi / 2 if alpha < 1 else math.pi / 2 * (2 - alpha) / alpha
    v = math.pi * (uniform(name, 0) - 0.5)
    w = -F.ln(uniform(name, 1))
    top = F.sin(alpha * (v + rho)) / F.pow(F.cos(v) * math.cos(rho * alpha), F.lit(1 / alpha))
    return top * F.pow(F.cos(v - alpha * (v + rho)) / w, F.lit((1 - alpha) / alpha))


def sketch(counts: DataFrame, alpha: float, k: int = 100) -> DataFrame:
    """(proj, x) for k projections; map-side sums keep the shuffle at k rows a task."""
    _check(alpha)
    spread = counts.withColumn("proj", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return spread.groupBy("proj").agg(F.sum(F.col("cnt") * stable(key(F.col("item"), F.col("proj")), alpha)).alias("x"))


def merge(*states: DataFrame) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("proj").agg(F.sum("x").alias("x"))


def kappa(alpha: float) -> float:
    return alpha if alpha < 1 else 2 - alpha


def moment_constant(power: float, alpha: float) -> float:
    """E|x|**(power*alpha) / F**power of the sketch's entries."""
    k = kappa(alpha)
    return (
        math.cos(k * power * math.pi / 2) / math.cos(k * math.pi / 2) ** power
        * (2 / math.pi) * math.sin(math.pi * power * alpha / 2) * math.gamma(1 - power) * math.gamma(power * alpha)
    )


def optimal_power(alpha: float) -> float:
    """The power of least variance of the power estimator."""

    def objective(p: float) -> float:
        try:
            return (moment_constant(2 * p, alpha) / moment_constant(p, alpha) ** 2 - 1) / p**2
        except (ValueError, ZeroDivisionError, OverflowError):
            return math.inf

    low, high = (-10.0, -0.01) if alpha < 1 else (0.01, 0.499)
    return minimise(lambda p: v if (v := objective(p)) > 0 else math.inf, low, high, 1e-6)


def power_estimate(state: DataFrame, alpha: float, k: int, power: float | None = None) -> DataFrame:
    """(estimate) by the mean of |x|**(power*alpha), with first-order bias correction. No entries other than 0: 0."""
    _check(alpha)
    p = optimal_power(alpha) if power is None else power
    g1, g2 = moment_constant(p, alpha), moment_constant(2 * p, alpha)
    bias = 1 - (1 / k) * (1 / (2 * p)) * (1 / p - 1) * (g2 / g1**2 - 1)
    mean = F.avg(F.pow(F.abs("x"), F.lit(p * alpha)))
    return state.where("x <> 0").agg(F.coalesce(F.pow(mean / g1, F.lit(1 / p)) * bias, F.lit(0.0)).alias("estimate"))


def geometric_estimate(state: DataFrame, alpha: float, k: int) -> DataFrame:
    """(estimate): product of |x|**(alpha/k) over its expectation."""
    _check(alpha)
    const = moment_constant(1 / k, alpha) ** k
    return state.where("x <> 0").agg(F.coalesce(F.exp(alpha * F.avg(F.ln(F.abs("x")))) / const, F.lit(0.0)).alias("estimate"))


def harmonic_estimate(state: DataFrame, alpha: float, k: int) -> DataFrame:
    """(estimate) from the sum of |x|**-alpha; for alpha below 1 only."""
    if alpha >= 1:
        raise ValueError("the harmonic estimator needs alpha < 1")
    g = math.gamma(1 + alpha)
    const = k * math.cos(alpha * math.pi / 2) / g * (1 - (1 / k) * (2 * g**2 / math.gamma(1 + 2 * alpha) - 1))
    return state.where("x <> 0").agg(F.coalesce(const / F.sum(F.pow(F.abs("x"), F.lit(-alpha))), F.lit(0.0)).alias("estimate"))


def estimate_moment(counts: DataFrame, alpha: float, k: int = 100, method: str = "optimal") -> DataFrame:
    state = sketch(counts, alpha, k)
    makers = {"optimal": power_estimate, "geometric": geometric_estimate, "harmonic": harmonic_estimate}
    if method not in makers:
        raise ValueError("method must be optimal, geometric or harmonic")
    return makers[method](state, alpha, k)


def test_counts(spark, size: int = 1000, kind: str = "zipf") -> DataFrame:
    """(item, cnt): ``zipf`` (1000 / rank), ``uniform`` (1 to 99) or ``sparse`` (a tenth not zero)."""
    u = uniform(key(kind, F.col("id")))
    forms = {"zipf": 1000.0 / (F.col("id") + 1), "uniform": F.floor(u * 99) + 1.0, "sparse": F.when(u < 0.1, F.floor(uniform(key("s", F.col("id"))) * 99) + 1.0).otherwise(0.0)}
    if kind not in forms:
        raise ValueError("kind must be zipf, uniform or sparse")
    return spark.range(size).select(F.col("id").alias("item"), forms[kind].cast("double").alias("cnt"))


def accuracy(counts: DataFrame, alphas: list[float], k: int) -> DataFrame:
    """(alpha, method, estimate, exact, rel_error) of all estimators that exist for each alpha."""
    out = None
    for a in alphas:
        state, exact = sketch(counts, a, k), exact_moment(counts, a)
        for method, f in (("optimal", power_estimate), ("geometric", geometric_estimate), ("harmonic", harmonic_estimate)):
            if method == "harmonic" and a >= 1:
                continue
            row = f(state, a, k).crossJoin(exact).select(F.lit(a).alias("alpha"), F.lit(method).alias("method"), "estimate", F.col("moment").alias("exact"))
            out = row if out is None else out.unionByName(row)
    return out.withColumn("rel_error", F.abs(F.col("estimate") / F.col("exact") - 1))
