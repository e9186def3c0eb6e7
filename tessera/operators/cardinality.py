"""Mergeable distinct-count sketches (HyperLogLog and PCSA states) with the tau-GRA estimator.

A sketch is a table: ``(by.., bucket, reg)`` for HyperLogLog, ``(by.., bucket, bits)`` for PCSA. Updating is one
partial and final aggregate, merging another, both also valid on streams; estimating needs a row a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hex32, leading_zero_bits
from tessera.sources.shared import stored

TAU_HLL, TAU_PCSA = 0.889897, 0.343557
CELLS = 63


def hashed(df: DataFrame, item: Column, m: int) -> DataFrame:
    """``df`` with ``bucket`` (first 32 bits of sha256 modulo m) and ``lz`` (leading zero bits of the other 224)."""
    h = F.sha2(item.cast("string").cast("binary"), 256)
    return df.withColumn("bucket", (hex32(h) % m).cast("int")).withColumn("lz", leading_zero_bits(F.substring(h, 9, 56)))


def hll_update(df: DataFrame, item: Column, m: int, by: list[str] | None = None) -> DataFrame:
    """HyperLogLog registers; a missing bucket is empty. Null items are ignored."""
    rows = hashed(df.where(item.isNotNull()), item, m)
    return rows.groupBy(*(by or []), "bucket").agg(F.max(F.col("lz") + 1).cast("int").alias("reg"))


def hll_merge(*states: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(by or []), "bucket").agg(F.max("reg").alias("reg"))


def hll_constant(tau: float, m: int) -> float:
    return m * (math.gamma(tau) * (1 - 2**-tau) / math.log(2)) ** (1 / tau)


def hll_estimate(state: DataFrame, m: int, tau: float = TAU_HLL, by: list[str] | None = None) -> DataFrame:
    """(by.., estimate): m times a constant times the mean of 2**(-tau*reg) to the power -1/tau."""
    total = F.sum(F.pow(F.lit(2.0), -tau * F.col("reg"))) + (m - F.count("*"))
    return state.groupBy(*(by or [])).agg((hll_constant(tau, m) * F.pow(total / m, F.lit(-1 / tau))).alias("estimate"))


def pcsa_update(df: DataFrame, item: Column, m: int, by: list[str] | None = None) -> DataFrame:
    """PCSA bitmaps of ``CELLS`` bits; rarer values share the last."""
    rows = hashed(df.where(item.isNotNull()), item, m)
    bit = F.expr(f"shiftleft(1L, least(lz, {CELLS - 1}))")
    return rows.groupBy(*(by or []), "bucket").agg(F.bit_or(bit).alias("bits"))


def pcsa_merge(*states: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(by or []), "bucket").agg(F.bit_or("bits").alias("bits"))


def pcsa_estimate(state: DataFrame, m: int, tau: float = TAU_PCSA, by: list[str] | None = None) -> DataFrame:
    """(by.., estimate) from the total size, to the power tau, of the cells not hit; cell j has size 2**-(j+1)."""
    sizes = [2.0 ** (-(j + 1) * tau) for j in range(CELLS)]
    free = sum(F.when(F.expr(f"(shiftright(bits, {j}) & 1) = 0"), F.lit(s)).otherwise(0.0) for j, s in enumerate(sizes))
    total = F.sum(free) + (m - F.count("*")) * F.lit(sum(sizes))
    const = m * (math.gamma(tau) / math.log(2)) ** (1 / tau)
    return state.groupBy(*(by or [])).agg((const * F.pow(total / m, F.lit(-1 / tau))).alias("estimate"))


def variance_hll(tau: float) -> float:
    """Limiting relative variance times m; infinite for tau <= 0."""
    if tau <= 0:
        return math.inf
    ratio = math.gamma(2 * tau) / math.gamma(tau) ** 2
    return (math.log(2) * ratio * (1 + 2**-tau) / (1 - 2**-tau) - 1) / tau**2


def variance_pcsa(tau: float) -> float:
    if tau <= 0:
        return math.inf
    return math.log(2) * (1 - 2 ** (-2 * tau)) * math.gamma(2 * tau) / math.gamma(tau) ** 2 / tau**2


def minimise(f: Callable[[float], float], low: float, high: float, tol: float = 1e-9) -> float:
    """Golden-section search for the minimum of a function with one valley."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tol:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def optimal_tau(kind: str) -> float:
    """The tau of least variance: of ``hyperloglog`` or ``pcsa``."""
    if kind not in ("hyperloglog", "pcsa"):
        raise ValueError("kind must be 'hyperloglog' or 'pcsa'")
    return minimise(variance_hll if kind == "hyperloglog" else variance_pcsa, 0.01, 2.0)


def accuracy(df: DataFrame, item: Column, m: int, taus: list[float]) -> DataFrame:
    """(kind, tau, estimate, exact, rel_error): one pass for each sketch, all taus from its state."""
    exact = df.agg(F.count_distinct(item).alias("exact"))
    hll, pcsa = stored(hll_update(df, item, m)), stored(pcsa_update(df, item, m))  # m rows each
    out = None
    for tau in taus:
        for kind, est in (("hyperloglog", hll_estimate(hll, m, tau)), ("pcsa", pcsa_estimate(pcsa, m, tau))):
            row = est.select(F.lit(kind).alias("kind"), F.lit(tau).alias("tau"), "estimate")
            out = row if out is None else out.unionByName(row)
    return out.crossJoin(exact).withColumn("rel_error", F.abs(F.col("estimate") - F.col("exact")) / F.col("exact"))
