"""Analytic functions to minimise, over array columns and as numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import total


def branin(x: Column) -> Column:
    """Least value 0.397887 on [-5, 10] x [0, 15]."""
    a, b = x[0], x[1]
    t = b - 5.1 / (4 * math.pi**2) * a * a + 5 / math.pi * a - 6
    return t * t + 10 * (1 - 1 / (8 * math.pi)) * F.cos(a) + 10


def _floor(v: Column) -> Column:
    """In doubles; Spark's floor is a long, which has no NaN and ends at 2^63."""
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def staircase(x: Column, stairs: int = 5) -> Column:
    """Sum of squares of coordinates cut down to steps of 1/stairs; null coordinates count as absent, and null if there are none."""
    there = F.filter(x, lambda v: v.isNotNull())
    return F.when(F.size(there) > 0, total(F.transform(there, lambda v: F.pow(_floor(v * stairs) / stairs, 2))))


def michalewicz(x: Column, m: int = 10) -> Column:
    return -total(F.transform(x, lambda v, i: F.sin(v) * F.pow(F.sin((i + 1) * v * v / math.pi), F.lit(2.0 * m))))


def rastrigin(x: Column) -> Column:
    return 10.0 * F.size(x) + total(F.transform(x, lambda v: v * v - 10 * F.cos(2 * math.pi * v)))


def rosenbrock(x: Column) -> Column:
    left, right = F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1)
    return total(F.zip_with(left, right, lambda a, b: 100 * (b - a * a) * (b - a * a) + (1 - a) * (1 - a)))


def branin_numpy(x) -> float:
    a, b = float(x[0]), float(x[1])
    return (b - 5.1 / (4 * math.pi**2) * a * a + 5 / math.pi * a - 6) ** 2 + 10 * (1 - 1 / (8 * math.pi)) * math.cos(a) + 10


def staircase_numpy(x, stairs: int = 5) -> float:
    return float(((np.floor(np.asarray(x) * stairs) / stairs) ** 2).sum())
