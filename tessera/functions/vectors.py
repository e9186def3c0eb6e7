"""Array expressions: inner products, norms and distances without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x) -> Column:
    return _c(x).cast("array<double>")


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def squared_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v)


def squared_distance(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def literal(values) -> Column:
    """An array of doubles as a constant."""
    return F.array(*(F.lit(float(v)) for v in values))


def literal_matrix(rows) -> Column:
    return F.array(*(literal(r) for r in rows))


def matvec(rows: Column, vector) -> Column:
    """The product of a constant matrix (array of rows) with an array column."""
    return F.transform(rows, lambda r: dot(r, vector))
