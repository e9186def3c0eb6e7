"""Kronecker structure of binary patterns: divisors, factorisability as a count of distinct pairs, chains by recursion.

A pattern is a table of 1-based coordinates ``(i, j)`` of a square matrix of order n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pattern(spark: SparkSession, rows: list[list[int]]) -> DataFrame:
    """(i, j) of the ones of a square 0/1 matrix; ValueError for other shapes."""
    if any(len(r) != len(rows) for r in rows):
        raise ValueError("the matrix must be square")
    cells = [(i + 1, j + 1) for i, r in enumerate(rows) for j, v in enumerate(r) if v]
    return spark.createDataFrame(cells, "i long, j long")


def linear_index(i: Column, j: Column, n: int | Column) -> Column:
    """Column-major, from 1."""
    return (j - 1) * n + i


def pair_of(index: Column, n: int | Column) -> tuple[Column, Column]:
    return (index - 1) % n + 1, F.floor((index - 1) / n) + 1


def split(i: Column, n2: Column | int) -> tuple[Column, Column]:
    """Outer and inner part of an index under an inner order n2."""
    return F.floor((i - 1) / n2) + 1, (i - 1) % n2 + 1


def divisors(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).where(F.lit(n) % F.col("id") == 0).select(F.col("id").alias("divisor"))


def compatible(spark: SparkSession, n: int) -> DataFrame:
    """(n1, n2) with n1 n2 = n, both above 1."""
    return spark.range(2, n).where(F.lit(n) % F.col("id") == 0).select(F.col("id").alias("n1"), F.floor(F.lit(n) / F.col("id")).alias("n2"))


def check(pat: DataFrame, n: int) -> DataFrame:
    """(n1, n2, factorizable) for every compatible pair.

    The pattern factorises if the pairs of outer and inner indices are the product of their projections: one aggregate
    with three distinct counts, whatever the pairs. The empty pattern factorises.
    """
    pairs = compatible(pat.sparkSession, n)
    i1, i2 = split(F.col("i"), F.col("n2"))
    j1, j2 = split(F.col("j"), F.col("n2"))
    outer, inner = linear_index(i1, j1, F.col("n1")), linear_index(i2, j2, F.col("n2"))
    seen = pat.crossJoin(F.broadcast(pairs)).select("n1", "n2", outer.alias("l1"), inner.alias("l2"))
    counts = seen.groupBy("n1", "n2").agg(F.count_distinct("l1", "l2").alias("c"), F.count_distinct("l1").alias("a"), F.count_distinct("l2").alias("b"))
    out = pairs.join(counts, ["n1", "n2"], "left")
    return out.select("n1", "n2", F.coalesce(F.col("c") == F.col("a") * F.col("b"), F.lit(True)).alias("factorizable"))


def factors(pat: DataFrame, n1: int, n2: int) -> tuple[DataFrame, DataFrame]:
    """The two patterns of a factorisation."""
    i1, i2 = split(F.col("i"), n2)
    j1, j2 = split(F.col("j"), n2)
    return pat.select(i1.alias("i"), j1.alias("j")).distinct(), pat.select(i2.alias("i"), j2.alias("j")).distinct()


def is_maximal(checked: DataFrame) -> DataFrame:
    return checked.agg(F.coalesce(F.bool_and("factorizable"), F.lit(True)).alias("maximal"))


CHAINS = """
WITH RECURSIVE l AS (SELECT n1 AS v FROM {pairs} WHERE factorizable),
e AS (SELECT x.v AS a, y.v AS b FROM l x JOIN l y ON y.v > x.v AND y.v % x.v = 0
      WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.v > x.v AND o.v < y.v AND y.v % o.v = 0 AND o.v % x.v = 0)),
c(last, path) AS (
  SELECT x.v, CAST(x.v AS VARCHAR(200)) FROM l x WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.v < x.v AND x.v % o.v = 0)
  UNION ALL
  SELECT e.b, CAST(concat(c.path, ',', CAST(CAST(e.b / e.a AS BIGINT) AS VARCHAR(20))) AS VARCHAR(200)) FROM c JOIN e ON e.a = c.last)
SELECT CAST(concat(path, ',', CAST(CAST({n} / last AS BIGINT) AS VARCHAR(20))) AS STRING) AS chain FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = c.last)
"""


def chains(checked: DataFrame, n: int) -> DataFrame:
    """(chain): all maximal chains of factor orders under direct divisibility, as comma-joined text."""
    checked.createOrReplaceTempView("tessera_pairs")
    return checked.sparkSession.sql(CHAINS.format(pairs="tessera_pairs", n=n))


def graph(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (id), edges (src, dst, ratio)) of the left orders under direct divisibility."""
    v = checked.where("factorizable").select(F.col("n1").alias("id"))
    a, b, o = v.select(F.col("id").alias("src")), v.select(F.col("id").alias("dst")), v.select(F.col("id").alias("o"))
    e = a.join(b, (F.col("dst") > F.col("src")) & (F.col("dst") % F.col("src") == 0))
    direct = e.join(o, (F.col("o") > F.col("src")) & (F.col("o") < F.col("dst")) & (F.col("dst") % F.col("o") == 0) & (F.col("o") % F.col("src") == 0), "left_anti")
    return v, direct.withColumn("ratio", (F.col("dst") / F.col("src")).cast("long"))


def basis(spark: SparkSession, i: int, j: int) -> DataFrame:
    return spark.createDataFrame([(i, j)], "i long, j long")


def product(a: DataFrame, b: DataFrame, n2: int) -> DataFrame:
    """The pattern of a Kronecker product, b of order n2."""
    y = b.select(F.col("i").alias("i2"), F.col("j").alias("j2"))
    return a.crossJoin(F.broadcast(y)).select(((F.col("i") - 1) * n2 + F.col("i2")).alias("i"), ((F.col("j") - 1) * n2 + F.col("j2")).alias("j"))
