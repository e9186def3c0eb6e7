"""Queries on denoisers, message passing and one-bit measurements."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.operators import sensing as S
from tessera.plans.registry import query, table

N, M_, RHO = 60, 30, 0.1
DELTA = M_ / N
PRICE = "((l_extendedprice - 40000) / 20000)"


def _value(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_extendedprice") - 40000) / 20000).alias("r"))


_KEYS = "l_orderkey, l_linenumber, l_partkey"


@query(f"SELECT {_KEYS}, round(sign({PRICE}) * greatest(abs({PRICE}) - 0.5, 0), 8) + 0.0 AS x, CASE WHEN abs({PRICE}) > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS dx FROM lineitem")
def soft_threshold(spark, d):
    r = F.col("r")
    return _value(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", (F.round(S.soft_threshold(r, 0.5), 8) + 0.0).alias("x"), S.soft_derivative(r, 0.5).alias("dx"))


def _gb(r: str, v: str) -> str:
    odds = f"{math.log(RHO / (1 - RHO))!r} + 0.5 * ln({v} / ({v} + 1.0)) + 0.5 * {r} * {r} * (1 / {v} - 1 / ({v} + 1.0))"
    return f"({r} / ({v} + 1.0) / (1 + exp(-greatest(-500.0, least(500.0, {odds})))))"


@query(f"SELECT {_KEYS}, round({_gb(PRICE, '0.25::DOUBLE')}, 6) + 0.0 AS x FROM lineitem")
def gb_denoise(spark, d):
    return _value(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", (F.round(S.gauss_bernoulli(F.col("r"), 0.25, RHO), 6) + 0.0).alias("x"))


@query(f"SELECT {_KEYS}, round(1 / (1 + exp(-greatest(-500.0, least(500.0, {math.log(RHO / (1 - RHO))!r} + (2 * {PRICE} - 1) / 0.5)))), 6) AS x FROM lineitem")
def bernoulli_denoise(spark, d):
    return _value(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.bernoulli(F.col("r"), 0.25, RHO), 6).alias("x"))


_A = f"""a AS (SELECT i::INTEGER AS row, j::INTEGER AS col, {H.sql_gaussian("concat('a_0_', i::VARCHAR, '_', j::VARCHAR)")} / {math.sqrt(N)!r} AS v FROM range({M_}) r(i), range({N}) c(j)),
x0 AS (SELECT j::INTEGER AS col, CASE WHEN {H.sql_uniform("concat('x_0_', j::VARCHAR)")} < {RHO} THEN {H.sql_gaussian("concat('g_0_', j::VARCHAR)")} ELSE 0.0 END AS x FROM range({N}) c(j)),
y AS (SELECT row, sum(v * x) AS y FROM a JOIN x0 USING (col) GROUP BY 1)"""


@query(f"WITH {_A} SELECT row, col, round(v, 6) + 0.0 AS v FROM a")
def sensing_matrix(spark, d):
    return S.gaussian_matrix(spark, M_, N).select("row", "col", (F.round("v", 6) + 0.0).alias("v"))


_RING = f"least(abs(row * 6 // {M_} - col * 6 // {N}), 6 - abs(row * 6 // {M_} - col * 6 // {N}))"


@query(f"WITH {_A} SELECT row, col, round(v * {math.sqrt(N)!r} / {math.sqrt(M_)!r} / (1 + {_RING}), 6) + 0.0 AS v FROM a WHERE {_RING} <= 1")
def seeded_matrix(spark, d):
    return S.seeded_matrix(spark, M_, N, 6, 1).select("row", "col", (F.round("v", 6) + 0.0).alias("v"))


_STEP = f"""var AS (SELECT avg(y * y) AS var FROM y), r AS (SELECT col, sum(v * y) AS r FROM a JOIN y USING (row) GROUP BY 1),
x1 AS (SELECT col, sign(r) * greatest(abs(r) - 1.1 * sqrt(var), 0) AS x, CASE WHEN abs(r) > 1.1 * sqrt(var) THEN 1.0 ELSE 0.0 END AS dx FROM r, var),
b AS (SELECT avg(dx) / {DELTA!r} AS b FROM x1), z1 AS (SELECT y.row, any_value(y.y) - sum(a.v * x1.x) + any_value(y.y) * any_value(b.b) AS z FROM y JOIN a ON a.row = y.row JOIN x1 ON x1.col = a.col, b GROUP BY 1)"""


@query(f"WITH {_A}, {_STEP} SELECT 'x' AS part, col AS i, round(x, 6) + 0.0 AS v FROM x1 UNION ALL SELECT 'z', row, round(z, 6) + 0.0 FROM z1")
def amp_one_step(spark, d):
    """One step from zero: estimate and corrected residual."""
    a = S.gaussian_matrix(spark, M_, N)
    y = S.measure(a, S.sparse_signal(spark, N, RHO))
    eta, slope = S.denoiser("soft", None, scale=1.1)
    zero = spark.range(N).select(F.col("id").cast("int").alias("col"), F.lit(0.0).alias("x"))
    x, z = S.amp_step(a, y, zero, y.withColumnRenamed("y", "z"), DELTA, eta, slope)
    rounded = lambda c: (F.round(c, 6) + 0.0).alias("v")
    return x.select(F.lit("x").alias("part"), F.col("col").alias("i"), rounded("x")).unionByName(z.select(F.lit("z").alias("part"), F.col("row").alias("i"), rounded("z")))


@query()
def amp_phase_grid(spark, d):
    return S.phase_grid(spark, 120, [0.2, 0.4, 0.6], [0.05, 0.1, 0.2], 2)


_TAU = f"sqrt(2 * ln(1 / {RHO})) * sqrt(s2)"


@query(f"WITH RECURSIVE e(t, mse) AS (SELECT 0, {RHO}::DOUBLE UNION ALL SELECT t + 1, {RHO} * s2 * exp(-pow({_TAU}, 2) / (2 * s2)) FROM (SELECT t, 0.0001 + mse / 0.5 AS s2 FROM e WHERE t < 20)) SELECT t, round(mse, 9)::DOUBLE AS mse FROM e")
def state_evolution(spark, d):
    return S.state_evolution(spark, 0.5, RHO, 0.01, 20).select("t", F.round("mse", 9).alias("mse"))


@query("WITH b AS (SELECT t::INTEGER AS t, 1e-4 + (0.02 - 1e-4) * t / 99.0 AS beta FROM range(100) r(t)) SELECT t, round(beta, 9)::DOUBLE AS beta, round(exp(sum(ln(1 - beta)) OVER (ORDER BY t)), 9) AS alpha_bar FROM b")
def alpha_cumprod(spark, d):
    return S.schedule(spark, 100).select("t", F.round("beta", 9).alias("beta"), F.round("alpha_bar", 9).alias("alpha_bar"))


_W = "[" + ", ".join(map(repr, S.smoothing_weights(2, 1.0))) + "]"
_SMOOTH = f"""x AS (SELECT vec_id AS i, generate_subscripts(embedding, 1)::INTEGER - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT a.i, a.j, sum(b.v * {_W}[k + 3]) AS s, any_value(a.v) AS v FROM x a, range(-2, 3) r(k) JOIN x b ON b.i = a.i AND b.j = CASE WHEN abs(a.j + k) >= 64 THEN 126 - abs(a.j + k) ELSE abs(a.j + k) END GROUP BY 1, 2)"""


def _signals(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {_SMOOTH} SELECT i, j, round(s, 6) + 0.0 AS v FROM s")
def reflect_smooth(spark, d):
    return _signals(spark, d).select("i", F.posexplode(S.smooth(F.col("x"))).alias("j", "v")).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {_SMOOTH} SELECT i, j, round((v - sqrt(1 - 0.9::DOUBLE) * (v - s)) / sqrt(0.9::DOUBLE), 6) + 0.0 AS v FROM s")
def tweedie_step(spark, d):
    x = _signals(spark, d).withColumn("e", S.noise_estimate(F.col("x")))
    return x.select("i", F.posexplode(S.tweedie(F.col("x"), F.col("e"), 0.9)).alias("j", "v")).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


_FIT = "(0.05 * l_quantity - 1.0)"
_Y = "(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END)"


@query(f"SELECT round(sum(greatest(-{_Y} * {_FIT}, 0) + ln(1 + exp(-abs({_Y} * {_FIT})))), 4) AS nll FROM lineitem")
def logistic_nll(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0)
    return table(spark, d, "lineitem").agg(F.round(F.sum(S.logistic_loss(y, 0.05 * F.col("l_quantity") - 1.0)), 4).alias("nll"))


_Z = "(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END * (0.05 * l_quantity - 1.0))"


@query(f"SELECT round(sum(-ln(greatest(1e-10, 0.5 + exp(-{_Z} * {_Z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 40), lambda k: pow({_Z}, 2 * k + 1) * sqrt(pi()) / (pow(2, k + 1) * gamma(k + 1.5))))))), 4) AS nll FROM lineitem")
def probit_nll(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0)
    return table(spark, d, "lineitem").agg(F.round(F.sum(S.probit_loss(y, 0.05 * F.col("l_quantity") - 1.0, 1.0)), 4).alias("nll"))


@query()
def one_bit_recovery(spark, d):
    """Loss by noise level while a signal is recovered from the signs of its measurements."""
    a = S.gaussian_matrix(spark, 60, 20)
    x = S.sparse_signal(spark, 20, 0.3)
    y = S.measure(a, x).select("row", F.when(F.col("y") >= 0, 1.0).otherwise(-1.0).alias("y"))
    _, history = S.one_bit_reconstruct(a, y, 20, steps=5, inner=3)
    return spark.createDataFrame(history, "t int, mu double, loss double, norm double")
