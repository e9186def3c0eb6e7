"""Queries on kernels, Gaussian processes, kernel search and black-box minimisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import kernels as Kn
from tessera.functions import testfunctions as Tf
from tessera.operators import gp as G
from tessera.plans.registry import query, table

_SERIES = "s AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS y FROM events GROUP BY 1), t AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, y FROM s), p AS (SELECT i::BIGINT AS i, [i / 10.0::DOUBLE, y / 100] AS row FROM t)"


def _points(spark, d):
    from pyspark.sql import Window as W

    s = table(spark, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.avg("value").alias("y"))
    t = s.select((F.row_number().over(W.orderBy("day")) - 1).cast("long").alias("i"), "y")
    return t.select("i", F.array(F.col("i") / 10.0, F.col("y") / 100).alias("row"))


_D2 = "((a.row[1] - b.row[1]) ** 2 + (a.row[2] - b.row[2]) ** 2)"
_PER = "(sin(pi() * (a.row[1] - b.row[1]) / 0.7::DOUBLE) ** 2 + sin(pi() * (a.row[2] - b.row[2]) / 0.7::DOUBLE) ** 2)"
FORMS = {
    "se": (Kn.SquaredExponential.of(2.0, 0.8), f"2 * exp(-{_D2} / {2 * 0.8**2!r})"),
    "per": (Kn.Periodic.of(1.5, 0.9, 0.7), f"1.5 * exp(-2 * {_PER} / {0.9**2!r})"),
    "lin": (Kn.Linear.of(0.5, 1.2), "0.5 + 1.2 * (a.row[1] * b.row[1] + a.row[2] * b.row[2])"),
    "rq": (Kn.RationalQuadratic.of(1.1, 0.6, 1.7), f"1.1 * pow(1 + {_D2} / {2 * 1.7 * 0.6**2!r}, -1.7)"),
    "matern": (Kn.Matern.of(0.9, 1.3), f"0.9 * (1 + sqrt(5 * {_D2}) / 1.3 + (5 * {_D2}) / {3 * 1.3**2!r}) * exp(-sqrt(5 * {_D2}) / 1.3)"),
    "white": (Kn.WhiteNoise.of(0.3), "CASE WHEN a.i = b.i THEN 0.3 ELSE 0 END"),
}


def _pairs(form: str) -> str:
    return f"WITH {_SERIES} SELECT a.i AS a, b.i AS b, round(({form})::DOUBLE, 6) + 0.0 AS k FROM p a, p b"


def _register(name: str, kernel: Kn.Kernel, form: str) -> None:
    def f(spark, d):
        return G.gram(_points(spark, d), kernel).select("a", "b", (F.round("k", 6) + 0.0).alias("k"))

    f.__name__ = name
    query(_pairs(form))(f)


for _n, (_kernel, _form) in FORMS.items():
    _register(f"kernel_{_n}", _kernel, _form)

_CODE = [1, 0, 0, 0, 1] + [0, 0, 0, 1, 0] + [0] * 5  # SE*LIN + MAT
_CODE_SQL = f"exp(-{_D2} / 2) * (1 + a.row[1] * b.row[1] + a.row[2] * b.row[2]) + (1 + sqrt(5 * {_D2}) + (5 * {_D2}) / 3) * exp(-sqrt(5 * {_D2}))"
_register("kernel_composite", Kn.from_code(_CODE), _CODE_SQL)


@query(f"WITH {_SERIES} SELECT round(sqrt(sum(pow(({_CODE_SQL}) - exp(-{_D2} / 2), 2))), 5) AS distance FROM p a, p b")
def kernel_frobenius(spark, d):
    return G.frobenius(_points(spark, d), Kn.from_code(_CODE), Kn.base("SE")).select(F.round("distance", 5).alias("distance"))


@query(f"WITH {_SERIES} SELECT i, round((row[2] - avg(row[2]) OVER ()) / stddev_pop(row[2]) OVER (), 6) + 0.0 AS z FROM p")
def zscore_series(spark, d):
    s = _points(spark, d).select("i", F.col("row")[1].alias("y"))
    return G.zscore(s, "y").select("i", (F.round("z", 6) + 0.0).alias("z"))


@query(f"SELECT i::DOUBLE AS t, round(0.5 * i + 3 * (1 + 0.01 * i) * sin(2 * {math.pi!r} * i / 12), 6) + 0.0 AS y FROM range(144) r(i)")
def seasonal_series(spark, d):
    return G.seasonal_series(spark, 144, 0.5, 3.0, 12.0, 0.01).select("t", (F.round("y", 6) + 0.0).alias("y"))


_E = "WITH e AS (SELECT vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


@query(_E + f""" SELECT i,
 round(pow(x[2] - {5.1 / (4 * math.pi**2)!r} * x[1] * x[1] + {5 / math.pi!r} * x[1] - 6, 2) + {10 * (1 - 1 / (8 * math.pi))!r} * cos(x[1]) + 10, 5) AS branin,
 round(list_sum(list_transform(x, lambda v: pow(floor(v * 5) / 5, 2))), 5) AS staircase,
 round(640 + list_sum(list_transform(x, lambda v: v * v - 10 * cos({2 * math.pi!r} * v))), 4) AS rastrigin,
 round(list_sum(list_transform(range(1, 64), lambda j: 100 * pow(x[j + 1] - x[j] * x[j], 2) + pow(1 - x[j], 2))), 3) AS rosenbrock,
 round(-list_sum(list_transform(range(1, 65), lambda j: sin(x[j]) * pow(sin(j * x[j] * x[j] / {math.pi!r}), 20))), 6) + 0.0 AS michalewicz FROM e""")
def bench_functions(spark, d):
    x = F.col("x")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"))
    return e.select("i", F.round(Tf.branin(x), 5).alias("branin"), F.round(Tf.staircase(x), 5).alias("staircase"), F.round(Tf.rastrigin(x), 4).alias("rastrigin"), F.round(Tf.rosenbrock(x), 3).alias("rosenbrock"), (F.round(Tf.michalewicz(x), 6) + 0.0).alias("michalewicz"))


@query(_E + " SELECT i, round(y, 6) AS y FROM (SELECT i, list_sum(list_transform(x, lambda v: pow(floor(v * 5) / 5, 2))) AS y FROM e) ORDER BY y, i LIMIT 1")
def best_observation(spark, d):
    y = F.round(Tf.staircase(F.col("embedding").cast("array<double>")), 6)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), y.alias("y"))
    return e.orderBy(F.asc_nulls_last("y"), F.asc_nulls_last("i")).limit(1)  # by the rounded value, as the SQL's alias y


@query("WITH x AS (SELECT vec_id AS i, list_transform(embedding, lambda e: e::DOUBLE) AS row FROM embeddings) SELECT round(quantile_cont(list_distance(a.row, b.row), 0.5), 5) AS length FROM x a JOIN x b ON a.i < b.i")
def length_scale_median(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row"))
    return G.length_scale(points).select(F.round("length", 5).alias("length"))


_NAME = "concat('0_', d::VARCHAR, '_', i::VARCHAR)"


@query(f"WITH g AS (SELECT i::BIGINT AS i, d::INTEGER AS d, {_NAME} AS n FROM range(20) a(i), range(2) b(d)), c AS (SELECT i, d, row_number() OVER (PARTITION BY d ORDER BY md5(n), i) - 1 AS c, {H.sql_uniform(f'concat(chr(117), chr(95), n)')} AS u FROM g) SELECT i, d, round(CASE WHEN d = 0 THEN -5 + (c + u) / 20 * 15 ELSE (c + u) / 20 * 15 END, 6) AS v FROM c")
def lhs_sample(spark, d):
    out = G.latin_hypercube(spark, 20, [(-5, 10), (0, 15)])
    return out.select("i", F.posexplode("x").alias("d", "v")).select("i", "d", F.round("v", 6).alias("v"))


def _series(spark, d):
    rows = _points(spark, d).orderBy("i").collect()
    x, y = np.array([[r["row"][0]] for r in rows]), np.array([r["row"][1] for r in rows])
    return x, (y - y.mean()) / (y.std() or 1.0)


@query()
def gp_posterior(spark, d):
    """Posterior mean and deviation of the daily mean of events, predicted where the points are."""
    x, y = _series(spark, d)
    fitted = G.fit_all(spark, [Kn.SquaredExponential.of(dim=0)], x, y, restarts=1)[0]
    gp = G.GaussianProcess(fitted["kernel"], fitted["noise"]).fit(x, y)
    return G.predict_table(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i long, row array<double>"), gp)


@query()
def gp_components(spark, d):
    """Mean and deviation of the additive components of a fitted sum."""
    x, y = _series(spark, d)
    kernel = Kn.SquaredExponential.of(dim=0) + Kn.Periodic.of(period=0.7, dim=0)
    return spark.createDataFrame(G.decompose(G.GaussianProcess(kernel, 0.1).fit(x, y), x), "component long, kernel string, x double, mean double, std double")


@query()
def kernel_search(spark, d):
    x, y = _series(spark, d)
    _, history = G.search(spark, x, y, depth=2, restarts=0, steps=8)
    return spark.createDataFrame(history, "depth long, kernel string, bic double")


@query()
def bbo_branin(spark, d):
    """Best value by query: kernel chosen by evidence, beside a fixed kernel."""
    out = []
    for name, fixed in (("chosen", False), ("fixed", True)):
        _, _, h = G.minimise(spark, Tf.branin_numpy, [(-5, 10), (0, 15)], G.Settings(budget=25, fixed=fixed))
        out += [(name, r["query"], r["best"], r["kernel"]) for r in h]
    return spark.createDataFrame(out, "method string, query long, best double, kernel string")


@query()
def expected_improvement(spark, d):
    """Expected improvement over the best day, at every day."""
    x, y = _series(spark, d)
    gp = G.GaussianProcess(Kn.SquaredExponential.of(dim=0), 0.1).fit(x, y)
    p = G.predict_table(spark.createDataFrame([(i, [float(v) + 0.05 for v in r]) for i, r in enumerate(x)], "i long, row array<double>"), gp)
    return p.select("i", G.expected_improvement(F.col("mean"), F.col("std"), float(y.min())).alias("gain"))


@query()
def kernel_latent(spark, d):
    """Kernels of a space by evidence, with their place in the latent plane."""
    x, y = _series(spark, d)
    codes = Kn.kernel_space(15)
    e = G._evidences(spark, codes, 1.0, x, y, 0.1)
    z = G.latent(np.array(codes), e)
    return spark.createDataFrame([(str(Kn.from_code(c)), float(v), float(p[0]), float(p[1])) for c, v, p in zip(codes, e, z, strict=True)], "kernel string, evidence double, u double, v double")
