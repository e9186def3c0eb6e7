"""Queries over matrices: products, projections, dissimilarities, least squares, low rank."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.operators import leastsq, linalg, lowrank
from tessera.operators import projections as P
from tessera.plans.registry import query, table

D = 64
EPS, DELTA = 0.5, 0.1
K, S = P.sparse_dims(EPS, DELTA)
KW, SW = P.sparse_dims_wide(0.6, DELTA)

X = "x AS (SELECT vec_id AS i, generate_subscripts(embedding, 1)::INTEGER - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _block(name: str, k: int, s: int, remainder: bool) -> str:
    if remainder and k < s:
        s = k
    w = k // s
    size = f"(CASE WHEN b = {s - 1} THEN {k - (s - 1) * w} ELSE {w} END)" if remainder else str(w)
    key = "concat(j::VARCHAR, '_', b::VARCHAR)"
    return f"{name} AS (SELECT (b * {w} + {H.sql_md5_mod(key, size)})::INTEGER AS r, j::INTEGER AS j, (CASE WHEN ({H.sql_h32(key, 3)} >> 8) % 2 = 0 THEN 1.0 ELSE -1.0 END / {math.sqrt(s)!r})::DOUBLE AS v FROM range({D}) a(j), range({s}) c(b))"


BLOCK = _block("s", K, S, False)
MAPPED = f"WITH {X}, {BLOCK}, y AS (SELECT x.i, s.r, sum(x.v * s.v) AS y FROM x JOIN s USING (j) GROUP BY 1, 2)"


def _rows(spark, d, *keep):
    return linalg.to_rows(table(spark, d, "embeddings"), "vec_id", "embedding", *keep)


def _r(c: str, n: int = 6):
    """Rounded, without a negative zero."""
    return (F.round(c, n) + 0.0).alias(c)


def _mapped(spark, d):
    rows = _rows(spark, d)
    return rows, P.transform(rows, P.block_matrix(spark, D, K, S), D, K)


@query(f"WITH {X} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM x a JOIN x b USING (i) GROUP BY 1, 2")
def gram_matrix(spark, d):
    return linalg.cross_gram(_rows(spark, d)).select("i", "j", _r("v"))


@query(f"WITH {X}, t AS (SELECT j AS i, i AS j, v FROM x) SELECT t.i, x.j, round(sum(t.v * x.v), 6) + 0.0 AS v FROM t JOIN x ON t.j = x.i GROUP BY 1, 2")
def coo_matmul(spark, d):
    x = linalg.to_coo(_rows(spark, d))
    return linalg.matmul(linalg.transpose(x), x).select("i", "j", _r("v"))


@query("WITH r AS (SELECT e / 10.0 AS epsilon, d / 100.0 AS delta FROM range(1, 10) a(e), (SELECT unnest([1, 5, 10, 20]) AS d)) SELECT epsilon::DOUBLE AS epsilon, delta::DOUBLE AS delta, greatest(1, floor(8 * ln(1 / delta) / (epsilon * epsilon)))::BIGINT AS k, least(greatest(1, floor(8 * ln(1 / delta) / (epsilon * epsilon))), greatest(floor(2 * ln(1 / delta) / (2 * epsilon - epsilon * epsilon)), floor(4 * ln(1 / delta) / epsilon)))::BIGINT AS s, greatest(10, floor(20 * ln(1 / delta) / (epsilon * epsilon)))::BIGINT AS k_wide, greatest(2, floor(4 * ln(1 / delta) / epsilon))::BIGINT AS s_wide FROM r")
def jl_dimensions(spark, d):
    rows = [(e / 10.0, x / 100.0, *P.sparse_dims(e / 10.0, x / 100.0), *P.sparse_dims_wide(e / 10.0, x / 100.0)) for e in range(1, 10) for x in (1, 5, 10, 20)]
    return spark.createDataFrame(rows, "epsilon double, delta double, k long, s long, k_wide long, s_wide long")


@query(f"WITH {BLOCK} SELECT r, j, round(v, 9) AS v FROM s")
def jl_block_matrix(spark, d):
    return P.block_matrix(spark, D, K, S).select("r", "j", _r("v", 9))


@query(f"WITH {_block('s', KW, SW, True)} SELECT r, j, round(v, 9) AS v FROM s")
def jl_block_matrix_wide(spark, d):
    return P.block_matrix(spark, D, KW, SW, True).select("r", "j", _r("v", 9))


_GN = "concat(j::VARCHAR, '_', r::VARCHAR)"


@query(f"WITH g AS (SELECT j::INTEGER AS j, r::INTEGER AS r, {_GN} AS n FROM range({D}) a(j), range({K}) b(r)), o AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY md5(n), r) AS q FROM g) SELECT r, j, round({H.sql_sign('n')} / {math.sqrt(S)!r}, 9)::DOUBLE AS v FROM o WHERE q <= {S}")
def jl_graph_matrix(spark, d):
    return P.graph_matrix(spark, D, K, S).select("r", "j", _r("v", 9))


@query(f"{MAPPED}, g AS (SELECT i, r FROM (SELECT DISTINCT i FROM x), range({K}) b(r)) SELECT g.i, g.r::INTEGER AS r, round(coalesce(y.y, 0), 6) + 0.0 AS y FROM g LEFT JOIN y USING (i, r)")
def jl_block_transform(spark, d):
    return _mapped(spark, d)[1].select("i", F.posexplode("row").alias("r", "y")).select("i", "r", _r("y"))


@query(f"{MAPPED}, a AS (SELECT i, sum(v * v) AS n FROM x GROUP BY 1), b AS (SELECT i, sum(y * y) AS m FROM y GROUP BY 1) SELECT i, round(m / n, 6) AS distortion FROM a JOIN b USING (i)")
def jl_distortion(spark, d):
    return P.norm_distortion(*_mapped(spark, d)).select("i", _r("distortion"))


@query(f"{MAPPED}, xr AS (SELECT vec_id AS i, list_transform(embedding, lambda e: e::DOUBLE) AS row FROM embeddings), z AS (SELECT i, list(coalesce(y.y, 0) ORDER BY g.r) AS row FROM (SELECT DISTINCT i FROM x) CROSS JOIN range({K}) g(r) LEFT JOIN y USING (i, r) GROUP BY i), q AS (SELECT list_distance(za.row, zb.row) / list_distance(a.row, b.row) AS q FROM xr a JOIN xr b ON a.i < b.i JOIN z za ON za.i = a.i JOIN z zb ON zb.i = b.i) SELECT count(*) AS pairs, round(avg(q), 6) AS mean_ratio, round(min(q), 6) AS min_ratio, round(max(q), 6) AS max_ratio, round(avg(CASE WHEN abs(q - 1) > {EPS} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS violations FROM q")
def jl_pair_distortion(spark, d):
    rows, mapped = _mapped(spark, d)
    out = P.pair_distortion(rows.join(mapped.withColumnRenamed("row", "mapped"), "i"), EPS)
    return out.select("pairs", *(_r(c) for c in ("mean_ratio", "min_ratio", "max_ratio", "violations")))


@query(f"WITH {BLOCK} SELECT j, count(*) AS nnz, (SELECT round(count(*) / ({K} * {D})::DOUBLE, 6) FROM s) AS ratio FROM s GROUP BY j")
def jl_column_sparsity(spark, d):
    s = P.block_matrix(spark, D, K, S)
    return P.column_sparsity(s).crossJoin(P.sparsity(s, D, K)).select("j", "nnz", _r("ratio"))


@query("WITH x AS (SELECT vec_id AS i, list_transform(embedding, lambda e: e::DOUBLE) AS row FROM embeddings) SELECT a.i AS a, b.i AS b, round(list_distance(a.row, b.row), 5) AS dist FROM x a JOIN x b ON a.i < b.i")
def pairwise_dist(spark, d):
    return linalg.pairwise(_rows(spark, d)).select("a", "b", F.round("d0", 5).alias("dist"))


@query("WITH x AS (SELECT vec_id AS i, list_transform(embedding[1:48], lambda e: e::DOUBLE) AS p, list_transform(embedding[49:64], lambda e: e::DOUBLE) AS n FROM embeddings) SELECT a.i AS a, b.i AS b, round(sqrt(greatest(0, list_distance(a.p, b.p) ** 2 - list_distance(a.n, b.n) ** 2)), 4) + 0.0 AS dist FROM x a JOIN x b ON a.i < b.i")
def pseudo_euclid_dist(spark, d):
    return linalg.pairwise(_rows(spark, d), positive=48).select("a", "b", (F.round("d0", 4) + 0.0).alias("dist"))


NAT = "p AS (SELECT n_nationkey::BIGINT AS i, [n_regionkey::DOUBLE, (n_nationkey % 7)::DOUBLE, sqrt(n_nationkey)] AS row FROM nation)"
SIMPLEX = f"{NAT}, d AS (SELECT a.i, b.i AS j, list_distance(a.row, b.row) ** 2 + 0.5 * (a.row[3] - b.row[3]) ** 4 AS v FROM p a, p b)"


def _nations(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("long").alias("i"), F.array(F.col("n_regionkey").cast("double"), (k % 7).cast("double"), F.sqrt(k.cast("double"))).alias("row"))


@query(f"WITH {SIMPLEX} SELECT i, j, round(v, 6) AS v FROM d")
def dissimilarity_simplex(spark, d):
    return P.synthetic_dissimilarity(_nations(spark, d), "simplex").select("i", "j", _r("v"))


@query(f"WITH {NAT} SELECT a.i, b.i AS j, round(CASE WHEN a.i = b.i THEN 0 ELSE greatest(0, list_distance(a.row, b.row) - abs(a.row[3]) / 2 - abs(b.row[3]) / 2) ** 2 END, 6) AS v FROM p a, p b")
def dissimilarity_balls(spark, d):
    return P.synthetic_dissimilarity(_nations(spark, d), "balls").select("i", "j", _r("v"))


@query(f"WITH {SIMPLEX} SELECT i, j, round(-0.5 * (v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER ()), 6) + 0.0 AS v FROM d")
def double_center(spark, d):
    return linalg.double_center(P.synthetic_dissimilarity(_nations(spark, d), "simplex")).select("i", "j", _r("v"))


@query()
def pseudo_euclid_embedding(spark, d):
    """Positive and negative eigenspaces projected apart; distances under the signature."""
    diss = P.synthetic_dissimilarity(_nations(spark, d), "simplex")
    rows, (k, _), _ = P.pseudo_euclidean(diss)
    return linalg.pairwise(rows, positive=k).select("a", "b", F.col("d0").alias("dist"))


@query()
def power_distance_embedding(spark, d):
    diss = P.synthetic_dissimilarity(_nations(spark, d), "simplex")
    rows, radius = P.power_distance(diss)
    return linalg.pairwise(rows).select("a", "b", F.col("d0").alias("dist"), F.lit(radius).alias("radius"))


@query(f"{MAPPED}, xr AS (SELECT vec_id AS i, list_transform(embedding, lambda e: e::DOUBLE) AS row FROM embeddings), z AS (SELECT i, list(coalesce(y.y, 0) ORDER BY g.r) AS row FROM (SELECT DISTINCT i FROM x) CROSS JOIN range({K}) g(r) LEFT JOIN y USING (i, r) GROUP BY i), e AS (SELECT abs(list_distance(a.row, b.row) - list_distance(za.row, zb.row)) / (list_distance(a.row, b.row) + 1e-10) AS e FROM xr a JOIN xr b ON a.i < b.i JOIN z za ON za.i = a.i JOIN z zb ON zb.i = b.i) SELECT round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error, round(stddev_pop(e), 6) AS std_error FROM e")
def distance_preservation(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row"))
    return P.map_preservation(rows, P.dense(P.block_matrix(spark, D, K, S), D, K)).select(*(_r(c) for c in ("max_error", "mean_error", "std_error")))


def _entry_sql(kind: str, value: str) -> str:
    n = f"concat('0_{kind}_', i::VARCHAR, '_', j::VARCHAR)"
    return f"WITH e AS (SELECT i::INTEGER AS i, j::INTEGER AS j, {n} AS n FROM range({D}) a(i), range(8) b(j)) SELECT i, j, round({value}, 6) + 0.0 AS v FROM e"


def _entries(kind):
    return lambda spark, d: P.entries(spark, kind, D, 8).select("i", "j", _r("v"))


def _named(name: str, kind: str, sql: str) -> None:
    f = _entries(kind)
    f.__name__ = name
    query(sql)(f)


_named("proj_gaussian", "gaussian", _entry_sql("gaussian", H.sql_gaussian("n")))
_named("proj_rademacher", "rademacher", _entry_sql("rademacher", f"{H.sql_sign('n')}::DOUBLE"))
_named("proj_achlioptas", "achlioptas", _entry_sql("achlioptas", f"CASE WHEN {H.sql_uniform('n')} < {1 / 6!r} THEN sqrt(3.0) WHEN {H.sql_uniform('n')} < {1 / 3!r} THEN -sqrt(3.0) ELSE 0.0 END"))
_named("proj_sparse_jl", "SJLT", f"WITH e AS (SELECT i::INTEGER AS i, j::INTEGER AS j, concat('0_sparse_jl_', i::VARCHAR, '_', j::VARCHAR) AS n FROM range({D}) a(i), range(8) b(j)), o AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY md5(n), i) AS q FROM e) SELECT i, j, {H.sql_sign('n')}::DOUBLE AS v FROM o WHERE q <= 1")
_named("proj_block_sparse", "block_sparse", _entry_sql("block_sparse", f"{H.sql_sign('n')} / {math.sqrt(D)!r}::DOUBLE"))
_PICK = "floor({u} * 64)::INTEGER"
for _kind, _value in (
    ("srht", "CASE WHEN bit_count(i & p) % 2 = 0 THEN f ELSE -f END"),
    ("srft", "f * cos(2 * pi() * i * p / 64)"),
):
    _pick = _PICK.format(u=H.sql_uniform(f"concat('0_{_kind}_pick_', j::VARCHAR)"))
    _flip = H.sql_sign(f"concat('0_{_kind}_sign_', i::VARCHAR)")
    _named(
        f"proj_{_kind}", _kind,
        f"WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings LIMIT 0), e AS (SELECT i::INTEGER AS i, j::INTEGER AS j, {_pick} AS p, {_flip}::DOUBLE AS f FROM range({D}) a(i), range(8) b(j)) SELECT i, j, round({_value} / {math.sqrt(8)!r}, 6) + 0.0 AS v FROM e".replace("WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings LIMIT 0), e", "WITH e"),
    )


_SR = H.sql_sign("concat('0_srht_sign_', x.j::VARCHAR)")
_SP = _PICK.format(u=H.sql_uniform("concat('0_srht_pick_', r::VARCHAR)"))


@query(f"WITH {X}, p AS (SELECT r::INTEGER AS r, {_SP} AS p FROM range(8) b(r)) SELECT x.i, p.r, round(sum(CASE WHEN bit_count(x.j & p.p) % 2 = 0 THEN x.v ELSE -x.v END * {_SR}) / {math.sqrt(8)!r}, 6) + 0.0 AS y FROM x, p GROUP BY 1, 2")
def srht_transform(spark, d):
    return P.project(_rows(spark, d), "srht", D, 8).select("i", F.posexplode("row").alias("r", "y")).select("i", "r", _r("y"))


_AK, _AS = 40, 4
_ab = _block("s", _AK, _AS, False).replace(f"range({D}) a(j)", "(SELECT DISTINCT vec_id // 2 AS j FROM embeddings)").replace("j::INTEGER AS j", "j::BIGINT AS j")


@query(f"WITH {X}, {_ab}, a AS (SELECT i // 2 AS n, j, v FROM x WHERE i % 2 = 0), b AS (SELECT i // 2 AS n, j, v FROM x WHERE i % 2 = 1), e AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM a JOIN b USING (n) GROUP BY 1, 2), sa AS (SELECT s.r, a.j, sum(s.v * a.v) AS v FROM s JOIN a ON s.j = a.n GROUP BY 1, 2), sb AS (SELECT s.r, b.j, sum(s.v * b.v) AS v FROM s JOIN b ON s.j = b.n GROUP BY 1, 2), z AS (SELECT sa.j AS i, sb.j AS j, sum(sa.v * sb.v) AS v FROM sa JOIN sb USING (r) GROUP BY 1, 2) SELECT round(sqrt(sum((e.v - coalesce(z.v, 0)) ** 2)) / sqrt(sum(e.v ** 2)), 6) AS error FROM e LEFT JOIN z USING (i, j)")
def approx_matmul_error(spark, d):
    """A'B of the even and odd rows against the product of their sketches."""
    x = linalg.to_coo(_rows(spark, d))
    half = lambda p: x.where(F.col("i") % 2 == p).select(F.floor(F.col("i") / 2).alias("i"), "j", "v")
    a, b = half(0), half(1)
    n = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] // 2 + 1
    s = P.block_matrix(spark, n, _AK, _AS).select(F.col("r").alias("i"), F.col("j").cast("long").alias("j"), "v")
    exact = linalg.matmul(linalg.transpose(a), b)
    sa, sb = linalg.matmul(s, a), linalg.matmul(s, b)
    return linalg.relative_error(exact, linalg.matmul(linalg.transpose(sa), sb)).select(_r("error"))


@query()
def learned_map(spark, d):
    """A few gradient steps of the optimised map, and its largest distortion beside those of Gaussian draws."""
    rows = _rows(spark, d)
    m, var, history = P.learn_map(rows, D, 16, steps=5)
    best = P.max_distortion(rows, {0: m.T * 4.0})
    return spark.createDataFrame(history, "step long, objective double, gradient double, variance double, norm double").crossJoin(best.select("distortion"))


_TS = [f"concat('{t}_gaussian_', i::VARCHAR, '_', j::VARCHAR)" for t in range(3)]


@query(f"WITH {X}, g AS (" + " UNION ALL ".join(f"SELECT {t}::BIGINT AS trial, i::INTEGER AS i, j::INTEGER AS j, {H.sql_gaussian(n)} AS g FROM range({D}) a(i), range(16) b(j)" for t, n in enumerate(_TS)) + "), y AS (SELECT trial, x.i AS vec, g.j, sum(x.v * g.g) AS y FROM x JOIN g ON g.i = x.j GROUP BY 1, 2, 3), n AS (SELECT trial, vec, sum(y * y) / 16 AS m FROM y GROUP BY 1, 2), o AS (SELECT i AS vec, sum(v * v) AS b FROM x GROUP BY 1) SELECT trial, round(max(abs(m - b)), 5) AS distortion FROM n JOIN o USING (vec) GROUP BY trial")
def gaussian_baseline(spark, d):
    draws = {t: P.sample_matrix(spark, "gaussian", D, 16, t) for t in range(3)}
    return P.max_distortion(_rows(spark, d), draws).select("trial", F.round("distortion", 5).alias("distortion"))


# ---- least squares

_X = ["1", "l_quantity", "l_discount", "l_tax"]


def _lsq(spark, d):
    return table(spark, d, "lineitem"), [F.lit(1.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], F.col("l_extendedprice")


@query("SELECT " + ", ".join(f"round(sum(({_X[i]})::DOUBLE * {_X[j]}), 2) AS g_{i}_{j}" for i in range(4) for j in range(i, 4)) + ", " + ", ".join(f"round(sum({_X[i]} * l_extendedprice), 1) AS c_{i}" for i in range(4)) + ", count(*) AS n FROM lineitem")
def normal_equations(spark, d):
    out = leastsq.normal_equations(*_lsq(spark, d))
    return out.select(*(F.round(c, 2 if c[0] == "g" else 1).alias(c) for c in out.columns if c[0] in "gc"), "n")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ols_regr(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


_CN = "concat('0_', l_orderkey::VARCHAR, '_', l_linenumber::VARCHAR, '_', l_partkey::VARCHAR)"
_CS = H.sql_sign(_CN)


@query(f"SELECT ({H.sql_h32(_CN, 1)} % 64)::INTEGER AS bucket, round(sum({_CS} * 1.0), 4)::DOUBLE AS x0, round(sum({_CS} * l_quantity), 4) AS x1, round(sum({_CS} * l_extendedprice), 2) AS y FROM lineitem GROUP BY 1")
def countsketch_rows(spark, d):
    row = H.key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    out = leastsq.countsketch(table(spark, d, "lineitem"), row, {"x0": F.lit(1.0), "x1": F.col("l_quantity"), "y": F.col("l_extendedprice")}, 64)
    return out.select("bucket", _r("x0", 4), _r("x1", 4), _r("y", 2))


@query()
def sketch_and_solve(spark, d):
    """Relative residuals of sketched, normal-equation and QR solutions."""
    df, x, y = _lsq(spark, d)
    row = H.key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    out = None
    for name, beta in (("sketch", leastsq.sketch_and_solve(df, row, x, y, 512, 128)), ("normal", leastsq.solve_normal(df, x, y)), ("qr", leastsq.tsqr(df, x, y))):
        r = leastsq.residual(df, x, y, beta).select(F.lit(name).alias("method"), "residual")
        out = r if out is None else out.unionByName(r)
    return out


@query()
def sketch_sweep(spark, d):
    """Relative residuals over a grid of sketch sizes; every repeat has its own seed."""
    from tessera.sources.tables import Sweep

    df, x, y = _lsq(spark, d)
    row = H.key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    out = None
    for cell in Sweep(k1=[128, 512], k2=[32, 64], repeats=2).table(spark).collect():
        beta = leastsq.sketch_and_solve(df, row, x, y, cell["k1"], cell["k2"], cell["repeat"])
        r = leastsq.residual(df, x, y, beta).select(F.lit(cell["k1"]).alias("k1"), F.lit(cell["k2"]).alias("k2"), F.lit(cell["repeat"]).alias("repeat"), "residual")
        out = r if out is None else out.unionByName(r)
    return out


# ---- low rank plus sparse

_CARD = 200


@query(f"WITH {X} SELECT i, j, v FROM x ORDER BY abs(v) DESC, i, j LIMIT {_CARD}")
def hard_threshold_topcard(spark, d):
    return linalg.hard_threshold(linalg.to_coo(_rows(spark, d)), _CARD)


@query(f"WITH {X} SELECT j AS pixel, round(avg(v), 8) + 0.0 AS mean FROM x GROUP BY 1")
def frame_mean(spark, d):
    return lowrank.frames_mean(_rows(spark, d)).select("pixel", (F.round("mean", 8) + 0.0).alias("mean"))


@query(f"WITH {X}, m AS (SELECT j, avg(v) AS m FROM x GROUP BY 1) SELECT round(sqrt(avg((v - m) ** 2)), 8) AS rmse FROM x JOIN m USING (j)")
def rmse_recon(spark, d):
    x = linalg.to_coo(_rows(spark, d))
    m = x.groupBy("j").agg(F.avg("v").alias("m"))
    return x.join(F.broadcast(m), "j").agg(F.round(linalg.rmse(F.col("v"), F.col("m")), 8).alias("rmse"))


_U = [1 / 8.0 if j % 2 == 0 else -1 / 8.0 for j in range(D)]
_US = "[" + ", ".join(map(str, _U)) + "]"


@query(f"WITH {X}, p AS (SELECT i, sum(v * {_US}[j + 1]) AS p FROM x GROUP BY 1) SELECT x.i, x.j, round(p.p * {_US}[x.j + 1], 6) + 0.0 AS v FROM x JOIN p USING (i)")
def low_rank_step(spark, d):
    """One projection of the rows on a given direction, by array expressions alone."""
    import numpy as np

    return linalg.to_coo(lowrank.low_rank_step(_rows(spark, d), np.array(_U)[:, None])).select("i", "j", _r("v"))


@query(f"WITH {X} SELECT 1::BIGINT AS iteration, 0.0::DOUBLE AS rmse")
def godec_one_iter(spark, d):
    """With all entries kept as sparse the reconstruction is exact after one iteration."""
    _, errors = lowrank.decompose(_rows(spark, d), D, rank=1)
    return spark.createDataFrame([(t + 1, round(e, 9) + 0.0) for t, e in enumerate(errors)], "iteration long, rmse double")


@query()
def godec_decompose(spark, d):
    """Errors by iteration with a bounded sparse part, for each projection."""
    rows, out = _rows(spark, d), []
    for kind in P.KINDS:
        _, errors = lowrank.decompose(rows, D, rank=4, card=2000, max_iter=2, kind=kind)
        out += [(kind, t + 1, e) for t, e in enumerate(errors)]
    return spark.createDataFrame(out, "projection string, iteration long, rmse double")
