"""Queries on benchmark files, supervised projections, binary factors and Kronecker structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.operators import binary as B
from tessera.operators import kronecker as K
from tessera.operators import linalg
from tessera.operators import supervised as D
from tessera.plans.registry import query, table
from tessera.sources import tables as T
from tessera.sources.shared import new_path

# ---- sources: orders stand for benchmark rows (video = priority, pixels = year, projection = status, seconds = price)

_BENCH = "b AS (SELECT o_orderpriority AS video, year(o_orderdate)::BIGINT AS pixels, o_orderstatus AS projection, o_totalprice AS seconds, o_orderkey AS k FROM orders)"


def _bench(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("video"), F.year("o_orderdate").cast("long").alias("pixels"), F.col("o_orderstatus").alias("projection"), F.col("o_totalprice").alias("seconds"), F.col("o_orderkey").alias("k"))


@query(f"WITH {_BENCH} SELECT projection, pixels, min(seconds) AS seconds FROM b GROUP BY 1, 2")
def bench_pivot(spark, d):
    cells = T.pivot(_bench(spark, d))
    return cells.select("projection", F.explode("cells").alias("pixels", "seconds"))


@query(f"WITH {_BENCH} SELECT video, pixels, projection, seconds, k FROM (SELECT *, row_number() OVER (PARTITION BY video, pixels ORDER BY seconds, k) AS r FROM b) WHERE r = 1")
def bench_best(spark, d):
    return T.best_by(_bench(spark, d), ["video", "pixels"], "seconds", "k")


@query(f"WITH {_BENCH} SELECT video, pixels, projection, round(seconds, 2) AS seconds FROM b")
def bench_csv_round_trip(spark, d):
    """Rows written as headered CSV to the session's shared folder and read back typed."""
    path = new_path(spark, "bench")
    T.write_csv(_bench(spark, d).select("video", "pixels", "projection", "seconds"), path)
    return T.read_bench(spark, path).select("video", "pixels", "projection", F.round("seconds", 2).alias("seconds"))


@query("SELECT k1::INTEGER AS k1, k2::INTEGER AS k2, r::INTEGER AS repeat FROM (SELECT unnest([64, 128, 256]) AS k1), (SELECT unnest([32, 64, 128]) AS k2), (SELECT unnest([0, 1]) AS r) WHERE k2 <= k1")
def sweep_grid(spark, d):
    return T.Sweep(k1=T.int_list("64,128,256"), k2=T.int_list("32,64,128"), repeats=2).table(spark)


# ---- supervised projections

_X = "x AS (SELECT vec_id AS i, label, generate_subscripts(embedding, 1)::INTEGER - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_R = "r AS (SELECT vec_id AS i, label, list_transform(embedding, lambda e: e::DOUBLE) AS row FROM embeddings)"


def _rows(spark, d):
    return linalg.to_rows(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT 0.3 + 0.1::DOUBLE * t / 49 AS e FROM range(50) r(t)) SELECT round(e, 9) AS epsilon, least(64, ceil(12 * ln(n) / (e * e * (1.5 - e))))::BIGINT AS p, round(12 * ln(n) * (3 * e - 3 * e * e) / pow(1.5 * e * e - e * e * e, 2), 2) AS slope FROM g, n")
def jl_dimension_grid(spark, d):
    n = table(spark, d, "embeddings").count()
    rows = [(round(e, 9), p, round(s, 2)) for e, p, s in D.best_epsilon(n, 64)]
    return spark.createDataFrame(rows, "epsilon double, p long, slope double")


@query(f"WITH {_X}, s AS (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1) SELECT x.i, x.j, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 5) + 0.0 AS v FROM x JOIN s USING (j)")
def standardise(spark, d):
    return linalg.to_coo(D.standardised(_rows(spark, d))).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {_X}, s AS (SELECT label, j, sum(v) AS v FROM x GROUP BY 1, 2) SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM s a JOIN s b USING (label) GROUP BY 1, 2")
def supervised_scatter(spark, d):
    return D.scatter(_rows(spark, d)).select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


@query(f"WITH {_R}, s AS (SELECT a.label, a.i, sum(list_distance(a.row, b.row)) AS s FROM r a JOIN r b USING (label) GROUP BY 1, 2) SELECT label, i, round(s, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9), i) AS q FROM s) WHERE q = 1")
def class_medoids(spark, d):
    return D.medoids(_rows(spark, d)).select("label", "i", F.round("total", 4).alias("total"))


_CENT = f"{_X}, {_R}, c AS (SELECT label, list(m ORDER BY j) AS row FROM (SELECT label, j, avg(v) AS m FROM x GROUP BY 1, 2) GROUP BY 1), n AS (SELECT r.i, r.label, c.label AS predicted, row_number() OVER (PARTITION BY r.i ORDER BY round(list_distance(r.row, c.row) ** 2, 12), c.label) AS q FROM r, c)"


@query(f"WITH {_CENT} SELECT i, label, predicted FROM n WHERE q = 1")
def nearest_centroid(spark, d):
    rows = _rows(spark, d)
    return D.nearest(rows, D.centroids(rows))


@query(f"WITH {_CENT} SELECT round(avg(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS accuracy FROM n WHERE q = 1")
def centroid_accuracy(spark, d):
    rows = _rows(spark, d)
    return D.accuracy(D.nearest(rows, D.centroids(rows))).select(F.round("accuracy", 9).alias("accuracy"))


@query()
def dictionary_classifier(spark, d):
    """Supervised projection, learned dictionary and codes; nearest medoid in the projected space, beside PCA."""
    rows = D.standardised(_rows(spark, d)).cache()
    out = []
    for name, basis in (("supervised", D.supervised_basis(rows, 64, 10)), ("pca", D.pca_basis(rows, 64, 10))):
        low = linalg.times(rows, basis)
        dictionary, changes = D.learn_dictionary(low, 10, 12, max_iter=3)
        coded = D.sparse_codes(low, dictionary)
        error = coded.select(F.avg(F.aggregate("code", F.lit(0.0), lambda s, v: s + F.abs(v))).alias("l1")).first()["l1"]
        out.append((name, D.accuracy(D.nearest(low, D.medoids(low))).first()["accuracy"], error, changes[-1]))
    return spark.createDataFrame(out, "projection string, accuracy double, code_l1 double, change double")


# ---- binary factors

RANK = 3


@query("SELECT u::BIGINT AS u, k::INTEGER AS k, ((u >> (3 - k)) & 1)::INTEGER AS bit FROM range(16) a(u), range(4) b(k)")
def binary_vectors(spark, d):
    return B.patterns(spark, 4).select("u", F.posexplode("bits").alias("k", "bit"))


_WEIGHTS = np.array([[10.0, 0.02, 0.01], [20.0, 0.04, 0.03], [5.0, 0.01, 0.05]])
_PATS = " UNION ALL ".join(f"SELECT {u}::BIGINT AS u, [{', '.join(repr(float(x)) for x in p)}] AS fit" for u, p in enumerate(B._combine(RANK) @ _WEIGHTS))


@query(f"WITH p AS ({_PATS}), x AS (SELECT row_number() OVER () AS i, [l_quantity, l_discount, l_tax] AS row FROM lineitem), s AS (SELECT i, u, round(list_sum(list_transform(range(1, 4), lambda c: (row[c] - fit[c]) * (row[c] - fit[c]))), 12) AS loss FROM x, p) SELECT u, count(*) AS n, round(sum(loss), 4) AS loss FROM (SELECT i, u, loss, row_number() OVER (PARTITION BY i ORDER BY loss, u) AS q FROM s) WHERE q = 1 GROUP BY u")
def bmf_tstep(spark, d):
    """Rows by the 0/1 pattern that fits them best for given weights: an exhaustive search, a row at a time."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), F.array("l_quantity", "l_discount", "l_tax").alias("row"))
    return B.assign(rows, _WEIGHTS).groupBy("u").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 4).alias("loss"))


def _mixture(seed: int, m: int, n: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 2, (m, r))
    a = rng.random((r, n))
    return t, a / a.sum(0)


_BITS = H.sql_h32("concat('bmf_', i::VARCHAR, '_', k::VARCHAR)")


@query(f"SELECT string_agg((({_BITS} >> 8) % 2)::VARCHAR, '' ORDER BY i) AS pattern, 0.0::DOUBLE AS residual FROM range(40) a(i), range(4) b(k) GROUP BY k")
def bmf_exact(spark, d):
    """The columns of T, drawn by digest, recovered from D = T A alone, with the residual of the factors."""
    grid = spark.range(160).select((F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).cast("int").alias("k"))
    t = linalg.to_numpy(grid.select("i", F.col("k").alias("j"), (F.shiftright(H.h32(H.key("bmf", F.col("i"), F.col("k"))), 8) % 2).alias("v")), (40, 4))
    _, a = _mixture(3, 40, 16, 4)
    got, w = B.factor_exact(spark, t @ a)
    residual = round(float(np.abs(got @ w - t @ a).max()), 6)
    return spark.createDataFrame([("".join(str(int(v)) for v in c), residual) for c in got.T], "pattern string, residual double")


@query()
def bmf_approximate(spark, d):
    """Losses of alternating optimisation on noisy mixtures, weights on the simplex."""
    t, a = _mixture(5, 60, 12, 3)
    noisy = t @ a + 0.02 * np.random.default_rng(1).standard_normal((60, 12))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(noisy)], "i long, row array<double>")
    _, _, losses = B.factor_approximate(rows, 3, simplex=True)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(losses)], "iteration long, loss double")


# ---- Kronecker structure of the nations x regions incidence, 12 x 12

_ORDER = 12
_PAT = "t AS (SELECT DISTINCT (c_nationkey % 12)::BIGINT + 1 AS i, ((o_orderkey % 2) * 6 + c_nationkey % 3 * 2)::BIGINT + 1 AS j FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%')"
_PAIRS = f"p AS (SELECT i::BIGINT AS n1, ({_ORDER} // i)::BIGINT AS n2 FROM range(2, {_ORDER}) r(i) WHERE {_ORDER} % i = 0)"


def _pattern(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.where(F.col("o_orderpriority").like("1%")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select((F.col("c_nationkey") % 12 + 1).cast("long").alias("i"), ((F.col("o_orderkey") % 2) * 6 + F.col("c_nationkey") % 3 * 2 + 1).cast("long").alias("j")).distinct()


@query(f"SELECT i::BIGINT AS divisor FROM range(1, {_ORDER + 1}) r(i) WHERE {_ORDER} % i = 0")
def kron_divisors(spark, d):
    return K.divisors(spark, _ORDER)


@query(f"WITH {_PAIRS} SELECT n1, n2 FROM p")
def kron_pairs(spark, d):
    return K.compatible(spark, _ORDER)


@query(f"WITH {_PAT} SELECT i, j, (j - 1) * {_ORDER} + i AS l, (i - 1) // 3 + 1 AS i1, (i - 1) % 3 + 1 AS i2 FROM t")
def kron_indices(spark, d):
    i1, i2 = K.split(F.col("i"), 3)
    back, _ = K.pair_of(K.linear_index(F.col("i"), F.col("j"), _ORDER), _ORDER)
    return _pattern(spark, d).select(back.alias("i"), "j", K.linear_index(F.col("i"), F.col("j"), _ORDER).alias("l"), i1.alias("i1"), i2.alias("i2"))


_CHECK = f"{_PAIRS}, s AS (SELECT n1, n2, ((j - 1) // n2) * n1 + (i - 1) // n2 + 1 AS l1, ((j - 1) % n2) * n2 + (i - 1) % n2 + 1 AS l2 FROM t, p), k AS (SELECT p.n1, p.n2, coalesce(c = a * b, true) AS factorizable FROM p LEFT JOIN (SELECT n1, n2, count(DISTINCT (l1, l2)) AS c, count(DISTINCT l1) AS a, count(DISTINCT l2) AS b FROM s GROUP BY 1, 2) USING (n1, n2))"


@query(f"WITH {_PAT}, {_CHECK} SELECT n1, n2, factorizable FROM k")
def kron_check(spark, d):
    return K.check(_pattern(spark, d), _ORDER)


@query(f"WITH {_PAT}, {_CHECK} SELECT bool_and(factorizable) AS maximal FROM k")
def kron_maximal(spark, d):
    return K.is_maximal(K.check(_pattern(spark, d), _ORDER))


#: [[1,1],[0,0]] x [[1,1],[0,0]] x a 3 x 3 pattern: every compatible pair factorises.
_MAXIMAL = "t AS (SELECT (a.i - 1) * 6 + (b.i - 1) * 3 + c.i AS i, (a.j - 1) * 6 + (b.j - 1) * 3 + c.j AS j FROM (VALUES (1, 1), (1, 2)) a(i, j), (VALUES (1, 1), (1, 2)) b(i, j), (VALUES (1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (3, 3)) c(i, j))"


def _maximal(spark):
    top = K.pattern(spark, [[1, 1], [0, 0]])
    return K.product(top, K.product(top, K.pattern(spark, [[1, 1, 1], [0, 0, 0], [1, 1, 1]]), 3), 6)


@query(f"WITH {_MAXIMAL} SELECT i::BIGINT AS i, j::BIGINT AS j FROM t")
def kron_product(spark, d):
    return _maximal(spark)


@query(f"WITH {_MAXIMAL} SELECT DISTINCT ((i - 1) // 3 + 1)::BIGINT AS i, ((j - 1) // 3 + 1)::BIGINT AS j FROM t")
def kron_factors(spark, d):
    return K.factors(_maximal(spark), 4, 3)[0]


@query("WITH RECURSIVE " + f"{_MAXIMAL}, {_CHECK}, " + K.CHAINS.format(pairs="k", n=_ORDER).strip().removeprefix("WITH RECURSIVE "))
def kron_chains(spark, d):
    """All chains of factor orders of a maximal pattern, by a recursive query over direct divisibility."""
    return K.chains(K.check(_maximal(spark), _ORDER), _ORDER)


@query(f"WITH {_MAXIMAL}, {_CHECK}, l AS (SELECT n1 AS l FROM k WHERE factorizable) SELECT a.l AS src, b.l AS dst, (b.l // a.l)::BIGINT AS ratio FROM l a JOIN l b ON b.l > a.l AND b.l % a.l = 0 WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.l > a.l AND o.l < b.l AND b.l % o.l = 0 AND o.l % a.l = 0)")
def kron_graph(spark, d):
    return K.graph(K.check(_maximal(spark), _ORDER))[1]
