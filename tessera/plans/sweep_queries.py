"""Sweeps over sizes and settings, generators of test data, and sources that have no table of their own."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import kernels as Kn
from tessera.functions import testfunctions as Tf
from tessera.operators import binary, gp, leastsq, linalg, lowrank, sensing, supervised
from tessera.operators import projections as P
from tessera.plans.projection_queries import X, _block, _r, _rows
from tessera.plans.registry import query, table
from tessera.plans.sensing_queries import _A, M_, N, RHO
from tessera.sources import tables as T
from tessera.sources.shared import new_path, stored

D = 64

# ---- projections


def _start(kind: str) -> str:
    """(i, s): the test vector of a kind."""
    n = f"concat('0_{kind}_', i::VARCHAR, '_0')"
    value = {
        "gaussian": H.sql_gaussian("n"),
        "rademacher": f"{H.sql_sign('n')}::DOUBLE",
        "achlioptas": f"CASE WHEN {H.sql_uniform('n')} < {1 / 6!r} THEN sqrt(3.0) WHEN {H.sql_uniform('n')} < {1 / 3!r} THEN -sqrt(3.0) ELSE 0.0 END",
        "sparse_jl": f"CASE WHEN row_number() OVER (ORDER BY md5(n), i) = 1 THEN {H.sql_sign('n')} ELSE 0 END::DOUBLE",
        "block_sparse": f"{H.sql_sign('n')} / {math.sqrt(D)!r}::DOUBLE",
        "srht": "CASE WHEN bit_count(i & p) % 2 = 0 THEN f ELSE -f END::DOUBLE",
        "srft": "f * cos(2 * pi() * i * p / 64)",
    }[kind]
    pick, flip = H.sql_uniform(f"'0_{kind}_pick_0'"), H.sql_sign(f"concat('0_{kind}_sign_', i::VARCHAR)")
    return f"SELECT '{kind}' AS kind, i, {value} AS s FROM (SELECT i::INTEGER AS i, {n} AS n, floor({pick} * 64)::INTEGER AS p, {flip}::DOUBLE AS f FROM range({D}) r(i))"


@query(f"""WITH {X}, s AS ({' UNION ALL '.join(_start(k) for k in P.KINDS)}), g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (i) GROUP BY 1, 2),
y AS (SELECT kind, g.i AS j, sum(g.v * s.s) AS y FROM g JOIN s ON s.i = g.j GROUP BY 1, 2), l AS (SELECT kind, sqrt(sum(y * y)) AS l FROM y GROUP BY 1),
e AS (SELECT kind, x.i, sum(x.v * y.y / l.l) AS p FROM x JOIN y USING (j) JOIN l USING (kind) GROUP BY 1, 2) SELECT kind AS projection, round(sum(p * p), 5) AS energy FROM e GROUP BY 1""")
def low_rank_kinds(spark, d):
    """What one direction found from a test vector of each kind holds of the rows."""
    rows, out = _rows(spark, d), None
    for kind in P.KINDS:
        row = lowrank.captured(rows, D, kind).select(F.lit(kind).alias("projection"), F.round("energy", 5).alias("energy"))
        out = row if out is None else out.unionByName(row)
    return out


_SCALES = [(e, *P.sparse_dims(e, 0.1)) for e in (0.4, 0.6, 0.8)]


@query(f"WITH {X}, n AS (SELECT i, sqrt(sum(v * v)) AS n FROM x GROUP BY 1), " + ", ".join(_block(f"s{t}", k, s, False) + f", y{t} AS (SELECT i, sqrt(sum(y * y)) AS y FROM (SELECT x.i, s{t}.r, sum(x.v * s{t}.v) AS y FROM x JOIN s{t} USING (j) GROUP BY 1, 2) GROUP BY 1)" for t, (_, k, s) in enumerate(_SCALES))
       + " " + " UNION ALL ".join(f"SELECT {e!r}::DOUBLE AS epsilon, {k}::BIGINT AS k, {s}::BIGINT AS s, round(avg(abs(y / n - 1)), 6) AS mean_error, round(max(abs(y / n - 1)), 6) AS max_error, round(avg(CASE WHEN abs(y / n - 1) > {e!r} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS violations FROM n JOIN y{t} USING (i)" for t, (e, k, s) in enumerate(_SCALES)))
def jl_scaling(spark, d):
    """Distortion of norms, and the share beyond epsilon, as the dimensions grow with 1/epsilon."""
    rows, out = _rows(spark, d), None
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    before = rows.select("i", norm("row").alias("n"))
    for e, k, s in _SCALES:
        after = P.transform(rows, P.block_matrix(spark, D, k, s), D, k).select("i", norm("row").alias("y"))
        off = F.abs(F.col("y") / F.col("n") - 1)
        row = before.join(after, "i").agg(F.round(F.avg(off), 6).alias("mean_error"), F.round(F.max(off), 6).alias("max_error"), F.round(F.avg((off > e).cast("double")), 6).alias("violations"))
        row = row.select(F.lit(e).alias("epsilon"), F.lit(k).cast("long").alias("k"), F.lit(s).cast("long").alias("s"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("WITH c AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS epsilon) SELECT epsilon, greatest(1, floor(2 * ln(n) / (epsilon * epsilon)))::BIGINT AS k FROM c, e")
def jl_pair_dimensions(spark, d):
    n = table(spark, d, "embeddings").count()
    return spark.createDataFrame([(e, P.pairs_dim(n, e)) for e in (0.1, 0.25, 0.5, 1.0)], "epsilon double, k long")


@query(f"WITH {X} SELECT i, j, v FROM x")
def coo_round_trip(spark, d):
    """Rows to coordinates and back, from a Parquet matrix."""
    rows = T.read_matrix(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")
    return linalg.to_coo(linalg.from_coo(linalg.to_coo(rows)))


# ---- least squares

_CONDS, _CD, _CN = (10.0, 1e4, 1e8), 256, 8


@query(" UNION ALL ".join(f"SELECT {c!r}::DOUBLE AS cond, i::BIGINT AS i, j::INTEGER AS j, round(sum((1 - 2 * (bit_count(i & k) % 2)) * (1 - 2 * (bit_count(k & j) % 2)) * pow({c ** (-1 / (_CN - 1))!r}, k)) / {math.sqrt(_CD * _CN)!r}, 9) + 0.0 AS v FROM range({_CD}) a(i), range({_CN}) b(j), range({_CN}) e(k) GROUP BY i, j" for c in _CONDS))
def conditioned_rows(spark, d):
    out = None
    for c in _CONDS:
        row = linalg.to_coo(leastsq.conditioned_rows(spark, _CD, _CN, c)).select(F.lit(c).alias("cond"), "i", "j", _r("v", 9))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def condition_sweep(spark, d):
    """Relative error of the solution of each method as the condition number grows; repeats have their own seeds."""
    out = []
    for c in _CONDS:
        rows = leastsq.conditioned_rows(spark, 4096, _CN, c)
        x = [F.col("row")[j] for j in range(_CN)]
        df = stored(rows.withColumn("b", sum(x, F.lit(0.0))))  # the solution is all ones
        x = [F.col("row")[j] for j in range(_CN)]
        ways = {"normal": lambda: leastsq.solve_normal(df, x, F.col("b")), "qr": lambda: leastsq.tsqr(df, x, F.col("b"))}  # noqa: B023
        ways |= {f"sketch {t}": lambda t=t: leastsq.sketch_and_solve(df, F.col("i"), x, F.col("b"), 512, 64, t) for t in range(2)}  # noqa: B023
        for name, solve in ways.items():
            out.append((c, name, float(np.linalg.norm(solve() - 1) / math.sqrt(_CN))))
    return spark.createDataFrame(out, "cond double, method string, error double")


# ---- classes, matching

_C = "(SELECT generate_series AS i FROM generate_series(0, 299))"


@query(f"SELECT i::BIGINT AS i, (i % 4)::INTEGER AS label, j::INTEGER AS j, round(2.0 * {H.sql_gaussian("concat('c_0_', (i % 4)::VARCHAR, '_', j::VARCHAR)")} + {H.sql_gaussian("concat('p_0_', i::VARCHAR, '_', j::VARCHAR)")}, 6) + 0.0 AS v FROM range(300) a(i), range(6) b(j)")
def sample_classes(spark, d):
    rows = supervised.sample_classes(spark, 300, 6, 4)
    return rows.select("i", "label", F.posexplode("row").alias("j", "v")).select("i", "label", "j", _r("v"))


@query("""WITH b AS (SELECT l_quantity AS a0, l_discount AS a1, l_tax AS a2, l_tax + 0.1 * l_discount AS b0, l_quantity + 100 * l_tax AS b1, l_discount - 0.001 * l_quantity AS b2 FROM lineitem),
c AS (SELECT corr(a0, b0) AS c00, corr(a0, b1) AS c01, corr(a0, b2) AS c02, corr(a1, b0) AS c10, corr(a1, b1) AS c11, corr(a1, b2) AS c12, corr(a2, b0) AS c20, corr(a2, b1) AS c21, corr(a2, b2) AS c22 FROM b),
g AS (SELECT unnest([[c00, c01, c02], [c10, c11, c12], [c20, c21, c22]]) AS r, unnest([0, 1, 2]) AS i FROM c),
p AS (SELECT [x, y, z] AS p FROM range(3) a(x), range(3) b(y), range(3) d(z) WHERE x <> y AND y <> z AND x <> z),
s AS (SELECT p, sum(r[p[i + 1] + 1]) AS s FROM p, g GROUP BY p), w AS (SELECT p FROM s ORDER BY s DESC LIMIT 1)
SELECT i::INTEGER AS i, p[i + 1]::INTEGER AS matched, round(r[p[i + 1] + 1], 6) AS correlation FROM g, w""")
def bmf_match(spark, d):
    """Columns matched with mixtures of them, one to one, by greatest summed correlation."""
    t = table(spark, d, "lineitem")
    b = {"b0": F.col("l_tax") + 0.1 * F.col("l_discount"), "b1": F.col("l_quantity") + 100 * F.col("l_tax"), "b2": F.col("l_discount") - 0.001 * F.col("l_quantity")}
    corr = binary.correlations(t.withColumns(b), ["l_quantity", "l_discount", "l_tax"], list(b))
    return spark.createDataFrame([(i, j, round(float(corr[i, j]), 6)) for i, j in enumerate(binary.match(corr))], "i int, matched int, correlation double")


# ---- one-bit measurements


@query(f"WITH {_A} SELECT row, CASE WHEN y >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign, CASE WHEN {H.sql_uniform("concat('l_0_', row::VARCHAR)")} < 1 / (1 + exp(-y)) THEN 1.0 ELSE -1.0 END::DOUBLE AS logistic FROM y")
def one_bit_signs(spark, d):
    y = sensing.measure(sensing.gaussian_matrix(spark, M_, N), sensing.sparse_signal(spark, N, RHO))
    return sensing.signs(y).withColumnRenamed("y", "sign").join(sensing.signs(y, "logistic").withColumnRenamed("y", "logistic"), "row")


@query()
def one_bit_trials(spark, d):
    """Mean and deviation of the error over trials, for both laws of signs."""
    out = []
    for task in ("onebit_cs", "logistic"):
        for seed in range(2):
            a, x = sensing.gaussian_matrix(spark, 60, 20, seed), sensing.sparse_signal(spark, 20, 0.3, seed)
            got, _ = sensing.one_bit_reconstruct(a, sensing.signs(sensing.measure(a, x), task, seed), 20, steps=3, inner=4, task=task)
            truth = np.array([r["x"] for r in x.orderBy("col").collect()])  # 20 entries
            out.append((task, sensing.recovery_error(got, truth)))
    trials = spark.createDataFrame(out, "task string, error double")
    return trials.groupBy("task").agg(F.count("*").alias("trials"), F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"))


# ---- processes and search


@query(f"""WITH z AS (SELECT t::INTEGER AS draw, {H.sql_gaussian("concat('prior_0_0_', t::VARCHAR)")} AS z0, {H.sql_gaussian("concat('prior_0_1_', t::VARCHAR)")} AS z1 FROM range(5) r(t)),
l AS (SELECT sqrt(1 + 1e-6) AS l00, exp(-0.5) / sqrt(1 + 1e-6) AS l10, sqrt(1 + 1e-6 - exp(-1.0) / (1 + 1e-6)) AS l11)
SELECT 0::INTEGER AS i, draw, round(l00 * z0, 6) + 0.0 AS y FROM z, l UNION ALL SELECT 1, draw, round(l10 * z0 + l11 * z1, 6) + 0.0 FROM z, l""")
def gp_prior(spark, d):
    """Draws of a squared-exponential process at two points."""
    out = gp.prior_table(spark, Kn.SquaredExponential.of(1.0, 1.0), np.array([[0.0], [1.0]]), 5)
    return out.select("i", "draw", _r("y"))


@query()
def bbo_staircase(spark, d):
    """Best value by query on a staircase of five dimensions, beside a fixed kernel."""
    out = []
    for name, fixed in (("chosen", False), ("fixed", True)):
        _, _, h = gp.minimise(spark, Tf.staircase_numpy, [(-2, 2)] * 5, gp.Settings(budget=14, fixed=fixed))
        out += [(name, r["query"], r["best"], r["kernel"]) for r in h]
    return spark.createDataFrame(out, "method string, query long, best double, kernel string")


# ---- frames


@query("SELECT f::BIGINT AS i, (x * 4 + y)::INTEGER AS j, ((f * 37 + y * 11 + x * 5) % 256)::DOUBLE AS v FROM range(3) a(f), range(4) b(y), range(5) c(x)")
def frames_column_major(spark, d):
    """Raw frames of 4 x 5 pixels from a binary file, columns one after the other."""
    f, y, x = np.meshgrid(np.arange(3), np.arange(4), np.arange(5), indexing="ij")
    path = new_path(spark, "frames")
    T.write_frames(spark, f"{path}/a.raw", ((f * 37 + y * 11 + x * 5) % 256).astype(np.uint8))
    return linalg.to_coo(T.read_frames(spark, path, 4, 5))
