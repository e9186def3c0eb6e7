"""Queries over sketches: distinct counts, retrieval, moments."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.operators import cardinality as C
from tessera.operators import moments as Mo
from tessera.operators import retrieval as R
from tessera.plans.registry import query, table
from tessera.sources.shared import stored
from tessera.streaming import sketches as S

M = 64
TAUS = [0.5, 1.0, 1.5, C.TAU_HLL, C.TAU_PCSA]


def _hashed(item: str, source: str, by: str = "") -> str:
    return f"""h AS (SELECT {by}{H.sql_h32('x', 0).replace("md5(x)", "sha256(x)")} % {M} AS bucket, {H.sql_leading_zero_bits("substr(sha256(x), 9, 56)")} AS lz
    FROM (SELECT {by}({item})::VARCHAR AS x FROM {source}))"""


def _hll_sql(tau: float) -> str:
    return f"{C.hll_constant(tau, M)!r} * pow((sum(pow(2.0, {-tau!r} * reg)) + ({M} - count(*))) / {M}, {-1 / tau!r})"


def _pcsa_sql(tau: float) -> str:
    whole = sum(2.0 ** (-(j + 1) * tau) for j in range(C.CELLS))
    const = M * (math.gamma(tau) / math.log(2)) ** (1 / tau)
    free = f"list_sum(list_transform(range({C.CELLS}), lambda j: CASE WHEN ((bits >> j) & 1) = 0 THEN pow(2.0, -(j + 1) * {tau!r}) ELSE 0.0 END))"
    return f"{const!r} * pow((sum({free}) + ({M} - count(*)) * {whole!r}) / {M}, {-1 / tau!r})"


@query(f"WITH {_hashed('user_id', 'events', 'event_type, ')}, r AS (SELECT event_type, bucket, max(lz + 1) AS reg FROM h GROUP BY ALL) SELECT event_type, round({_hll_sql(C.TAU_HLL)}, 4) AS estimate FROM r GROUP BY event_type")
def hll_tau_estimate(spark, d):
    """Distinct users by event type: one hash projection, one aggregate, one scalar expression."""
    state = C.hll_update(table(spark, d, "events"), F.col("user_id"), M, ["event_type"])
    return C.hll_estimate(state, M, by=["event_type"]).select("event_type", F.round("estimate", 4).alias("estimate"))


@query(f"WITH {_hashed('o_custkey', 'orders')} SELECT bucket::INTEGER AS bucket, max(lz + 1)::INTEGER AS reg FROM h GROUP BY bucket")
def hll_registers(spark, d):
    return C.hll_update(table(spark, d, "orders"), F.col("o_custkey"), M)


@query(f"WITH {_hashed('o_custkey', 'orders')} SELECT bucket::INTEGER AS bucket, bit_or(1::BIGINT << least(lz, {C.CELLS - 1})) AS bits FROM h GROUP BY bucket")
def pcsa_bitmaps(spark, d):
    return C.pcsa_update(table(spark, d, "orders"), F.col("o_custkey"), M)


@query(f"WITH {_hashed('l_partkey', 'lineitem', 'l_returnflag, ')}, r AS (SELECT l_returnflag, bucket, bit_or(1::BIGINT << least(lz, {C.CELLS - 1})) AS bits FROM h GROUP BY ALL) SELECT l_returnflag, round({_pcsa_sql(C.TAU_PCSA)}, 4) AS estimate FROM r GROUP BY l_returnflag")
def pcsa_tau_estimate(spark, d):
    state = C.pcsa_update(table(spark, d, "lineitem"), F.col("l_partkey"), M, ["l_returnflag"])
    return C.pcsa_estimate(state, M, by=["l_returnflag"]).select("l_returnflag", F.round("estimate", 4).alias("estimate"))


@query(f"WITH {_hashed('c_custkey', 'customer', 'c_nationkey, ')}, r AS (SELECT n_regionkey, bucket, max(lz + 1) AS reg FROM h JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) SELECT n_regionkey, round({_hll_sql(C.TAU_HLL)}, 4) AS estimate FROM r GROUP BY n_regionkey")
def sketch_merge_by_nation(spark, d):
    """Sketches by nation, merged to regions: the state of a union is the max of states."""
    by_nation = C.hll_update(table(spark, d, "customer"), F.col("c_custkey"), M, ["c_nationkey"])
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    named = by_nation.join(nation, by_nation.c_nationkey == nation.n_nationkey)
    regions = C.hll_merge(named.select("n_regionkey", "bucket", "reg"), by=["n_regionkey"])
    return C.hll_estimate(regions, M, by=["n_regionkey"]).select("n_regionkey", F.round("estimate", 4).alias("estimate"))


@query(
    f"WITH {_hashed('o_custkey', 'orders')}, e AS (SELECT count(DISTINCT o_custkey) AS exact FROM orders), a AS (SELECT bucket, max(lz + 1) AS reg FROM h GROUP BY ALL), b AS (SELECT bucket, bit_or(1::BIGINT << least(lz, {C.CELLS - 1})) AS bits FROM h GROUP BY ALL), r AS ("
    + " UNION ALL ".join(f"SELECT 'hyperloglog' AS kind, {t!r}::DOUBLE AS tau, {_hll_sql(t)} AS estimate FROM a UNION ALL SELECT 'pcsa', {t!r}, {_pcsa_sql(t)} FROM b" for t in TAUS)
    + ") SELECT kind, tau, round(estimate, 4) AS estimate, exact, round(abs(estimate - exact) / exact, 6) AS rel_error FROM r, e"
)
def exact_vs_sketch_distinct(spark, d):
    out = C.accuracy(table(spark, d, "orders"), F.col("o_custkey"), M, TAUS)
    return out.select("kind", "tau", F.round("estimate", 4).alias("estimate"), "exact", F.round("rel_error", 6).alias("rel_error"))


@query("""WITH t AS (SELECT (i / 20.0)::DOUBLE AS tau FROM range(1, 41) r(i))
SELECT tau, round((ln(2) * gamma(2 * tau) / pow(gamma(tau), 2) * (1 + pow(2, -tau)) / (1 - pow(2, -tau)) - 1) / (tau * tau), 6) AS var_hll,
 round(ln(2) * (1 - pow(2, -2 * tau)) * gamma(2 * tau) / pow(gamma(tau), 2) / (tau * tau), 6) AS var_pcsa FROM t""")
def tau_variance_grid(spark, d):
    rows = [(i / 20.0, round(C.variance_hll(i / 20.0), 6), round(C.variance_pcsa(i / 20.0), 6)) for i in range(1, 41)]
    return spark.createDataFrame(rows, "tau double, var_hll double, var_pcsa double")


@query("""WITH t AS (SELECT (i / 1000.0)::DOUBLE AS tau FROM range(50, 1900) r(i)), v AS (SELECT tau,
 (ln(2) * gamma(2 * tau) / pow(gamma(tau), 2) * (1 + pow(2, -tau)) / (1 - pow(2, -tau)) - 1) / (tau * tau) AS hll, ln(2) * (1 - pow(2, -2 * tau)) * gamma(2 * tau) / pow(gamma(tau), 2) / (tau * tau) AS pcsa FROM t)
SELECT 'hyperloglog' AS kind, arg_min(tau, hll) AS tau FROM v UNION ALL SELECT 'pcsa', arg_min(tau, pcsa) FROM v""")
def optimal_taus(spark, d):
    """The minimisers of the variances, found by golden section; the published values are 0.889897 and 0.343557."""
    return spark.createDataFrame([(k, round(C.optimal_tau(k), 3)) for k in ("hyperloglog", "pcsa")], "kind string, tau double")


@query(f"WITH {_hashed('user_id', 'events', 'ts, ')} SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, bucket::INTEGER AS bucket, max(lz + 1)::INTEGER AS reg FROM h GROUP BY 1, 2")
def windowed_hll(spark, d):
    """Registers by day from a file stream run to its end; equal to the batch result."""
    stream = S.windowed_registers(S.stream_table(spark, f"{d}/events.parquet"), F.col("user_id"), M)
    out = S.run_to_table(stream)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "bucket", "reg")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id AS item, count(*) AS cnt FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    out = S.run_to_table(S.windowed_moment_counts(S.stream_table(spark, f"{d}/events.parquet"), "user_id"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "item", "cnt")


# ---- retrieval

DIM, SLOTS, MAPS, K, COORDS = 4096, 96, 2, 10, 24


def _terms(t: str, i: str, name: str) -> str:
    return f"{name} AS (SELECT {i} AS id, ({H.sql_h32('w')} % {DIM})::INTEGER AS coord, count(*)::DOUBLE AS value FROM (SELECT {i}, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM {t}) WHERE w <> '' GROUP BY 1, 2)"


TERMS = f"WITH {_terms('documents', 'doc_id', 'v')}, {_terms('benchmark', 'item_id', 'q')}"
EXACT = "e AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM (SELECT q.id AS query_id, v.id AS doc_id, sum(q.value * v.value) AS score FROM v JOIN q USING (coord) GROUP BY 1, 2))"
SKETCH = f"s AS (SELECT id, ({H.sql_h32("concat(m::VARCHAR, '_', coord::VARCHAR)")} % {SLOTS})::INTEGER AS slot, max(value) AS ub, min(value) AS lb FROM v, (SELECT unnest(range({MAPS})) AS m) GROUP BY 1, 2)"
DECODE = f"d AS (SELECT v.id, v.coord, any_value(v.value) AS value, min(coalesce(s.ub, 0)) AS ub, max(coalesce(s.lb, 0)) AS lb FROM v, (SELECT unnest(range({MAPS})) AS m) x LEFT JOIN s ON s.id = v.id AND s.slot = ({H.sql_h32("concat(x.m::VARCHAR, '_', v.coord::VARCHAR)")} % {SLOTS}) GROUP BY 1, 2)"
APPROX = f"""p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, coord) AS r FROM q) WHERE r <= {COORDS}),
b AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, doc_id) AS r FROM (
  SELECT p.id AS query_id, d.id AS doc_id, sum(CASE WHEN p.value > 0 THEN d.ub ELSE d.lb END * p.value) AS bound FROM d JOIN p USING (coord) GROUP BY 1, 2)) WHERE r <= {5 * K}),
a AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM (
  SELECT b.query_id, b.doc_id, sum(q.value * v.value) AS score FROM b JOIN v ON v.id = b.doc_id JOIN q ON q.id = b.query_id AND q.coord = v.coord GROUP BY 1, 2))"""


def _vectors(spark, d):
    return R.term_vectors(table(spark, d, "documents"), "doc_id", dimension=DIM), R.term_vectors(table(spark, d, "benchmark"), "item_id", dimension=DIM)


@query(f"{TERMS} SELECT id, coord, value FROM v")
def sparse_postings(spark, d):
    return _vectors(spark, d)[0]


@query(f"{TERMS} SELECT a.id AS query_id, b.id AS doc_id, sum(a.value * b.value) AS score FROM q a JOIN q b USING (coord) WHERE a.id % 50 = 0 GROUP BY 1, 2")
def sparse_inner_product(spark, d):
    """Scores of a stated set of queries against all items."""
    q = _vectors(spark, d)[1]
    return R.inner_products(q.where("id % 50 = 0"), q)


@query(f"{TERMS}, {EXACT} SELECT query_id, doc_id, score, rank FROM e WHERE rank <= {K}")
def mips_exact_topk(spark, d):
    docs, q = _stored_vectors(spark, d)
    return R.exact_topk(q, docs, K)


@query(f"{TERMS}, {SKETCH} SELECT id, slot, ub, lb FROM s")
def mips_sketch_build(spark, d):
    return R.build_sketch(_vectors(spark, d)[0], SLOTS, MAPS)


@query(f"{TERMS}, {SKETCH}, {DECODE} SELECT id, coord, ub, lb FROM d")
def mips_decode(spark, d):
    docs = _vectors(spark, d)[0]
    return R.decode(docs, R.build_sketch(docs, SLOTS, MAPS), SLOTS, MAPS)


def _stored_vectors(spark, d):
    return tuple(stored(x) for x in _vectors(spark, d))


def _approx(docs, q, m=SLOTS):
    return R.sketch_topk(q, docs, R.slot_places(docs.sparkSession, DIM, m, MAPS), m, K, max_coords=COORDS)


@query(f"{TERMS}, {SKETCH}, {DECODE}, {APPROX} SELECT query_id, doc_id, score, rank FROM a WHERE rank <= {K}")
def mips_sketch_topk(spark, d):
    docs, q = _stored_vectors(spark, d)
    return _approx(docs, q)


@query(f"{TERMS}, {EXACT}, {SKETCH}, {DECODE}, {APPROX} SELECT e.query_id, round(avg(CASE WHEN a.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS recall FROM (SELECT * FROM e WHERE rank <= {K}) e LEFT JOIN (SELECT * FROM a WHERE rank <= {K}) a USING (query_id, doc_id) GROUP BY 1")
def mips_recall(spark, d):
    docs, q = _stored_vectors(spark, d)
    return R.recall(R.exact_topk(q, docs, K), _approx(docs, q)).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"{TERMS} SELECT index_mb, sketch_mb, vectors_mb, index_mb + sketch_mb + vectors_mb AS total_mb FROM (SELECT count(*) * 8 / 1048576.0::DOUBLE AS index_mb, count(DISTINCT id) * 8 * {SLOTS} / 1048576.0::DOUBLE AS sketch_mb, count(*) * 16 / 1048576.0::DOUBLE AS vectors_mb FROM v)")
def mips_memory(spark, d):
    return R.memory(_vectors(spark, d)[0], SLOTS)


@query(f"{TERMS}, {SKETCH}, {DECODE} SELECT floor(ub - value)::BIGINT AS bin, count(*) AS n FROM d WHERE ub - value >= 0 GROUP BY 1")
def sketch_error_hist(spark, d):
    docs = _vectors(spark, d)[0]
    return R.error_histogram(docs, R.build_sketch(docs, SLOTS, MAPS), SLOTS, MAPS)


def _sized(sql: str, m: int) -> str:
    """The sketch CTEs for another size, under other names."""
    for name in ("s", "d", "p", "b", "a"):
        sql = re.sub(rf"\b{name} AS \(", f"{name}{m} AS (", sql)
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{m} {name}", sql)
    return sql.replace(f"% {SLOTS})", f"% {m})")


SIZES = (24, SLOTS)
_SWEEP = ", ".join(_sized(f"{SKETCH}, {DECODE}, {APPROX}", m) for m in SIZES)


@query(f"{TERMS}, {EXACT}, {_SWEEP} " + " UNION ALL ".join(
    f"SELECT {m}::INTEGER AS m, round(avg(r), 6)::DOUBLE AS recall, any_value(mb) AS sketch_mb FROM (SELECT e.query_id, avg(CASE WHEN x.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM (SELECT * FROM e WHERE rank <= {K}) e LEFT JOIN (SELECT * FROM a{m} WHERE rank <= {K}) x USING (query_id, doc_id) GROUP BY 1), (SELECT count(DISTINCT id) * 8 * {m} / 1048576.0::DOUBLE AS mb FROM v)"
    for m in SIZES))
def mips_sweep(spark, d):
    """Recall and memory by sketch size; times are for the benchmark to take."""
    docs, q = _stored_vectors(spark, d)
    exact, out = stored(R.exact_topk(q, docs, K)), None
    for m in SIZES:
        recall = R.recall(exact, _approx(docs, q, m)).agg(F.round(F.avg("recall"), 6).alias("recall"))
        row = recall.crossJoin(R.memory(docs, m).select("sketch_mb")).select(F.lit(m).alias("m"), "recall", "sketch_mb")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{TERMS}, " + ", ".join(_sized(f"{SKETCH}, {DECODE}", m) for m in SIZES) + " " + " UNION ALL ".join(f"SELECT {m}::INTEGER AS m, floor(ub - value)::BIGINT AS bin, count(*) AS n FROM d{m} WHERE ub - value >= 0 GROUP BY 2" for m in SIZES))
def sketch_error_sweep(spark, d):
    """Errors of the decoded bounds by sketch size: larger sketches err less."""
    docs, out = stored(_vectors(spark, d)[0]), None
    for m in SIZES:
        row = R.error_histogram(docs, R.build_sketch(docs, m, MAPS), m, MAPS).select(F.lit(m).alias("m"), "bin", "n")
        out = row if out is None else out.unionByName(row)
    return out


_NAME = "concat('7_', id::VARCHAR, '_', j::VARCHAR)"


@query(f"""WITH g AS (SELECT i::BIGINT AS id, j::INTEGER AS j FROM range(50) a(i), range(100) b(j)), n AS (SELECT id, j, {_NAME} AS name FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(name), j) AS r FROM n) SELECT id, j AS coord, round({H.sql_gaussian("concat('v_', name)")}, 6) + 0.0 AS value FROM r WHERE r <= 5""")
def synthetic_vectors(spark, d):
    return R.synthetic_vectors(spark, 50, 100, 0.05, "gaussian", 7).select("id", "coord", (F.round("value", 6) + 0.0).alias("value"))


# ---- moments

COUNTS = "c AS (SELECT l_partkey AS item, count(*) AS cnt FROM lineitem GROUP BY 1)"
PROJ = 100


def _counts(spark, d):
    return Mo.item_counts(table(spark, d, "lineitem"), "l_partkey")


def _stable_sql(alpha: float) -> str:
    rho = math.pi / 2 if alpha < 1 else math.pi / 2 * (2 - alpha) / alpha
    name = "concat(item::VARCHAR, '_', j::VARCHAR)"
    v, w = f"(pi() * ({H.sql_uniform(name)} - 0.5))", f"(-ln({H.sql_uniform(name, 1)}))"
    return f"(sin({alpha!r} * ({v} + {rho!r})) / pow(cos({v}) * {math.cos(rho * alpha)!r}, {1 / alpha!r}) * pow(cos({v} - {alpha!r} * ({v} + {rho!r})) / {w}, {(1 - alpha) / alpha!r}))"


def _sketch_sql(alpha: float) -> str:
    return f"WITH {COUNTS}, x AS (SELECT j::INTEGER AS proj, sum(cnt * {_stable_sql(alpha)}) AS x FROM c, range({PROJ}) r(j) GROUP BY 1)"


@query(f"WITH {COUNTS} SELECT round(sum(pow(cnt::DOUBLE, 0.5)), 4) AS f_half, round(sum(pow(cnt::DOUBLE, 2)), 4) AS f_two FROM c")
def moment_exact(spark, d):
    c = _counts(spark, d)
    return Mo.exact_moment(c, 0.5).crossJoin(Mo.exact_moment(c, 2.0).withColumnRenamed("moment", "m2")).select(F.round("moment", 4).alias("f_half"), F.round("m2", 4).alias("f_two"))


@query(f"WITH {COUNTS} SELECT round(ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt), 6) AS entropy FROM c")
def entropy_shannon(spark, d):
    return Mo.shannon_entropy(_counts(spark, d)).select(F.round("entropy", 6).alias("entropy"))


@query(f"WITH {COUNTS}, f AS (SELECT sum(pow(cnt::DOUBLE, 0.99)) AS fa, sum(cnt)::DOUBLE AS f1 FROM c) SELECT round((1 - fa / pow(f1, 0.99)) / (0.99 - 1), 6) AS entropy FROM f")
def tsallis_entropy(spark, d):
    f = _counts(spark, d).agg(F.sum(F.pow(F.col("cnt").cast("double"), F.lit(0.99))).alias("fa"), F.sum("cnt").cast("double").alias("f1"))
    return f.select(F.round(Mo.tsallis(F.col("fa"), F.col("f1"), 0.99), 6).alias("entropy"))


@query(f"{_sketch_sql(0.9)} SELECT proj, round(x, 3) + 0.0 AS x FROM x")
def stable_sketch(spark, d):
    return Mo.sketch(_counts(spark, d), 0.9, PROJ).select("proj", (F.round("x", 3) + 0.0).alias("x"))


_G9 = math.gamma(1.9)
_HARM = PROJ * math.cos(0.9 * math.pi / 2) / _G9 * (1 - (1 / PROJ) * (2 * _G9**2 / math.gamma(2.8) - 1))


@query(f"{_sketch_sql(0.9)} SELECT round({_HARM!r} / sum(pow(abs(x), -0.9)), 3) AS estimate FROM x")
def moment_harmonic(spark, d):
    return Mo.harmonic_estimate(Mo.sketch(_counts(spark, d), 0.9, PROJ), 0.9, PROJ).select(F.round("estimate", 3).alias("estimate"))


@query(f"{_sketch_sql(0.9)} SELECT round(exp(0.9 * avg(ln(abs(x)))) / {Mo.moment_constant(1 / PROJ, 0.9) ** PROJ!r}, 3) AS estimate FROM x")
def moment_geometric(spark, d):
    return Mo.geometric_estimate(Mo.sketch(_counts(spark, d), 0.9, PROJ), 0.9, PROJ).select(F.round("estimate", 3).alias("estimate"))


_P = Mo.optimal_power(0.9)
_PG, _PG2 = Mo.moment_constant(_P, 0.9), Mo.moment_constant(2 * _P, 0.9)
_PB = 1 - (1 / PROJ) * (1 / (2 * _P)) * (1 / _P - 1) * (_PG2 / _PG**2 - 1)


@query(f"{_sketch_sql(0.9)} SELECT round(pow(avg(pow(abs(x), {_P * 0.9!r})) / {_PG!r}, {1 / _P!r}) * {_PB!r}, 3) AS estimate FROM x")
def moment_power(spark, d):
    return Mo.estimate_moment(_counts(spark, d), 0.9, PROJ).select(F.round("estimate", 3).alias("estimate"))


@query(f"{_sketch_sql(0.95)} , f AS (SELECT sum(cnt)::DOUBLE AS f1 FROM c), e AS (SELECT exp(0.95 * avg(ln(abs(x)))) / {Mo.moment_constant(1 / PROJ, 0.95) ** PROJ!r} AS m FROM x) SELECT round((1 - m / pow(f1, 0.95)) / (0.95 - 1), 4) AS entropy FROM e, f")
def entropy_sketched(spark, d):
    c = _counts(spark, d)
    est = Mo.geometric_estimate(Mo.sketch(c, 0.95, PROJ), 0.95, PROJ).crossJoin(c.agg(F.sum("cnt").cast("double").alias("f1")))
    return est.select(F.round(Mo.tsallis(F.col("estimate"), F.col("f1"), 0.95), 4).alias("entropy"))


@query("SELECT i::BIGINT AS item, 1000.0 / (i + 1) AS cnt FROM range(1000) r(i)")
def zipf_counts(spark, d):
    return Mo.test_counts(spark, 1000, "zipf")


_U1, _U2 = H.sql_uniform("concat('uniform_', i::VARCHAR)"), H.sql_uniform("concat('sparse_', i::VARCHAR)")


@query(f"SELECT 'uniform' AS kind, i::BIGINT AS item, (floor({_U1} * 99) + 1.0)::DOUBLE AS cnt FROM range(300) r(i) UNION ALL SELECT 'sparse', i::BIGINT, (CASE WHEN {_U2} < 0.1 THEN floor({H.sql_uniform("concat('s_', i::VARCHAR)")} * 99) + 1.0 ELSE 0.0 END)::DOUBLE FROM range(300) r(i)")
def uniform_and_sparse_counts(spark, d):
    kinds = [Mo.test_counts(spark, 300, k).select(F.lit(k).alias("kind"), "item", "cnt") for k in ("uniform", "sparse")]
    return kinds[0].unionByName(kinds[1])


ALPHAS = (0.5, 0.9, 0.99)


def _estimates_sql(alpha: float) -> dict[str, str]:
    p, g = Mo.optimal_power(alpha), Mo.moment_constant
    g1, g2, ga = g(p, alpha), g(2 * p, alpha), math.gamma(1 + alpha)
    bias = 1 - (1 / PROJ) * (1 / (2 * p)) * (1 / p - 1) * (g2 / g1**2 - 1)
    harmonic = PROJ * math.cos(alpha * math.pi / 2) / ga * (1 - (1 / PROJ) * (2 * ga**2 / math.gamma(1 + 2 * alpha) - 1))
    return {
        "optimal": f"pow(avg(pow(abs(x), {p * alpha!r})) / {g1!r}, {1 / p!r}) * {bias!r}",
        "geometric": f"exp({alpha!r} * avg(ln(abs(x)))) / {g(1 / PROJ, alpha) ** PROJ!r}",
        "harmonic": f"{harmonic!r} / sum(pow(abs(x), {-alpha!r}))",
    }


_ACC = [(n, a) for n in ("zipf", "parts") for a in ALPHAS]
_ACC_SQL = f"WITH zipf AS (SELECT i::BIGINT AS item, 1000.0::DOUBLE / (i + 1) AS cnt FROM range(500) r(i)), parts AS (SELECT l_partkey AS item, count(*)::DOUBLE AS cnt FROM lineitem GROUP BY 1), "
_ACC_SQL += ", ".join(f"x{t} AS (SELECT j, sum(cnt * {_stable_sql(a)}) AS x FROM {n}, range({PROJ}) r(j) GROUP BY 1), f{t} AS (SELECT sum(pow(cnt, {a!r})) AS f FROM {n})" for t, (n, a) in enumerate(_ACC))
_ACC_SQL += " " + " UNION ALL ".join(f"SELECT '{n}' AS counts, {a!r}::DOUBLE AS alpha, '{method}' AS method, round(({sql}) / any_value(f), 6) AS ratio FROM x{t}, f{t}" for t, (n, a) in enumerate(_ACC) for method, sql in _estimates_sql(a).items())


@query(_ACC_SQL)
def moment_accuracy(spark, d):
    """Estimates by their true values, of all estimators over a grid of alpha, for a skewed and a real distribution of counts."""
    out = None
    for name, counts in (("zipf", Mo.test_counts(spark, 500, "zipf")), ("parts", _counts(spark, d))):
        rows = Mo.accuracy(counts, list(ALPHAS), PROJ).select(F.lit(name).alias("counts"), "alpha", "method", F.round(F.col("estimate") / F.col("exact"), 6).alias("ratio"))
        out = rows if out is None else out.unionByName(rows)
    return out
