"""Golden values and invariants of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, testfunctions
from tessera.operators import binary, cardinality, gp, kronecker, leastsq, linalg, lowrank, moments, projections, retrieval, sensing, supervised
from tessera.sources import tables


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, row array<double>")


def test_taus_and_variances():
    assert cardinality.optimal_tau("hyperloglog") == pytest.approx(0.8899, abs=1e-3)
    assert cardinality.optimal_tau("pcsa") == pytest.approx(0.3435, abs=1e-3)
    assert cardinality.variance_hll(1.0) == pytest.approx(3 * math.log(2) - 1)
    assert cardinality.variance_hll(0) == math.inf
    with pytest.raises(ValueError):
        cardinality.optimal_tau("other")


def test_sketches_merge_and_estimate(spark):
    a = spark.range(0, 3000).select(F.col("id").cast("string").alias("x"))
    b = spark.range(2000, 6000).select(F.col("id").cast("string").alias("x"))
    item = F.col("x")
    merged = cardinality.hll_merge(cardinality.hll_update(a, item, 256), cardinality.hll_update(b, item, 256))
    whole = cardinality.hll_update(a.union(b), item, 256)
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0
    assert cardinality.hll_estimate(whole, 256).first()["estimate"] == pytest.approx(6000, rel=0.2)
    bits = cardinality.pcsa_merge(cardinality.pcsa_update(a, item, 256), cardinality.pcsa_update(b, item, 256))
    assert cardinality.pcsa_estimate(bits, 256).first()["estimate"] == pytest.approx(6000, rel=0.15)


@pytest.mark.parametrize(("alpha", "tol"), [(0.5, 0.35), (0.9, 0.2), (0.95, 0.2), (1.1, 0.2)])
def test_moment_estimators(spark, alpha, tol):
    counts = moments.test_counts(spark, 200, "zipf")
    exact = moments.exact_moment(counts, alpha).first()["moment"]
    for method in ["optimal", "geometric", *(["harmonic"] if alpha < 1 else [])]:
        assert moments.estimate_moment(counts, alpha, 300, method).first()["estimate"] == pytest.approx(exact, rel=tol), method


def test_moment_errors(spark):
    with pytest.raises(ValueError):
        moments.sketch(moments.test_counts(spark, 5, "uniform"), 2.5)
    with pytest.raises(ValueError):
        moments.harmonic_estimate(None, 1.2, 10)
    with pytest.raises(ValueError):
        moments.test_counts(spark, 5, "other")


def test_retrieval_bounds_hold(spark):
    docs = retrieval.synthetic_vectors(spark, 30, 60, 0.1, "exponential", 1)
    q = retrieval.synthetic_vectors(spark, 3, 60, 0.1, "exponential", 2)
    sketch = retrieval.build_sketch(docs, 8, 2)
    decoded = docs.join(retrieval.decode(docs, sketch, 8, 2), ["id", "coord"])
    assert decoded.where("ub < value or lb > value").count() == 0
    exact = retrieval.exact_topk(q, docs, 5)
    plain = retrieval.ranked(retrieval.inner_products(q, docs), 5)
    assert exact.exceptAll(plain).count() == 0 and plain.exceptAll(exact).count() == 0
    approx = retrieval.sketch_topk(q, docs, retrieval.slot_places(spark, 60, 8, 2), 8, 5, k_first=30)
    assert retrieval.recall(exact, approx).agg(F.avg("recall")).first()[0] == 1.0


def test_block_search_equals_the_join(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    docs = retrieval.synthetic_vectors(spark, 80, 40, 0.2, "gaussian", 3).withColumn("value", F.round(4 * F.col("value")))
    docs = docs.where("id % 7 <> 3 or coord % 2 = 0").unionByName(spark.range(100, 120).select(F.col("id"), F.lit(5).alias("coord"), F.lit(1.0).alias("value")))  # ties
    q = retrieval.synthetic_vectors(spark, 7, 40, 0.2, "gaussian", 4).withColumn("value", F.round(4 * F.col("value")))
    m, maps, k = 6, 2, 4
    got = retrieval.exact_topk(q, docs, k)
    plain = retrieval.ranked(retrieval.inner_products(q, docs), k)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(got) == rows(plain)
    part = F.row_number().over(retrieval.W.partitionBy("id").orderBy(F.desc(F.abs("value")), "coord"))
    short = q.withColumn("r", part).where("r <= 3").select(F.col("id").alias("query_id"), "coord", F.col("value").alias("q"))
    bounds = retrieval.decode(docs, retrieval.build_sketch(docs, m, maps), m, maps).join(short, "coord")
    bounds = bounds.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.sum(F.when(F.col("q") > 0, F.col("ub")).otherwise(F.col("lb")) * F.col("q")).alias("bound"))
    kept = retrieval.ranked(bounds, 9, "bound").select("query_id", "doc_id")
    plain = retrieval.ranked(kept.join(retrieval.inner_products(q, docs), ["query_id", "doc_id"]), k)
    assert rows(retrieval.sketch_topk(q, docs, retrieval.slot_places(spark, 40, m, maps), m, k, 9, 3)) == rows(plain)


def test_sparse_jl_constants(spark):
    assert projections.sparse_dims(0.1, 0.1) == (1842, 92)
    assert projections.sparse_dims_wide(0.3, 0.1) == (511, 30)
    rows = {(r["r"], r["j"]) for r in projections.block_matrix(spark, 4, 28, 4).collect()}
    assert {(21 + 5, 0), (21 + 3, 1), (21 + 3, 2)} <= rows
    with pytest.raises(ValueError):
        projections.make_sparse(spark, 4, construction="other")
    with pytest.raises(ValueError):
        projections.kind_of("other")
    assert projections.kind_of("SJLT") == "sparse_jl"


def test_hadamard(spark):
    m = projections.sample_matrix(spark, "srht", 4, 1000, 3) * math.sqrt(1000)
    assert np.abs(m) == pytest.approx(np.ones_like(m))


def test_pairwise_and_centering(spark):
    x = np.random.default_rng(0).standard_normal((7, 3))
    got = {(r["a"], r["b"]): r["d0"] for r in linalg.pairwise(points(spark, x)).collect()}
    assert len(got) == 21
    for (a, b), v in got.items():
        assert v == pytest.approx(np.linalg.norm(x[a] - x[b]))
    d = projections.synthetic_dissimilarity(points(spark, x), "simplex")
    rows, radius = projections.power_distance(d)
    assert radius >= 0 and rows.count() == 7
    _, signature, counts = projections.pseudo_euclidean(d)
    assert signature[0] == signature[1] and counts["positive"] >= 1


def test_gamma_p():
    assert projections.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert projections.gamma_p(0.5, 0.5) == pytest.approx(math.erf(math.sqrt(0.5)))
    assert projections.gamma_p(5.0, 20.0) == pytest.approx(1 - math.exp(-20) * sum(20**k / math.factorial(k) for k in range(5)))


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a - 2 * b)) for i, (a, b) in enumerate(x)], "i long, a double, b double, y double")
    cols, y = [F.col("a"), F.col("b")], F.col("y")
    for beta in (leastsq.solve_normal(df, cols, y), leastsq.tsqr(df, cols, y), leastsq.sketch_and_solve(df, F.col("i"), cols, y, 64, 16)):
        assert beta == pytest.approx([3, -2], abs=1e-6)
    with pytest.raises(ValueError):
        leastsq.sketch_and_solve(df, F.col("i"), cols, y, 4, 8)
    m = leastsq.conditioned(30, 3, 100.0, rng)
    assert np.linalg.cond(m) == pytest.approx(100, rel=1e-6)


def test_low_rank(spark):
    rng = np.random.default_rng(4)
    x = np.outer(rng.standard_normal(20), rng.standard_normal(8))
    x[3, 2] += 9
    out, errors = lowrank.decompose(points(spark, x), 8, rank=1, card=1, power=2, max_iter=6, tol=1e-6)
    assert errors[-1] < 0.05
    assert abs(out.where("i = 3").first()["sparse"][2] - 9) < 0.5
    _, errors = lowrank.decompose(points(spark, x), 8, rank=1)
    assert len(errors) == 1 and errors[0] < 1e-9


def test_denoisers(spark):
    df = spark.createDataFrame([(v,) for v in (-2.0, -0.5, 0.0, 0.5, 2.0)], "r double")
    assert [r[0] for r in df.select(sensing.soft_threshold(F.col("r"), 1.0)).collect()] == [-1, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        sensing.denoiser("bayesian", None)
    with pytest.raises(ValueError):
        sensing.denoiser("other", 0.1)


def test_amp_recovers():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((100, 200)) / 10
    x = np.where(rng.random(200) < 0.1, rng.standard_normal(200), 0)
    got, _ = sensing.amp_dense(a, a @ x, "bayesian", rho=0.1)
    assert ((got - x) ** 2).mean() < 1e-4


def test_normal_cdf(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (None,)], "x double")
    got = [r[0] for r in df.select(sensing.normal_cdf("x")).collect()]
    assert got[0] == 0.5 and got[1] == pytest.approx(0.975, abs=1e-4) and got[2] is None


def test_binary_factors(spark):
    t = np.array([[1, 0], [0, 1], [1, 1], [0, 0], [1, 0]])
    a = np.array([[0.2, 0.9, 0.5], [0.8, 0.1, 0.5]])
    got, w = binary.factor_exact(spark, t @ a)
    assert {tuple(c) for c in got.T} == {tuple(c) for c in t.T}
    assert got @ w == pytest.approx(t @ a)
    with pytest.raises(ValueError):
        binary.factor_exact(spark, np.array([[0.3, 0.4], [0.3, 0.45]]))
    assert binary.match_columns(t.astype(float), t[:, ::-1].astype(float)) == [1, 0]
    s = binary.project_simplex(np.array([[2.0], [0.5]]))
    assert s[:, 0] == pytest.approx([1, 0])


def test_binary_points_of_large_rank(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = rng.integers(0, 2, (14, 5))
    a = rng.random((5, 9))
    d = t @ (a / a.sum(0))
    plain = binary.exact_vertices(spark, d)
    p = d[:, :1]
    cols = binary._pivots(d - p)
    rows = binary._pivots((d - p)[:, cols].T)
    z = (d - p)[:, cols] @ np.linalg.inv((d - p)[np.ix_(rows, cols)])
    assert binary._bounded_vertices(z, p[:, 0], rows).tolist() == plain.tolist()
    e = np.concatenate([np.eye(30), np.zeros((30, 1))], 1)  # the unit cube: its vertices on the simplex of 31 columns
    got = binary.exact_vertices(spark, np.concatenate([e, 1 - e.sum(0, keepdims=True)]))
    assert sorted(map(tuple, got.T)) == sorted(map(tuple, np.concatenate([e, 1 - e.sum(0, keepdims=True)]).T.astype(int)))


def test_quasi_newton_steps():
    h = np.diag([1.0, 10.0, 100.0])
    f = lambda x: (h @ x - 1, float(0.5 * x @ h @ x - x.sum()))
    x, _ = sensing._minimise(f, np.zeros(3), np.zeros(3), 0.0, 1.0, 60)
    assert x == pytest.approx([1, 0.1, 0.01], abs=1e-3)


def test_kronecker(spark):
    diag = kronecker.pattern(spark, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]])
    assert [r["factorizable"] for r in kronecker.check(diag, 4).collect()] == [False]
    ones = kronecker.pattern(spark, [[1] * 4] * 4)
    assert kronecker.is_maximal(kronecker.check(ones, 4)).first()["maximal"]
    assert kronecker.is_maximal(kronecker.check(kronecker.basis(spark, 1, 1), 4)).first()["maximal"]
    with pytest.raises(ValueError):
        kronecker.pattern(spark, [[1, 0]])
    top, bottom = kronecker.pattern(spark, [[1, 1], [0, 0]]), kronecker.pattern(spark, [[1, 1, 1], [0, 0, 0], [1, 1, 1]])
    p = kronecker.product(top, kronecker.product(top, bottom, 3), 6)
    checked = kronecker.check(p, 12)
    assert {(r["n1"], r["n2"]) for r in checked.where("factorizable").collect()} == {(2, 6), (3, 4), (4, 3), (6, 2)}
    assert {r["chain"] for r in kronecker.chains(checked, 12).collect()} == {"2,2,3", "2,3,2", "3,2,2"}
    padded = kronecker.pattern(spark, [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]])
    checked = kronecker.check(kronecker.product(padded, bottom, 3), 12)
    assert {(r["n1"], r["n2"]) for r in checked.where("factorizable").collect()} == {(2, 6), (4, 3)}
    assert {r["chain"] for r in kronecker.chains(checked, 12).collect()} == {"2,2,3"}


def test_kernels_agree(spark):
    x = np.random.default_rng(1).standard_normal((4, 2))
    for k in (kernels.SquaredExponential.of(2, 0.5), kernels.Periodic.of(1, 0.8, 0.6), kernels.Linear.of(), kernels.RationalQuadratic.of(1, 1, 2), kernels.Matern.of(), kernels.from_code([1, 1, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0])):
        got = np.zeros((4, 4))
        for r in gp.gram(points(spark, x), k).collect():
            got[r["a"], r["b"]] = r["k"]
        assert got == pytest.approx(k.matrix(x, x), abs=1e-9), str(k)
    assert str(kernels.from_code([0] * 15)) == "SE"
    assert len(kernels.kernel_space(20)) == len(set(kernels.kernel_space(20))) == 20


def test_gaussian_process():
    x = np.linspace(0, 5, 20)[:, None]
    y = np.sin(x[:, 0])
    p = gp.GaussianProcess(kernels.SquaredExponential.of(), 1e-4).fit(x, y)
    mean, var = p.predict(x)
    assert np.abs(mean - y).max() < 1e-2 and (var > 0).all()
    before = p.evidence()
    p.optimise(np.array([0.0, 0.0, math.log(1e-2)]))
    assert p.evidence() > before - 1e-6 or p.evidence() > 0
    parts = gp.decompose(gp.GaussianProcess(kernels.SquaredExponential.of() + kernels.Linear.of(), 0.1).fit(x, y), x)
    assert {c[0] for c in parts} == {0, 1}


def test_functions(spark):
    df = spark.createDataFrame([([math.pi, 2.275],)], "x array<double>")
    assert df.select(testfunctions.branin(F.col("x"))).first()[0] == pytest.approx(0.397887, abs=1e-5)
    one = spark.createDataFrame([([1.0, 1.0, 1.0],)], "x array<double>")
    assert one.select(testfunctions.rosenbrock(F.col("x"))).first()[0] == 0
    zero = spark.createDataFrame([([0.0, 0.0],)], "x array<double>")
    assert zero.select(testfunctions.rastrigin(F.col("x"))).first()[0] == pytest.approx(0)


def test_latin_hypercube(spark):
    x = np.array([r["x"] for r in gp.latin_hypercube(spark, 10, [(0, 1), (5, 6)]).collect()])
    for d, low in ((0, 0), (1, 5)):
        assert sorted(np.floor((x[:, d] - low) * 10).astype(int)) == list(range(10))


def test_hard_threshold_by_cuts(spark):
    rng = np.random.default_rng(4)
    for values in (rng.standard_normal(400), rng.integers(-2, 3, 400).astype(float), np.ones(400)):
        coo = spark.createDataFrame([(k // 20, k % 20, float(v)) for k, v in enumerate(values)], "i int, j int, v double")
        want = sorted(coo.collect(), key=lambda r: (-abs(r["v"]), r["i"], r["j"]))
        for card in (0, 1, 37, 200, 399, 400, 500):
            got = linalg.hard_threshold(coo, card, sort_rows=16).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want[:card])), card


def test_dictionary_step_refits_codes(spark):
    rng = np.random.default_rng(5)
    z = rng.standard_normal((60, 6))
    rows = points(spark, z)
    dictionary = rng.standard_normal((6, 4))
    dictionary /= np.linalg.norm(dictionary, axis=0)
    coded = supervised.sparse_codes(rows, dictionary, 0.5).orderBy("i").cache()
    x = np.stack([r["code"] for r in coded.collect()])
    new, steps = supervised.update_atoms(coded, dictionary)
    d, want = dictionary.copy(), x.copy()
    for a in range(4):  # the same step by singular vectors
        used = np.abs(x[:, a]) > 1e-12
        e = (z - want @ d.T + np.outer(want[:, a], d[:, a]))[used]
        u = np.linalg.svd(e.T)[0][:, 0]
        u *= 1 if u @ d[:, a] >= 0 else -1
        d[:, a], want[used, a] = u, e @ u
    got = np.stack([r["code"] for r in supervised.refitted(coded, steps).orderBy("i").collect()])
    assert new == pytest.approx(d, abs=1e-6) and got == pytest.approx(want, abs=1e-6)
    error = lambda c, m: supervised.representation_error(c, m).first()["error"]
    assert error(supervised.refitted(coded, steps), new) < error(coded, dictionary)


def test_assign_ways_agree(spark):
    rng = np.random.default_rng(6)
    rows = points(spark, rng.standard_normal((50, 3)))
    for r in (3, 9):
        w = rng.standard_normal((r, 3))
        fits = binary._combine(r) @ w
        got = {x["i"]: (x["u"], x["loss"]) for x in binary.assign(rows, w).collect()}
        for x in rows.collect():
            loss = np.round(((np.array(x["row"]) - fits) ** 2).sum(1), 12)
            assert got[x["i"]] == (int(loss.argmin()), pytest.approx(loss.min()))


def test_supervised(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, [float(v) for v in rng.standard_normal(3) + 6 * (i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, label int, row array<double>")
    assert supervised.accuracy(supervised.nearest(df, supervised.medoids(df))).first()["accuracy"] == 1
    z = linalg.to_coo(supervised.standardised(df)).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in z)
    assert supervised.best_epsilon(1000, 10_000)[-1][2] == min(e[2] for e in supervised.best_epsilon(1000, 10_000))


def test_sources(spark, tmp_path):
    rows = [("v", 4, "b", 2.0), ("v", 4, "a", 1.0), ("w", 4, "a", 3.0)]
    df = spark.createDataFrame(rows, tables.BENCH_SCHEMA)
    tables.write_csv(df, str(tmp_path / "bench"), "video", "pixels")
    back = tables.read_bench(spark, str(tmp_path / "bench"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert {r["projection"] for r in tables.best_by(back, ["video", "pixels"], "seconds", "projection").collect()} == {"a"}
    assert tables.pivot(back).where("projection = 'b'").first()["cells"] == {4: 2.0}
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "a.raw").write_bytes(bytes(range(12)))
    frames = tables.read_frames(spark, str(tmp_path / "frames"), 2, 3).orderBy("i").collect()
    assert [r["row"][0] for r in frames] == [0.0, 6.0]
    with pytest.raises(ValueError):
        tables.int_list("")
