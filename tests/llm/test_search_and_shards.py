"""Top-k search and sharding against brute force, with the awkward rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _store, knn, shard

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, step=100):
    out = []
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in {(i, tuple(v)) for i, v in ok if i % step == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, knn.voronoi_topk(df, F.col("vec_id") % 100 == 0, k, **kw).collect()))


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.standard_normal(8)]) for i in range(900)]
    assert run(spark, rows) == brute(rows, 10)


def test_topk_awkward_rows(spark):
    rng = np.random.default_rng(1)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(250)]  # a hot vector: ties throughout
    rows += [(1000 + i, [float(x) for x in rng.standard_normal(3)]) for i in range(300)]
    rows += [(7, None), (8, [1.0, None, 0.0]), (9, [float("nan"), 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0]), (None, same), (2000, [1.0]), (2001, [])]
    rows += [(1000, rows[250][1]), (5000, [0.1, 0.2, 0.3]), (5000, [0.1, 0.2, 0.3])]  # repeated rows, one of them a query
    assert run(spark, rows) == brute(rows, 10)


def test_topk_prunes_but_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(50 * i, [float(x) for x in rng.standard_normal(4) * (1 + 10 * (i % 7 == 0))]) for i in range(200)]
    assert run(spark, rows, 3, max_pivots=16) == brute(rows, 3)


def sent_rows(spark, rows, k=10):
    """(rows replicated, blocks)."""
    df = spark.createDataFrame(rows, SCHEMA)
    assigned, _, tests, pivots, dim, chunks = knn._plan(df, F.col("vec_id") % 100 == 0, k, "vec_id", "embedding", knn.MAX_PIVOTS)
    out = knn.replicate(assigned, tests, pivots, dim, chunks).collect()
    return sum(len(knn._unpack([r["payload"]], dim)[0]) for r in out), len({t[0] for t in tests})


def test_topk_replicates_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.standard_normal((3000, 16)))]
    n, blocks = sent_rows(spark, rows)
    assert blocks <= math.ceil(30 / 8) and n <= blocks * len(rows)


def test_topk_prunes_clusters(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(5)
    centres = 20 * rng.standard_normal((8, 16))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.05 * rng.standard_normal(16)]) for i in range(3001)]
    n, blocks = sent_rows(spark, rows)
    assert n < 0.5 * blocks * len(rows)
    assert run(spark, rows) == brute(rows, 10)


def test_pack_widths():
    ids = np.array([5, -7])
    for top in (3.0, 2.0**20, 2.0**40):
        x = np.array([[top, -1.0], [0.0, -top]])
        got_ids, got = knn._unpack([knn._pack(ids, x), knn._pack(ids[:1], x[:1])], 2)
        assert got_ids.tolist() == [5, -7, 5] and (got == np.concatenate([x, x[:1]])).all()


def test_topk_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, [(100, [1.0]), (1, [0.5])]) == [(100, 1, 1, 512 * 1024)]


def test_exact_scores_beyond_doubles():
    q, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0]])
    assert knn.exact_scores(q, v)[0, 0] == 2**60 + 3


def test_hypergeometric_law():
    rng = random.Random(5)
    n, good, bad, draws = 20_000, 7, 13, 6
    counts = [0] * 7
    for _ in range(n):
        counts[shard.hypergeometric(rng, draws, good, bad)] += 1
    for k, c in enumerate(counts):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert shard.hypergeometric(rng, 0, 5, 5) == 0 and shard.hypergeometric(rng, 10, 5, 5) == 5
    assert 0 < shard.hypergeometric(rng, 10**9, 10**10, 10**10) < 10**9


def test_matrix_margins():
    m = shard.communication_matrix([10, 0, 25, 7], [14, 14, 14], 3)
    assert [sum(r) for r in m] == [10, 0, 25, 7] and [sum(c) for c in zip(*m, strict=True)] == [14, 14, 14]


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_shards_are_exact(spark, block_rows):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", 1, 2) for i in range(101)] + [(None, None, 1, 2), (5, "", 1, 2), (5, "", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int")
    out = shard.shuffle_shards(df, [F.col("doc_id"), F.col("text")], 8, block_rows=block_rows).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = shard.shuffle_shards(df.repartition(3), [F.col("doc_id"), F.col("text")], 8, block_rows=block_rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_shards_of_tables_with_helper_names(spark):
    names = ["_hashed", "_BLOCK", "_rank", "_ends", "_sub", "_offset", "_place", "_b_side", "_j_side", "_s_side", "b", "n"]
    df = spark.range(300).select(F.col("id").alias("doc_id"), *(F.lit(k).alias(c) for k, c in enumerate(names)))
    out = shard.shuffle_shards(df, [F.col("doc_id")], 8, block_rows=9)
    assert out.columns == [*df.columns, "shard", "slot"]
    rows = out.collect()
    assert all([r[c] for c in names] == list(range(len(names))) for r in rows)
    assert all(sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(38 if j < 4 else 37)) for j in range(8))


def test_shards_are_uniform(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    out = shard.shuffle_shards(df, [F.col("doc_id")], 8, block_rows=300).where("doc_id < 2000").groupBy("shard").count().collect()
    assert all(abs(r["count"] - 250) < 5 * math.sqrt(250) for r in out)


def test_shards_of_nothing(spark):
    assert shard.shuffle_shards(spark.createDataFrame([], "doc_id long"), [F.col("doc_id")], 8).count() == 0


def test_shared_folder(spark, monkeypatch):
    assert _store.fresh(["_A", "b"], "a", "b", "a") == ["_a_", "_b", "_a__"]

    class Session:  # a cluster without spark.checkpoint.dir
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _store.shared_dir(Session)
    table = _store.stored(spark.range(5))
    assert table.count() == 5
    _store.discard(table, spark.range(1))
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        spark.read.parquet(table._tessera_path)


def test_shard_query(spark, tmp_path):
    rows = [(1, "é", "x"), (2, None, "y"), (3, "", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, size string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in shard.op5_hypergeometric_shards(spark, str(tmp_path)).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [3, 1, 1]
    assert got[1]["text_crc32"] == zlib.crc32("é".encode()) and got[2]["text_crc32"] == 0
    assert got[1]["law"] == "rows" and got[1]["grown_shard"] is None
