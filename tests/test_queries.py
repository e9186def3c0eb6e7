"""Every registered query of the engine against its SQL in DuckDB; queries without SQL must give rows."""

from __future__ import annotations

import functools
import itertools
import math
import os

import duckdb
import numpy as np
import pytest

from tessera.operators import linalg
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canon(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert canon(got[cols]) == canon(want[cols])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, sf).count() > 0


def same_as_sql(spark, path, name, rows, schema="vec_id long, embedding array<float>"):
    """The query's rows and its SQL's on a small table of embeddings."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(path)).toPandas(), c.sql(catalog.SQL[name]).df()
    assert canon(got[sorted(got.columns)]) == canon(want[sorted(want.columns)])
    return want


def test_best_observation_ties(spark, tmp_path):
    a = [0.25, 0.45, 0.65, 1.05, 1.25]
    value = lambda x: functools.reduce(lambda s, v: s + (math.floor(v * 5) / 5) ** 2, x, 0.0)
    second, *_, first = sorted(itertools.permutations(a), key=value)  # one value when rounded; the second row's is less by the last bits
    assert value(second) < value(first) and round(value(second), 6) == round(value(first), 6)
    assert len(same_as_sql(spark, tmp_path / "ties", "best_observation", [(9, list(second)), (3, list(first)), (5, [3.0] * 5)])) == 1


def test_best_observation_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [None, None]), (6, [1e30, 0.0])]
    same_as_sql(spark, tmp_path / "odd", "best_observation", [*odd, (8, [None, 0.5]), (9, [0.3, 0.5])])
    same_as_sql(spark, tmp_path / "no_value", "best_observation", [odd[4], odd[1], odd[0]])
    same_as_sql(spark, tmp_path / "not_a_number", "best_observation", [odd[0], odd[2], odd[3]])
    same_as_sql(spark, tmp_path / "large", "best_observation", [odd[5], (7, [1e25, 0.0])])
    assert not len(same_as_sql(spark, tmp_path / "empty", "best_observation", []))


def vectors(n, width=64, seed=5):
    return np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)


def keyed(x, start=0):
    return [(start + k, [float(v) for v in r]) for k, r in enumerate(x)]


def no_pair_tables(*_, **__):
    raise AssertionError("pairs of rows leave their tasks")


def test_distance_preservation_keeps_pairs_in_tasks(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(linalg, "pairwise", no_pair_tables)
    test_same_rows(spark, sf, duck, "distance_preservation")


def test_distance_preservation_near_copies(spark, tmp_path):
    x = vectors(6)
    near = x + np.float32(1e-6) * vectors(6, seed=6)
    same_as_sql(spark, tmp_path / "near", "distance_preservation", [*keyed(x), *keyed(near, 6), *keyed(x[:2], 12), (20, None)])


def test_distance_preservation_blocks(spark, tmp_path):
    same_as_sql(spark, tmp_path / "blocks", "distance_preservation", keyed(vectors(1300)))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_distance_preservation_few_rows(spark, tmp_path, n):
    same_as_sql(spark, tmp_path / "few", "distance_preservation", keyed(vectors(n)))


def test_length_scale_keeps_pairs_in_tasks(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(linalg, "pairwise", no_pair_tables)
    test_same_rows(spark, sf, duck, "length_scale_median")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_length_scale_few_rows(spark, tmp_path, n):
    same_as_sql(spark, tmp_path / "few", "length_scale_median", [*keyed(vectors(n)), (20, None), (None, [0.0] * 64)])


def test_length_scale_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    far = (vectors(5, 3) + np.float32(4e6)).tolist()  # their product cancels
    same_as_sql(spark, tmp_path / "far", "length_scale_median", list(enumerate(far)))
    same_as_sql(spark, tmp_path / "inf", "length_scale_median", list(enumerate([[1.0, inf], [2.0, 0.0], [3.0, 1.0], [4.0, inf]])))
    same_as_sql(spark, tmp_path / "nan", "length_scale_median", list(enumerate([[1.0, nan], [2.0, 0.0], [3.0, 1.0], [4.0, 9.0]])))


def test_length_scale_copies(spark, tmp_path, monkeypatch):
    """The two middle distances are 0 and 5, far apart; three equal rows and one apart give three of each."""
    monkeypatch.setattr(linalg, "LISTED", 2)  # bins of more are narrowed down to single values
    want = same_as_sql(spark, tmp_path / "copies", "length_scale_median", list(enumerate([[0.0, 0.0]] * 3 + [[3.0, 4.0]])))
    assert want["length"].tolist() == [2.5]


def test_pair_quantile_passes(spark, monkeypatch):
    """Many blocks, tiles and passes against numpy, to the last bits."""
    monkeypatch.setattr(linalg, "LISTED", 50)
    x = vectors(1300, 8)
    rows = spark.createDataFrame(keyed(x), "i long, row array<float>")
    a, b = np.triu_indices(len(x), 1)
    d = np.linalg.norm(x.astype(float)[a] - x.astype(float)[b], axis=1)
    for q in (0.0, 0.3, 0.5, 1.0):
        assert linalg.pair_quantile(rows, q) == pytest.approx(np.quantile(d, q), rel=1e-10)
