"""The pipeline, stage by stage and whole, against brute force over a small corpus."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from tessera.llm import bpe, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_matches_brute_force(spark, sf, tmp_path):
    import public_tokenizers

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]

    norm = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    owners: dict[str, list[int]] = {}
    for i, t in kept:
        for k in {norm(x) for x in t.split("\n")} - {""}:
            owners.setdefault(k, []).append(i)
    cleaned = []
    for i, t in kept:
        out, own = [], set()
        for line in t.split("\n"):
            k = norm(line)
            if k and len(owners[k]) >= 10:
                if min(owners[k]) != i or k in own:
                    continue
                own.add(k)
            out.append(line)
        if "".join(out).strip(" \t\n\v\f\r") or len(out) == len(t.split("\n")):
            cleaned.append((i, "\n".join(out)))

    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = {i: shingles(t) for i, t in cleaned}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    cleaned = [(i, t) for i, t in cleaned if find(i) == i]

    words = lambda t: re.findall(r"\w+", t.lower())
    grams = {tuple(w[k : k + 8]) for w in map(words, bench) for k in range(len(w) - 7)}
    cleaned = [(i, t) for i, t in cleaned if sum(tuple(w) in grams for x in [words(t)] for w in zip(*(x[k:] for k in range(8)), strict=False)) < 5]

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == [i for i, _ in cleaned]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, t in cleaned:
        assert got[i]["n_tokens"] == len(enc.encode_ordinary(t))
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


AWKWARD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 !!", "en", "s", 5), (None, "the words of a text without id here", "en", "s", 3), (4, "the words of a text that is plain and clean", "en", "s", 40), (4, "the words of a text that is plain and clean", "en", "s", 40), (5, "de " * 50_000, "fr", None, 1)]


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
def test_stages_take_any_rows(spark, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, share string, spans int, label int"
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    spark.createDataFrame([(1, "some benchmark text of eight words or more here", "x")], "item_id long, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= {r[0] for r in rows}
        if rows:
            assert 4 in kept, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
