"""Line, substring and near-duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import _text, jaccard, lines, suffix
from tessera.llm._graph import components

SPACE = " \t\n\v\f\r"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- lines


def brute_lines(rows, min_docs):
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE)) for x in (t or "").split("\n")]
    seen: dict[str, int] = {}
    for _, t in rows:
        for k in set(keys(t)) - {""}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in rows:
        raw = (t or "").split("\n")
        kept = [x for x, k in zip(raw, keys(t), strict=True) if not (k and seen[k] >= min_docs)]
        out.append((i, len(raw), len(raw) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(0)
    common = ["  Shared LINE\t", "shared line", "Été commun", "-----"]
    rows = []
    for i in range(60):
        body = [words(rng, 4) for _ in range(3)]
        body += [rng.choice(common) for _ in range(i % 4)] + [""] * (i % 3)
        rng.shuffle(body)
        rows.append((i, "\n".join(body)))
    rows += [(100 + i, "copy one\ncopy two\n\nnext\x0bline") for i in range(20)]  # a hot group of copies
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 200_000), (204, "shared line\nshared line"), (204, "shared line\nshared line"), (None, "shared line\nown")]
    return rows


@pytest.mark.parametrize("kw", [{}, {"segments": 16}, {"broadcast_keys": 0}])
def test_lines_match_brute_force(spark, kw):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, n_lines int, other int")
    out = lines.dedup_lines(df, 10, **kw)
    assert out.columns == ["doc_id", "text", "other", "n_lines", "n_dropped"]
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()], key=str)
    assert got == brute_lines(rows, 10)
    assert out.where("doc_id = 200").first()["text"] is None


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_first_occurrence_stays(spark, limit):
    rows = [(i, f"Same line\nown {i}\nsame line") for i in range(5, 17)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10, keep="first", broadcast_keys=limit).collect()}
    assert out[5] == "Same line\nown 5" and all(out[i] == f"own {i}" for i in range(6, 17))


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), 10, keep="last")


@pytest.mark.parametrize("segments", [1, 8])
def test_filters_miss_no_repeat_and_few_others_pass(spark, segments):
    rows = [(i, f"line {i // 2}\nonly {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, n = lines.suspects(df, segments=segments)
    assert n == segments
    held, each = lines.suspect_filter(found, n, found.agg(F.sum("n")).first()[0])
    hashes = lambda keys: np.array([lines.key_hash(k.encode()) for k in keys], np.uint64)
    listed = {int(h) for r in found.collect() for h in np.frombuffer(r["hashes"], np.uint64)}
    assert listed >= set(hashes([f"line {k}" for k in range(200)]).tolist())
    assert lines.passes(hashes([f"line {k}" for k in range(200)]), held, each, n).all()
    assert lines.passes(hashes([f"only {k}" for k in range(400)]), held, each, n).mean() < 0.1
    assert lines.segments_for(0) == 1 and lines.segments_for(10**10) == 1 << 16 and lines.segments_for(10**15) == lines.MAX_SEGMENTS


def test_lines_of_repeated_ids_and_helper_names(spark, tmp_path):
    """Rows are documents: twelve rows of one id share a line, which goes; SQL says the same."""
    import duckdb

    names = ["_uid", "_own_uid", "_OWN_KEYS", "key", "salt", "uid", "first_doc"]
    rows = [(7, f"Shared\nown {i}", *names) for i in range(12)] + [(i, f"other {i}\nshort") for i in range(20, 29)]
    rows = [(*r, *names)[: 2 + len(names)] for r in rows]
    df = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for limit in (1 << 20, 0):
        out = lines.dedup_lines(df, 10, broadcast_keys=limit).collect()
        assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, t if i != 7 else t[7:]) for i, t, *_ in rows)
        assert all(r["_OWN_KEYS"] == "_OWN_KEYS" for r in out)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, lines.op9_bloom_line_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(lines.OP9_SQL).fetchall()) and {r[2] for r in got} == {0, 1}


def test_short_keys_count_code_points(spark):
    rows = [(i, "é\nxy\nabc") for i in range(10)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10, min_chars=2).collect()
    assert {r["text"] for r in out} == {"é"}


# ---- substrings


def brute_substrings(rows, n=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - n + 1):
                w = b[k : k + n]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - n + 1):
                if first[b[k : k + n]] < i:
                    gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(kept)))
    return sorted(out, key=str)


def substring_rows():
    rng = random.Random(1)
    passages = [words(rng, 40, 5000) for _ in range(3)]
    rows = [(i, words(rng, 30, 5000) + " " + passages[i % 3] + " é " + words(rng, 10, 5000)) for i in range(40)]
    rows += [(100 + i, passages[0][: 49 + i]) for i in range(4)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # a hot group of copies
    rows += [(300, "ab" * 400), (301, "ba" * 300), (302, "a" * 60), (303, "a" * 51), (304, "a" * 49)]
    rows += [(400, None), (401, ""), (None, passages[1]), (402, passages[2]), (402, passages[2]), (402, "x" + passages[2]), (-5, passages[2])]
    rows += [(500, words(rng, 60_000, 5000)), (501, "z" * 300_000)]
    return rows


def test_substrings_match_brute_force(spark):
    rows = substring_rows()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    out = suffix.remove_repeats(df)
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in out.collect()], key=str)
    assert got == brute_substrings(rows)


def test_substrings_of_tables_with_helper_names(spark):
    rng = random.Random(2)
    passage = words(rng, 40, 5000)
    names = ["spans", "uid", "t1", "t2", "tokens", "_uid", "_SPANS", "_doc", "first", "_hot", "_n"]
    rows = [(i, f"{i} {passage} {i}", *names) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    out = suffix.remove_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in out) == brute_substrings([r[:2] for r in rows])
    assert all(r["_SPANS"] == "_SPANS" and r["uid"] == "uid" for r in out)


def test_equal_hashes_are_not_equal_bytes(monkeypatch):
    """With all contents hashed to one value the bytes decide."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2400] = text[100:500]
    a, b, n = np.array([100, 0, 150]), np.array([2000, 2000, 2050]), np.array([400, 60, 50])
    assert suffix.same_bytes(text, a, b, n, 64).tolist() == [True, False, True]
    monkeypatch.setattr(suffix._text, "hash_ranges", lambda buf, start, end: np.zeros(len(start), np.uint64))
    pd = pytest.importorskip("pandas")
    e = np.zeros(3, suffix.ENTRY)
    e["doc"], e["uid"], e["windows"] = [1, 2, 3], [11, 12, 13], 10
    parts = [rng.integers(97, 123, 59).astype(np.uint8) for _ in range(2)]
    joined = np.concatenate([parts[0], parts[1], parts[0]])
    payload = np.int64(3).tobytes() + suffix.zstandard.ZstdCompressor().compress(suffix.pack(e, joined))
    out = suffix._solve(pd.DataFrame({"kind": [0], "payload": [payload]}))
    assert out["doc_id"].tolist() == [3] and np.frombuffer(out["spans"][0], np.int64).tolist() == [0, 59]


def test_substrings_of_nothing(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 4))
def test_suffix_array_and_prefixes(raw, alphabet):
    text = np.frombuffer(raw, np.uint8) % alphabet + 97
    b = text.tobytes()
    sa, _ = suffix.suffix_array(text, 50)
    assert sorted(sa) == list(range(len(b)))
    assert all(b[x : x + 50] <= b[y : y + 50] for x, y in zip(sa[:-1], sa[1:], strict=True))
    lcp = suffix.common_prefixes(text, sa, 50, lanes=8)
    for k in range(1, len(b)):
        x, y = b[sa[k - 1] : sa[k - 1] + 50], b[sa[k] : sa[k] + 50]
        n = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
        assert lcp[k] == n


@pytest.mark.parametrize("part", [120, 1 << 20])
def test_parts_merge_by_binary_search(part):
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1500:2100] = text[:600]
    b, at = text.tobytes(), np.unique(rng.integers(0, 2950, 900))
    owner = rng.integers(0, 60, len(at))
    least: dict[bytes, int] = {}
    for a, o in zip(at, owner, strict=True):
        least[b[a : a + 50]] = min(o, least.get(b[a : a + 50], 99))
    assert list(suffix.least_owner(text, at, owner, part)) == [least[b[a : a + 50]] for a in at]


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(0)
    parts = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 10, 49, 50, 51, 700, 3)]
    buf, offs = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    owner, token, first, count = suffix.anchors(buf, offs)
    covered = sorted(x for f, c in zip(first, count, strict=True) for x in range(f, f + c))
    assert covered == [x for k in range(len(parts)) for x in range(offs[k], offs[k + 1] - 49)]
    moved = np.concatenate([buf[3:30], buf[offs[5] : offs[6]]])
    again = suffix.anchors(moved, np.array([0, 27, len(moved)]))
    assert set(again[1][again[0] == 1]) == set(token[owner == 5])


# ---- near duplicates


def shingle_set(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_near(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(sets[k]), None if i is None else least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)], key=str)


def near_rows():
    rng = random.Random(7)
    rows = []
    for base in range(6):
        text = words(rng, 80, 3000).split()
        for k in range(12):  # chains and stars of edits, around the threshold
            w = list(text)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if k % 4 == 3:
                text = w
            rows.append((len(rows), " ".join(w) + (" tail of words here now" if k == 5 else "")))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(40)]  # a hot group of copies, case aside
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one"), (2006, "a b c d e"), (2007, "a b c d e f"), (2008, "a b c d")]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (3000, words(rng, 30_000, 10**6)), (-4, rows[13][1] + " z")]
    return rows


def check_near(spark, rows):
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute_near(rows)


def test_near_duplicates_match_brute_force(spark):
    check_near(spark, near_rows())


def test_near_duplicates_with_long_buckets_and_held_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = random.Random(3)
    base = words(rng, 60, 3000).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 8):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check_near(spark, rows)


def near_copies(n, seed=3, edits=8):
    rng = random.Random(seed)
    base = words(rng, 60, 3000).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(i % edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("max_hot", [1 << 20, 1])
def test_near_duplicates_with_frequent_shingles(spark, monkeypatch, max_hot):
    for name, value in {"HOT_DF": 3, "HOT_ROWS": 6, "CHUNK": 3, "MAX_HOT": max_hot}.items():
        monkeypatch.setattr(jaccard, name, value)
    check_near(spark, near_copies(70) + [(1000 + i, t) for i, t in near_copies(40, 4, 14)] + near_rows()[:30])


def test_frequent_shingles_are_dealt_out(spark, monkeypatch):
    """Entries of a shingle that many classes share: one group a cell, and none where one component has them all."""
    for name, value in {"HOT_DF": 3, "HOT_ROWS": 10}.items():
        monkeypatch.setattr(jaccard, name, value)
    token = np.arange(1, 5, dtype=np.uint64)
    rows = [(i, 4, token.tobytes(), bytes([255] * 4), i % 2) for i in range(60)]
    classes = spark.createDataFrame(rows, "node long, n long, tokens binary, dfs binary, label long")
    for label, cells in ((F.col("label"), 21), (F.lit(7).cast("long"), 0)):
        made = classes.withColumn("label", label)
        frequent = jaccard._frequent(made, 60, 4, 75)
        assert sorted(frequent[2]) == [6] * len(frequent[0]) and frequent[1].all() == bool(cells)
        e = np.concatenate([np.zeros(0, jaccard.ENTRY), *(np.frombuffer(r["payload"], jaccard.ENTRY) for r in jaccard._index(made, 4, 75, False, 1, frequent).collect() if r["bucket"] < 4)])
        groups = {(int(t), int(c)): 0 for t, c in zip(e["token"], e["cell"], strict=True)}
        for t, c in zip(e["token"], e["cell"], strict=True):
            groups[int(t), int(c)] += 1
        assert len(groups) == cells * len(set(e["token"])) and max(groups.values(), default=0) < 45


@pytest.mark.parametrize("bit", [0, 39, 40, 63, 64, 100, 127])
def test_classes_are_told_apart_by_every_bit(bit):
    token = np.arange(1, 101, dtype=np.uint64) << np.uint64(50)
    sigs = np.array([[5, 9], [5, 9]], np.uint64)
    sigs[1, bit // 64] ^= np.uint64(1 << (bit % 64))
    pd = pytest.importorskip("pandas")
    rows = []
    for batch in range(2):
        rows += jaccard.batch_rows(np.array([batch]), np.ones(1, bool), np.zeros(100, np.int64), token, batch + 10, 1, sigs[batch : batch + 1])
    back = jaccard.count_classes(pd.DataFrame(rows, columns=["bucket", "kind", "batch", "payload"]))
    for _, group in back.groupby("batch"):
        _, got, _, df = jaccard.gathered(group)
        assert got.tolist() == token.tolist() and set(df.tolist()) == {2}
    rows = [r for batch in range(2) for r in jaccard.batch_rows(np.array([batch]), np.ones(1, bool), np.zeros(100, np.int64), token, batch + 10, 1, sigs[:1])]
    back = jaccard.count_classes(pd.DataFrame(rows, columns=["bucket", "kind", "batch", "payload"]))
    assert (back["kind"] != jaccard.PART).all()


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["component_id"] == 1


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), max_size=12), st.data())
def test_prefix_filter_loses_no_pair(a, change, data):
    b = a ^ change
    if not b or 100 * len(a & b) < 75 * len(a | b):
        return
    df = {t: data.draw(st.integers(2, 4)) if t in a & b else 1 for t in a | b}
    for order in range(jaccard.ORDERS):
        entries = []
        for s in (a, b):
            shared = np.array(sorted(t for t in s if df[t] > 1), np.uint64)
            own, rest = jaccard.prefix(len(s), shared, np.array([df[int(t)] for t in shared], np.uint8), order)
            e = np.zeros(len(own), jaccard.ENTRY)
            e["token"], e["rest"], e["n"], e["node"] = own, rest, len(s), len(entries)
            entries.append(e)
        common = np.intersect1d(entries[0]["token"], entries[1]["token"])
        x, y = (np.array([e[e["token"] == t][0] for t in common], jaccard.ENTRY) for e in entries)
        assert len(common) and jaccard.reachable(x, y, 75).any()


@pytest.mark.parametrize("part", [10, 1 << 20])
def test_components(spark, part):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), part).collect()}
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_kernels_agree_with_python():
    texts = ["Hello  World\tagain\x0bx", "", "   ", "one", "ünï cödé A", "x" * 300_000 + " tail"]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end, hashed = _text.word_hashes(buf, offs)
    found = [b"".join(raw)[s:e].lower() for s, e in zip(start, end, strict=True)]
    assert found == [w.encode() if isinstance(w, str) else w for t in raw for w in t.lower().split()]
    by: dict[bytes, int] = {}
    for w, h in zip(found, hashed, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_shared_column_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x")], "doc_id long, text string, component_id string")
    assert jaccard.near_duplicates(df).collect()[0]["component_id"] == 1
    assert F is not None
