"""Tokens, languages, personal data and benchmark passages against brute force or held-out truth."""

from __future__ import annotations

import base64
import functools
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, pii, wordpiece

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["Hello world's  end\n\n x", "", None, "  lead and trail  ", "Grüße, Ñandú 12345   🙂 日本語", "a" * 5000, "word " * 60_000, "\n" * 3000 + "x", " \t " * 500, "<|endoftext|> plain"]


def frame(spark, texts, more="x int"):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], f"doc_id long, text string, {more}")


# ---- byte-level BPE


def test_digest_equals_the_library(spark):
    enc = bpe.encoding(RANKS, tokenizers.PATTERN)
    rows = {r["doc_id"]: r for r in bpe.digest(frame(spark, TEXTS, "n_tokens int"), RANKS, tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 3, 17])
def test_pieces_change_nothing(size):
    enc = bpe.encoding(RANKS, tokenizers.PATTERN)
    rng = random.Random(size)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", "é", "1", " ", "  ", "\n", "\t", "'s", "!", " ", "日"]) for _ in range(rng.randrange(60)))
        assert "".join(bpe.pieces(t, size)) == t
        assert bpe.encode(t, RANKS, tokenizers.PATTERN, size).tolist() == enc.encode_ordinary(t)


def test_round_trip_columns(spark):
    df = bpe.encode_documents(frame(spark, TEXTS[:6], "token_ids int"), RANKS, tokenizers.PATTERN)
    for r in df.collect():
        assert bpe.decode(r["token_ids"], RANKS, tokenizers.PATTERN) == (r["text"] or "").encode()
    assert bpe.decode([0, 1], RANKS, tokenizers.PATTERN) is not None
    assert bpe.digest(frame(spark, []), RANKS, tokenizers.PATTERN).count() == 0


# ---- word pieces


def greedy(word: bytes, first: set[bytes], rest: set[bytes]) -> int:
    n, at = 0, 0
    while at < len(word):
        table = rest if at else first
        k = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in table), 0)
        if not k:
            return 1
        n, at = n + 1, at + k
    return n


def test_automaton_is_greedy():
    rng = random.Random(0)
    for trial in range(300):
        make = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(n)}
        first = make(rng.randrange(1, 12))
        rest = first if trial % 2 else make(rng.randrange(1, 12))
        machine = wordpiece.Automaton(first, None if trial % 2 else rest)
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 14)))
            assert machine.count(w) == (greedy(w, first, rest) if w else 0), (first, rest, w)


def test_counts(spark):
    vocabulary = {base64.b64decode(x.split()[0]) for x in open(RANKS, "rb")}
    out = wordpiece.count_tokens(frame(spark, TEXTS, "n_tokens string"), functools.partial(wordpiece.rank_file_automaton, RANKS)).collect()
    for r in out:
        raw = (r["text"] or "").encode()
        if len(raw) < 6000:
            assert r["n_tokens"] == sum(greedy(w, vocabulary, vocabulary) for w in raw.split())
        assert r["n_words"] == len(raw.split()) and r["n_bytes"] == len(raw)
    assert next(r for r in out if r["doc_id"] == 6)["n_tokens"] == 60_000 * greedy(b"word", vocabulary, vocabulary)


# ---- languages

SPEECH = {
    "en": "the of and to in that was his with for this have from they which would there their when who will more said what about into them can only other time new some could these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte".split(),
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой что весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место иметь ничто".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(SPEECH[lang]) for _ in range(n))


def speech(spark, n=300):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randrange(5, 60)), lang, lang) for i, lang in enumerate(random.Random(2).choices(list(SPEECH), k=n))]
    rows += [(900, None, "en", ""), (901, "12 34 !!", "en", ""), (902, "", None, ""), (903, "日本語の文章です", None, ""), (904, "The " + "x" * 20_000, None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    df = speech(spark)
    model = langid.train(df.where(~langid.held_out()))
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    test = out.where(langid.held_out() & (F.col("doc_id") < 900))
    assert test.count() > 30
    assert test.where("lang_pred <> lang").count() <= 0.03 * test.count()
    rows = {r["doc_id"]: r for r in out.where("doc_id >= 900").collect()}
    assert [rows[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert rows[903]["lang_pred"] in SPEECH and rows[903]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.select("score").collect())
    # only text decides
    moved = langid.identify(df.withColumn("doc_id", -F.col("doc_id")).withColumn("lang", F.lit("zz")), model)
    assert sorted(r["lang_pred"] for r in moved.collect()) == sorted(r["lang_pred"] for r in out.collect())


def test_spans_of_mixed_text(spark):
    model = langid.train(speech(spark))
    rng = random.Random(9)
    parts = [sentence(rng, "en", 30), sentence(rng, "ru", 20), sentence(rng, "de", 30)]
    df = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    spans = langid.identify(df, model, spans=True).first()["lang_spans"]
    raw = " ".join(parts).encode()
    assert [s["lang"] for s in spans if s["end"] - s["start"] > 40] == ["en", "ru", "de"]
    assert raw[spans[0]["start"] : spans[0]["end"]].decode().startswith(parts[0][:20])


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    counts = np.array([4, 0, 1, 3])
    scores = rng.standard_normal((8, 3)).astype(np.float32) * 4
    got = langid.viterbi(scores, counts, 2.0)
    at = 0
    for n in counts:
        own = scores[at : at + n]
        if n:
            value = lambda p, own=own: sum(own[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert value(tuple(got[at : at + n])) == pytest.approx(value(best), abs=1e-4)
        at += n


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert langid.identify(df, None).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0), None).count() == 0


def test_hundreds_of_languages(spark):
    rng = random.Random(6)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for _ in range(230)]
    rows = [(k * 3 + j, " ".join(rng.choices(w, k=12)), f"l{k:03}") for k, w in enumerate(words) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model.langs) == 230 and model.bits == langid.TABLE_BITS - 1
    assert langid.identify(df, model).where("lang_pred = lang").count() >= 0.99 * len(rows)


def test_scripts_of_rare_first_bytes(spark):
    rng = random.Random(8)
    letters = {"syr": range(0x712, 0x72D), "dv": range(0x780, 0x7A6), "nqo": range(0x7CA, 0x7EB), "zgh": range(0x2D30, 0x2D68), "ff": range(0x1E922, 0x1E944), "got": range(0x10330, 0x1034A)}
    make = lambda k: " ".join("".join(chr(rng.choice(letters[k])) for _ in range(3)) for _ in range(12))
    rows = [(k * 10 + j, make(lang), lang) for k, lang in enumerate(letters) for j in range(5)]
    rows += [(k, "“" + sentence(rng, "en", 20) + "” 🙂 – " + sentence(rng, "en", 5), "en") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.train(df)).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in out)


def test_every_language_is_learned(spark):
    """One English text fills half the rows; a language of three texts among 20,000 stays too."""
    rng = random.Random(2)
    rows = [(i, sentence(random.Random(0), "en", 40), "en") for i in range(4000)]
    rows += [(i, sentence(rng, "de", 12), "de") for i in range(4000, 12000)] + [(i, sentence(rng, "ru", 12), "ru") for i in range(12000, 12003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, sample=500)
    assert model.langs == ["de", "en", "ru"]
    chosen = langid._sample(df.select("lang", "text"), 500, 64).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in chosen}
    assert n["en"] == 1 and n["ru"] == 3 and 350 < n["de"] < 650
    again = langid.train(df.repartition(7), sample=500)
    assert (again.word == model.word).all() and (again.trigram == model.trigram).all()


def test_scripts_by_code_point(spark):
    letters = {1: "aéőơếZ", 2: "αἀ", 3: "яӁ", 5: "א", 6: "بﺏ", 10: "क", 11: "ক", 15: "த", 20: "ก", 21: "ກ", 22: "ཀ", 23: "က", 24: "ა", 25: "한", 26: "አ", 30: "ក", 33: "かカ", 35: "漢𠀀", 37: "𐌰"}
    for script, chars in letters.items():
        for c in chars:
            raw = c.encode()
            w = langid.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert w.script.tolist() == [script], c
    raw = "× – “ ” … € 🙂 12".encode()
    assert not langid.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).script.any()


def test_whole_query_against_brute_force(spark, tmp_path):
    """Training, scores and paths in plain Python over the same table places."""
    import itertools
    import math
    import zlib

    rng = random.Random(12)
    rows = [(i, sentence(rng, lang, rng.randrange(1, 7)) + rng.choice(["", " " + sentence(rng, "ru", 3), " 12 !"]), lang) for i, lang in enumerate(rng.choices(list(SPEECH), k=60))]
    rows += [(100, None, "en"), (101, "", "de"), (102, "42", "en"), (103, rows[0][1], None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def parts(t):
        raw = t.encode()
        w = langid.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if raw else None
        return [] if w is None else [(w.hashed[k], [int(g) for g in w.grams[w.start[k] : w.end[k]]], int(w.script[k]), int(w.end[k] - w.start[k]), int(w.start[k])) for k in range(len(w.start))]

    out_of = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    size = 1 << langid.TABLE_BITS
    counts = {}
    for lang, text in {(lang, t) for i, t, lang in rows if lang and t is not None and not out_of(i)}:
        grams, words, scripts = counts.setdefault(lang, ({}, {}, {}))
        for h, g, s, n, _ in parts(text):
            for x in g:
                grams[x] = grams.get(x, 0) + 1
            if s:
                words[h] = words.get(h, 0) + 1
                scripts[s] = scripts.get(s, 0) + n
    langs = sorted(counts)
    logp = lambda c, x: math.log((c.get(x, 0) + 0.5) / (sum(c.values()) + 0.5 * size))
    allowed = {lang: {s for s, n in counts[lang][2].items() if n >= langid.MIN_SCRIPT_SHARE * sum(counts[lang][2].values())} for lang in langs}
    got = {r["doc_id"]: r for r in langid.op6_language_spans(spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert r["held_out"] == out_of(i)
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, "")
            continue
        words = parts(t)
        table = []
        for h, g, s, _, _ in words:
            raw = [sum(logp(counts[lang][0], x) for x in g) + logp(counts[lang][1], h) for lang in langs]
            some = s and any(s in allowed[lang] for lang in langs)
            table.append([0.0 if not some else x - sum(raw) / len(raw) if s in allowed[lang] else -1e4 for x, lang in zip(raw, langs, strict=True)])
        value = lambda p: sum(row[x] for row, x in zip(table, p, strict=True)) - langid.SWITCH_PENALTY * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        path = max(itertools.product(range(len(langs)), repeat=len(words)), key=value) if len(words) < 10 else None
        spans = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in r["spans"].split(",")]
        labels = [next(langs.index(lang) for lang, a, z in spans if a <= w[4] < z) for w in words]
        assert path is None or value(tuple(labels)) == pytest.approx(value(path), abs=1e-2)
        share = [sum(w[3] for w, x in zip(words, labels, strict=True) if x == k and w[2] and any(w[2] in a for a in allowed.values())) for k in range(len(langs))]
        assert r["lang_pred"] == langs[share.index(max(share))] and r["score"] == pytest.approx(max(share) / sum(share))


def test_training_sample_is_bounded(spark):
    model = langid.train(speech(spark), sample=60)
    assert set(model.langs) <= set(SPEECH) and model.trigram.shape[0] == 1 << langid.TABLE_BITS


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PII = [
    "mail a.b+c@ex-ample.co.uk, x@y.z; user@host no", "a@b.c-_x@y.z a@b.c@d.e @x.y a@.b", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 5", "+1 (743) 555-3824 +49 30 123456-7 +1 2 +123456789012345678 +1((((((", "é日🙂 x@y.zz 🙂 1.1.1.1 +1 555 555 5555",
    "a\u0001b@c.d\u0002 1.2.3.4 \u0001\u0002 x@y.z\u0001", "4111 1111 1111 1111-1 4111  1111 1 1-4111111111111111",
    None, "", "x" * 100_000, "1" * 50_000, "a@" + "b." * 20_000 + "c", "+1" + "(" * 50_000, "1.2.3.4 " * 2_000,
]


def test_base_spans_match_regex(spark):
    rng = random.Random(0)
    soup = ["".join(rng.choice(["a", "@", ".", "-", " ", "1", "22", "+1", "(", "é", "_", "4111111111111111"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = PII + soup
    out = {r["doc_id"]: r for r in pii.extract(frame(spark, texts, "spans int")).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert out[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (i, t and t[:80], out[i]["spans"][:200], joined[:200])
        assert [out[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert set(joined.split(",")) <= set(out[i]["spans"].split(","))


def test_patterns_discover_unseen(spark):
    rng = random.Random(3)
    rows = [f"text {rng.random()} please contact me at user{i}@mail.example.com today" for i in range(40)]
    rows += [f"nothing here, room {i} is free on floor {i % 7} of 12" for i in range(60)]
    rows += ["please contact me at ghost@localhost today", "please contact me at ghost@intranet today", "weird token zz9@host alone"]
    rows += [f"call my number +1 (555) 010-{1000 + i} now" for i in range(30)] + ["call my number 555-010-7777 now"]
    out = {r["doc_id"]: r for r in pii.extract(frame(spark, rows)).collect()}
    assert out[100]["spans"] == "email:21:36" and out[101]["n_learned"] == 1 and out[102]["n_learned"] == 0
    assert out[133]["n_learned"] == 1 and out[133]["spans"].startswith("phone:15:")
    assert all(out[i]["n_learned"] == 0 for i in range(40, 100))
    assert out[100]["n_email"] == 0 and out[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_patterns_discover_spaced_numbers(spark):
    rows = [f"call my number +1 (555) 010-{1000 + i} now" for i in range(30)] + [f"pay with card 4111 1111 1111 1111 please {i}" for i in range(9)]
    rows += [f"pay with card {c} please" for c in ("4012888888881881", "5555 5555 5555 4444", "3782 822463 10005", "6011 1111 1111 1117", "5105105105105100")]
    more = ["(017) 555-7713", "555 123 4567", "017.555 7713", "555-010-7777"]
    first = len(rows)
    rows += [f"call my number {x} now" for x in more] + ["pay with card 4111 1111 1111 1112 please", "call my room 555 123 4567 now", "born 1980, call my number (017) 555-7713 now, or 5 of 6"]
    rows += ["in 1980 please call my number 5551237777 now"]
    out = {r["doc_id"]: r for r in pii.extract(frame(spark, rows)).collect()}
    for k, x in enumerate(more):
        assert out[first + k]["spans"] == f"phone:15:{15 + len(x)}"
    assert out[first + 4]["spans"] == "card:14:33" and out[first + 5]["n_learned"] == 0
    assert out[first + 6]["spans"] == "phone:26:40" and out[first + 7]["spans"] == "phone:30:40"


def brute_learned(instances, rounds, min_seeds, min_confidence):
    edges: dict = {}
    for kind, pattern, value, seed in instances:
        if pattern:
            edges[kind, pattern, value] = edges.get((kind, pattern, value), False) or seed
    score = {(k, v): 0.0 for k, _, v in edges}
    promoted: set = set()
    trusted: dict = {}
    for _ in range(rounds):
        by: dict = {}
        for e, seed in edges.items():
            by.setdefault(e[:2], []).append((1.0 if seed else score[e[0], e[2]], seed or (e[0], e[2]) in promoted))
        conf = {p: sum(s for s, _ in x) / (len(x) + 0.1) for p, x in by.items() if sum(b for _, b in x) >= min_seeds}
        trusted = {p: c for p, c in conf.items() if c >= min_confidence}
        for (k, p, v), seed in edges.items():
            if not seed:
                score[k, v] = max(score[k, v], conf.get((k, p), 0.0))
                if (k, p) in trusted:
                    promoted.add((k, v))
    return trusted


def test_learned_patterns_against_brute_force(spark):
    rng = random.Random(5)
    for trial in range(3):
        rows = []
        for _ in range(400):
            pattern = rng.randrange(25)
            v = rng.randrange(pattern * 3, pattern * 3 + 9)
            rows.append((rng.choice(["email", "phone"]), f"p{pattern}" if pattern else "", f"v{v}", v < 40))
        got = {(r["kind"], r["pattern"]): r["conf"] for r in pii.learned(spark.createDataFrame(rows, "kind string, pattern string, value string, seed boolean"), 400, 3, 3, 0.6 + 0.1 * trial).collect()}
        want = brute_learned(rows, 3, 3, 0.6 + 0.1 * trial)
        assert got.keys() == want.keys() and len(got) > 3
        assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_patterns_of_the_second_round(spark):
    """Six logins stand where seeds do and then in contexts no seed is in; one more login stands only there."""
    rows = [f"please contact me at user{i}@mail.example.com today" for i in range(80)]
    rows += [f"please contact me at ghost{i}@host{i} today" for i in range(6)]
    first = len(rows)
    rows += [f"the secret box belongs to ghost{i % 6}@host{i % 6} forever" for i in range(12)]
    rows += ["the other box belongs to ghost1@host1 forever", "some login is zz9@host alone"]
    out = {r["doc_id"]: r for r in pii.extract(frame(spark, rows)).collect()}
    assert all(out[i]["n_learned"] == 1 and out[i]["spans"].startswith("email:") for i in range(80, first + 13))
    assert out[first + 13]["n_learned"] == 0
    one = pii.learned
    try:
        pii.learned = lambda x, n: one(x, n, rounds=1)
        out = {r["doc_id"]: r for r in pii.extract(frame(spark, rows)).collect()}
    finally:
        pii.learned = one
    assert all(out[i]["n_learned"] == 1 for i in range(80, first)) and all(out[i]["n_learned"] == 0 for i in range(first, first + 14))


def test_contexts_are_fixed_windows(spark):
    text = "é 1 22, phone 1980 x " * 9 + "🙂 7"
    for pattern in (r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*+", r"[0-9]"):
        row = pii.positioned(frame(spark, [text, "1" * 70, "none"]), "text", pattern, "x").orderBy("doc_id").collect()
        for t, r in zip((text, "1" * 70), row, strict=False):
            want = [(m.start(), m.end(), t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 48]) for m in re.finditer(pattern, t)]
            assert [(s["start"], s["end"], s["left"], s["right"]) for s in r["x"]] == want


def test_pii_of_nothing_and_native(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.extract(empty).count() == 0
    plan = pii.extract(frame(spark, ["x@y.z"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_prefix_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 8, 9, 10, 100, 1001)]
    df = spark.createDataFrame([(x,) for x in lists], "a array<int>").select("a", pii.prefix_sums(F.col("a")).alias("s"))
    for r in df.collect():
        assert list(r["s"])[: len(r["a"])] == [sum(r["a"][:k]) for k in range(len(r["a"]))]


# ---- decontamination

ITEM = "If the train leaves Boston with 12 cars and Alice boards after 30 minutes, how many minutes pass before Alice meets 12 other people on the train"


def decon(spark, texts, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(frame(spark, texts, "item_id string"), bench).collect()}


def test_templates(spark):
    swapped = ITEM.replace("Alice", "Bob").replace("12", "45").replace("30", "7.5")
    broken = ITEM.replace("Alice boards", "Bob boards").replace("12 other", "99 other")
    rng = random.Random(0)
    clean = " ".join(f"word{rng.randrange(500)}" for _ in range(2000))
    texts = [f"{clean} {ITEM} {clean}", f"{clean} {swapped}. {clean}", f"{clean} {broken} {clean}", clean, None, "", ITEM.upper(), "short item here now", ITEM[:60], "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    items = [ITEM, "short item here now", None, "", "tiny one", "1 2 3 4 5 6 7 8 9 10 11 12 13", ITEM]
    got = decon(spark, texts, items)
    # in mid-sentence the item's first word looks like a name, so the windows with it don't count
    assert got[(0, 0)]["kind"] == "verbatim" and got[(0, 0)]["share"] >= 0.9
    assert got[(1, 0)]["kind"] == "reparameterised"
    assert (2, 0) not in got or got[(2, 0)]["n_windows"] < got[(0, 0)]["n_windows"]
    assert (7, 1) in got and {d for d, _ in got} & {3, 4, 5, 9} == set()
    assert {i for _, i in got} <= {0, 1}


def brute_windows(text):
    owner, kind, hashed = decontam.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert not owner.any()
    return kind.tolist(), hashed


def test_token_kinds():
    kind, _ = brute_windows("Then Alice ran 3.5 km, or ten miles. Bob 1,000 times: Kilo 5kg")
    assert kind == [0, 2, 0, 1, 3, 0, 1, 3, 0, 1, 0, 0, 1]


def test_verbatim_passages_against_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(f"w{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}{rng.choice('klmnop')}" for _ in range(n))
    items = [make(rng.randrange(4, 40)) for _ in range(15)]
    texts = []
    for k in range(60):
        t = make(rng.randrange(20, 200))
        texts.append(t + " " + items[k % 15] + " " + make(5) if k % 3 == 0 else t)
    got = {d for d, _ in decon(spark, texts, items)}
    assert got == {k for k in range(60) if any(i in texts[k] for i in items)}


def test_verbatim_copies_of_any_item(spark):
    items = [
        "Compute 1 2 3 4 5 6 7 8 9 10 11 12 13 14", "Red Hot Chili Peppers Live In Hyde Park London", "quick brown fox", "Photosynthesis?",
        "一列火车从北京出发开往上海需要多少小时", "電車は何時に東京駅を出発しますか", "รถไฟออกจากกรุงเทพกี่โมง", "what do Alice Bob Carol and Dave eat",
    ]
    texts = [f"we read that {x} and so on" for x in items[:4]] + [f"前文里说{items[4]}，然后继续", f"次の文は{items[5]}です", f"ถามว่า{items[6]}ครับ", f"they wrote “{items[7]}” there"]
    texts += ["compute 1 2 3 4 5", "red hot peppers in London", "quick fox", "北京和上海的火车", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    got = decon(spark, texts, items)
    assert set(got) == {(k, k) for k in range(8)}
    assert all(r["kind"] == "verbatim" and r["share"] == 1 for r in got.values())


def test_slot_values_may_coincide_or_change_once(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for k in range(10, 300, 15):
        words[k] = "12"
    long = " ".join(words)
    several = " ".join("45" if w == "12" else w for w in words)
    items = ["tom has 3 apples and buys 5 pears at the shop before he goes home", long]
    once = lambda t, old: t[:400] + t[400:].replace(old, " 99 ", 1)
    texts = ["x tom has 4 apples and buys 4 pears at the shop before he goes home y", once(long, " 12 "), once(several, " 45 ")]
    got = decon(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1)}
    assert [r["kind"] for _, r in sorted(got.items())] == ["reparameterised", "verbatim", "reparameterised"]
    assert got[(0, 0)]["share"] == 1 and all(0.9 < got[(k, 1)]["share"] < 1 for k in (1, 2))


def test_slot_values_of_any_length(spark):
    longer = ITEM.replace("Boston", "New York").replace("Alice", "Mary Ann").replace("12", "twenty five")
    item = "the boat with Carl Gustav Larsson and Eve sails one hundred fifty miles in ten hours, how fast does the boat sail with both of them"
    shorter = item.replace("Carl Gustav Larsson", "Bo").replace("one hundred fifty", "90")
    got = decon(spark, [f"so {longer} ok", longer, f"so {shorter} ok"], [ITEM, item])
    assert set(got) == {(0, 0), (1, 0), (2, 1)}
    assert all(r["kind"] == "reparameterised" and r["n_windows"] >= 6 for r in got.values())


def test_reparameterised_items_inside_a_sentence(spark):
    items = ["Tom has 3 apples and buys pears", "Find the sum of 12", "John Smith has 5 apples and buys more pears", "Compute how much Bob paid for 7 large cakes there"]
    texts = [
        "they asked (Tom has 4 apples and buys pears) again", "he said, Find the sum of 45, and left", "they say “Joan Smythe has 6 apples and buys more pears” here",
        "we asked Compute how much Eve paid for 9 large cakes there again", "Tom has 4 apples and buys pears", "tom has 4 apples and buys pears", "so Compute how many cakes",
    ]
    got = decon(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 0)}
    assert {r["kind"] for r in got.values()} == {"reparameterised"}


def test_items_of_one_template_are_joined_once(spark):
    rng = random.Random(9)
    make = lambda a, b, name: f"the farmer {name} sells {a} sheep at the old market and buys {b} goats on the way home from there"
    items = [make(10 + i, 200 + i, "Tom") for i in range(40)] + ["an item that has no slots at all but words enough to be found"]
    texts = [make(7, 9, "Eve")] + [make(10 + i, 200 + i, "Tom") for i in (0, 5, 17)] + [make(7, 7, "Tom"), items[40], "plain words " * 20]
    texts = [f"{rng.random()} so {t} and more" for t in texts]
    got = decon(spark, texts, items)
    assert {k: r["kind"] for k, r in got.items() if r["kind"] == "verbatim"} == {(1, 0): "verbatim", (2, 5): "verbatim", (3, 17): "verbatim", (5, 40): "verbatim"}
    assert {k for k, r in got.items() if r["kind"] == "reparameterised"} == {(0, 0), (2, 0), (3, 0), (4, 0)}


def brute_contamination(texts, items):
    """The rule in plain Python, over the kinds and values of ``decontam.tokens``; items must not share a form."""

    def units(text):
        kind, hashed = brute_windows(text)
        out = []
        for k, h in zip(kind, hashed.tolist(), strict=True):
            if k and out and out[-1][0] == k:
                out[-1] = (k, (*out[-1][1], h))
            else:
                out.append((k, (h,)))
        return list(zip(kind, hashed.tolist(), strict=True)), out

    found = set()
    for d, text in enumerate(texts):
        raw, templ = units(text)
        for i, item in enumerate(items):
            item_raw, item_templ = units(item)
            diagonals: dict = {}
            for exact, own, theirs in ((True, item_raw, raw), (False, item_templ, templ)):
                width = min(8, len(own))
                for a in range(len(own) - width + 1):
                    mine = own[a : a + width]
                    if not exact and (len(own) < 4 or sum(k == 0 for k, _ in mine) * 8 < 5 * width):
                        continue
                    for b in range(len(theirs) - width + 1):
                        other = theirs[b : b + width]
                        if exact and [h for _, h in mine] == [h for _, h in other] or not exact and all(x[0] == y[0] and (x[0] or x == y) for x, y in zip(mine, other, strict=True)):
                            pairs = set() if exact else {(x[1], y[1]) for x, y in zip(mine, other, strict=True) if x[0]}
                            diagonals.setdefault((exact, b - a), []).append((a, pairs, any(k != 1 for k, _ in mine), len(own) - width + 1))
            for (exact, _), hits in diagonals.items():
                votes: dict = {}
                for _, pairs, _, _ in hits:
                    for x, y in pairs:
                        votes.setdefault(x, {}).setdefault(y, 0)
                        votes[x][y] += 1
                to = {x: max(ys, key=lambda y: (ys[y], y == x)) for x, ys in votes.items()}  # noqa: B023
                good = [h for h in hits if all(to[x] == y for x, y in h[1])]
                if good and (not exact or any(h[2] for h in good)) and (len(good) >= 6 or len(good) >= 0.5 * good[0][3]):
                    found.add((d, i))
    return found


def test_reparameterised_items_against_brute_force(spark):
    rng = random.Random(21)
    names, word = ["Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid"], lambda: f"w{rng.randrange(60)}"

    def item():
        out = [rng.choice(names) if rng.random() < 0.1 else str(rng.randrange(2, 90)) if rng.random() < 0.15 else word() for _ in range(rng.randrange(6, 30))]
        return ["start", *out]

    items = [item() for _ in range(14)]
    texts = []
    for k in range(70):
        own = list(items[k % 14])
        swap = {w: (rng.choice(names) if w[0].isupper() else str(rng.randrange(2, 90))) for w in own if w[0].isupper() or w[0].isdigit()}
        if k % 5 == 1:
            own = [swap.get(w, w) for w in own]
        elif k % 5 == 2:  # each place by its own draw
            own = [rng.choice(names) if w[0].isupper() else str(rng.randrange(2, 90)) if w[0].isdigit() else w for w in own]
        elif k % 5 == 3:
            own = own[: len(own) // 2 + rng.randrange(3)]
        elif k % 5 == 4:
            own = [word() for _ in own]
        texts.append(" ".join([word() for _ in range(rng.randrange(12))] + own + [word() for _ in range(rng.randrange(12))]))
    items = [" ".join(x) for x in items]
    want = brute_contamination(texts, items)
    assert set(decon(spark, texts, items)) == want
    assert {(k, k % 14) for k in range(70) if k % 5 < 2} <= want and len(want) > 35


def test_decontamination_of_nothing(spark):
    assert decon(spark, [], [ITEM]) == {} and decon(spark, [ITEM], []) == {}
