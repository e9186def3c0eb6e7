"""Language identification: scripts narrow the candidates, Viterbi over words labels the spans of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._store import bounded_batches

TRAIN_DOCS = 8192
FLOOR_DOCS = 64
TABLE_BITS = 16
GROUP_BYTES = 3 << 20
SWITCH_PENALTY = 8.0
MIN_SCRIPT_SHARE = 0.02
#: With more languages than this, tables and groups of texts get smaller, so that memory stays what it is here.
FULL_LANGS = 200
UNKNOWN = "und"

#: Scripts by the first two UTF-8 bytes of a letter, as (first bytes from, to, second bytes from, to, script number).
_RANGES = (
    (0xC3, 0xC3, 0x80, 0x96, 1), (0xC3, 0xC3, 0x98, 0xB6, 1), (0xC3, 0xC3, 0xB8, 0xBF, 1), (0xC4, 0xCA, 0x80, 0xBF, 1), (0xE1, 0xE1, 0xB8, 0xBB, 1),  # Latin
    (0xCD, 0xCD, 0xB0, 0xBF, 2), (0xCE, 0xCF, 0x80, 0xBF, 2), (0xE1, 0xE1, 0xBC, 0xBF, 2),  # Greek
    (0xD0, 0xD3, 0x80, 0xBF, 3), (0xD4, 0xD4, 0x80, 0xAF, 3), (0xD4, 0xD4, 0xB1, 0xBF, 4), (0xD5, 0xD5, 0x80, 0xBF, 4), (0xD6, 0xD6, 0x80, 0x8F, 4),  # Cyrillic, Armenian
    (0xD6, 0xD6, 0x90, 0xBF, 5), (0xD7, 0xD7, 0x80, 0xBF, 5), (0xD8, 0xDB, 0x80, 0xBF, 6), (0xEF, 0xEF, 0xAD, 0xB7, 6), (0xEF, 0xEF, 0xB9, 0xBB, 6),  # Hebrew, Arabic
    (0xDC, 0xDC, 0x80, 0xBF, 7), (0xDD, 0xDD, 0x80, 0x8F, 7), (0xDD, 0xDD, 0x90, 0xBF, 6), (0xDE, 0xDE, 0x80, 0xBF, 8), (0xDF, 0xDF, 0x80, 0xBF, 9),  # Syriac, Thaana, N'Ko
    (0xE0, 0xE0, 0xA4, 0xA5, 10), (0xE0, 0xE0, 0xA6, 0xA7, 11), (0xE0, 0xE0, 0xA8, 0xA9, 12), (0xE0, 0xE0, 0xAA, 0xAB, 13), (0xE0, 0xE0, 0xAC, 0xAD, 14),  # Devanagari .. Oriya
    (0xE0, 0xE0, 0xAE, 0xAF, 15), (0xE0, 0xE0, 0xB0, 0xB1, 16), (0xE0, 0xE0, 0xB2, 0xB3, 17), (0xE0, 0xE0, 0xB4, 0xB5, 18), (0xE0, 0xE0, 0xB6, 0xB7, 19),  # Tamil .. Sinhala
    (0xE0, 0xE0, 0xB8, 0xB9, 20), (0xE0, 0xE0, 0xBA, 0xBB, 21), (0xE0, 0xE0, 0xBC, 0xBF, 22), (0xE1, 0xE1, 0x80, 0x81, 23), (0xE1, 0xE1, 0x82, 0x83, 24),  # Thai .. Georgian
    (0xE1, 0xE1, 0x84, 0x87, 25), (0xEA, 0xEA, 0xB0, 0xBF, 25), (0xEB, 0xED, 0x80, 0xBF, 25), (0xE1, 0xE1, 0x88, 0x8D, 26), (0xE1, 0xE1, 0x8E, 0x8F, 27),  # Hangul .. Cherokee
    (0xE1, 0xE1, 0x90, 0x99, 28), (0xE1, 0xE1, 0x9A, 0x9B, 29), (0xE1, 0xE1, 0x9E, 0x9F, 30), (0xE1, 0xE1, 0xA0, 0xA2, 31),  # Canadian .. Mongolian
    (0xE2, 0xE2, 0xB0, 0xB7, 32), (0xE3, 0xE3, 0x81, 0x83, 33), (0xE3, 0xE3, 0x84, 0x86, 34), (0xE3, 0xE3, 0x90, 0xBF, 35), (0xE4, 0xE9, 0x80, 0xBF, 35),  # Tifinagh .. Han
    (0xF0, 0xF0, 0xA0, 0xB3, 35), (0xEA, 0xEA, 0x80, 0x92, 36), (0xF0, 0xF0, 0x90, 0x9B, 37), (0xF0, 0xF0, 0x9E, 0x9E, 38), (0xE0, 0xE0, 0xA0, 0xA3, 39),  # Yi, astral, others
    (0xE1, 0xE1, 0x9C, 0x9D, 39), (0xE1, 0xE1, 0xA3, 0xB7, 39), (0xEA, 0xEA, 0x93, 0xAF, 39),
)
SCRIPTS = 40
_SCRIPT = np.zeros((256, 256), np.int8)
for _a, _b, _c, _d, _s in _RANGES:
    _SCRIPT[_a : _b + 1, _c : _d + 1] = _s
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


@dataclass
class Model:
    """Log-probabilities of hashed byte trigrams and words by language, and the scripts each language uses."""

    langs: list[str]
    trigram: np.ndarray  # float32 [2**TABLE_BITS, langs]
    word: np.ndarray
    allowed: np.ndarray  # bool [SCRIPTS, langs]
    prior: int

    @property
    def bits(self) -> int:
        return len(self.trigram).bit_length() - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    hashed: np.ndarray  # table index of the word
    script: np.ndarray
    grams: np.ndarray  # table index of the trigram around each byte
    lower: np.ndarray


def words_of(buf: np.ndarray, offs: np.ndarray, bits: int = TABLE_BITS) -> Words:
    low = _text.LOWER[buf]
    if len(low) > 1:  # Latin-1 capitals
        upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
        low[1:][upper] += 0x20
    start, end, h = _text.word_hashes(low, offs, lower=False)
    wide = np.where(_text.IS_SPACE[low], np.uint8(32), low).astype(np.uint32)
    before, after = np.empty_like(wide), np.empty_like(wide)
    if len(wide):
        before[0], after[-1] = 32, 32
        before[1:], after[:-1] = wide[:-1], wide[1:]
        inner = offs[(offs > 0) & (offs < len(wide))]
        before[inner], after[inner - 1] = 32, 32
    gram = (before << np.uint32(16)) | (wide << np.uint32(8)) | after
    gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
    script_at = _ASCII_LETTER[low].astype(np.int8)
    lead = np.flatnonzero(low[:-1] >= 0xC3)
    script_at[lead] = _SCRIPT[low[lead], low[lead + 1]]
    letters = np.flatnonzero(script_at)
    first = np.searchsorted(letters, start)
    inside = first < len(letters)
    inside[inside] = letters[first[inside]] < end[inside]
    script = np.zeros(len(start), np.int8)
    script[inside] = script_at[letters[first[inside]]]
    owner = np.searchsorted(offs, start, "right") - 1
    return Words(start, end, owner, (h >> np.uint64(64 - bits)).astype(np.int64), script, gram, low)


def _sample(rows: DataFrame, sample: int, floor: int) -> DataFrame:
    """About ``sample`` distinct texts of ``rows`` (lang, text), in proportion to the languages' distinct texts but of each ``floor``
    at least (all, where it has fewer). Texts are drawn by hash, so the choice depends on nothing else."""
    keyed = rows.withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in keyed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if total <= sample:
        chosen = keyed
    else:
        whole = 1 << 30
        cuts = [(lang, min(whole, -(-max(floor, sample * n // total) * whole // n))) for lang, n in sizes.items()]
        cuts = rows.sparkSession.createDataFrame(cuts, "lang string, cut long")
        drawn = F.pmod(F.xxhash64("h", F.lit(29)), F.lit(whole)) < F.col("cut")
        chosen = keyed.join(F.broadcast(cuts), "lang").where(drawn)
    return chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, sample: int = TRAIN_DOCS, floor: int = FLOOR_DOCS) -> Model | None:
    """Fit on about ``sample`` distinct labelled texts (``text``, ``lang``), of each language ``floor`` at least; None without any.

    A text counts once for a language, however many rows have it. Counts are summed per language where the rows are; the
    driver gets two tables of 2**16 counts a language, of fewer from ``FULL_LANGS`` languages on.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = rows.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return None
    rows = _sample(rows, sample, floor)
    bits = max(1, TABLE_BITS - (-(-langs // FULL_LANGS) - 1).bit_length())
    size = 1 << bits

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            buf, offs = _text.buffers(b.column(1))
            for lo, hi in _text.blocks(buf, offs):
                part, cut = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                w = words_of(part, cut, bits)
                own = np.repeat(np.arange(hi - lo), np.diff(cut))
                for lang in set(langs[lo:hi]):
                    mine = np.array([x == lang for x in langs[lo:hi]])
                    c = held.setdefault(lang, [np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(SCRIPTS, np.int64)])
                    letters = mine[w.owner] & (w.script > 0)
                    c[0] += np.bincount(w.grams[mine[own] & ~_text.IS_SPACE[part]], minlength=size)
                    c[1] += np.bincount(w.hashed[letters], minlength=size)
                    c[2] += np.bincount(w.script[letters], weights=(w.end - w.start)[letters], minlength=SCRIPTS).astype(np.int64)
        if held:
            cols = [pa.array([c[k].tobytes() for c in held.values()], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *cols], ["lang", "grams", "words", "scripts"])

    def add(group):
        import pandas as pd

        out = {"lang": group["lang"].iloc[:1]}
        for c in ("grams", "words", "scripts"):
            out[c] = [np.sum([np.frombuffer(x, np.int64) for x in group[c]], axis=0).tobytes()]
        return pd.DataFrame(out)

    schema = "lang string, grams binary, words binary, scripts binary"
    found = sorted(rows.mapInArrow(run, schema).groupBy("lang").applyInPandas(add, schema).collect(), key=lambda r: r["lang"])
    counts = [np.stack([np.frombuffer(r[c], np.int64) for r in found], 1).astype(float) for c in ("grams", "words", "scripts")]
    logp = [np.log((c + 0.5) / (c.sum(0) + 0.5 * size)).astype(np.float32) for c in counts[:2]]
    allowed = counts[2] >= MIN_SCRIPT_SHARE * np.maximum(1, counts[2].sum(0))
    return Model([r["lang"] for r in found], logp[0], logp[1], allowed & (counts[2] > 0), int(counts[1].sum(0).argmax()))


def word_scores(model: Model, w: Words) -> np.ndarray:
    """Score of each word by language, less the mean; languages that don't use the word's script are out of reach."""
    out = np.empty((len(w.start), len(model.langs)), np.float32)
    for k in range(len(model.langs)):
        total = np.concatenate([[0.0], np.cumsum(model.trigram[:, k][w.grams], dtype=np.float64)])
        out[:, k] = total[w.end] - total[w.start] + model.word[:, k][w.hashed]
    out -= out.mean(1, keepdims=True)
    allowed = model.allowed[w.script]
    some = allowed.any(1) & (w.script > 0)
    out[~some] = 0
    out[some[:, None] & ~allowed] = -1e4
    return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word; texts advance together, one word a step, so time follows the longest text."""
    n, langs = scores.shape
    order = np.argsort(-counts, kind="stable")
    at = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    best_before = np.zeros(n, np.int32)
    switched = np.zeros((n, langs), bool)
    labels = np.zeros(n, np.int32)
    if not n:
        return labels
    v = np.zeros((len(counts), langs), np.float32)
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # texts with more than t words
    for t in range(int(sizes[0])):
        m = live[t]
        i = at[:m] + t
        now = v[:m]
        if t:
            arg = now.argmax(1)
            top = now[np.arange(m), arg][:, None] - penalty
            best_before[i] = arg
            switched[i] = now < top
            np.maximum(now, top, out=now)
        now += scores[i]
        now -= now.max(1, keepdims=True)
    last = v.argmax(1).astype(np.int32)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = live[t]
        i = at[:m] + t
        label = last[:m]
        labels[i] = label
        last[:m] = np.where(switched[i, label], best_before[i], label)
    return labels


@dataclass
class Labels:
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    label: np.ndarray
    share: np.ndarray  # bytes of words by text and language


def label_texts(model: Model, buf: np.ndarray, offs: np.ndarray) -> Labels:
    """Words of a group of texts and their labels. Scores are made block by block, all texts of the group advance together."""
    rows, k = len(offs) - 1, len(model.langs)
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32),) * 3 + (np.zeros((0, k), np.float32), np.zeros(0, np.int32))]
    for lo, hi in _text.blocks(buf, offs):
        w = words_of(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], model.bits)
        weight = np.where((w.script > 0) & model.allowed[w.script].any(1), w.end - w.start, 0)
        small = lambda x: x.astype(np.int32)
        parts.append((small(w.start + offs[lo]), small(w.end + offs[lo]), small(w.owner + lo), word_scores(model, w), small(weight)))
    start, end, owner, scores, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    labels = viterbi(scores, np.bincount(owner, minlength=rows))
    share = np.bincount(owner.astype(np.int64) * k + labels, weights=weight, minlength=rows * k).reshape(rows, k)
    return Labels(start, end, owner, labels, share)


def identify(docs: DataFrame, model: Model | None, text: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and, if asked for, ``lang_spans`` (array of start byte, end byte, lang).

    ``lang_pred`` is the language with most bytes of words in its spans, ties to the first by name; ``score`` is its
    share. Text that is null or has no letter gets ``und`` and 0; letters of scripts no language was seen in give the
    most common language and 0; without a model all is ``und``. Only ``text`` decides; the model is a few MB.
    """
    bounded_batches(docs.sparkSession)
    names = ["lang_pred", "score", "lang_spans"][: 2 + spans]
    base = docs.drop("lang_pred", "score", "lang_spans")
    kinds = [T.StringType(), T.DoubleType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))]
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=False))])
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index(text)

    def run(batches):
        model = held.value
        names_of = pa.array(model.langs if model else [], pa.string())
        for b in batches:
            column = b.column(at)
            buf, offs = _text.buffers(column)
            preds, scores, all_spans, counts = [], [], [], [np.zeros(1, np.int64)]
            group = GROUP_BYTES if model is None else GROUP_BYTES * FULL_LANGS // max(FULL_LANGS, len(model.langs))
            for lo, hi in _text.blocks(buf, offs, group):
                part, cut = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part], dtype=np.int32)])
                has = letters[cut[1:]] > letters[cut[:-1]]
                for r in np.flatnonzero(~has):
                    has[r] = any(map(str.isalpha, part[cut[r] : cut[r + 1]].tobytes().decode()))
                if model is None:
                    preds += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    counts.append(np.zeros(hi - lo, np.int64))
                    continue
                w = label_texts(model, part, cut)
                labels, share = w.label, w.share
                total = share.sum(1)
                best = np.where(total > 0, share.argmax(1), model.prior)
                score = np.where(has & (total > 0), share[np.arange(len(best)), best] / np.maximum(total, 1), 0.0)
                preds += [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                scores += score.tolist()
                if spans:
                    ok = has[w.owner]
                    start, end, owner, labels = w.start[ok], w.end[ok], w.owner[ok], labels[ok]
                    new = np.ones(len(labels), bool)
                    new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(labels))[: len(first)] - 1
                    counts.append(np.bincount(owner[first], minlength=hi - lo))
                    all_spans.append(pa.StructArray.from_arrays([pa.array((start[first] - cut[owner[first]]).astype(np.int64)), pa.array((end[last] - cut[owner[last]]).astype(np.int64)), names_of.take(pa.array(labels[first]))], ["start", "end", "lang"]))
            new = [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
                flat = pa.concat_arrays([pa.array([], kind), *(x.cast(kind) for x in all_spans)])
                new.append(pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [f.name for f in schema.fields])
            _text.release()

    return base.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 modulo 5, and where there is no id; such rows teach nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    spans = F.array_join(F.transform("lang_spans", lambda x: F.concat_ws(":", x["lang"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return identify(rows, model, spans=True).select("doc_id", "held_out", "lang_pred", "score", spans.alias("spans"))
