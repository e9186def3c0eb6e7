"""Line deduplication: two Bloom filters find suspects, only suspects shuffle, exact counts decide.

1. Tasks send the 64-bit hashes of their lines' keys, packed, to segments by the hash's leading bits. A segment holds its part of
   the two filters, for hashes seen once and seen twice, and keeps the hashes that the second one has: the suspects.
   There are as many segments as the lines need, and they stay on the executors.
2. The suspects, a small share of the lines, make a filter that all tasks get. Lines that pass it leave their task with
   their whole key, once a task, and are counted exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._store import bounded_batches, discard, few_files, fresh, stored

SPACE = b" \t\n\v\f\r"
LINE_BITS = 16
SEGMENT_BITS = 1 << 22
MAX_SEGMENTS = 1 << 24
MAX_FILTER_BITS = 1 << 30
BROADCAST_KEYS = 1 << 20


def line_keys(text: bytes) -> list[bytes]:
    """The keys of a text's lines: ASCII space stripped at both ends, A-Z lower-cased; an empty text has one empty line."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def counts(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def key_hash(key: bytes) -> int:
    """64-bit hash of a key: what the filters hold."""
    return xxhash.xxh3_64_intdigest(key)


def key_digest(key: bytes) -> bytes:
    """128-bit hash of a key: its identity once it is confirmed."""
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist() if len(column) else []


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter, or a segment of one, of ``bits`` (a power of two)."""
    h = _text.mix(hashes)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash, by its leading bits; ``segments`` is a power of two."""
    return (hashes >> np.uint64(65 - segments.bit_length())).astype(np.int64) if segments > 1 else np.zeros(len(hashes), np.int64)


def segments_for(lines: int) -> int:
    """Segments of ``SEGMENT_BITS`` for ``LINE_BITS`` a line, a power of two."""
    need = max(1, lines * LINE_BITS // SEGMENT_BITS)
    return min(MAX_SEGMENTS, 1 << (need - 1).bit_length())


def _sent_hashes(docs: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(segment, once, twice): each task's hashes by segment, of keys it has in one document and in more."""

    def run(batches):
        seen: list[np.ndarray] = []
        for b in batches:
            for t in _texts(b.column(0)):
                own = {key_hash(k) for k in set(line_keys(t)) if counts(k, min_chars)}
                seen.append(np.fromiter(own, np.uint64, len(own)))
            if sum(map(len, seen)) > 4_000_000:
                yield from emit(seen)
                seen = []
        yield from emit(seen)

    def emit(seen):
        if not seen or not sum(map(len, seen)):
            return
        h = np.sort(np.concatenate(seen))
        start = _text.runs(h)
        again = np.diff(np.append(start, len(h))) > 1
        at = _segment(h[start], segments)
        cut = np.append(_text.runs(at), len(at))
        for s in range(0, len(cut) - 1, 256):
            parts = [(a, z) for a, z in zip(cut[s : s + 256], cut[s + 1 : s + 257], strict=False)]
            own = lambda a, z, which: h[start[a:z]][which[a:z]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[a]) for a, _ in parts], pa.int32()), pa.array([own(a, z, ~again) for a, z in parts], pa.binary()), pa.array([own(a, z, again) for a, z in parts], pa.binary())],
                ["segment", "once", "twice"],
            )

    return docs.select("text").mapInArrow(run, "segment int, once binary, twice binary")


def _suspects(group):
    """(segment, n, hashes): the hashes that the second filter of a segment has, after those of all tasks are in."""
    import pandas as pd

    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for single, several in zip(group["once"], group["twice"], strict=True):
        a, b = _positions(np.frombuffer(single, np.uint64), SEGMENT_BITS)
        before = once[a] & once[b]
        twice[a[before]] = twice[b[before]] = True
        once[a] = once[b] = True
        a, b = _positions(np.frombuffer(several, np.uint64), SEGMENT_BITS)
        once[a] = once[b] = twice[a] = twice[b] = True
    found = [np.zeros(0, np.uint64)]
    for column in ("once", "twice"):
        for raw in group[column]:
            h = np.frombuffer(raw, np.uint64)
            a, b = _positions(h, SEGMENT_BITS)
            found.append(h[twice[a] & twice[b]])
    found = _text.distinct(np.concatenate(found))
    return pd.DataFrame({"segment": group["segment"].iloc[:1], "n": [len(found)], "hashes": [found.tobytes()]})


def suspects(docs: DataFrame, min_chars: int = 1, segments: int | None = None) -> tuple[DataFrame, int]:
    """((segment, n, hashes), segments): the hashes of keys that may be in two documents or more; none is missed."""
    if segments is None:
        lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n")).first()["n"]
        segments = segments_for(lines or 0)
    sent = _sent_hashes(docs, segments, min_chars)
    return stored(sent.groupBy("segment").applyInPandas(_suspects, "segment int, n long, hashes binary")), segments


def suspect_filter(found: DataFrame, segments: int, total: int) -> tuple[np.ndarray, int]:
    """(packed bits, bits a segment) of a filter over the ``total`` suspects, of ``MAX_FILTER_BITS`` at most; fuller ones pass more."""
    bits = min(MAX_FILTER_BITS, 1 << math.ceil(math.log2(max(1, total * LINE_BITS))))
    each = max(64, bits // segments)

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                own = np.zeros(each, bool)
                for at in _positions(np.frombuffer(raw, np.uint64), each):
                    own[at] = True
                out.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["segment", "bits"])

    held, step = np.zeros(segments * each // 8, np.uint8), each // 8
    for r in found.where(F.col("n") > 0).select("segment", "hashes").mapInArrow(run, "segment int, bits binary").toLocalIterator():
        held[r["segment"] * step : (r["segment"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return held, each


def passes(hashes: np.ndarray, held: np.ndarray, each: int, segments: int) -> np.ndarray:
    """Whether the filter has each hash."""
    base = _segment(hashes, segments) * each
    out = np.ones(len(hashes), bool)
    for place in _positions(hashes, each):
        at = base + place
        out &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, segments: int | None = None) -> DataFrame:
    """(key, first_doc): the 128-bit digests of the keys of at least ``min_docs`` rows, with the smallest doc_id that has each.

    Only suspects leave their task, once for each task and key; counts are exact over key texts.
    """
    found, segments = suspects(docs, min_chars, segments)
    total = found.agg(F.sum("n")).first()[0] or 0
    held = docs.sparkSession.sparkContext.broadcast(suspect_filter(found, segments, total))
    discard(found)

    def run(batches):
        bits, each = held.value
        seen: dict[bytes, list[int]] = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, t in zip(ids, _texts(b.column(1)), strict=True):
                own = [k for k in set(line_keys(t)) if counts(k, min_chars)]
                if not own:
                    continue
                hit = passes(np.fromiter((key_hash(k) for k in own), np.uint64, len(own)), bits, each, segments)
                for k, h in zip(own, hit, strict=True):
                    if h:
                        c = seen.setdefault(k, [0, i])
                        c[0] += 1
                        c[1] = i if c[1] is None else c[1] if i is None else min(c[1], i)
            if len(seen) > 500_000:
                yield emit(seen)
                seen = {}
        yield emit(seen)

    def emit(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())],
            ["text", "n", "first_doc"],
        )

    part = docs.select("doc_id", "text").mapInArrow(run, "text binary, n long, first_doc long")
    exact = part.groupBy("text").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc")).where(F.col("n") >= min_docs)

    def digests(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_digest(k) for k in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["key", "first_doc"])

    return few_files(exact.select("text", "first_doc").mapInArrow(digests, "key binary, first_doc long"), total)


def _clean(text: bytes, doc_id, held: dict[bytes, int | None], min_chars: int, keep_first: bool) -> tuple[int, int, bytes]:
    """(lines, dropped lines, what stays)."""
    keys, raw = line_keys(text), text.split(b"\n")
    out, own = [], set()
    for k, line in zip(keys, raw, strict=True):
        h = key_digest(k) if counts(k, min_chars) else None
        if h is not None and h in held:
            if not keep_first or held[h] != doc_id or h in own:
                continue
            own.add(h)
        out.append(line)
    return len(raw), len(raw) - len(out), b"\n".join(out)


def _line_rows(docs: DataFrame, uid: str, min_chars: int) -> DataFrame:
    def run(batches):
        for b in batches:
            u, h = [], []
            for i, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                own = {key_digest(k) for k in set(line_keys(t)) if counts(k, min_chars)}
                u += [i] * len(own)
                h += own
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(h, pa.binary())], ["uid", "key"])

    return docs.select(uid, "text").mapInArrow(run, "uid binary, key binary")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", segments: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with ``text`` cleaned and ``n_lines``, ``n_dropped`` added (columns of those names are replaced).

    Lines whose key is found in at least ``min_docs`` documents go from every document (``keep="none"``), or stay once,
    at their first place in the smallest doc_id that has them (``keep="first"``; in every row of it, if that doc_id repeats).
    Each row is a document of its own for the counts, even if a doc_id repeats. Null text counts as one empty line and
    stays null. Keys under ``min_chars`` code points never go. Confirmed keys are known by 128 bits. They are broadcast if at
    most ``broadcast_keys``; beyond that they are joined to the documents' own keys by shuffle, with the same result.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    spark, first = docs.sparkSession, keep == "first"
    bounded_batches(spark)
    base = docs.drop("n_lines", "n_dropped")
    found = repeated_lines(base.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_docs, min_chars, segments)
    names = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at_id, at_text = names.index("doc_id"), names.index("text")

    def cleaned(b, columns, held_of):
        ids, texts = b.column(at_id).to_pylist(), _texts(b.column(at_text))
        rows = [_clean(t, i, held_of(k), min_chars, first) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        there = b.column(at_text).is_valid().to_pylist()
        text = pa.array([r[2] if ok else None for ok, r in zip(there, rows, strict=True)], pa.binary()).cast(b.column(at_text).type)
        cols = list(b.columns)[:columns]
        cols[at_text] = text
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], [f.name for f in schema.fields])

    if found.count() <= broadcast_keys:
        keys = spark.sparkContext.broadcast({bytes(r["key"]): r["first_doc"] for r in found.toLocalIterator()})

        def run(batches):
            held = keys.value
            for b in batches:
                yield cleaned(b, len(names), lambda _: held)
                _text.release()

        return base.mapInArrow(run, schema)

    uid, own_uid, own_keys = fresh(names, "uid", "own_uid", "own_keys")
    keyed = base.withColumn(uid, F.unhex(F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("text")), 256)))
    salts = 16
    salted = _line_rows(keyed, uid, min_chars).dropDuplicates().withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    wide = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    own = salted.join(wide, ["key", "salt"]).groupBy("uid").agg(F.collect_list(F.struct("key", "first_doc")).alias("keys")).toDF(own_uid, own_keys)
    joined = keyed.join(own, F.col(uid) == F.col(own_uid), "left").select(*names, own_keys)

    def run(batches):
        for b in batches:
            lists = b.column(len(names)).to_pylist()
            yield cleaned(b, len(names), lambda k: {x["key"]: x["first_doc"] for x in lists[k] or ()})

    return joined.mapInArrow(run, schema)


def op9_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT row, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d)
), r AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(r.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k GROUP BY row
"""
