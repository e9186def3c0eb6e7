"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm._store import bounded_batches

PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a rank file (lines of base64 token and rank); cached per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text at boundaries that no pre-token crosses.

    With the pattern of the public byte-level vocabularies a match holds white space only at its front, so a cut
    between a non-space and a following space changes no match: the look-ahead of ``\\s+(?!\\S)`` sees only what
    follows its run, and a run of white space is never cut. A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str, pattern: str, size: int = PIECE_CHARS) -> np.ndarray:
    """Token ids of a whole text (null: none), without special tokens."""
    enc = encoding(path, pattern)
    parts = [np.asarray(enc.encode_ordinary(p), np.uint32) for p in pieces(text or "", size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def decode(ids, path: str, pattern: str) -> bytes:
    """The raw bytes of a sequence of ids; they need not be valid UTF-8."""
    return encoding(path, pattern).decode_bytes([int(x) for x in ids])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an array column of token ids (null text: empty array). One pass, no shuffle."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            rows = [encode(x.as_py(), path, pattern).astype(np.int32) for x in b.column(b.schema.get_field_index(text))]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], [*b.schema.names, ids])

    clean = docs.drop(ids)
    schema = T.StructType([*clean.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return clean.withColumn(text, F.col(text)).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: token count and digests of the ids and of the decoded bytes.

    ``decoded_sha256`` comes from decoding the ids, not from the text. Null text counts as empty: no tokens, digests
    of the empty string. Repeated rows give repeated results; only ``doc_id`` and ``text`` are read.
    """

    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            counts, ids_hash, text_hash = [], [], []
            for x in b.column(1):
                ids = encode(x.as_py(), path, pattern)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(encoding(path, pattern).decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
