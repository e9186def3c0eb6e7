"""Greedy word-piece lengths by a linear longest-match automaton; pieces are counted, never built."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._store import bounded_batches

CACHE_WORDS = 400_000
CACHE_BYTES = 64


class Automaton:
    """Trie of the vocabulary with failure links and the number of pieces each link pops.

    ``first`` pieces may start a word, ``rest`` pieces continue one (the same for vocabularies without a mark). Being
    at node u means: the bytes since the last counted piece spell u. If no edge fits, the longest pieces at the front
    of u's string are final: ``pops[u]`` counts them, ``fail[u]`` is the node of what is left, or -1 if nothing fits.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes] | None = None):
        first = {p for p in first if p}
        rest = first if rest is None else {p for p in rest if p}
        self.edges: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]

        def insert(root: int, pieces: set[bytes]) -> None:
            for piece in sorted(pieces):
                u = root
                for c in piece:
                    v = self.edges[u].get(c)
                    if v is None:
                        v = len(self.edges)
                        self.edges[u][c] = v
                        self.edges.append({})
                        ends.append(False)
                    u = v
                ends[u] = True

        self.start, self.next = 0, 0
        insert(0, first)
        if rest is not first and rest != first:
            self.next = len(self.edges)
            self.edges.append({})
            ends.append(False)
            insert(self.next, rest)
        n = len(self.edges)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [self.start] if self.next == self.start else [self.start, self.next]
        for u in queue:  # breadth first
            for c, v in self.edges[u].items():
                if ends[v]:
                    self.fail[v], self.pops[v] = self.next, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], popped
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; 1 (the unknown piece) where that gets stuck; 0 if empty."""
        if not word:
            return 0
        edges, fail, pops = self.edges, self.fail, self.pops
        u, n = self.start, 0
        for c in word:
            v = edges[u].get(c)
            while v is None:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return 1
                v = edges[u].get(c)
            u = v
        while u != self.next:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


@functools.lru_cache(maxsize=2)
def rank_file_automaton(path: str) -> Automaton:
    """The automaton of a file of base64 pieces and ranks; no continuation mark, so a piece fits anywhere in a word."""
    with open(path, "rb") as f:
        return Automaton(base64.b64decode(line.split()[0]) for line in f if line.strip())


def count_tokens(docs: DataFrame, make, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_words`` and ``n_tokens`` of each whole text (null text: zeros).

    ``make`` gives the automaton in the worker. Words are runs of non-space bytes. Counts of short words are
    remembered, up to ``CACHE_WORDS``; a long word passes through the automaton once, byte by byte. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("n_bytes", "n_words", "n_tokens")
    added = ["n_bytes", "n_words", "n_tokens"]
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    at = base.columns.index(text)

    def run(batches):
        machine, known = make(), {}
        for b in batches:
            n_words, n_tokens = [], []
            buf, offs = _text.buffers(b.column(at))
            for r in range(len(offs) - 1):
                words = buf[offs[r] : offs[r + 1]].tobytes().split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = machine.count(w)
                        if len(w) <= CACHE_BYTES:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            new = [pa.array(np.diff(offs), pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def op8_wordpiece_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, functools.partial(rank_file_automaton, path)).select("doc_id", "n_bytes", "n_words", "n_tokens")
