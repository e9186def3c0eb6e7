"""Substring deduplication by suffix arrays: Larsson-Sadakane refinement, Kasai common prefixes, binary-search merging.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller id. Every such string
(window) has an anchor, the leftmost least hash of its ``GRAM``-byte substrings, so equal windows have equal anchors.

1. Of equal texts the one of smallest id stands for all: the others are repeats from end to end.
2. Anchors are exchanged between batches of texts; those found in one text only are done.
3. Documents cut the neighbourhoods of shared anchors: the windows of one anchor and the bytes they cover. They go to
   shards by the anchor. Of neighbourhoods of a batch that are equal byte by byte only those of the smallest id go, the others
   are all repeats.
4. A shard's neighbourhoods form one text. A large shard is cut into parts that get a suffix array each; windows of one
   part are looked up in the sorted windows of the others by binary search. Neighbours in a suffix array with a common
   prefix of ``LENGTH`` bytes are equal windows; the smallest id among them keeps its own.

A row is known by its doc_id and a hash of its text, texts are equal by two such hashes (128 bits), the rest by their bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._graph import with_least
from tessera.llm._store import bounded_batches, discard, fresh, stored
from tessera.llm.jaccard import BATCH_BYTES, batch_rows, count_classes, gathered

LENGTH = 50
GRAM = 26
PART_BYTES = 2 << 20
SHARD_BYTES = 3 << 20
BUCKET_BYTES = 16 << 20
LANES = 1 << 15
TOKEN_BITS = 48
_SPARE = np.uint64(64 - TOKEN_BITS)
#: A difference of two 8-byte words is below the k-th bound if their first k+1 bytes are equal.
_BELOW = np.array([1 << (56 - 8 * k) for k in range(8)], np.uint64)


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of ``text`` by the first ``depth`` bytes, at least 8; equal prefixes have equal ranks.

    Larsson-Sadakane refinement: suffixes sorted by h bytes are sorted by h + s through the ranks s places on, and only
    groups that are not single yet are sorted again. A rank is the place of the group's first suffix.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    start = _text.runs(key[sa])
    size = np.diff(np.append(start, n))
    rank[sa] = np.repeat(start, size)
    h = 8
    open_at = np.flatnonzero(np.repeat(size > 1, size))
    while h < depth and len(open_at):
        step = min(h, depth - h)
        at = sa[open_at]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(pair)
        at, pair = at[order], pair[order]
        sa[open_at] = at
        start = _text.runs(pair)
        size = np.diff(np.append(start, len(pair)))
        rank[at] = np.repeat(open_at[start], size)
        open_at = open_at[np.repeat(size > 1, size)]
        h += step
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int, lanes: int = LANES) -> np.ndarray:
    """lcp[r]: bytes, ``limit`` at most, that the suffixes at places r-1 and r of ``sa`` have in common.

    Kasai's rule, the value falls by one at most from a text position to the next, in many lanes that advance together.
    ``sa`` is sorted by ``limit`` bytes, so the rule holds where the follower of the neighbour still stands before;
    elsewhere the count begins anew. Equal bytes are passed eight at a time while they can be.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for k in range(8):
        words[:n] = (words[:n] << np.uint64(8)) | padded[k : n + k]
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.where(place > 0, sa[np.maximum(place - 1, 0)], -1)
    lcp = np.zeros(n, np.int64)
    step = max(limit, math.ceil(n / lanes))
    first = np.arange(0, n, step)
    h, last = np.zeros(len(first), np.int64), np.full(len(first), -1)
    for s in range(step):
        i = first + s
        live = i < n
        i, h, last, first = i[live], h[live], last[live], first[live]
        follower = last + 1
        valid = (last >= 0) & (follower < n)
        valid[valid] = place[follower[valid]] < place[i[valid]]
        h = np.where(valid, np.maximum(h - 1, 0), 0)
        last = before[i]
        grow = np.flatnonzero(last >= 0)
        while len(grow):
            differ = words[i[grow] + h[grow]] ^ words[last[grow] + h[grow]]
            same = np.zeros(len(grow), np.int64)
            for bits in range(8):
                same += differ < _BELOW[bits]
            h[grow] += same
            room = np.minimum(limit, n - np.maximum(i[grow], last[grow]))
            grow = grow[(same == 8) & (h[grow] < room)]
        h = np.minimum(h, np.where(last >= 0, np.minimum(limit, n - np.maximum(i, last)), 0))
        lcp[place[i]] = h
    return lcp


def _sorted_windows(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the windows at the given places: sorted by content, with the number of each distinct content."""
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    sa, _ = suffix_array(text, LENGTH)
    lcp = common_prefixes(text, sa, LENGTH)
    chain = np.cumsum(lcp < LENGTH)  # suffixes with one number agree in LENGTH bytes
    keep = wanted[sa]
    chain = chain[keep]
    group = np.cumsum(np.concatenate([[0], (chain[1:] != chain[:-1])])) if len(chain) else chain
    return sa[keep], group


def least_owner(text: np.ndarray, at: np.ndarray, owner: np.ndarray, part_bytes: int = PART_BYTES) -> np.ndarray:
    """For each window (places ``at``, increasing) the smallest owner of an equal window.

    Texts above ``part_bytes`` are cut into parts with a suffix array each; each part's distinct windows are looked up
    in those of every other by binary search.
    """
    best = owner.copy()
    if not len(at):
        return best
    cuts = np.unique(np.searchsorted(at, np.arange(0, int(at[-1]) + part_bytes, part_bytes)))
    if cuts[-1] != len(at):
        cuts = np.append(cuts, len(at))
    parts = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        base = at[lo]
        piece = text[base : at[hi - 1] + LENGTH]
        order, group = _sorted_windows(piece, at[lo:hi] - base)
        index = lo + np.searchsorted(at[lo:hi] - base, order)
        start = _text.runs(group)
        least = np.minimum.reduceat(owner[index], start)
        parts.append([index, group, at[index[start]], least])
    for x in range(len(parts)):
        for y in range(x + 1, len(parts)):
            small, large = (x, y) if len(parts[x][2]) <= len(parts[y][2]) else (y, x)
            spot = _lookup(text, parts[small][2], parts[large][2])
            hit = np.flatnonzero(spot >= 0)
            both = np.minimum(parts[small][3][hit], parts[large][3][spot[hit]])
            parts[small][3][hit] = both
            parts[large][3][spot[hit]] = both
    for index, group, _, least in parts:
        best[index] = least[group]
    return best


def _lookup(text: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in ``table`` (places of distinct windows, sorted by content) of the window equal to each of ``at``, or -1."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(table))
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int8)
        for s in range(0, len(a), 100_000):
            x, y = view[a[s : s + 100_000]], view[b[s : s + 100_000]]
            differ = x != y
            k = differ.argmax(1)
            row = np.arange(len(k))
            out[s : s + 100_000] = np.where(differ[row, k], np.where(x[row, k] < y[row, k], -1, 1), 0)
        return out

    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) // 2
        less = compare(table[mid], at[busy]) < 0
        low[busy] = np.where(less, mid + 1, low[busy])
        high[busy] = np.where(less, high[busy], mid)
    found = np.full(len(at), -1)
    inside = np.flatnonzero(low < len(table))
    equal = compare(table[low[inside]], at[inside]) == 0
    found[inside[equal]] = low[inside[equal]]
    return found


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, token, first window, windows) of the anchors: maximal runs of windows with one anchor, in order."""
    none = np.zeros(0, np.int64)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    spread = LENGTH - GRAM + 1
    h = _text.prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    value = _text.range_hash(h, at, at + GRAM)
    own_value, where = value, at.astype(np.int32)
    width = 1
    while width < spread:
        s = min(width, spread - width)
        later = value[s:] < value[:-s]
        where = np.where(later, where[s:], where[:-s])
        value = np.minimum(value[s:], value[:-s])
        width += s
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = owner[:n] == owner[LENGTH - 1 :]
    new = np.ones(n, bool)
    new[1:] = (where[1:n] != where[: n - 1]) | ~whole[:-1] | (owner[1:n] != owner[: n - 1])
    first = np.flatnonzero(new & whole)
    following = np.append(np.flatnonzero(new | ~whole), n)
    end = following[np.searchsorted(following, first, "right")]
    # least values crowd at zero; mixed again, they spread over the buckets
    return owner[first], _text.mix(own_value[where[first]]) >> np.uint64(64 - TOKEN_BITS), first, end - first


def _pieces(buf: np.ndarray, offs: np.ndarray):
    """Blocks of texts; a text beyond a block comes in pieces that overlap by a window less a byte, with its offset."""
    for lo, hi in _text.blocks(buf, offs, _text.BLOCK):
        if hi - lo > 1 or offs[hi] - offs[lo] <= _text.BLOCK:
            yield lo, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], 0
            continue
        for a in range(offs[lo], offs[hi], _text.BLOCK):
            z = min(a + _text.BLOCK + LENGTH - 1, offs[hi])
            yield lo, buf[a:z], np.array([0, z - a]), a - offs[lo]


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """The distinct anchors of each text; rows are (uid, doc_id, text, t2). Equal texts are one class; the least id sends."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = b.column(1).to_numpy(zero_copy_only=False)
            sigs = np.stack([ids, b.column(4).to_numpy(zero_copy_only=False)], 1).view(np.uint64)
            buf, offs = _text.buffers(b.column(2))
            for lo, hi in _text.blocks(buf, offs, BATCH_BYTES):
                part, cut = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                keys = [np.zeros(0, np.uint64)]
                for base, x, c, _ in _pieces(part, cut):
                    owner, token, _, _ = anchors(x, c)
                    keys.append(_text.distinct(((base + owner).astype(np.uint64) << np.uint64(TOKEN_BITS)) | token))
                keys = _text.distinct(np.concatenate(keys))
                owner, token = (keys >> np.uint64(TOKEN_BITS)).astype(np.int64), keys & np.uint64((1 << TOKEN_BITS) - 1)
                stamp = b.column(3)[lo].as_py()
                digest = hashlib.blake2b(ids[lo:hi].tobytes() + stamp.to_bytes(8, "little", signed=True), digest_size=8).digest()
                rows = list(batch_rows(ids[lo:hi], np.ones(hi - lo, bool), owner, token << _SPARE, int.from_bytes(digest, "little") >> 1, buckets, sigs[lo:hi], turn[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                    ["bucket", "kind", "batch", "payload"],
                )
                del keys, owner, token, rows
                _text.release()

    rows = docs.select("uid", "doc_id", "text", F.monotonically_increasing_id().alias("at"), "t2")
    return rows.mapInArrow(run, "bucket int, kind int, batch long, payload binary")


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, uid, tokens): the shared anchors of a batch's texts."""
    meta, token, owner, _ = gathered(group)
    token = token >> _SPARE
    order = np.argsort((owner.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
    owner, token = owner[order], token[order]
    start = _text.runs(owner)
    ends = np.append(start[1:], len(owner))[: len(start)]
    of = lambda plane: meta[plane].view(np.int64)[owner[start]]
    return pd.DataFrame({"doc_id": of(6), "uid": of(0), "tokens": [token[a:z].tobytes() for a, z in zip(start, ends, strict=True)]})


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether ``size`` bytes (one at least) from each of the places ``a`` equal those from ``b``."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(a):
        base = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
        n = size[lo:hi]
        start = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(start, n)
        out[lo:hi] = np.logical_and.reduceat(text[np.repeat(a[lo:hi], n) + within] == text[np.repeat(b[lo:hi], n) + within], start)
        lo = hi
    return out


ENTRY = np.dtype([("doc", "i8"), ("uid", "i8"), ("first", "u4"), ("windows", "u1")])


def pack(e: np.ndarray, text: np.ndarray) -> bytes:
    """Entries column by column, then their bytes."""
    return b"".join(np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names) + text.tobytes()


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    e, at = np.zeros(n, ENTRY), 0
    for c in ENTRY.names:
        e[c] = np.frombuffer(raw, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return e, np.frombuffer(raw, np.uint8, offset=at)


SPAN = np.dtype([("doc", "i8"), ("uid", "i8"), ("start", "i8"), ("end", "i8")])


def _cut(shards: int):
    """(uid, doc_id, text, tokens) to (shard, kind, payload): neighbourhoods of shared anchors, and spans known already."""

    def neighbourhoods(b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries, contents, tokens, bytes) of a batch's shared anchors; the bytes follow each other in that order."""
        uids, docs, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(3)
        buf, offs = _text.buffers(b.column(2))
        entries, contents, tokens, texts = [np.zeros(0, ENTRY)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for lo, part, cut, shift in _pieces(buf, offs):
            owner, token, first, windows = anchors(part, cut)
            held = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(lists[lo + r].as_py(), np.uint64) | np.uint64(r << TOKEN_BITS) for r in range(len(cut) - 1))])
            mine = (owner.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token
            spot = np.minimum(np.searchsorted(held, mine), max(0, len(held) - 1))
            keep = held[spot] == mine if len(held) else np.zeros(len(mine), bool)
            owner, token, first, windows = owner[keep], token[keep], first[keep], windows[keep]
            e = np.zeros(len(owner), ENTRY)
            size = windows + LENGTH - 1
            contents.append(_text.range_hash(_text.prefix_hash(part), first, first + size))
            e["doc"], e["uid"], e["windows"] = docs[lo + owner], uids[lo + owner], windows
            e["first"] = first - cut[owner] + shift
            ends = np.cumsum(size)
            entries.append(e)
            tokens.append(token)
            texts.append(part[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)])
        return np.concatenate(entries), np.concatenate(contents), np.concatenate(tokens), np.concatenate(texts)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            e, content, token, text = neighbourhoods(b)
            if not len(e):
                continue
            size = e["windows"].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((e["doc"], content))
            start = _text.runs(content[order])
            first = np.repeat(order[start], np.diff(np.append(start, len(order))))
            known = (e["doc"][order] > e["doc"][first]) & (size[order] == size[first])
            known[known] = same_bytes(text, begin[order[known]], begin[first[known]], size[order[known]])
            x = e[order[known]]
            spans = np.zeros(len(x), SPAN)
            spans["doc"], spans["uid"], spans["start"] = x["doc"], x["uid"], x["first"]
            spans["end"] = spans["start"] + x["windows"] + LENGTH - 1
            rows = [(int(spans["uid"][0]) % shards, 1, spans.tobytes())] if len(spans) else []
            at = order[~known]
            to = (token[at] % np.uint64(shards)).astype(np.int64)
            inner = np.lexsort((token[at], to))
            at, to = at[inner], to[inner]
            starts = _text.runs(to)
            for s, z in zip(starts, np.append(starts[1:], len(to)), strict=False):
                own = at[s:z]
                ends = np.cumsum(size[own])
                pick = np.arange(ends[-1]) - np.repeat(ends - size[own] - begin[own], size[own])
                rows.append((int(to[s]), 0, np.int64(len(own)).tobytes() + packer.compress(pack(e[own], text[pick]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                ["shard", "kind", "payload"],
            )
            del e, content, token, text, rows
            _text.release()

    return run


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, uid, spans) of the repeated byte ranges of a shard's documents, packed as pairs of start and end."""
    spans = [np.frombuffer(p, SPAN) for p in group.loc[group["kind"] == 1, "payload"]]
    entries, texts = [np.zeros(0, ENTRY)], [np.zeros(0, np.uint8)]
    for p in group.loc[group["kind"] == 0, "payload"]:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        raw = zstandard.ZstdDecompressor().decompress(p[8:])
        own, part = unpack(raw, n)
        entries.append(own)
        texts.append(part)
    e, text = np.concatenate(entries), np.concatenate(texts)
    if len(e):
        size = e["windows"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        # one neighbourhood stands for all equal ones
        content = _text.hash_ranges(text, begin, begin + size)
        order = np.lexsort((e["doc"], content))
        start = _text.runs(content[order])
        which = np.empty(len(e), np.int64)
        which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        rep = order[start]
        own = size[rep[which]]
        unlike = np.flatnonzero(own != size)
        equal = np.flatnonzero(own == size)
        unlike = np.concatenate([unlike, equal[~same_bytes(text, begin[equal], begin[rep[which[equal]]], size[equal])]])
        which[unlike] = len(rep) + np.arange(len(unlike))
        rep = np.concatenate([rep, unlike])
        own = size[rep]
        base = np.cumsum(own) - own
        joined = text[np.arange(own.sum()) - np.repeat(base - begin[rep], own)]
        count = e["windows"][rep].astype(np.int64)
        offset = np.cumsum(count) - count
        at = np.arange(count.sum()) - np.repeat(offset - base, count)
        least = least_owner(joined, at, np.repeat(e["doc"][rep], count))
        # back to every occurrence
        windows = e["windows"].astype(np.int64)
        ends = np.cumsum(windows)
        within = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
        row = np.repeat(np.arange(len(e)), windows)
        gone = least[offset[which[row]] + within] < e["doc"][row]
        if gone.any():
            head = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])
            tail = gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])
            s, z = np.flatnonzero(head), np.flatnonzero(tail)
            found = np.zeros(len(s), SPAN)
            found["doc"], found["uid"], found["start"] = e["doc"][row[s]], e["uid"][row[s]], e["first"][row[s]] + within[s]
            found["end"] = e["first"][row[z]] + within[z] + LENGTH
            spans.append(found)
    out = np.concatenate(spans) if spans else np.zeros(0, SPAN)
    order = np.lexsort((out["start"], out["uid"], out["doc"]))
    out = out[order]
    # join what overlaps, so that a document's rows from this shard are few
    new = np.ones(len(out), bool)
    new[1:] = (out["uid"][1:] != out["uid"][:-1]) | (out["doc"][1:] != out["doc"][:-1])
    reach = new.copy()
    reach[1:] |= out["start"][1:] > out["end"][:-1]
    starts = np.flatnonzero(reach)
    end = np.maximum.reduceat(out["end"], starts) if len(starts) else out["end"]
    pairs = np.stack([out["start"][starts], end], 1)
    heads = np.flatnonzero(new[starts])
    tails = np.append(heads[1:], len(starts))[: len(heads)]
    _text.release()
    first = out[starts[heads]]
    return pd.DataFrame({"doc_id": first["doc"], "uid": first["uid"], "spans": [pairs[a:z].tobytes() for a, z in zip(heads, tails, strict=True)]})


def union(pairs: np.ndarray) -> np.ndarray:
    """Overlapping and adjacent (start, end) rows as maximal runs, in order."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0])]
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[head, 0], reach[np.append(head[1:], len(pairs)) - 1]], 1)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, uid): rows whose whole text a row of smaller doc_id has; ``docs`` holds two hashes uid, t2 of the text."""
    ids = with_least(stored(docs.select("doc_id", "uid", "t2")), ["uid", "t2"], "doc_id", "first")
    return ids.where(F.col("doc_id") > F.col("first")).select("doc_id", "uid").distinct()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, spans): byte ranges to remove, for ``docs`` (doc_id, uid, text, t2) with two hashes uid, t2 of the text.

    A copy of a whole text has the one range from 0 to 2**62.
    """
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, math.ceil(total / BUCKET_BYTES))
    keys = ["doc_id", "uid"]
    sent = _send(docs, buckets)
    shared = sent.groupBy("bucket").applyInPandas(count_classes, sent.schema).groupBy("batch").applyInPandas(_shared, "doc_id long, uid long, tokens binary")
    whole = stored(copies(docs))
    shared = stored(shared.groupBy(*keys).agg(F.first("tokens").alias("tokens")).join(whole, keys, "left_anti"))
    shards = max(12, math.ceil(total / SHARD_BYTES))
    cut = docs.join(shared, keys).select("uid", "doc_id", "text", "tokens").mapInArrow(_cut(shards), "shard int, kind int, payload binary")
    spans = cut.groupBy("shard").applyInPandas(_solve, "doc_id long, uid long, spans binary")
    found = spans.groupBy(*keys).agg(F.collect_list("spans").alias("spans"))
    everything = F.lit(np.array([0, 1 << 62], np.int64).tobytes())
    out = stored(found.unionByName(whole.select(*keys, F.array(everything).alias("spans"))))
    discard(shared, whole)
    return out


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs) of each text.

    Texts count as UTF-8 bytes, null as empty; what is kept need not be valid UTF-8. Rows of one doc_id don't repeat
    each other; rows without doc_id stay whole and count for none. Columns of the added names are replaced, all others may
    have any name.
    """
    added = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    base = docs.drop(*(f.name for f in added))
    doc, uid, doc_side, uid_side, spans = fresh(base.columns, "doc", "uid", "doc_side", "uid_side", "spans")
    keyed = base.withColumn(doc, F.col("doc_id").cast("long")).withColumn(uid, F.xxhash64(text))
    source = keyed.where(F.col(doc).isNotNull() & (F.octet_length(text) >= LENGTH)).select(
        F.col(doc).alias("doc_id"), F.col(uid).alias("uid"), F.col(text).alias("text"), F.xxhash64(F.lit(7), text).alias("t2")
    )
    side = repeated_spans(source).toDF(doc_side, uid_side, spans)
    joined = keyed.join(side, (F.col(doc) == F.col(doc_side)) & (F.col(uid) == F.col(uid_side)), "left").select(*base.columns, spans)
    at, width = base.columns.index(text), len(base.columns)
    schema = T.StructType([*base.schema.fields, *added])

    def run(batches):
        for b in batches:
            buf, offs = _text.buffers(b.column(at))
            kept, n_bytes, removed, counts = [], [], [], []
            for r, spans in enumerate(b.column(width)):
                raw = buf[offs[r] : offs[r + 1]].tobytes()
                gone = union(np.frombuffer(b"".join(spans.as_py() or ()), np.int64).reshape(-1, 2)).tolist()
                out, last = [], 0
                for a, z in gone:
                    out.append(raw[last:a])
                    last = z
                out.append(raw[last:])
                kept.append(b"".join(out))
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                counts.append(len(gone))
            new = [pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*list(b.columns)[:-1], *new], [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT row, doc_id, b, substr(h, b * 4000 + 1, 4098) AS h FROM d, unnest(range(0, length(h) // 4000 + 1)) t(b)),
win AS (SELECT row, doc_id, b * 2000 + i AS i, substr(h, 2 * i + 1, 100) AS w FROM c, unnest(range(0, least(2000, length(h) // 2 - 49))) t(i) WHERE doc_id IS NOT NULL),
least_ AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
hit AS (SELECT row, i, i > lag(i) OVER (PARTITION BY row ORDER BY i) + 50 AS gap FROM win JOIN least_ USING (w) WHERE first < doc_id),
run AS (SELECT row, i, count(*) FILTER (WHERE gap) OVER (PARTITION BY row ORDER BY i) AS g FROM hit),
span AS (SELECT row, g, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY row, g),
part AS (SELECT row, a, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS last FROM span),
kept AS (SELECT row, count(*) AS n, sum(z - a) AS removed, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k FROM part JOIN d USING (row) GROUP BY row)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (row)
"""
