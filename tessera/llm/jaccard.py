"""N-gram Jaccard join by multiple-global-order filtering, to components of linked documents.

1. Texts become sets of 64-bit shingles; equal sets (by 128-bit signatures) are one class. Batches of texts send their
   shingles, packed and sorted, to buckets; a bucket counts in how many classes each shingle is and returns those of two
   or more. A class of which too few shingles come back can't reach the threshold with any other and is done.
2. Global orders put rare shingles first and break ties by different hashes. Two classes that reach the threshold share
   a shingle of their prefixes under every order. A first round takes only the pairs of a prefix bucket's members with its
   most typical member; the final round takes all pairs of different components. In both, candidates must share prefix
   shingles under all orders before they are verified.
3. Links are joined to components by alternating stars.

Frequent shingles: in the first round their classes are dealt to salted groups with a head each, and the heads meet; in the final
round a shingle of more than ``HOT_ROWS`` classes is left out if one component holds them all, and otherwise its classes are
cut into groups and each pair of groups is a task's share.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._graph import components, with_least, with_value
from tessera.llm._store import bounded_batches, discard, few_files, stored

PERCENT = 75
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
ORDERS = 2
STAR_TOKENS = 6
CHUNK = 1024
HOT_DF = 255
HOT_ROWS = 1 << 16
MAX_HOT = 1 << 20

PART, META, HELD = 0, 1, 2
ENTRY_BYTES = 10


def _planes(token: np.ndarray, owner: np.ndarray) -> bytes:
    """Sorted tokens and their texts' indices as byte planes, high bytes first: what compresses lies together."""
    return token.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() + owner.astype(">u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unplanes(data, n: int, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, indices) of n entries that begin at byte ``at``."""
    token = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T
    owner = np.frombuffer(data, np.uint8, 2 * n, at + 8 * n).reshape(2, n).T
    whole = lambda x, kind: np.ascontiguousarray(x).view(kind).ravel()
    return whole(token, ">u8").astype(np.uint64), whole(owner, ">u2").astype(np.int64)


def needed(n, percent: int = PERCENT):
    """The least overlap of a set of n that reaches the threshold with any other set."""
    return -(-percent * n // 100)


def batch_rows(ids: np.ndarray, valid: np.ndarray, owner: np.ndarray, token: np.ndarray, batch: int, buckets: int, sigs: np.ndarray | None = None, turn: np.ndarray | None = None):
    """The rows a batch of texts sends: (bucket, kind, batch, payload).

    ``token`` are the distinct 64-bit tokens of each text, sorted by text. Texts of one class count once for a token, and only one
    of the batch sends: that of least ``turn``, or the first. A class is a row of ``sigs``, two 64-bit values, or else a set
    of tokens. A bucket gets the classes of the texts it gets tokens of.
    """
    docs = len(ids)
    n = np.bincount(owner, minlength=docs)
    if sigs is None:
        at = np.cumsum(n) - n
        sums = []
        for salt in (0x51ED270B, 0x2545F491):
            total = np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(token ^ np.uint64(salt << 16)))])
            with np.errstate(over="ignore"):
                sums.append(_text.mix(total[at + n] - total[at] + n.astype(np.uint64)))
        sigs = np.stack(sums, 1)
    turn = np.arange(docs) if turn is None else turn
    order = np.lexsort((turn, sigs[:, 1], sigs[:, 0]))
    sends = np.ones(docs, bool)
    sends[order[1:]] = (sigs[order][1:] != sigs[order][:-1]).any(1)
    meta = np.concatenate([ids.view(np.uint64), n.astype(np.uint64), sigs[:, 0], sigs[:, 1], sends.astype(np.uint64), valid.astype(np.uint64), turn.astype(np.int64).view(np.uint64)])
    yield batch % buckets, META, batch, meta.tobytes()
    keep = sends[owner]
    token, owner = token[keep], owner[keep]
    if not len(token):
        return
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    # a shingle of three or more classes of this batch is known to be shared: two entries stand for all
    start = _text.runs(token)
    place = np.arange(len(token)) - np.repeat(start, np.diff(np.append(start, len(token))))
    if (place > 1).any():
        yield batch % buckets, HELD, batch, _planes(token[place > 1], owner[place > 1])
        token, owner = token[place <= 1], owner[place <= 1]
    cut = np.searchsorted(token, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
    for b, (a, z) in enumerate(zip(cut, np.append(cut[1:], len(token)), strict=True)):
        if a < z:
            here = np.unique(owner[a:z])
            yield b, PART, batch, np.array([len(here), z - a], "<u4").tobytes() + here.astype("<u2").tobytes() + sigs[here].tobytes() + _planes(token[a:z], owner[a:z])


def _send(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offs = _text.buffers(b.column(1))
            for lo, hi in _text.blocks(buf, offs, BATCH_BYTES):
                part, cut = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                parts = [_text.shingles(part[cut[a] : cut[z]], cut[a : z + 1] - cut[a], words) for a, z in _text.blocks(part, cut)]
                base = [a for a, _ in _text.blocks(part, cut)]
                owner = np.concatenate([p[0] + s for p, s in zip(parts, base, strict=True)])
                token = np.concatenate([p[1] for p in parts])
                stamp = b.column(2)[lo].as_py()
                digest = hashlib.blake2b(ids[lo:hi].tobytes() + cut.tobytes() + stamp.to_bytes(8, "little", signed=True), digest_size=8).digest()
                rows = list(batch_rows(ids[lo:hi], valid[lo:hi], owner, token, int.from_bytes(digest, "little") >> 1, buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                    ["bucket", "kind", "batch", "payload"],
                )
                del parts, owner, token, rows
                _text.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    return rows.mapInArrow(run, "bucket int, kind int, batch long, payload binary")


def _class_numbers(sigs: np.ndarray) -> np.ndarray:
    """A number for each row of 128-bit signatures, the same for equal rows."""
    order = np.lexsort((sigs[:, 1], sigs[:, 0]))
    out = np.zeros(len(sigs), np.int32)
    out[order[1:]] = np.cumsum((sigs[order][1:] != sigs[order][:-1]).any(1))
    return out


def count_classes(group: pd.DataFrame) -> pd.DataFrame:
    """Return to each batch its shingles that are in two classes or more, with the number of classes (255 at most)."""
    passed = group[group["kind"] != PART]
    own = group[group["kind"] == PART]
    out = [passed]
    if len(own):
        tokens, owners, rows_of, sigs, sizes, base = [], [], [], [], [], 0
        for p in own["payload"]:
            docs, n = (int(x) for x in np.frombuffer(p, "<u4", 2))
            here = np.frombuffer(p, "<u2", docs, 8)
            sigs.append(np.frombuffer(p, np.uint64, 2 * docs, 8 + 2 * docs).reshape(docs, 2))
            token, owner = _unplanes(p, n, 8 + 18 * docs)
            tokens.append(token)
            owners.append(owner.astype(np.uint16))
            rows_of.append((base + np.searchsorted(here, owner)).astype(np.int32))
            sizes.append(n)
            base += docs
        tokens, owners, which = np.concatenate(tokens), np.concatenate(owners), _class_numbers(np.concatenate(sigs))[np.concatenate(rows_of)]
        del rows_of, sigs
        order = np.argsort(tokens)
        start = _text.runs(tokens[order])
        length = np.diff(np.append(start, len(order)))
        many = np.repeat(length > 1, length)
        at = order[many]
        run = np.repeat(np.arange(len(start), dtype=np.int32), length)[many]
        del order, many
        inner = np.lexsort((which[at], run))
        at, run, s = at[inner], run[inner], which[at][inner]
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (s[1:] != s[:-1])]) if len(run) else np.zeros(0, bool)
        classes = np.bincount(run[fresh], minlength=len(start))
        df = np.zeros(len(tokens), np.uint8)
        df[at] = np.minimum(classes[run], 255)
        df[df == 1] = 0
        ends = np.cumsum(sizes)
        rows = []
        for batch, bucket, a, z in zip(own["batch"], own["bucket"], ends - sizes, ends, strict=True):
            hit = df[a:z] > 0
            if hit.any():
                rows.append((bucket, PART, batch, df[a:z][hit].tobytes() + _planes(tokens[a:z][hit], owners[a:z][hit])))
        out.append(pd.DataFrame(rows, columns=["bucket", "kind", "batch", "payload"]))
    _text.release()
    return pd.concat(out).astype({"bucket": "int32", "kind": "int32", "batch": "int64"})


def gathered(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(meta planes, tokens, their texts' indices, their classes) of what came back to a batch."""
    meta = np.frombuffer(group.loc[group["kind"] == META, "payload"].iloc[0], np.uint64).reshape(7, -1)
    tokens, owners, dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for p in group.loc[group["kind"] == PART].sort_values("bucket")["payload"]:
        n = len(p) // (1 + ENTRY_BYTES)
        dfs.append(np.frombuffer(p, np.uint8, n))
        token, owner = _unplanes(p, n, n)
        tokens.append(token)
        owners.append(owner)
    tokens, owners, dfs = np.concatenate(tokens), np.concatenate(owners), np.concatenate(dfs)
    for p in group.loc[group["kind"] == HELD, "payload"]:
        token, owner = _unplanes(p, len(p) // ENTRY_BYTES)
        at = np.minimum(np.searchsorted(tokens, token), max(0, len(tokens) - 1))
        back = tokens[at] == token if len(tokens) else np.zeros(len(token), bool)
        more = dfs[at[back]] if len(dfs) else dfs
        tokens, owners, dfs = np.concatenate([tokens, token[back]]), np.concatenate([owners, owner[back]]), np.concatenate([dfs, more])
    return meta, tokens, owners, dfs


def _gather(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """(doc_id, s1, s2, n, tokens, dfs) of a batch's texts; tokens only where enough of them are shared."""
        meta, token, owner, df = gathered(group)
        ids, n, sends = meta[0].view(np.int64), meta[1].astype(np.int64), meta[4].astype(bool)
        shared = np.bincount(owner, minlength=len(ids))
        alive = sends & (n > 0) & (shared >= needed(n, percent))
        keep = alive[owner]
        owner, token, df = owner[keep], token[keep], df[keep]
        order = np.lexsort((token, owner))
        token, df = token[order], df[order]
        ends = np.cumsum(np.where(alive, shared, 0))
        starts = ends - np.where(alive, shared, 0)
        return pd.DataFrame({
            "doc_id": pd.Series(ids).astype("Int64").mask(meta[5] == 0), "s1": meta[2].view(np.int64), "s2": meta[3].view(np.int64), "n": n,
            "tokens": [token[a:z].tobytes() if ok else None for a, z, ok in zip(starts, ends, alive, strict=True)],
            "dfs": [df[a:z].tobytes() if ok else None for a, z, ok in zip(starts, ends, alive, strict=True)],
        })

    return run


def prefix(n: int, token: np.ndarray, df: np.ndarray, order: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, rest): the shared shingles of a class's prefix under a global order, and how many of its shingles stand
    from each one on. Its unshared shingles come first in every order."""
    room = len(token) - needed(n, percent) + 1
    if room <= 0:
        return token[:0], np.zeros(0, np.int64)
    tie = _text.mix(token ^ np.uint64(order * 0x9E3779B9 + 1))
    own = token[np.lexsort((tie, df))][:room]
    return own, len(token) - np.arange(len(own))


def reachable(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries of one shingle allow the threshold if that shingle is the first the two classes share.

    Then the overlap is at most the shorter rest, and it must be percent / (100 + percent) of both sizes together. A
    pair that reaches the threshold passes at its first common shingle, so a shingle where it fails need not name it.
    """
    rest = np.minimum(x["rest"], y["rest"]).astype(np.int64)
    return ((100 + percent) * rest >= percent * (x["n"].astype(np.int64) + y["n"])) & (x["node"] != y["node"])


ENTRY = np.dtype([("token", "u8"), ("node", "i8"), ("n", "i4"), ("rest", "i4"), ("typical", "f4"), ("label", "i8"), ("cell", "u8"), ("side", "u4")])
_PAIRS = "a long, b long, order int, left binary, right binary"
HEADS = -1


def _salt(node: np.ndarray, salts: int) -> np.ndarray:
    return (_text.mix(node.view(np.uint64)) % np.uint64(salts)).astype(np.int64)


def _entries(token: np.ndarray, **fields) -> np.ndarray:
    e = np.zeros(len(token), ENTRY)
    e["token"] = token
    for name, value in fields.items():
        e[name] = value
    return e


def _to_buckets(entries: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """(bucket, payload): the entries of each order, packed by the bucket of their token and cell; order o has its own buckets."""
    keys, blobs = [], []
    for o, e in enumerate(entries):
        to = (_text.mix(e["token"] + _text.mix(e["cell"])) % np.uint64(buckets)).astype(np.int64)
        at = np.argsort(to, kind="stable")
        e, to = e[at], to[at]
        start = _text.runs(to)
        for s, z in zip(start, np.append(start[1:], len(to)), strict=False):
            keys.append(o * buckets + int(to[s]))
            blobs.append(e[s:z].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "payload"])


def _index(classes: DataFrame, buckets: int, percent: int, star: bool, salts: int = 1, frequent=None) -> DataFrame:
    """(bucket, payload): the entries of the classes' prefixes, packed by bucket.

    First round: of ``STAR_TOKENS`` shingles of one order; a shingle of ``HOT_DF`` classes or more has ``salts`` cells. Final round:
    of ``frequent`` shingles those of one component are left out; the others' entries go to each cell of their group.
    """
    held = classes.sparkSession.sparkContext.broadcast(frequent)

    def spread(e: np.ndarray) -> np.ndarray:
        token, mixed, groups = held.value
        spot = np.minimum(np.searchsorted(token, e["token"]), len(token) - 1)
        big = token[spot] == e["token"]
        out = [e[~big]]
        e, spot = e[big & mixed[spot]], spot[big & mixed[spot]]
        count = groups[spot]
        rows = np.repeat(np.arange(len(e)), count)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        e = e[rows]
        own = (_text.mix(e["node"].view(np.uint64)) % count[rows].astype(np.uint64)).astype(np.int64)
        e["side"] = own
        e["cell"] = 1 + np.minimum(own, other) * count[rows] + np.maximum(own, other)
        return np.concatenate([*out, e])

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            entries: list[list[np.ndarray]] = [[np.zeros(0, ENTRY)] for _ in range(1 if star else ORDERS)]
            for node, n, tokens, dfs, label in zip(*(cols[c] for c in ("node", "n", "tokens", "dfs", "label")), strict=True):
                token, df = np.frombuffer(tokens, np.uint64), np.frombuffer(dfs, np.uint8)
                typical = len(token) / n + df.astype(float).mean() / 256
                for o, into in enumerate(entries):
                    own, rest = prefix(n, token, df, o, percent)
                    if star:
                        pick = np.argsort(_text.mix(own ^ np.uint64(0x5BD1E995)))[:STAR_TOKENS]
                        own, rest = own[pick], rest[pick]
                    into.append(_entries(own, node=node, n=n, typical=typical, label=label, rest=rest))
                    if star and salts > 1:
                        hot = df[np.searchsorted(token, own)] >= HOT_DF
                        into[-1]["cell"] = np.where(hot, 1 + _salt(into[-1]["node"], salts), 0)
            joined = [np.concatenate(e) for e in entries]
            yield _to_buckets([spread(e) if frequent else e for e in joined], buckets)

    return classes.select("node", "n", "tokens", "dfs", "label").mapInArrow(run, "bucket int, payload binary")


def _frequent(classes: DataFrame, count: int, buckets: int, percent: int):
    """(shingles, several components?, groups) of the prefix shingles of more than ``HOT_ROWS`` classes; None if there can't be any.

    Entries are counted where they are and by shingle; the bound is raised with the table, so that at most ``MAX_HOT`` come.
    """
    if count <= HOT_ROWS:
        return None
    kinds = "order int, token long, n long, low long, high long"

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            for o in range(ORDERS):
                tokens, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for n, raw, dfs, label in zip(*(cols[c] for c in ("n", "tokens", "dfs", "label")), strict=True):
                    token, df = np.frombuffer(raw, np.uint64), np.frombuffer(dfs, np.uint8)
                    own, _ = prefix(n, token, df, o, percent)
                    own = own[df[np.searchsorted(token, own)] >= HOT_DF]
                    tokens.append(own)
                    labels.append(np.full(len(own), label))
                token, label = np.concatenate(tokens), np.concatenate(labels)
                at = np.lexsort((label, token))
                token, label = token[at], label[at]
                start = _text.runs(token)
                last = np.append(start[1:], len(token))[: len(start)] - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), o), pa.int32()), pa.array(token[start].view(np.int64)), pa.array(last - start + 1), pa.array(label[start]), pa.array(label[last])],
                    ["order", "token", "n", "low", "high"],
                )

    counted = classes.select("n", "tokens", "dfs", "label").mapInArrow(run, kinds).groupBy("order", "token").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    by = counted.groupBy("token").agg(F.max("n").alias("n"), F.max(F.col("low") != F.col("high")).alias("mixed"))
    by = stored(by.where(F.col("n") > HOT_ROWS))
    bound = max(HOT_ROWS, (by.agg(F.sum("n")).first()[0] or 0) // MAX_HOT)
    by = by.where(F.col("n") > bound)
    rows = by.toPandas()
    if not len(rows):
        return None
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(token)
    return token[at], rows["mixed"].to_numpy(bool)[at], -(-rows["n"].to_numpy(np.int64)[at] // bound)


def _frame(a, b, order: int, left=None, right=None) -> pd.DataFrame:
    left = [None] * len(a) if left is None else left
    return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64), "order": np.full(len(a), order, np.int32), "left": left, "right": [None] * len(a) if right is None else right})


def _cross(x: np.ndarray, y: np.ndarray, percent: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels whose sizes allow the threshold; ``own``: x is y, each pair once.

    In a cell of two groups only pairs across them count: the others belong to the groups' own cells.
    """
    i, j = np.triu_indices(len(x), 1) if own else np.divmod(np.arange(len(x) * len(y)), len(y))
    ok = x["label"][i] != y["label"][j]
    i, j = i[ok], j[ok]
    ok = reachable(x[i], y[j], percent)
    a, b = x["node"][i][ok], y["node"][j][ok]
    return np.minimum(a, b), np.maximum(a, b)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def _to_heads(e: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of each member with the most typical one of its token and cell, entries of those heads)."""
    e = e[np.lexsort((e["node"], -e["typical"], e["cell"], e["token"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["cell"][1:] != e["cell"][:-1])
    start = np.flatnonzero(new)
    head = np.repeat(start, np.diff(np.append(start, len(e))))
    small, large = np.minimum(e["n"], e["n"][head]), np.maximum(e["n"], e["n"][head])
    ok = (100 * small.astype(np.int64) >= percent * large.astype(np.int64)) & (e["node"] != e["node"][head])
    a, b = e["node"][head][ok], e["node"][ok]
    return *_unique_pairs(np.minimum(a, b), np.maximum(a, b)), e[start]


def _first_candidates(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b, heads = _to_heads(np.concatenate([np.frombuffer(p, ENTRY) for p in group["payload"]]), percent)
        heads = heads[heads["cell"] > 0].copy()
        heads["cell"] = 0
        pairs = _frame(a, b, 0)
        return pd.concat([pairs, _frame([0], [0], HEADS, [heads.tobytes()], [None])]) if len(heads) else pairs

    return run


def _candidates(buckets: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = int(group["bucket"].iloc[0]) // buckets
        e = np.concatenate([np.frombuffer(p, ENTRY) for p in group["payload"]])
        e = e[np.lexsort((e["n"], e["label"], e["side"], e["cell"], e["token"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["cell"][1:] != e["cell"][:-1])
        start = np.flatnonzero(new)
        mixed = np.minimum.reduceat(e["label"], start) != np.maximum.reduceat(e["label"], start)
        ends = np.append(start[1:], len(e))[: len(start)]
        pairs_a, pairs_b, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        for s, z in zip(start[mixed], ends[mixed], strict=True):
            middle = s + int(np.searchsorted(e["side"][s:z], e["side"][s], "right"))
            one = middle == z  # else a cell of two groups, of which only pairs across are wanted
            if one and z - s <= CHUNK:
                a, b = _cross(e[s:z], e[s:z], percent, True)
                pairs_a.append(a)
                pairs_b.append(b)
                continue
            for i in range(s, middle, CHUNK):
                x = e[i : min(i + CHUNK, middle)]
                for j in range(i if one else middle, z, CHUNK):
                    y = e[j : min(j + CHUNK, z)]
                    labels = {int(x["label"][0]), int(x["label"][-1]), int(y["label"][0]), int(y["label"][-1])}  # each chunk is sorted by label
                    apart = max(int(x["n"].min()), int(y["n"].min())) * percent > 100 * min(int(x["n"].max()), int(y["n"].max()))
                    if len(labels) > 1 and not apart:
                        left.append(x.tobytes())
                        right.append(y.tobytes() if j != i else None)
        a, b = _unique_pairs(np.concatenate(pairs_a), np.concatenate(pairs_b))
        whole = _frame(a, b, order)
        return pd.concat([whole, _frame([0] * len(left), [0] * len(left), order, left, right)]) if left else whole

    return run


def _expand(percent: int):
    """Turn rows that stand for two chunks of a long bucket into pairs."""

    def run(batches):
        for b in batches:
            yield b.filter(b.column(3).is_null()).select([0, 1, 2])
            chunks = b.filter(b.column(3).is_valid()).to_pydict()
            for order, x, y in zip(chunks["order"], chunks["left"], chunks["right"], strict=True):
                x = np.frombuffer(x, ENTRY)
                pa_, pb_ = _cross(x, x if y is None else np.frombuffer(y, ENTRY), percent, y is None)
                for s in range(0, len(pa_), 1 << 16):
                    cut = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(pa_[cut]), pa.array(pb_[cut]), pa.array(np.full(len(pa_[cut]), order), pa.int32())], ["a", "b", "order"])

    return run


def _first_pairs(classes: DataFrame, buckets: int, percent: int, salts: int) -> DataFrame:
    """(a, b): each prefix shingle's classes with its most typical one, or with that of their cell, and those with theirs."""
    made = _index(classes, buckets, percent, True, salts).groupBy("bucket").applyInPandas(_first_candidates(percent), _PAIRS)
    if salts > 1:
        made = stored(made)
        regroup = lambda batches: (_to_buckets([np.frombuffer(p, ENTRY)], buckets) for b in batches for p in b.column(0).to_pylist())
        heads = made.where(F.col("order") == HEADS).select("left").mapInArrow(regroup, "bucket int, payload binary")
        made = made.unionByName(heads.groupBy("bucket").applyInPandas(_first_candidates(percent), _PAIRS))
    return made.where(F.col("order") != HEADS).select("a", "b").distinct()


def _pairs(classes: DataFrame, count: int, buckets: int, percent: int) -> DataFrame:
    """(a, b): pairs of different labels that are candidates under every order."""
    frequent = _frequent(classes, count, buckets, percent)
    made = _index(classes, buckets, percent, False, 1, frequent).groupBy("bucket").applyInPandas(_candidates(buckets, percent), _PAIRS)
    # a long bucket's chunk pairs are dealt out again: its task only lists them
    pairs = made.repartition(buckets).mapInArrow(_expand(percent), "a long, b long, order int")
    found = pairs.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, order)")).alias("orders"))
    return found.where(F.col("orders") == ((1 << ORDERS) - 1)).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, percent: int, intersect: bool) -> DataFrame:
    """(u, v) of the pairs that reach the threshold, over whole sets; with ``intersect`` only of those that share prefix
    shingles under every order, which pairs that reach it do."""
    columns = ["node", "n", "tokens", "dfs"]
    side = lambda x: classes.select(*(F.col(c).alias(f"{c}_{x}") for c in columns)).withColumnRenamed(f"node_{x}", x)

    def run(batches):
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in b.schema.names}
            held: dict[int, list[np.ndarray]] = {}

            def prefixes(node, n, tokens, dfs, held=held):
                if node not in held:
                    token, df = np.frombuffer(tokens, np.uint64), np.frombuffer(dfs, np.uint8)
                    held[node] = [np.sort(prefix(n, token, df, o, percent)[0]) for o in range(ORDERS)]
                return held[node]

            meet = lambda x, y: y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
            ok = []
            for k in range(len(c["a"])):
                (na, ta, da), (nb, tb, db) = ((c[f"n_{x}"][k], c[f"tokens_{x}"][k], c[f"dfs_{x}"][k]) for x in "ab")
                if intersect and not all(meet(x, y).any() for x, y in zip(prefixes(c["a"][k], na, ta, da), prefixes(c["b"][k], nb, tb, db), strict=True)):
                    ok.append(False)
                    continue
                common = int(meet(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)).sum())
                ok.append(100 * common >= percent * (na + nb - common))
            kept = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["u", "v"])

    names = [f"{c}_{x}" for x in "ab" for c in columns[1:]]
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *names).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = _text.SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Sets: distinct shingles of ``words`` words (runs of non-space, A-Z lower-cased); fewer words make one shingle, none
    (null, empty or blank text) an empty set that is linked with nothing. Documents link when the intersection is at
    least ``percent`` hundredths of the union; ``component_id`` is the smallest doc_id reachable. All links count: equal
    sets are one class, the first round only spares pairs of classes already connected. Shingles are compared by
    64-bit hashes (see ``_text.shingles`` for the chance of error), classes by 128 bits. Rows without doc_id keep null as
    component. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, math.ceil(total / BUCKET_BYTES))
    sent = _send(docs, buckets, words)
    returned = sent.groupBy("bucket").applyInPandas(count_classes, sent.schema)
    table = stored(returned.groupBy("batch").applyInPandas(_gather(percent), "doc_id long, s1 long, s2 long, n long, tokens binary, dfs binary"))

    alive = table.where(F.col("tokens").isNotNull()).groupBy("s1", "s2").agg(F.min_by(F.struct("n", "tokens", "dfs"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("x"))
    classes = stored(alive.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "x.n", "x.tokens", "x.dfs"))  # numbers are fixed once stored
    count = classes.count()
    first = _first_pairs(classes.withColumn("label", F.col("node")), buckets, percent, max(1, min(count // HOT_ROWS, HOT_ROWS)))
    star = few_files(verified(first, classes, percent, True), count)
    labels = components(star, rows=count)
    relabelled = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = verified(_pairs(relabelled, count, buckets, percent), classes, percent, False)
    final = components(star.unionByName(rest), rows=count)
    discard(star, labels)

    # least ids by class, then by component, then back to the rows; hot classes and components stay where they are
    sigs = ["s1", "s2"]
    per_class = table.groupBy(*sigs).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    n = table.count()
    labelled = few_files(per_class.join(classes.select("node", *sigs).join(final, "node"), sigs, "left").select(*sigs, "least", "rows", "label"), n)
    least = with_least(labelled, ["label"], "least", "first").select(*sigs, "rows", F.coalesce("first", "least").alias("first"))
    least = few_files(least, n)
    discard(classes, labelled, final)
    out = with_value(table.select("doc_id", "n", *sigs), sigs, least, "first", "rows")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op10_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT row, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
both_ AS (SELECT a.row AS x, b.row AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.row < b.row GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.row = x JOIN n q ON q.row = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(o.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (row) LEFT JOIN reach ON reach.x = w.row LEFT JOIN w o ON o.row = reach.y GROUP BY w.row, w.doc_id
"""
