"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, slot consistency."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._store import bounded_batches, few_files

WINDOW = 8
MIN_LITERALS = 5
MIN_SHORT = 4
MIN_WINDOWS = 6
MIN_SHARE = 0.5
FILTER_BITS = 1 << 24
MAX_FILTER_BITS = 1 << 30
STEP = 1 << 18

#: Number words and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty sixty hundred thousand million billion"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres kmh mph"
)

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_UPPER = (_B >= 65) & (_B <= 90)
_WORD = _DIGIT | _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 0x80)
_STOP = np.isin(_B, [ord(c) for c in ".!?\n:;"])
_EXACT = np.uint64(0x6A09E667F3BCC909)
_CHECK = np.uint64(0xBB67AE8584CAA73B)


def _hash_words(words: str) -> np.ndarray:
    rows = words.split()
    buf = np.frombuffer(" ".join(rows).encode(), np.uint8)
    return np.sort(_text.word_hashes(buf, np.array([0, len(buf)]))[2])


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _wide(buf: np.ndarray, word: np.ndarray, edge: np.ndarray) -> None:
    """Mark the bounds of Han, Kana, Thai, Lao, Burmese, Khmer and full-width characters in ``edge``; clear ``word`` at punctuation."""
    lead = np.flatnonzero(buf >= 0xC2)
    if not len(lead):
        return
    a, b = buf[lead], buf[np.minimum(lead + 1, len(buf) - 1)]
    marks = (a == 0xC2) | (((a == 0xE2) | (a == 0xE3)) & (b == 0x80))
    for k in range(3):
        word[lead[marks & ((k < 2) | (a != 0xC2))] + k] = False
    alone = ((a >= 0xE3) & (a <= 0xE9) & ~marks) | ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xEF) & ((b == 0xBC) | (b == 0xBD)))
    alone |= ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F))) | ((a == 0xF0) & (b >= 0xA0))
    edge[lead[alone]] = True
    edge[lead[alone] + np.where(a[alone] == 0xF0, 4, 3)] = True


def tokens(buf: np.ndarray, offs: np.ndarray, quoted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, kind, hash) of the tokens of a block of texts.

    A token is a run of letters, digits and non-ASCII bytes; a point or comma between digits belongs to it. Characters of
    scripts without spaces are a token each; typographic quotes, dashes and spaces belong to none. A token is a
    number if it begins with a digit or is a number word, a unit if it stands after a number and in ``UNITS``, a name
    if it begins with a single capital and the text before it doesn't end a sentence; the first word of a ``quoted`` text
    doesn't begin one. Hashes ignore ASCII case.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    digit, word = _DIGIT[buf], _WORD[buf]
    mark = ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    word[1:-1] |= mark
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    _wide(buf, word, edge)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offs, start, "right") - 1
    hashed = _text.hash_ranges(_text.LOWER[buf], start, end)
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    before = np.concatenate([[0], end[:-1]]).astype(np.int64)
    new_text = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    opens = np.where(new_text, not quoted, stops[start] > stops[before])
    capital = _UPPER[buf[start]]
    after = buf[np.minimum(start + 1, n - 1)]
    capital |= (buf[start] == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    shouted = _UPPER[after] & (end - start > 1)
    kind = np.zeros(len(start), np.int8)
    kind[capital & ~shouted & ~opens] = NAME
    number = digit[start] | _member(hashed, _hash_words(NUMBER_WORDS))
    kind[number] = NUMBER
    follows = np.concatenate([[False], number[:-1]]) & ~new_text
    kind[follows & _member(hashed, _hash_words(UNITS)) & ~number] = UNIT
    return owner, kind, hashed


def _templates(kind: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Template value of each token: its hash, or the placeholder's."""
    marks = _text.mix(np.arange(1001, 1005, dtype=np.uint64))
    return np.where(kind == LITERAL, hashed, marks[kind])


def _rolled(values: np.ndarray, widths: set[int]):
    """(width, hash of the window at each place), shortest first."""
    p, _ = _text.powers(WINDOW + 2)
    sums = np.zeros(len(values), np.uint64)
    for k in range(min(max(widths, default=0), len(values))):
        with np.errstate(over="ignore"):
            sums = sums[: len(values) - k] + values[k:] * p[k + 1]
            if k + 1 in widths:
                yield k + 1, _text.mix(sums + np.uint64(k + 1))


SCHEMA = "id long, exact boolean, width int, at long, of long, worded boolean, window long, check long, slots array<long>"
FORM = "id long, form binary"


def _rows(ids, exact, owner, kind, hashed, values, at, first, of, worded, window, width):
    """Record batches of the windows at ``at``, whose places count from ``first``; ``check`` is a second hash of the window."""
    p, _ = _text.powers(WINDOW + 2)
    for s in range(0, len(at), 100_000):
        part = at[s : s + 100_000]
        own = owner[part]
        spot = part[:, None] + np.arange(width)
        is_slot = (kind[spot] != LITERAL) & (not exact)
        sizes = np.concatenate([[0], np.cumsum(is_slot.sum(1))]).astype(np.int32)
        slots = pa.ListArray.from_arrays(pa.array(sizes), pa.array(hashed[spot][is_slot].view(np.int64)))
        n = len(part)
        with np.errstate(over="ignore"):
            check = _text.mix((_text.mix(values[spot] + _CHECK) * p[1 : width + 1]).sum(1, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(own)), pa.array(np.full(n, exact)), pa.array(np.full(n, width), pa.int32()), pa.array(part - first[own], pa.int64()), pa.array(of[own], pa.int64()), pa.array(worded[part]), pa.array(window[part].view(np.int64)), pa.array(check.view(np.int64)), slots],
            ["id", "exact", "width", "at", "of", "worded", "window", "check", "slots"],
        )


def _units(owner, kind, hashed):
    """Template tokens: every literal, and every run of slot tokens of one kind as one, whose hash is the run's."""
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] == LITERAL) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    if len(at) == len(kind):
        return owner, kind, hashed
    unit = np.cumsum(first) - 1
    place = (np.arange(len(kind)) - at[unit]).astype(np.uint64)
    with np.errstate(over="ignore"):
        values = np.add.reduceat(np.where(place > 0, _text.mix(hashed + place * _EXACT), hashed), at)
    return owner[at], kind[at], values


def _ways(owner, kind, hashed):
    """(exact, owner, kind, hash, value) of what windows are made of: raw tokens, then template tokens."""
    units = _units(owner, kind, hashed)
    return (True, owner, kind, hashed, _text.mix(hashed ^ _EXACT)), (False, *units, _templates(*units[1:]))


def _forms(items: DataFrame) -> DataFrame:
    """(id, form): a digest of each item's template tokens and of which of its slots are equal; items of one form are alike
    up to the values. Items without slots have none."""

    def run(batches):
        for b in batches:
            buf, offs = _text.buffers(b.column(1))
            forms = []
            for lo, hi in _text.blocks(buf, offs):
                owner, kind, hashed = _units(*tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                values, begin = _templates(kind, hashed), np.searchsorted(owner, np.arange(hi - lo + 1))
                for a, z in zip(begin[:-1], begin[1:], strict=True):
                    slots = hashed[a:z][kind[a:z] != LITERAL]
                    _, first, which = np.unique(slots, return_index=True, return_inverse=True)
                    forms.append(hashlib.blake2b(values[a:z].tobytes() + first[which].astype("<i8").tobytes(), digest_size=16).digest() if len(slots) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.binary())], ["id", "form"])

    return items.select(F.col("item_id").cast("long").alias("id"), "text").mapInArrow(run, FORM)


def _item_windows(items: DataFrame) -> DataFrame:
    """Windows of ``WINDOW`` tokens, a shorter item as one: of raw tokens, and of template tokens where enough are literals.

    Places count from the end of the item. An item that begins with a capital has its first template window a second time,
    with the first word as a name, for documents that quote it inside a sentence. ``items`` (item_id, text, lead): an item
    that doesn't lead its form gives its windows of raw tokens with slots only; the leading one's stand for the rest.
    """

    def windows(exact, owner, kind, hashed, values, n_rows, leads, opening=None):
        begin = np.searchsorted(owner, np.arange(n_rows + 1))
        size = np.diff(begin)
        literal = kind == LITERAL
        if opening is not None:
            literal[begin[:-1][opening]] = True  # as enough as where the word is one
        literal = np.concatenate([[0], np.cumsum(literal)])
        other = np.concatenate([[0], np.cumsum(kind != NUMBER)])
        for width, h in _rolled(values, set(range(1 if exact else MIN_SHORT, WINDOW + 1))):
            n = len(h)
            ok = (owner[:n] == owner[width - 1 :]) & (np.minimum(size, WINDOW)[owner[:n]] == width)
            if not exact:
                ok &= (literal[width:] - literal[:n]) * WINDOW >= MIN_LITERALS * width
            if opening is not None:
                ok &= (np.arange(n) == begin[owner[:n]]) & opening[owner[:n]]
            of = size - width + 1
            if exact:
                slotted = literal[width:] - literal[:n] < width
                ok &= leads[owner[:n]] | slotted
                mine = np.bincount(owner[:n][ok], minlength=n_rows)
                of = np.where(leads, of, mine)
            else:
                ok &= leads[owner[:n]]
            yield exact, owner, kind, hashed, values, np.flatnonzero(ok), begin[1:], of, other[width:] > other[:n], h, width

    def run(batches):
        for b in batches:
            buf, offs = _text.buffers(b.column(1))
            for lo, hi in _text.blocks(buf, offs):
                ids = b.column(0).slice(lo, hi - lo)
                part, cut = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                owner, kind, hashed = tokens(part, cut)
                leads = b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                for way in _ways(owner, kind, hashed):
                    for w in windows(*way, hi - lo, leads):
                        yield from _rows(ids, *w)
                if not len(owner):
                    continue
                inside = tokens(part, cut, quoted=True)[1]
                first = np.searchsorted(owner, np.unique(owner))
                first = first[inside[first] != kind[first]]
                kind[first] = inside[first]
                opening = np.zeros(hi - lo, bool)
                opening[owner[first]] = True
                for w in windows(*_ways(owner, kind, hashed)[1], hi - lo, leads, opening):
                    yield from _rows(ids, *w)

    return items.select(F.col("item_id").cast("long").alias("id"), "text", "lead").mapInArrow(run, SCHEMA)


def _document_windows(docs: DataFrame, widths: dict[bool, set[int]], bits) -> DataFrame:
    """Windows of the widths of each way whose hash is in the filter; a whole short item counts once a text on raw tokens."""

    def run(batches):
        held = bits.value
        mask = np.uint64(8 * len(held) - 1)
        for b in batches:
            buf, offs = _text.buffers(b.column(1))
            for lo, hi in _text.blocks(buf, offs):
                ids = b.column(0).slice(lo, hi - lo)
                for exact, owner, kind, hashed, values in _ways(*tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])):
                    begin = np.searchsorted(owner, np.arange(hi - lo + 1))
                    for width, h in _rolled(values, widths[exact]):
                        n = len(h)
                        bit = (h & mask).astype(np.int64)
                        ok = ((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
                        at = np.flatnonzero(ok & (owner[:n] == owner[width - 1 :]))
                        if exact and width < WINDOW:
                            at = at[np.lexsort((h[at], owner[at]))]
                            new = np.ones(len(at), bool)
                            new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (h[at[1:]] != h[at[:-1]])
                            at = at[new]
                        yield from _rows(ids, exact, owner, kind, hashed, values, at, begin, np.diff(begin), np.ones(n, bool), h, width)

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, SCHEMA)


def _filter(windows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each window hash; ``bits`` is a power of two."""

    def run(batches):
        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            start = _text.runs(at // STEP)
            parts = [(at[a:z] % STEP).astype("<u4").tobytes() for a, z in zip(start, np.append(start[1:], len(at)), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array((at[start] // STEP).astype(np.int32)), pa.array(parts, pa.binary())], ["segment", "bits"])

    def merge(group):
        import pandas as pd

        out = np.zeros(STEP, bool)
        for x in group["bits"]:
            out[np.frombuffer(x, "<u4")] = True
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    parts = windows.select("window").mapInArrow(run, "segment int, bits binary").groupBy("segment").applyInPandas(merge, "segment int, bits binary")
    held = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        held[r["segment"] * STEP // 8 : (r["segment"] + 1) * STEP // 8] = np.frombuffer(r["bits"], np.uint8)
    return held


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, share, kind) of the documents that hold a benchmark item.

    Windows are joined by hash, in two ways: of ``WINDOW`` raw tokens (an item of fewer is one window), and of template
    tokens, at least five eighths literals (an item of 4 to 7 is one); a run of slot tokens of one kind is one. Raw windows tell of verbatim copies of any item;
    those of numbers alone are no evidence. Template windows on one diagonal (same offset between document and
    item) must map each slot value of the item to one of the document, which several may share: that of most windows, its own in
    a tie; windows with another value don't count. A document holds an item if on a diagonal
    ``MIN_WINDOWS`` windows agree, or ``MIN_SHARE`` of the item's, at least one; the diagonal of the largest share is given.
    ``kind`` is ``verbatim`` if all slot values are the item's own and ``reparameterised`` otherwise. Items of equal text
    count as the one of smallest id. Items of one form (the same template, slots equal in the same places) count as the one of
    smallest id too, but for documents that hold another one's own values: its raw windows with slots are indexed as well.
    So a template of many items is joined once. Documents send only windows that pass a filter of 16 bits an item window, 128 MiB
    at most, so what shuffles follows the matches; windows are compared by 128 bits. Null texts and ids match nothing; repeated doc_ids count as one document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    items = items.groupBy("text").agg(F.min("item_id").alias("item_id"))
    forms = _forms(items).withColumn("form", F.coalesce("form", F.col("id").cast("string").cast("binary")))
    lead = forms.groupBy("form").agg(F.min("id").alias("item_id")).select("item_id", F.lit(True).alias("lead"))
    items = items.withColumn("item_id", F.col("item_id").cast("long")).join(lead, "item_id", "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    own = few_files(_item_windows(items), 32 * items.count())
    widths: dict[bool, set[int]] = {True: set(), False: set()}
    for r in own.select("exact", "width").distinct().collect():  # at most WINDOW values each
        widths[r["exact"]].add(r["width"])
    size = min(MAX_FILTER_BITS, max(FILTER_BITS, 1 << (16 * own.count()).bit_length()))
    bits = spark.sparkContext.broadcast(_filter(own, size))
    theirs = _document_windows(docs.where(F.col("doc_id").isNotNull()), widths, bits)
    item = own.select("window", "check", "exact", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "of", "worded")
    hit = theirs.select(F.col("id").alias("doc_id"), "exact", "at", "window", "check", "slots").join(item, ["window", "check", "exact"])
    pairs = F.array_distinct(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")))
    run = ["doc_id", "item_id", "exact", "diagonal"]
    near = hit.select("doc_id", "item_id", "exact", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", F.xxhash64("item_slots").alias("own"), "of", "worded", pairs.alias("pairs"))
    slot = near.repartition(*run).select(*near.columns[:-1], F.explode_outer("pairs").alias("p")).select("*", "p.i", "p.d")
    slot = slot.withColumn("n", F.count("*").over(Window.partitionBy(*run, "i", "d")))
    slot = slot.withColumn("to", F.max(F.struct("n", F.col("i") == F.col("d"), "d")).over(Window.partitionBy(*run, "i"))["d"])
    same = F.coalesce(F.col("i") == F.col("d"), F.lit(True))
    agrees = F.coalesce(F.col("to") == F.col("d"), F.lit(True))
    windows = slot.groupBy(*run, "item_at", "own").agg(F.max("of").alias("of"), F.max("worded").alias("worded"), F.every(same).alias("same"), F.every(agrees).alias("agrees"))
    runs = (
        windows.where("agrees")
        .groupBy(*run)
        .agg(F.count_distinct("item_at").alias("n_windows"), F.max("of").alias("of"), F.max("worded").alias("worded"), F.every("same").alias("verbatim"))
        .where(F.col("worded") | ~F.col("exact"))
        .where((F.col("n_windows") >= MIN_WINDOWS) | (F.col("n_windows") >= MIN_SHARE * F.col("of")))
    )
    best = F.struct((F.col("n_windows") / F.col("of")).alias("share"), "verbatim", "n_windows")
    out = runs.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return out.select(
        "doc_id", "item_id", F.col("b.n_windows").alias("n_windows"), F.col("b.share").alias("share"),
        F.when(F.col("b.verbatim"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
