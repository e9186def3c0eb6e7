"""Connected components: parts of the edges are contracted where they are, then large-star and small-star steps join them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import discard, few_files, stored

PART_EDGES = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each) of the edges (u, v)."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, step := label[label]):
            label = step
    return nodes, nodes[label]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): each part's nodes with the root they have in that part."""

    def run(batches):
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            us.append(b.column(0).to_numpy())
            vs.append(b.column(1).to_numpy())
        nodes, roots = contract(np.concatenate(us), np.concatenate(vs))
        for s in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + (1 << 16)]), pa.array(roots[s : s + (1 << 16)])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v). Large star: neighbours above u move to u's least one; small star: those below u do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where(F.col("v") <= F.col("u"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    moved = seen.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).dropDuplicates()


def components(edges: DataFrame, part_edges: int = PART_EDGES, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v) with an edge to another; the label is the component's least node.

    Edges are dealt to parts of about ``part_edges`` rows, whatever their nodes, and a part is contracted to a star for each
    of its components. With one part that is all. Otherwise star steps follow: each round halves the depth of the trees at
    least. ``rows``: about how many edges, if known, for the files they are put in. A hub's edges stay spread: its least neighbour is a partial aggregate, joined back under adaptive skew handling.
    """
    now = edges.where(F.col("u") != F.col("v")).select("u", "v")
    now = stored(now) if rows is None else few_files(now, rows)
    parts = math.ceil(now.count() / part_edges)
    if parts <= 1:
        out = stored(_contracted(now.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("label")))
        discard(now)
        return out
    last, now = now, stored(_contracted(now.repartition(parts)).where(F.col("u") != F.col("v")))
    discard(last)
    check = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    mark = check(now)
    for _ in range(max_rounds):
        last, now = now, stored(_stars(_stars(now, True), False))
        discard(last)
        new = check(now)
        if (new["n"], new["s"]) == (mark["n"], mark["s"]):
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def with_value(rows: DataFrame, keys: list[str], values: DataFrame, out: str, count: str) -> DataFrame:
    """``rows`` with ``out`` of ``values`` (keys, out, count: rows of that key); both are stored tables, null keys match nothing.

    Keys of more than a thousandth of the rows number under a thousand, so they are broadcast and their rows stay where
    they are; the rest is joined by key, and no task of that join gets more than such a share of one key.
    """
    cut = max(1000, rows.count() // 1000)
    hot = values.where(F.col(count) > cut).select(*keys, out, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where(F.col("_hot").isNull()).drop(out, "_hot").join(values.where(F.col(count) <= cut).drop(count), keys, "left")
    return marked.where(F.col("_hot")).drop("_hot").select(cold.columns).unionByName(cold)


def with_least(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``rows`` (a stored table) with the least ``value`` of their keys, as ``out``."""
    return with_value(rows, keys, rows.groupBy(*keys).agg(F.min(value).alias(out), F.count("*").alias("_n")), out, "_n")
