"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.common import cut, release


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges' nodes but the roots."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, left, right = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    while True:
        x, y = root[left], root[right]
        differ = x != y
        if not differ.any():
            break
        left, right, x, y = left[differ], right[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _joined(edges: DataFrame) -> DataFrame:
    """``edges`` as stars, joined in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(c).astype(np.int64) for c in batch.columns] for batch in batches]
        if held:
            node, root = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    return edges.coalesce(1).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots; a root is its component's least node.

    Every round rewrites the edges in two aggregations and two joins and is cut to the shared
    folder; rounds grow with the logarithm of the longest shortest path. Up to ``few`` edges (16
    bytes each) are joined in one task instead, which needs no rounds. Loops and repeated edges
    do no harm; no edges give no rows.
    """
    e = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut(e if few else e.distinct(), "edges")
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        if before[0] <= few:
            held, e = e, cut(_joined(e), "edges")
            release(held)
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        held, e = e, cut(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        release(held)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tree = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tree.cut_path = e.cut_path
    return tree
