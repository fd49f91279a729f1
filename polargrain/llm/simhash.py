"""Near-duplicate documents by 64-bit SimHash and a Gray-order hierarchical index.

Fingerprints come from word shingles (A-Z lowered, words split at ASCII white space, joined
by one space; XXH64 with seed 42; a bit is set if set in over half of the hashes). Equal
fingerprints are one node. Nodes that differ in at most ``radius`` bits are linked:

* Distribution: the 64 bits are cut into ``radius + 2`` blocks; two linked fingerprints agree
  on at least two blocks, so they meet under the key of one of the block pairs. Keys that
  too many fingerprints share are dealt anew by longer keys.
* Index: within a key, fingerprints are sorted by Gray rank (neighbours differ in few bits),
  every eight consecutive nodes get a parent that holds the bit pattern they share, and a
  node keeps only the shared bits that its parent does not hold. A search walks down from
  the top, adds up differing bits node by node and drops a whole group once the sum exceeds
  the radius; a group whose open bits cannot exceed the radius any more is linked as a whole.
* Only a spanning forest of each key's links leaves a task; connected components of these
  edges are found by distributed rounds, so no pair is lost and no group's pairs are listed.

A key's group holds distinct fingerprints only (8 bytes each), whatever number of documents
share them; copies never meet in one task but for an id join that adaptive execution splits.

Defined results: null text counts as empty; texts without words have fingerprint zero, which
links like any other; fewer words than a shingle are one shingle; null doc_ids never name a
component unless it has no other; repeated rows are returned each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.chunks import slices
from polargrain.llm.common import cut, release, table
from polargrain.llm.components import components

FAN = 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: list[str | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - shingle + 1)
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]
        counts[k] = n
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = np.array(hashes, np.uint64)
    begins = np.concatenate([[0], np.cumsum(counts[some])])
    set_bits = np.zeros((len(some), 64), np.int64)
    for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
        for c in range(a, b, 1 << 16):
            bits = np.unpackbits(flat[c : min(b, c + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits[k] += bits.sum(0, dtype=np.int64)
    over = set_bits * 2 > counts[some][:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over groups of fingerprints; ``codes`` sorted by (group, Gray rank)."""

    def __init__(self, codes: np.ndarray, group_starts: np.ndarray):
        self.codes = codes
        sizes = np.diff(np.append(group_starts, len(codes)))
        # per level from the leaves: first leaf of every node, and first node of every group
        firsts, heads = [np.arange(len(codes))], [group_starts.astype(np.int64)]
        while sizes.max() > 1:
            parents = -(-sizes // FAN)
            head = np.concatenate([[0], np.cumsum(parents)[:-1]])
            group = np.repeat(np.arange(len(sizes)), parents)
            child = heads[-1][group] + (np.arange(parents.sum()) - head[group]) * FAN
            firsts.append(firsts[-1][child])
            heads.append(head)
            sizes = parents
        self.levels = []
        above = None
        for k in range(len(firsts) - 1, -1, -1):
            first = firsts[k]
            low, high = np.bitwise_and.reduceat(codes, first), np.bitwise_or.reduceat(codes, first)
            mask = ~(low ^ high)
            last = np.append(first[1:], len(codes))
            if above is None:
                residual = mask
                children = None
            else:
                parent = np.searchsorted(above, first, "right") - 1
                residual = mask & ~self.levels[-1]["mask"][parent]
                children = np.searchsorted(first, np.append(above, len(codes)), "left")
                self.levels[-1]["children"] = children
            self.levels.append({"first": first, "last": last, "mask": mask, "pattern": low & mask, "residual": residual, "open": 64 - np.bitwise_count(mask).astype(np.int64)})
            above = first
        self.top = np.repeat(np.arange(len(group_starts)), np.diff(np.append(group_starts, len(codes))))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query leaf, first leaf, last leaf) of linked groups that lie after the query."""
        q, node = queries, self.top[queries]
        spent = np.zeros(len(q), np.int64)
        for depth, level in enumerate(self.levels):
            spent = spent + np.bitwise_count((self.codes[q] ^ level["pattern"][node]) & level["residual"][node])
            keep = (spent <= radius) & (level["last"][node] - 1 > q)
            whole = keep & (spent + level["open"][node] <= radius)
            if whole.any():
                yield q[whole], np.maximum(level["first"][node[whole]], q[whole] + 1), level["last"][node[whole]]
            keep &= ~whole
            q, node, spent = q[keep], node[keep], spent[keep]
            if depth + 1 == len(self.levels) or not len(q):
                return
            a, b = level["children"][node], level["children"][node + 1]
            n = b - a
            begins = np.concatenate([[0], np.cumsum(n)[:-1]])
            node = np.repeat(a - begins, n) + np.arange(n.sum())
            q, spent = np.repeat(q, n), np.repeat(spent, n)


def forest(codes: np.ndarray, group_starts: np.ndarray, radius: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers (a, b): for every linked leaf an edge to the least leaf linked with it, group by group."""
    index, root = GrayIndex(codes, group_starts), np.arange(len(codes))
    sizes = np.diff(np.append(group_starts, len(codes)))
    queries = np.flatnonzero(np.repeat(sizes > 1, sizes))
    for c in range(0, len(queries), chunk):
        links = []
        for q, a, b in index.search(queries[c : c + chunk], radius):
            n = b - a
            begins = np.concatenate([[0], np.cumsum(n)[:-1]])
            links.append((np.repeat(q, n), np.repeat(a - begins, n) + np.arange(n.sum())))
        if links:
            left, right = (np.concatenate(x) for x in zip(*links, strict=True))
            while True:
                x, y = root[left], root[right]
                differ = x != y
                if not differ.any():
                    break
                left, right, x, y = left[differ], right[differ], x[differ], y[differ]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
    linked = np.flatnonzero(root != np.arange(len(codes)))
    return linked, root[linked]


def block_keys(fp: str, radius: int, blocks: int) -> F.Column:
    """Array of keys: for each choice of ``blocks - radius`` blocks its number and its bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[k + 1]) - 1) & ~((1 << cuts[k]) - 1) for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def fingerprint_documents(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for held in slices(rows, lambda r: len(r[1] or ""), 1_000_000):
                fps = fingerprints([t for _, t in held], shingle)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _keyed(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    return fps.select("fp", F.explode(block_keys("fp", radius, blocks)).alias("k")).select("k.choice", "k.bits", "fp")


def _linked(keyed: DataFrame, radius: int, block: int = 200_000) -> DataFrame:
    """Spanning edges (a, b) of the links within each key's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def links(rows: np.ndarray) -> pa.RecordBatch:
            codes = rows[2].view(np.uint64)
            change = np.ones(len(codes), bool)
            change[1:] = (np.diff(rows[0]) != 0) | (rows[1][1:] != rows[1][:-1])
            group = np.cumsum(change) - 1
            several = np.bincount(group)[group] > 1
            codes, group = codes[several], group[several]
            if len(codes):
                order = np.lexsort((gray_rank(codes), group))
                codes, group = codes[order], group[order]
                starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
                a, b = forest(codes, starts, radius)
                a, b = codes[a].view(np.int64), codes[b].view(np.int64)
            else:
                a = b = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)]))
            size += batch.num_rows
            if size >= block:
                rows = np.concatenate(held, 1)
                edge = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
                if len(edge):  # whole groups leave, the last stays for its other rows
                    at = int(edge[-1]) + 1
                    yield links(rows[:, :at])
                    rows = rows[:, at:]
                held, size = [rows], rows.shape[1]
        if size:
            yield links(np.concatenate(held, 1))

    return keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(run, "a long, b long")


def link_fingerprints(fps: DataFrame, radius: int = 2, hot: int = 500_000) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` within ``radius`` bits, directly or by others.

    Keys with over ``hot`` fingerprints are not searched as one group: their fingerprints are
    keyed anew by more and longer choices of blocks, which find every link among them, until no
    key is crowded (a key of all blocks but ``radius`` holds 2 ** (64 * radius / blocks) at most).
    """
    blocks, found = radius + 2, None
    while True:
        keyed = _keyed(fps, radius, blocks)
        crowded = keyed.groupBy("choice", "bits").count().filter(F.col("count") > hot).select("choice", "bits")
        last = blocks >= 8 * radius or crowded.isEmpty()
        if not last:
            crowded = cut(crowded, "crowded-keys")
            apart = keyed.join(crowded, ["choice", "bits"], "left_anti").select("choice", "bits", "fp")
            fps = cut(keyed.join(crowded, ["choice", "bits"], "left_semi").select("fp").distinct(), "crowded-codes")
        links = _linked(keyed if last else apart, radius)
        found = links if found is None else found.unionByName(links)
        if last:
            return found
        blocks += 2


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, hot: int = 500_000) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id of its component)."""
    marked = cut(fingerprint_documents(docs, shingle), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    tree = components(link_fingerprints(nodes.select("fp"), radius, hot))
    member = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    named = member.join(nodes.withColumnRenamed("fp", "node"), "node")
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    linked = named.join(heads, "root").select(F.col("node").alias("fp"), "head")
    classes = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id")), "classes")
    release(nodes, tree)
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names their component.

    A doc_id identifies a document: rows that repeat one stay or go together.
    """
    heads = near_duplicates(docs, shingle, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__head"))
    return docs.join(heads, docs["doc_id"].eqNullSafe(heads["__head"]), "left_semi")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
