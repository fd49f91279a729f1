"""Near copies by exact Jaccard similarity of word shingles, for the corpus pipeline.

Words are those of ``simhash`` (A-Z lowered, split at ASCII white space). Two documents are
linked if the Jaccard similarity of their sets of five-word shingles is at least 4/5, compared
on the words themselves; one document of every connected group stays.

No linked pair is lost. With n shingles in one order that all documents share, linked documents
meet under one of their first ``n - ceil(4 n / 5) + 1`` shingles, and at the first they share
the rest of both must still suffice. The order puts shingles that a bounded sample of documents
finds common last; the sample changes the cost, never the links. Candidates come in two rounds:

* the Gray-order index's forest over SimHash fingerprints, and for every shingle that documents
  meet under an edge from each to a next one; confirmed edges already join most of a group;
* all other pairs that meet, but for those that the first round has joined and those whose
  bitmaps of shingles already differ in more bits than similar sets can. A shingle that very many
  documents meet under is cut into parts, and every two parts are compared in a group of their own.

Defined results: null text counts as empty; texts without words have one empty shingle and so
equal each other; fewer words than a shingle are one shingle; rows that repeat a doc_id stay or
go together; a row with a null doc_id is a document by its text and stays for lack of another
only; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polargrain.llm.bytework import Hasher, mix, runs
from polargrain.llm.chunks import slices
from polargrain.llm.common import cut, release
from polargrain.llm.components import components
from polargrain.llm.simhash import fingerprints, link_fingerprints

STEP = np.uint64(0xD6E8FEB86659FD93)
BITS = 1024
FEW = 250_000  # links that one task joins to groups (4 MB); more take distributed rounds
WORD = np.ones(256, bool)
WORD[list(b" \t\n\r\x0b\x0c")] = False


def shingle_hashes(texts: list[str | None], shingle: int = 5) -> list[np.ndarray]:
    """Distinct shingle hashes of every text, ascending."""
    blobs = [(t or "").encode().lower() for t in texts]
    flat = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    starts, ends = runs(WORD[flat])
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(np.array([len(b) + 1 for b in blobs], np.int64))]))
    words = Hasher(flat)(starts, ends)

    def rolled(at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = out * STEP + words[at + k]
        return mix(out)

    whole = rolled(np.arange(max(0, len(words) - shingle + 1)), shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - shingle + 1] if b - a >= shingle else rolled(np.array([a]), b - a)))
    return out


def _shingles(text: str | None, shingle: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def node_of(doc_id: Column, text: Column) -> Column:
    """The doc_id; for a null one a number over 2 ** 62 made of the text."""
    unnamed = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(doc_id.cast("long"), unnamed)


def _common(texts: DataFrame, shingle: int, sample_docs: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, that several documents of a sample share, and in how many."""
    total = texts.count()
    if total > sample_docs:
        texts = texts.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < int(sample_docs / total * (1 << 40)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in slices(batch.column(0).to_pylist(), lambda t: len(t or ""), 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_hashes(held, shingle)).view(np.int64))], ["h"])

    counted = texts.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    rows = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = np.asarray(rows.column("h")).astype(np.int64).view(np.uint64), np.asarray(rows.column("n")).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(texts: DataFrame, shingle: int, sample_docs: int) -> DataFrame:
    """(h, n, node, at): the first shingles of every document, how many it has, and the place."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle, sample_docs))  # 200,000 rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for held in slices(rows, lambda r: len(r[1] or ""), 1_000_000):
                hs, ns, nodes, ats = [], [], [], []
                for (node, _), h in zip(held, shingle_hashes([t for _, t in held], shingle), strict=True):
                    n = len(h)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        h = h[np.argsort(np.where(common[at] == h, often[at], 0), kind="stable")]
                    k = n - (4 * n + 4) // 5 + 1
                    hs.append(h[:k])
                    ns.append(np.full(k, n, np.int32))
                    nodes.append(np.full(k, node, np.int64))
                    ats.append(np.arange(k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (ns, nodes, ats))], ["h", "n", "node", "at"])

    return texts.mapInArrow(run, "h long, n int, node long, at int")


def _column(values: pa.Array) -> np.ndarray:
    """Longs; bitmaps as one row of words each."""
    if pa.types.is_list(values.type):
        return np.asarray(values.flatten()).view(np.uint64).reshape(len(values), BITS // 64)
    return np.asarray(values).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[list[np.ndarray]]:
    """Columns of about ``block`` rows that hold whole runs of the first column."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([_column(c) for c in batch.columns])
        size += batch.num_rows
        if size >= block:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            edge = np.flatnonzero(np.diff(rows[0]))
            if len(edge):
                at = int(edge[-1]) + 1
                yield [c[:at] for c in rows]
                rows = [c[at:] for c in rows]
            held, size = [rows], len(rows[0])
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _suffice(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that first meet at these places can still be similar."""
    return 9 * np.minimum(n - at, m - to) >= 4 * (n + m)


def _met(firsts: DataFrame, block: int = 200_000) -> DataFrame:
    """(h, n, node, at, mate) of shingles that several documents meet under.

    The mate is the next document in an order drawn anew for every shingle, so that a large
    group's documents get many different ones; it is null where the two cannot be linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node, at in _blocks(batches, block):
            edge = np.diff(h) != 0
            keep = ~np.concatenate([[True], edge]) | ~np.concatenate([edge, [True]])
            h, n, node, at = h[keep], n[keep], node[keep], at[keep]
            order = np.lexsort((mix(node.view(np.uint64) * STEP + h.view(np.uint64)), h))
            h, n, node, at = h[order], n[order], node[order], at[order]
            near = (h[1:] == h[:-1]) & _suffice(n[1:], at[1:], n[:-1], at[:-1])
            mate = pa.array(np.append(node[1:], node[:1]), mask=~np.append(near, np.zeros(len(node[:1]), bool)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (h, n, node, at)), mate], ["h", "n", "node", "at", "mate"])

    return firsts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, n long, node long, at long, mate long")


def _mixed(rooted: DataFrame, block: int = 200_000, small: int = 64) -> DataFrame:
    """Rows of the shingles that documents of several roots meet under.

    Groups of up to ``small`` rows lose the rows that cannot be similar to any other of theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            order = np.lexsort((rows[1], rows[0]))
            h, n, node, at, root = (c[order] for c in rows)
            begin = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0]))
            size = np.diff(np.append(begin, len(h)))
            several = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
            keep = np.repeat(several & (size > small), size)
            few = np.repeat(np.where(several & (size <= small), size, 0), size)
            place = np.arange(len(h)) - np.repeat(begin, size)
            for k in range(1, small):
                x = np.flatnonzero(place + k < few)
                if not len(x):
                    break
                y = x + k
                fits = (root[x] != root[y]) & _suffice(n[x], at[x], n[y], at[y])
                keep[x[fits]] = keep[y[fits]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, n, node, at, root)], ["h", "n", "node", "at", "root"])

    return rooted.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, n long, node long, at long, root long")


def marks(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, n, fp, bits): how many distinct shingles, the SimHash, and ``BITS`` bits of which every shingle flips one.

    Two bitmaps differ in at most as many bits as their sets differ in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for held in slices(rows, lambda r: len(r[1] or ""), 1_000_000):
                hashes = shingle_hashes([t for _, t in held], shingle)
                odd = [np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1 for h in hashes]
                words = np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64)
                bits = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * words.shape[1], words.ravel())
                fps = fingerprints([t for _, t in held]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([len(h) for h in hashes], pa.int32()), pa.array(fps), bits], ["node", "n", "fp", "bits"])

    return texts.mapInArrow(run, "node long, n int, fp long, bits array<long>")


def _dealt(rows: DataFrame, crowd: int) -> DataFrame:
    """Adds u, v and own: a shingle with over ``crowd`` rows is cut into parts, and each pair of parts is a group of its own."""
    sizes = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("parts"))
    large = sizes.filter("parts > 1")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    cut_up = rows.join(large, "h").withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut_up = cut_up.select(*rows.columns, "own", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"))
    whole = rows.join(large, "h", "left_anti").select(*rows.columns, *[F.lit(0).alias(c) for c in ("own", "u", "v")])
    return whole.unionByName(cut_up)


def _pairs(mixed: DataFrame, block: int = 50_000, chunk: int = 250_000, crowd: int = 5_000) -> DataFrame:
    """(a, b) of documents of different roots that meet, whose shingles can still suffice and whose bitmaps agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = BITS // 64
        for g, n, node, at, root, own, u, v, bits in _blocks(batches, block):
            group = np.cumsum(np.concatenate([[0], np.diff(g) != 0]))
            place = (group << 32) + n
            until = np.searchsorted(place, (group << 32) + 5 * n // 4, "right")
            count = until - np.arange(len(g)) - 1
            total = np.concatenate([[0], np.cumsum(count)])
            i = 0
            while i < len(g):
                j = max(i + 1, int(np.searchsorted(total, total[i] + chunk, "right")) - 1)
                x = np.repeat(np.arange(i, j), count[i:j])
                y = np.arange(len(x)) - np.repeat(total[i:j] - total[i], count[i:j]) + x + 1
                fits = (root[x] != root[y]) & _suffice(n[x], at[x], n[y], at[y]) & ((u[x] == v[x]) | (own[x] != own[y]))
                x, y = x[fits], y[fits]
                apart = np.zeros(len(x), np.int64)
                for k in range(words):
                    apart += np.bitwise_count(bits[x, k] ^ bits[y, k])
                near = 9 * apart <= n[x] + n[y]
                x, y = node[x[near]], node[y[near]]
                pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])
                i = j

    keyed = _dealt(mixed, crowd).select(F.xxhash64("h", "u", "v").alias("g"), "h", "n", "node", "at", "root", "own", "u", "v", "bits")
    ordered = keyed.repartition("h", "u", "v").sortWithinPartitions("g", "n", "node").drop("h")
    return ordered.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _plausible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps let them be similar."""
    x = marked.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = marked.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    apart = sum((F.bit_count(F.col("xa")[k].bitwiseXOR(F.col("xb")[k])) for k in range(BITS // 64)), start=F.lit(0))
    sizes = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    return pairs.join(x, "a").join(y, "b").filter(sizes & (9 * apart <= F.col("na") + F.col("nb"))).select("a", "b").distinct()


def _gathered(rows: DataFrame, docs: int) -> DataFrame:
    """``rows`` in at most a task for 5,000 of ``docs`` documents, or two a core: every task's file costs a commit and, on a local disk, several processes."""
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, docs // 5_000))


def _sent(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``ids``, to be sent to all executors while they are few (8 bytes each), so that the texts they are joined to stay where they are."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Only texts of ``pairs`` are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set[bytes]] | None = None
        for part in (batch.slice(k, 100) for batch in batches for k in range(0, batch.num_rows, 100)):
            keep = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                if last is None or last[0] != x:
                    last = (x, _shingles(x, shingle))
                other = _shingles(y, shingle)
                keep.append(9 * len(last[1] & other) >= 4 * (len(last[1]) + len(other)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts.join(_sent(named), "node", "left_semi")
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _first_candidates(marked: DataFrame, nodes: DataFrame, met: DataFrame, radius: int) -> DataFrame:
    """(a, b) of the SimHash forest, of equal fingerprints and of mates; ``nodes`` has the least node of every fingerprint."""
    equal = marked.join(nodes, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    fp = lambda name, to: nodes.select(F.col("fp").alias(name), F.col("least").alias(to))
    close = link_fingerprints(nodes.select("fp"), radius).select(F.col("a").alias("p"), F.col("b").alias("q"))
    close = close.join(fp("p", "a"), "p").join(fp("q", "b"), "q").select("a", "b")
    mates = met.select(F.col("mate").alias("a"), F.col("node").alias("b"))
    both = equal.unionByName(close).unionByName(mates).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def representatives(docs: DataFrame, shingle: int = 5, radius: int = 2, sample_docs: int = 20_000, crowd: int = 5_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the first of its group."""
    texts = docs.select(node_of(F.col("doc_id"), F.col("text")).alias("node"), "text")
    total = texts.count()

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return cut(_gathered(rows, total), name, lean=True)

    met = kept(_met(prefixes(texts, shingle, sample_docs)), "met")
    marked = cut(marks(texts, shingle), "marks", lean=True)
    nodes = kept(marked.groupBy("fp").agg(F.min("node").alias("least")), "nodes")
    pairs = kept(_plausible(_first_candidates(marked, nodes, met, radius), marked), "pairs")
    links = kept(_confirmed(pairs, texts, shingle), "links")
    release(nodes, pairs)
    tree = components(links, few=FEW)
    rooted = met.join(tree, "node", "left").select("h", "n", "node", "at", F.coalesce("root", "node").alias("root"))
    mixed = kept(_mixed(rooted), "mixed")
    release(met, tree)
    pairs = kept(_pairs(mixed.join(marked.select("node", "bits"), "node").select(*mixed.columns, "bits"), crowd=crowd), "pairs")
    release(mixed, marked)
    more = kept(_confirmed(pairs, texts, shingle), "links")
    gone = components(links.unionByName(more), few=FEW).select(F.col("node").alias("__node"))
    release(links, pairs, more)
    return docs.withColumn("__at", node_of(F.col("doc_id"), F.col("text"))).join(_sent(gone), F.col("__at") == F.col("__node"), "left_anti").drop("__at")
