"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item's words (runs of letters, marks and numbers of the lower-cased text, by Unicode
category) give its distinct shingles of ``width`` words (a shorter item is one shingle of all
its words). With n shingles, an item is
contained if at least ``ceil(threshold * n)`` of them occur in the document, so at most
``n - ceil(threshold * n)`` are missing, and any ``n - ceil(threshold * n) + 1`` of them hold
one that occurs. The item's signature is its bottom-k MinHash with that k: items of one size
share one k, no containment at or over the threshold is missed, and most documents hit no
signature. Items are dealt into partitions by size (powers of two); a document is only held
against partitions whose smallest need it can meet with its own number of shingles. Every
candidate pair is then verified by exact shingle containment on the words themselves.

Documents are read once per benchmark block and never shuffled; a block is broadcast with its
size checked (``block_chars`` characters at most, unless one single item is larger), and a
larger benchmark takes several blocks.

Defined results: null or wordless items and documents match nothing; shingles repeated in an
item or a document count once; rows that repeat an id are matched each; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.bytework import Hasher, mix, runs
from polargrain.llm.chunks import slices
from polargrain.llm.common import table

WORD = np.zeros(256, bool)
WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
STEP = np.uint64(0xD6E8FEB86659FD93)
NO_WORD = regex.compile(r"[^\x00-\x7F\p{L}\p{M}\p{N}]+")


def lowered(text: str | None) -> bytes:
    """Lower-cased text in UTF-8; characters beyond ASCII that are no letter, mark or number become spaces."""
    low = (text or "").lower()
    return low.encode() if low.isascii() else NO_WORD.sub(" ", low).encode()


class Words:
    """Words of several texts at once, and hashes of their shingles."""

    def __init__(self, texts: list[str | None]):
        blobs = [lowered(t) for t in texts]
        self.data = b"\n".join(blobs) + b"\n"
        flat = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = runs(WORD[flat])
        borders = np.concatenate([[0], np.cumsum(np.array([len(b) + 1 for b in blobs], np.int64))])
        self.first = np.searchsorted(self.starts, borders)  # first word of every text, and the end
        self.hashes = Hasher(flat)(self.starts, self.ends)

    def shingles(self, width: int) -> np.ndarray:
        """Hash of the shingle that starts at each word; borders of texts are not looked at."""
        n = max(0, len(self.hashes) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * STEP + self.hashes[k : k + n]
        return mix(out)

    def text(self, word: int, width: int) -> bytes:
        return b" ".join(self.data[self.starts[k] : self.ends[k]] for k in range(word, word + width))

    def bounds(self, k: int, width: int) -> tuple[int, int]:
        """The words of text ``k`` at which a shingle of ``width`` starts."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        return a, max(a, b - width + 1)


@dataclass
class Partition:
    """Items of one width and one size class: signature hashes, ascending, and the item of each."""

    width: int
    least_need: int
    signature: np.ndarray
    item: np.ndarray


class Index:
    """Items as arrays: words of all texts, distinct shingle hashes item after item, signatures."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = 5, threshold: str = "0.8"):
        share, words = Fraction(threshold), Words([t for _, t in items])
        self.words = words
        n_words = np.diff(words.first)
        self.numbers = np.flatnonzero(n_words).tolist()  # items with words
        self.ids = [items[k][0] for k in self.numbers]
        self.width_of = [min(width, int(n_words[k])) for k in self.numbers]
        rolled = {w: words.shingles(w) for w in set(self.width_of)}
        self.size, self.need, hashes, parts = [], [], [], {}
        for i, (k, w) in enumerate(zip(self.numbers, self.width_of, strict=True)):
            a, b = words.bounds(k, w)
            hashes.append(np.unique(rolled[w][a:b]))
            # equal hashes of different shingles would only shorten the list, so sizes count shingles
            n = len(hashes[-1]) if len(hashes[-1]) == b - a else len(self.shingles(i))
            self.size.append(n)
            self.need.append(math.ceil(share * n))
            parts.setdefault((w, n.bit_length()), []).append(i)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.begin = np.cumsum([0, *map(len, hashes)])
        self.partitions = []
        for (w, _), members in sorted(parts.items()):
            least = [self.hashes_of(i)[: self.size[i] - self.need[i] + 1] for i in members]
            signature, item = np.concatenate(least), np.repeat(np.array(members, np.int32), [len(h) for h in least])
            order = np.argsort(signature, kind="stable")
            self.partitions.append(Partition(w, min(self.need[i] for i in members), signature[order], item[order]))
        words.hashes = np.zeros(0, np.uint64)  # not needed any more, and broadcast with the rest

    def hashes_of(self, i: int) -> np.ndarray:
        return self.hashes[self.begin[i] : self.begin[i + 1]]

    def shingles(self, i: int) -> set[bytes]:
        w = self.width_of[i]
        return {self.words.text(at, w) for at in range(*self.words.bounds(self.numbers[i], w))}

    def match(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text number, item number, shingles shared) of all contained items."""
        words, found = Words(texts), set()
        rolled = {w: words.shingles(w) for w in {p.width for p in self.partitions}}
        for part in self.partitions:
            hashes = rolled[part.width]
            if not len(hashes):
                continue
            at = np.searchsorted(part.signature, hashes)
            at[at == len(part.signature)] = 0
            for word in np.flatnonzero(part.signature[at] == hashes).tolist():
                k = int(np.searchsorted(words.first, word, "right")) - 1
                a, b = words.bounds(k, part.width)
                if word < b and b - a >= part.least_need:
                    until = int(np.searchsorted(part.signature, hashes[word], "right"))
                    found.update((k, i) for i in part.item[int(at[word]) : until].tolist())
        out, held = [], {}
        for k, i in sorted(found, key=lambda x: (x[1], x[0])):
            if i not in held:
                held = {i: self.shingles(i)}
            w = self.width_of[i]
            a, b = words.bounds(k, w)
            spots = a + np.flatnonzero(np.isin(rolled[w][a:b], self.hashes_of(i)))
            shared = len(held[i].intersection(words.text(s, w) for s in spots.tolist()))
            if shared >= self.need[i]:
                out.append((k, i, shared))
        return out


def blocks(benchmark: DataFrame, width: int, threshold: str, block_chars: int) -> Iterator[Index]:
    """Indexes over the whole benchmark, each of bounded size."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    chars, rows = items.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    if not rows:
        return
    n = -(-chars // block_chars)
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        largest = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("c"), F.count(F.lit(1)).alias("n")).filter((F.col("c") > block_chars) & (F.col("n") > 1))
        if n == 1 or n > 64 * rows or largest.isEmpty():
            break
        n *= 2
    for b in range(n):
        yield Index([(r[0], r[1]) for r in dealt.filter(F.col("block") == b).select("item_id", "text").orderBy("item_id", "text").collect()], width, threshold)


def _held(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None]]]:
    texts = batch.column("text").to_pylist()
    for held in slices(enumerate(texts), lambda r: len(r[1] or ""), 1_000_000):
        yield [i for i, _ in held], [t for _, t in held]


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: str = "0.8", block_chars: int = 8_000_000) -> DataFrame:
    """Pairs: doc_id, item_id, n_shared, n_item, containment."""
    spark, found = docs.sparkSession, None
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    for index in blocks(benchmark.select(F.col("item_id").cast("long"), "text"), width, threshold, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for numbers, texts in _held(batch):
                    for k, i, n in index.match(texts):
                        rows.append((ids[numbers[k]], index.ids[i], n, index.size[i], n / index.size[i]))
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        pairs = slim.mapInArrow(run, schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], schema)


def without_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: str = "0.8", block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no benchmark item."""
    spark = docs.sparkSession
    for index in blocks(benchmark.select(F.col("item_id").cast("long"), "text"), width, threshold, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for numbers, texts in _held(batch):
                    for k, _, _ in shared.value.match(texts):
                        keep[numbers[k]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, least(5, len(w)) AS k, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda x: array_to_string(w[x:x + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM i),
ds AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' ')))) AS g FROM d, ks),
bs AS (SELECT item_id, k, len(s) AS n_item, unnest(s) AS g FROM i)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item::DOUBLE AS containment
FROM ds JOIN bs USING (k, g) GROUP BY doc_id, item_id, n_item HAVING count(*) * 10 >= n_item * 8
"""
