"""Removal of repeated substrings: sampled suffixes, range partitions, multikey quicksort.

A byte goes if some string of ``window`` bytes that covers it also starts anywhere else. Two
equal windows hold the same sequence of inner strings, so both choose the same anchor: the
leftmost of their ``token``-byte strings with the least hash. Only the suffixes that start at
anchors are sorted, one for about every seventy positions; an anchor stands for the windows
that it owns, and its context is the bytes of all of them.

1. Every task stores its texts as part files in the shared folder and lists the anchors.
   Anchors whose leading token occurs once (by its hash, so none is lost) own no repeated window.
2. The suffixes of all other anchors are range-partitioned by sampled splitters, in the order of
   their leading bytes, a hash of the rest, and place, so that equal ones also spread over buckets.
   A bucket sorts its contexts by multikey quicksort (characters of eight bytes; all open ranges
   are split around their pivots together). Neighbours that are equal in every byte are repeats,
   with all their windows. Where a token has several contexts, the windows of those that
   occur once are sorted likewise, against one context of each kind.
3. A token at a bucket's border may go on in the next: its kinds of contexts are compared across
   all buckets, and then its windows. Tokens with over ``hot`` kinds have their windows
   range-partitioned and sorted as suffixes of their own, by the same code.
4. Removed ranges go back to the part files by part number, where texts are cut.

Texts are never shuffled, only contexts. Part files are bounded (``part_bytes``, or one text),
buckets too (``bucket_bytes`` on average; the windows of ``hot`` kinds of contexts are sorted in
about 200 MB), and long texts are hashed in pieces that overlap by a window.

Defined results: null text counts as empty; texts shorter than a window keep all; repeats are
judged on the input; repeated rows are texts of their own and remove one another; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.bytework import Hasher, mix, runs
from polargrain.llm.chunks import slices
from polargrain.llm.common import cut, filesystem, release, shared_dir, table

POSITION_BITS = 24
ANCHOR = "part long, row int, lo int, n int, skip int, token long"
CONTEXT = "part long, row int, lo int, n int, copies int, key binary"
FOUND = "part long, row int, lo int, n int, copies int, edge boolean, key binary"
RANGE = "part long, row int, lo int, hi int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(pieces: list[tuple[int, int, bytes]], window: int, token: int) -> list[tuple]:
    """Columns row, lo, n, skip (from lo to the anchor), token of all anchors of ``pieces`` (row, offset, bytes)."""
    lengths = np.array([len(b) for _, _, b in pieces], np.int64)
    data = b"".join(b for _, _, b in pieces)
    if len(data) < window:
        return []
    flat = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lengths)
    hasher = Hasher(flat)
    n = len(flat) - token + 1
    h = mix((hasher.sums[token:] - hasher.sums[:n]) * hasher.down[:n])
    low = np.uint64((1 << POSITION_BITS) - 1)
    ranked = (h & ~low) | np.arange(n, dtype=np.uint64)
    best = (_least(ranked, window - token + 1) & low).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(best)]
    inside = np.arange(len(best)) + window <= ends[piece]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return []
    best = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(new)
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    tokens = h[best[at]].view(np.int64)
    piece = piece[first]
    rows = np.array([r for r, _, _ in pieces], np.int32)[piece]
    local = np.array([o for _, o, _ in pieces], np.int64)[piece] + first - (ends - lengths)[piece]
    return [rows, local.astype(np.int32), count.astype(np.int32), (best[at] - first).astype(np.int32), tokens]


def _pieces(rows: list[bytes], window: int, most: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    for row, text in enumerate(rows):
        for at in range(0, max(1, len(text) - window + 1), most):
            yield row, at, text[at : at + most + window - 1]


class Part:
    """A stored part: the texts of some documents as one Arrow file of small batches."""

    def __init__(self, folder: str, part: int):
        fs, where = filesystem(f"{folder}/{part}.arrow")
        self.reader = pa.ipc.open_file(fs.open_input_file(where))
        self.firsts = np.frombuffer(self.reader.schema.metadata[b"first_rows"], "<i8")
        self.number, self.held = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self.number:
            self.number, self.held = k, self.reader.get_batch(k)
        return self.held

    def text(self, row: int) -> memoryview:
        k = int(np.searchsorted(self.firsts, row, "right")) - 1
        return memoryview(self.batch(k).column("text")[row - int(self.firsts[k])].as_buffer())

    @staticmethod
    def write(folder: str, rows: list[tuple[int | None, bytes]], batch_bytes: int = 4 << 20) -> int:
        part = uuid.uuid4().int >> 65
        fs, where = filesystem(f"{folder}/{part}.arrow")
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        batches = list(slices(rows, lambda r: len(r[1]), batch_bytes, 10_000))
        firsts = np.cumsum([0, *map(len, batches[:-1])]).astype("<i8")
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())], {b"first_rows": firsts.tobytes()})
        with fs.open_output_stream(where, compression=None) as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            for held in batches:
                f.write_batch(pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([t for _, t in held], pa.large_binary())], schema=schema))
        return part


def store(docs: DataFrame, folder: str, window: int, token: int, part_bytes: int, batch_bytes: int) -> DataFrame:
    """Write part files and list their anchors; every part also has one row with row = -1."""
    names = [c.split()[0] for c in ANCHOR.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def finish(rows: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
        part = Part.write(folder, rows, batch_bytes)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, -1, 0, 0, 0, None), kinds, strict=True)], names)
        for held in slices(_pieces([t for _, t in rows], window), lambda p: len(p[2]), 1 << 20, 1 << 20):
            columns = anchors(held, window, token)
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), part)), *map(pa.array, columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                if held and size + len(text) > part_bytes:
                    yield from finish(held)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield from finish(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, ANCHOR)


def multikey(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings (group by group) and the class of equal strings at each place of it.

    Multikey quicksort: every open range is split into less, equal and greater around the
    median of three of its eight-byte characters; the equal part goes on with the next
    character. The splits of all open ranges are made together. Strings of a group that agree
    in 56 bytes must have one length.
    """
    n = len(starts)
    order, new = np.arange(n) if group is None else np.argsort(group, kind="stable"), np.zeros(n, bool)
    if not n:
        return order, np.zeros(0, np.int64)
    new[0] = True
    if group is not None:
        new[1:] = np.diff(group[order]) != 0
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(64, np.uint8)]), 8)
    begin = np.flatnonzero(new)
    size, depth = np.diff(np.append(begin, n)), np.zeros(len(begin), np.int64)
    while True:
        live = (size > 1) & (depth < lengths[order[begin]])
        begin, size, depth = begin[live], size[live], depth[live]
        if not len(begin):
            return order, np.cumsum(new) - 1
        head = np.cumsum(size) - size
        span = np.repeat(np.arange(len(begin)), size)
        place = np.repeat(begin - head, size) + np.arange(len(span))
        item = order[place]
        left = lengths[item] - depth[span]
        key = eights[starts[item] + np.where(left > 0, depth[span], 0)].view(">u8").ravel().astype(np.uint64)
        short = np.flatnonzero(left < 8)
        if len(short):
            low = (8 * np.clip(8 - left[short], 0, 7)).astype(np.uint64)
            key[short] = np.where(left[short] > 0, key[short] >> low << low, 0)
        a, b, c = key[head], key[head + size // 2], key[head + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[span]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        counts = np.bincount(3 * span + side, minlength=3 * len(begin))
        base = np.cumsum(counts) - counts
        for k in range(3):
            own, each = np.flatnonzero(side == k), counts[k::3]
            to = np.repeat(base[k::3] - (np.cumsum(each) - each), each) + np.arange(len(own))
            order[place[to]] = item[own]
        some = counts > 0
        begin = (np.repeat(begin - head, 3) + base)[some]
        depth = (np.repeat(depth, 3) + np.tile([0, 8, 0], len(depth)))[some]
        size = counts[some]
        new[begin] = True


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which windows equal another one of their group."""
    order, cls = multikey(data, starts, np.full(len(starts), window), group)
    out = np.zeros(len(starts), bool)
    out[order] = np.bincount(cls, minlength=1)[cls] > 1 if len(cls) else False
    return out


def _aligned(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Tables of at least ``most`` bytes or the rest, cut only where the sorted ``column`` changes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            rows = pa.Table.from_batches(held)
            values = rows.column(column).to_numpy()
            edge = np.flatnonzero(values[1:] != values[:-1])
            if len(edge):
                at = int(edge[-1]) + 1
                yield rows.slice(0, at)
                rows = rows.slice(at).combine_chunks()
            held, size = rows.to_batches(), rows.nbytes
    if size:
        yield pa.Table.from_batches(held)


def contexts(picked: DataFrame, folder: str, window: int, token: int) -> DataFrame:
    """The contexts of anchors, read from the part files.

    The key starts with the leading token, then come four bytes of skip and n, the rest to the
    right and what lies to the left: contexts are equal if and only if their keys are.
    """
    names = [c.split()[0] for c in CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, number = None, None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("part", "row", "lo", "n", "skip")]
            keys = []
            for part, row, lo, n, skip in zip(*rows, strict=True):
                if part != number:
                    open_part, number = Part(folder, part), part
                text, at, hi = open_part.text(row), lo + skip, lo + n - 1 + window
                keys.append(b"".join((text[at : at + token], (skip << 16 | n).to_bytes(4, "big"), text[at + token : hi], text[lo:at])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "row", "lo", "n")], pa.array(np.ones(len(keys), np.int32)), pa.array(keys, pa.binary())], names)

    ordered = picked.repartition("part").sortWithinPartitions("part", "row")
    return ordered.mapInArrow(run, CONTEXT)


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Bytes of all keys, their starts and lengths, and the other columns."""
    key = pa.concat_arrays([c.cast(pa.large_binary()) for c in rows.column("key").chunks])
    offsets = np.frombuffer(key.buffers()[1], np.int64)[key.offset : key.offset + len(key) + 1]
    data = np.frombuffer(key.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets), {c: rows.column(c).to_numpy() for c in ("part", "row", "lo", "n", "copies")}


def _ranges(rows: dict[str, np.ndarray], of: np.ndarray, inner: np.ndarray, windows: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of repeated windows as part, row, lo and number of windows; ``of`` is the row of each window, ``inner`` its number there."""
    first = np.flatnonzero(windows & ~(np.concatenate([[False], windows[:-1] & (of[1:] == of[:-1])])))
    last = np.flatnonzero(windows & ~(np.concatenate([windows[1:] & (of[1:] == of[:-1]), [False]])))
    at = of[first]
    return {"part": rows["part"][at], "row": rows["row"][at], "lo": rows["lo"][at] + inner[first], "n": inner[last] - inner[first] + 1}


def window_repeats(data: np.ndarray, starts: np.ndarray, rows: dict[str, np.ndarray], group: np.ndarray, window: int, token: int, most: int = 300_000) -> Iterator[dict[str, np.ndarray]]:
    """Repeated windows of contexts with ``copies`` 1, among the contexts of their (ascending) group."""
    borders = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]])) if len(group) else np.zeros(1, np.int64)
    total = np.concatenate([[0], np.cumsum(rows["n"])])
    i = 0
    while i + 1 < len(borders):
        j = max(i + 1, int(np.searchsorted(total[borders], total[borders[i]] + most, "right")) - 1)
        own = slice(borders[i], borders[j])
        part = {k: v[own] for k, v in rows.items()}
        texts, counts = [], part["n"].astype(np.int64)
        skips = np.zeros(len(counts), np.int64)
        for k, (s, n) in enumerate(zip(starts[own].tolist(), counts.tolist(), strict=True)):
            skip = int(data[s + token]) << 8 | int(data[s + token + 1])
            end = s + 4 + n - 1 + window
            texts += [data[end - skip : end], data[s : s + token], data[s + token + 4 : end - skip]]
            skips[k] = skip
        sizes = counts - 1 + window
        of = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[of] + inner
        # equal windows lie equally far from their anchors
        place = (group[own][of] << 16) + inner - skips[of] + (1 << 15)
        hit = repeated_windows(np.concatenate(texts), at, place, window) & (part["copies"][of] == 1)
        yield _ranges(part, of, inner, hit)
        i = j


def equal_runs(rows: DataFrame, buckets: int, window: int, token: int, hot: int) -> DataFrame:
    """Repeats among ``CONTEXT`` rows, by range partitions and local sorts.

    Buckets follow the first bytes of the leading token, a hash of the rest, and the place. Rows
    without a key are repeated runs of windows. Rows with a key are contexts of which the bucket
    cannot tell: one of each kind, with its number of copies, that starts like the bucket's first
    or last (``edge``) or has a token with over ``hot`` kinds. Where ``token`` is 0, keys are
    single windows, and only those at the borders are left open.
    """
    lead = min(16, token or window)
    names = [c.split()[0] for c in FOUND.split(", ")]

    def out(part: dict[str, np.ndarray], copies: np.ndarray, edge: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part["part"], pa.int64()), *[pa.array(part[c].astype(np.int32)) for c in ("row", "lo", "n")], pa.array(copies.astype(np.int32)), pa.array(edge), keys], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        data, starts, lengths, cols = _columns(pa.Table.from_batches(held))
        held.clear()
        order, cls = multikey(data, starts, lengths)
        starts, lengths, cols = starts[order], lengths[order], {k: v[order] for k, v in cols.items()}
        copies = np.bincount(cls, cols["copies"]).astype(np.int64)
        sure = (copies[cls] > 1) & (cols["copies"] == 1)
        none = lambda n: pa.nulls(n, pa.binary())
        yes = {k: v[sure] for k, v in cols.items()}
        yield out(yes, np.zeros(len(yes["n"])), np.zeros(len(yes["n"]), bool), none(len(yes["n"])))
        first = np.flatnonzero(np.concatenate([[True], np.diff(cls) != 0]))  # one row a kind
        kinds, at = {k: v[first] for k, v in cols.items()}, starts[first]
        kinds["copies"] = copies
        heads = np.lib.stride_tricks.sliding_window_view(data, lead)[at]
        edge = (heads == heads[0]).all(1) | (heads == heads[-1]).all(1)
        open_ = edge.copy()
        if token:
            wide = np.lib.stride_tricks.sliding_window_view(data, token)
            change = np.concatenate([[True], (wide[at[1:]] != wide[at[:-1]]).any(1)])
            group = np.cumsum(change) - 1
            size, once = np.bincount(group), np.bincount(group, copies == 1)
            open_ |= size[group] > hot
            inside = ~open_ & (size[group] > 1) & (once[group] > 0)
            for found in window_repeats(data, at[inside], {k: v[inside] for k, v in kinds.items()}, group[inside], window, token):
                n = len(found["n"])
                yield out(found, np.zeros(n), np.zeros(n, bool), none(n))
        for k in range(0, len(first), 20_000):
            pick = k + np.flatnonzero(open_[k : k + 20_000])
            keys = [data[s : s + n].tobytes() for s, n in zip(at[pick].tolist(), lengths[first][pick].tolist(), strict=True)]
            yield out({c: v[pick] for c, v in kinds.items()}, copies[pick], edge[pick], pa.array(keys, pa.binary()))

    # the sample that Spark takes for splitters is of short leads and hashes, not of whole keys
    dealt = rows.withColumn("lead", F.substring("key", 1, lead)).withColumn("rest", F.xxhash64("key"))
    return dealt.repartitionByRange(buckets, "lead", "rest", "part", "row", "lo").select(*rows.columns).mapInArrow(run, FOUND)


def _spans(found: DataFrame, window: int) -> DataFrame:
    return found.select("part", "row", "lo", (F.col("lo") + F.col("n") - 1 + window).alias("hi"))


def _across(found: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of kinds that only several buckets together repeat, and the open kinds of all buckets."""
    kinds = found.filter("key is not null")
    border = kinds.filter("edge")
    total = border.groupBy("key").agg(F.sum("copies").cast("int").alias("copies"), F.min(F.struct("part", "row", "lo", "n")).alias("one"))
    late = border.filter("copies = 1").join(total.filter("copies > 1").select("key"), "key", "left_semi")
    whole = total.select("one.*", "copies", "key").unionByName(kinds.filter("not edge").drop("edge"))
    return _spans(late, window), whole


def removed_ranges(listed: DataFrame, folder: str, window: int, token: int, hot: int, bucket_bytes: int) -> DataFrame:
    """Byte ranges to remove, of all parts."""
    listed = listed.filter("row >= 0")
    # a written table on either side: adaptive execution can then split the rows of a hot token
    tokens = cut(listed.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token"), "tokens-shared")
    shared = cut(listed.join(tokens, "token").drop("token"), "anchors-shared")
    buckets = lambda size: max(1, -(-int(size or 0) // bucket_bytes))
    total = shared.agg(F.sum(F.col("n") + window + 40)).first()[0]
    found = cut(equal_runs(contexts(shared, folder, window, token), buckets(total), window, token, hot), "sorted")
    release(tokens, shared)
    late, kinds = _across(found, window)
    out = _spans(found.filter("key is null"), window).unionByName(late)

    # tokens at borders, and hot ones
    lead = F.substring("key", 1, token)
    several = kinds.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("k"), F.min("copies").alias("least"), F.sum("n").alias("windows")).filter("k > 1 and least = 1")
    several = cut(several, "open-tokens")
    opened = kinds.withColumn("lead", lead).join(several, "lead")
    few, many = opened.filter(F.col("k") <= hot), several.filter(F.col("k") > hot)
    out = out.unionByName(sorted_windows(few, window, token))
    size = many.agg(F.sum(F.col("windows") * (window + 40))).first()[0]
    if size:
        again = cut(equal_runs(single_windows(opened.filter(F.col("k") > hot), window, token), buckets(size), window, 0, hot), "sorted-windows")
        out = out.unionByName(_spans(again.filter("key is null"), window)).unionByName(_across(again, window)[0])
    return out


def sorted_windows(opened: DataFrame, window: int, token: int) -> DataFrame:
    """Repeated windows of tokens whose kinds have come together from several buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _aligned(batches, "lead", 2 << 20):
            lead = rows.column("lead").to_pylist()
            group = np.cumsum([0, *[a != b for a, b in zip(lead[1:], lead[:-1], strict=True)]])
            data, starts, _, cols = _columns(rows)
            for found in window_repeats(data, starts, cols, group, window, token):
                lo = found["lo"].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found["part"], pa.int64()), pa.array(found["row"], pa.int32()), pa.array(lo), pa.array((lo + found["n"] - 1 + window).astype(np.int32))], ["part", "row", "lo", "hi"])

    slim = opened.select("lead", "part", "row", "lo", "n", "copies", "key")
    return slim.repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(run, RANGE)


def single_windows(opened: DataFrame, window: int, token: int) -> DataFrame:
    """Every window of some contexts as a row of its own."""
    skip = F.conv(F.hex(F.substring("key", token + 1, 2)), 16, 10).cast("int")
    size = F.col("n") - 1 + window
    right = F.substring(F.col("key"), F.lit(token + 5), size - F.col("skip") - token)
    left = F.substring(F.col("key"), size - F.col("skip") + 5, F.col("skip"))
    text = opened.withColumn("skip", skip).withColumn("text", F.concat(left, F.substring("key", 1, token), right))
    each = text.select("part", "row", "lo", "n", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select("part", "row", (F.col("lo") + F.col("i")).alias("lo"), F.lit(1).alias("n"), F.least(F.col("copies"), F.lit(2)).alias("copies"), F.substring(F.col("text"), F.col("i") + 1, F.lit(window)).alias("key"))


def cut_texts(ranges: DataFrame, listed: DataFrame, folder: str, keep_text: bool) -> DataFrame:
    """Apply the ranges to the stored parts."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def finish(part: int, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        stored = Part(folder, part)
        order = np.argsort(rows, kind="stable")
        rows, lo, hi = rows[order], lo[order], hi[order]
        borders = np.searchsorted(rows, np.append(stored.firsts, np.iinfo(np.int64).max))
        for k, first in enumerate(stored.firsts.tolist()):
            own = slice(borders[k], borders[k + 1])
            yield cut_batch(stored.batch(k), rows[own] - first, lo[own], hi[own])

    def cut_batch(batch: pa.RecordBatch, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        change = np.zeros(int(lengths.sum()) + 1, np.int32)
        np.add.at(change, begins[rows] + lo, 1)
        np.add.at(change, begins[rows] + hi, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        some = begins[lengths > 0]
        first[some] = gone[some]
        gone_sums, first_sums = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, first))
        removed = gone_sums[ends] - gone_sums[begins]
        kept = [t if n == 0 else np.frombuffer(t, np.uint8)[~gone[a:b]].tobytes() for a, b, t, n in zip(begins.tolist(), ends.tolist(), texts, removed.tolist(), strict=True)]
        columns = [batch.column("doc_id"), pa.array(lengths), pa.array(removed), pa.array(first_sums[ends] - first_sums[begins]), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept if keep_text else [None] * len(kept), pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i < 4 else c for i, c in enumerate(columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _aligned(batches, "part", 1 << 20):
            part = rows.column("part").to_numpy()
            borders = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            row, lo, hi = (rows.column(c).to_numpy() for c in ("row", "lo", "hi"))
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                real = row[a:b] >= 0
                yield from finish(int(part[a]), row[a:b][real], lo[a:b][real], hi[a:b][real])

    parts = listed.filter("row < 0").select("part", "row", "lo", F.col("lo").alias("hi"))
    return ranges.unionByName(parts).repartition("part").sortWithinPartitions("part").mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, window: int = 200, token: int = 50, part_bytes: int = 32 << 20, batch_bytes: int = 4 << 20, hot: int = 20_000, bucket_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the bytes kept."""
    folder = shared_dir(docs.sparkSession, "parts")
    listed = cut(store(docs, folder, window, token, part_bytes, batch_bytes), "anchors")
    return cut_texts(removed_ranges(listed, folder, window, token, hot, bucket_bytes), listed, folder, keep_text)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
