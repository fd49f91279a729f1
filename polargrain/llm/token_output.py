"""Token-id output: one zstandard frame per document under a shared, trained dictionary.

A data set in the shared folder is ``dictionary.zdict`` (trained on the serialised id arrays
of a bounded document sample) and shard files. A shard is::

    b"PGTOKEN1" | frame of document 0 | frame of document 1 | ... | index | footer

The index holds one fixed-size entry per document (doc_id, null flag, frame offset, frame
length, token count, tokens before it in the shard); the footer holds the index offset, the
document count, the id width and the SHA-256 of the dictionary. One document is thus read by
one index lookup and one short range read, and a wrong dictionary is noticed before use.

Documents are range-partitioned by doc_id, tokenised after that shuffle and written in
ascending order (null first; rows that repeat a doc_id in the order of their texts' hashes
and texts). Shards carry unique names and are listed by a manifest that Spark commits, so
that retried or speculative tasks leave no listed duplicates. Starting positions come from a
running sum over the manifest (one row a shard).

Defined results: null text counts as empty and yields only the end id; an empty table yields
an empty data set; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.llm.chunks import ChunkCache, slices
from polargrain.llm.common import cut, filesystem, shared_dir, table

MAGIC = b"PGTOKEN1"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<i8"), ("length", "<i8"), ("n_tokens", "<i8"), ("before", "<i8")])
FOOTER = np.dtype([("index", "<i8"), ("docs", "<i8"), ("width", "<i8"), ("dictionary", "S32")])
FOOTER_BYTES = FOOTER.itemsize
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"

_tokenizers: dict[str, ChunkCache] = {}


def _cache(tokenizer_path: str) -> ChunkCache:
    if tokenizer_path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)

        vocabulary = tok.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

        def apart(chunks: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

        def encode(chunks: list[str]) -> list[bytes]:
            found = dict.fromkeys(chunks, b"")
            words = [c for c in chunks if _is_word(c)]
            for k in range(0, len(words), 500):
                some = words[k : k + 500]
                found.update(zip(some, _together(tok, ends, some) or apart(some), strict=True))
            rest = [c for c in chunks if not _is_word(c)]
            found.update(zip(rest, apart(rest), strict=True))
            return [found[c] for c in chunks]

        _tokenizers[tokenizer_path] = ChunkCache(encode, limit=400_000, split=_parts)
    return _tokenizers[tokenizer_path]


def _is_word(chunk: str) -> bool:
    """Whether the chunk is letters that the normaliser leaves as they are: one token group."""
    return len(chunk) <= 64 and chunk.isalpha() and chunk.islower() and (chunk.isascii() or max(chunk) <= "\xff")


def _together(tok, ends: np.ndarray, words: list[str]) -> list[bytes] | None:
    """Ids of every word, tokenised as one text; the last token of a group says that it ends one.

    None where there are not as many groups as words (every word has one at least).
    """
    ids = np.asarray(tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
    stops = np.flatnonzero(ends[ids]) + 1
    if len(stops) != len(words) or stops[-1] != len(ids):
        return None
    data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _parts(chunk: str) -> tuple[str, ...]:
    """Punctuation after a letter is a token group of its own, so it can be tokenised apart.

    The letter is looked for in the normalised core: lower-casing may end it with a mark.
    """
    core = chunk.rstrip(".,!?;:")
    return (core, chunk[len(core) :]) if len(core) < len(chunk) and unicodedata.normalize("NFC", core[-8:]).lower()[-1:].isalpha() else (chunk,)


def _folded(text: str) -> str:
    """The text lower-cased where that is all the tokenizer's normaliser would do to it.

    Latin-1 texts are unchanged by NFC and have one-to-one lower case; special tokens are
    matched before normalisation, so texts that may hold one stay as they are.
    """
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def encode_texts(texts: list[str | None], tokenizer_path: str, end_id: int) -> list[np.ndarray]:
    """Ids (32-bit) of every text, the end id appended.

    The tokenizer drops white space and never merges across it, so texts are cut at spaces
    and line feeds and each chunk is tokenised once.
    """
    cache, end = _cache(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
    split = [_folded(t or "").replace("\n", " ").split(" ") for t in texts]
    ids = cache.lookup(split)
    return [np.frombuffer(b"".join([*map(ids.__getitem__, chunks), end]), "<u4") for chunks in split]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, sample_docs: int, dict_bytes: int, sample_bytes: int = 1 << 14) -> bytes:
    """A dictionary trained on id arrays of about ``sample_docs`` documents, chosen by hash.

    A document lends its first ``sample_bytes`` bytes of ids, and twice ``sample_docs`` documents
    at most reach the driver, in a fixed order.
    """
    import zstandard

    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    picked = docs.filter(order < int(share * (1 << 40)) + 1) if share < 1 else docs

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in slices(zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True), lambda r: len(r[0] or "")):
                arrays = encode_texts([t for t, _ in held], tokenizer_path, end_id)
                cut_ids = [a[: sample_bytes // width].astype(f"<u{width}").tobytes() for a in arrays]
                yield pa.RecordBatch.from_arrays([pa.array(cut_ids, pa.binary()), pa.array([k for _, k in held], pa.int64())], ["ids", "at"])

    listed = picked.select("text", order.alias("at")).mapInArrow(serialise, "ids binary, at long")
    samples = [bytes(r[0]) for r in listed.orderBy("at", "ids").limit(2 * sample_docs).collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves are the dictionary
        return b"".join(samples)[:dict_bytes]


class ShardWriter:
    def __init__(self, folder: str, name: str, dictionary: bytes, width: int, level: int):
        import zstandard

        self.path, self.width, self.digest = f"{folder}/{name}.pgtok", width, hashlib.sha256(dictionary).digest()
        self.squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=False)
        fs, where = filesystem(self.path)
        fs.create_dir(os.path.dirname(where), recursive=True)
        self.out = fs.open_output_stream(where)
        self.out.write(MAGIC)
        self.at, self.tokens, self.entries = len(MAGIC), 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.squeeze.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is None, self.at, len(frame), len(ids), self.tokens))
        self.at += len(frame)
        self.tokens += len(ids)

    def close(self) -> tuple[str, int, int]:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(np.array([(self.at, len(self.entries), self.width, self.digest.hex()[:32])], FOOTER).tobytes())
        self.out.close()
        return self.path, len(self.entries), self.tokens


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        fs, where = filesystem(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES), FOOTER)[0]
        if foot["dictionary"].decode() != hashlib.sha256(dictionary).hexdigest()[:32]:
            raise ValueError(f"{path} was written with another dictionary")
        self.width, self.end = int(foot["width"]), int(foot["index"])
        self.index = np.frombuffer(self.file.read_at(int(foot["docs"]) * ENTRY.itemsize, self.end), ENTRY)
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        return self._ids(self.file.read_at(int(e["length"]), int(e["offset"])), int(e["n_tokens"]))

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.expand.decompress(frame, max_output_size=n * self.width), f"<u{self.width}").astype("<u4")

    def documents(self, block: int = 4 << 20) -> Iterator[tuple[np.void, np.ndarray]]:
        """(index entry, ids) of every document, read in blocks of about ``block`` bytes."""
        k, n = 0, len(self.index)
        ends = self.index["offset"] + self.index["length"]
        while k < n:
            first = int(self.index["offset"][k])
            stop = max(k + 1, int(np.searchsorted(ends, first + block, "right")))
            data = memoryview(self.file.read_at(int(ends[stop - 1]) - first, first))
            for e in self.index[k:stop]:
                at = int(e["offset"]) - first
                yield e, self._ids(data[at : at + int(e["length"])], int(e["n_tokens"]))
            k = stop


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, width: int = 2, sample_docs: int = 2000, dict_bytes: int = 1 << 16, level: int = 3, shard_bytes: int = 64 << 20) -> tuple[DataFrame, bytes]:
    """Write ``docs`` (doc_id, text) as shards; the manifest (with each shard's start) and the dictionary."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width, sample_docs, dict_bytes)
    folder = shared_dir(spark, "tokens")
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/dictionary.zdict") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, seq, shard, done = TaskContext.get().partitionId(), 0, None, []
        data = dictionary
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for held in slices(rows, lambda r: len(r[1] or "")):
                for (doc_id, _), ids in zip(held, encode_texts([t for _, t in held], tokenizer_path, end_id), strict=True):
                    shard = shard or ShardWriter(folder, f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}", data, width, level)
                    shard.add(doc_id, ids)
                    if shard.at >= shard_bytes:
                        done.append((part, seq, *shard.close()))
                        shard, seq = None, seq + 1
        if shard:
            done.append((part, seq, *shard.close()))
        names = ["part", "seq", "path", "n_docs", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    hashed = docs.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = cut(ordered.mapInArrow(write, MANIFEST), "tokens-manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))), dictionary


def read_tokens(spark: SparkSession, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """Per document of the listed shards: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, start: int):
            for e, ids in ShardReader(path, dictionary).documents():
                yield (None if e["null"] else int(e["doc_id"])), start + int(e["before"]), int(e["n_tokens"]), zlib.crc32(ids.tobytes())

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for held in slices(rows(path, start), lambda r: 1, 10_000, 10_000):
                    cols = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("path", "start").repartition(n).mapInArrow(read, READ)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, dictionary = write_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), end_id=1)
    return read_tokens(spark, manifest, dictionary)
