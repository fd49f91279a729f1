"""SentencePiece encoding with original byte spans, and decoding.

The normaliser is this module's own: it reads the model's compiled character map (a double
array trie followed by NUL-terminated replacements), rewrites the text by longest-prefix
matches and records for every normalised byte the source byte it came from. The pieces of
the normalised text come from the sentencepiece library with its own normalisation switched
off; cumulated piece lengths projected through the alignment give each piece's span of
original bytes.

Texts are cut before runs of the space mark and around line feeds where the model has no
piece across such a border (checked piece by piece), so a chunk is encoded once per worker.
Models without that property are encoded text by text.

Defined results: null text counts as empty; an empty text has only the begin and end ids;
begin and end ids have empty spans. Other columns are ignored; repeated rows and doc_ids
each give their row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.chunks import ChunkCache, slices
from polargrain.llm.common import table

MARK = "▁"
UNKNOWN = "�"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
ONE_SIDED = re.compile(f"{MARK}*[^{MARK}\n]*")


class CharacterMap:
    """The compiled map: longest-prefix lookup of UTF-8 bytes in a double-array trie."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that ``data`` has at ``at``."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node ^= _offset(units[0])
        for k in range(at, len(data)):
            c = data[k]
            if c == 0:
                break
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised bytes of a text, and for each of them (and the end) its source byte."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, trim: bool, escape: bool):
        self.map = CharacterMap(charsmap)
        self.dummy, self.trim, self.space = dummy_prefix, trim, (MARK if escape else " ").encode()

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.trim:
            return self._identity(data)
        return self._mapped(data)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        source = np.frombuffer(data, np.uint8)
        align = np.arange(len(data) + 1, dtype=np.int64)
        if len(self.space) > 1:
            align = np.repeat(align, np.append(np.where(source == 32, len(self.space), 1), 1))
        lead = self.space if self.dummy else b""
        return lead + data.replace(b" ", self.space), np.concatenate([np.zeros(len(lead), np.int64), align])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at = bytearray(), [], 0
        steps = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                c = data[at]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                hit = (n, data[at : at + n])
            steps.append((at, hit[1]))
            at += hit[0]
        if self.trim:
            while steps and steps[0][1] in (b" ", b""):
                steps.pop(0)
        if not steps:
            return b"", np.full(1, len(data), np.int64)
        start = steps[0][0] if self.trim else 0
        if self.dummy:
            out += self.space
            align += [start] * len(self.space)
        after_space = self.trim
        for source, piece in steps:
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                put = piece.replace(b" ", self.space)
                out += put
                align += [source] * len(put)
                after_space = self.trim and piece.endswith(b" ")
        end = len(data)
        if self.trim:
            while out.endswith(self.space):
                end = align[-len(self.space)]
                del out[-len(self.space) :], align[-len(self.space) :]
        return bytes(out), np.asarray([*align, end], np.int64)


class PieceCodec:
    def __init__(self, model_path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        own = any(p.type == p.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix
        if own and (spec.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("models with own symbols under a character map or with suffix spaces are not supported")
        self.whole = spm.SentencePieceProcessor(model_file=model_path)
        spec.precompiled_charsmap, spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", "identity", False, False
        self.plain = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        t = model.pieces[0]
        self.lengths = np.array([0 if p.type == t.CONTROL else 1 if p.type == t.BYTE else -1 if p.type == t.UNKNOWN else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.cuttable = bool(model.trainer_spec.byte_fallback) and model.trainer_spec.model_type == 2 and not own and all(p.type != t.NORMAL or ONE_SIDED.fullmatch(p.piece) for p in model.pieces)
        self.cache = ChunkCache(lambda chunks: [np.asarray(i, "<u4").tobytes() for i in self.plain.encode(chunks, num_threads=1)], limit=120_000)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: ids with begin and end, and an array of [start, end) source byte spans."""
        normal = [self.normalize(t or "") for t in texts]
        strings = [n.decode() for n, _ in normal]
        if self.cuttable:
            split = [CHUNK.findall(s) for s in strings]
            ids = self.cache.lookup(split)
            arrays = [np.frombuffer(b"".join(map(ids.__getitem__, chunks)), "<u4") for chunks in split]
        else:
            arrays = [np.asarray(i, "<u4") for i in self.plain.encode(strings, num_threads=1)]
        return [self._spans(a, s, align) for a, s, (_, align) in zip(arrays, strings, normal, strict=True)]

    def _spans(self, ids: np.ndarray, normal: str, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[ids]
        if (lengths < 0).any():  # the surface of an unknown piece is only known to the library
            lengths = np.array([len(p.encode()) if n < 0 else n for p, n in zip(self.plain.encode(normal, out_type=str), lengths, strict=True)], np.int64)
        ends = align[np.cumsum(lengths)] if len(ids) else np.zeros(0, np.int64)
        first, last = (align[0] if len(ids) else 0), align[-1]
        spans = np.empty((len(ids) + 2, 2), np.int64)
        spans[0], spans[-1] = first, last
        spans[1:-1, 1] = ends
        spans[1:-1, 0] = np.concatenate([[first], ends[:-1]]) if len(ids) else ends
        return np.concatenate([[self.whole.bos_id()], ids, [self.whole.eos_id()]]).astype("<u4"), spans

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode([a.tolist() for a in ids], num_threads=1)


@cache
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for held in slices(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda r: len(r[1] or ""), 1_000_000):
            yield [i for i, _ in held], [t or "" for _, t in held]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id, ids (with begin and end), and the pieces' source byte starts and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _batches(batches):
            done = codec(model_path).encode(texts)
            columns = [pa.array([a.astype(np.int32) for a, _ in done], pa.list_(pa.int32()))]
            columns += [pa.array([s[:, k] for _, s in done], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *columns], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every text; digests of the ids, the decoded text and the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for doc_ids, texts in _batches(batches):
            done = codec(model_path).encode(texts)
            decoded = codec(model_path).decode([a for a, _ in done])
            rows = [(i, len(a), sha(a.tobytes()), sha(d.encode()), sha(s.astype("<i8").tobytes())) for i, (a, s), d in zip(doc_ids, done, decoded, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def encoded_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id, its ids, their number, and whether the decoded ids give the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _batches(batches):
            ids = [a for a, _ in codec(model_path).encode(texts)]
            same = [d == t for d, t in zip(codec(model_path).decode(ids), texts, strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array([a.astype(np.int32) for a in ids], pa.list_(pa.int32())), pa.array([len(a) for a in ids], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
