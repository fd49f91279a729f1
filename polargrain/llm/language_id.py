"""Language of texts: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script (the code-point range of its first letter) narrows the candidate languages
to those whose training words use that script; its score for each candidate is the smoothed
log-probability of its byte n-grams (1 to 4 bytes, hashed to a fixed table). A Viterbi walk
over the words with a penalty for every change of language labels spans; the language with
most bytes in its spans is the text's, and its share of the labelled bytes the score.

Training counts n-grams of whole texts of at most about ``sample_docs`` documents, chosen by
the hash of doc_id among those with a language outside the held-out fold (crc32 of the id as
text, modulo 4, equal to 2). Prediction sees the text alone. The table takes 1 MB a language
on the driver and in every worker, so the number of different values of ``lang`` bounds it.

Defined results: a null text or one without a letter is ``und`` with score 0; words in a
script that no training word used may be any language; ties go to the first language in
alphabetical order; with no training rows every text is ``und``; repeated rows are each
predicted; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.bytework import Padded, held_out, runs
from polargrain.llm.chunks import slices
from polargrain.llm.common import table

N = 4
BUCKETS = 1 << 16
# first code points of script blocks, in order; words of one range share a script
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xAC00, 0xE000)
WORD = np.zeros(256, bool)
WORD[list(range(97, 123)) + list(range(65, 91)) + list(range(128, 256))] = True


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L); numbers such as a half are none."""
    return any(map(str.isalpha, text))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered and every non-letter a space; word starts, ends, and words per text."""
    blobs = [t.encode() for t in texts]
    sizes = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"\n" + b"\n".join(blobs).lower() + b"\n\n\n\n", np.uint8)
    data = np.where(WORD[data], data, 32).astype(np.uint8)
    starts, ends = runs(data != 32)
    doc_starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
    counts = np.diff(np.searchsorted(starts, doc_starts))
    return data, starts, ends, counts


def scripts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number of the first code point at each start."""
    b = [data[starts + k].astype(np.int64) for k in range(4)]
    one, two, three = b[0], (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    point = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [one, two, three], four)
    return np.searchsorted(np.array(SCRIPT_STARTS), point, "right") - 1


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each n the table row of the n-gram that starts at each byte (n-grams of one length share a block)."""
    code = np.zeros(len(data) - N, np.uint32)
    m = len(code)
    for n in range(1, N + 1):
        code = code << np.uint32(8) | data[n - 1 : n - 1 + m]
        h = code * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        yield (h & np.uint32(BUCKETS - 1)).astype(np.int32) + (n - 1) * BUCKETS


def gram_starts(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose n-grams belong to a word (from the space before it), and word borders in them."""
    lengths = ends - starts + 1
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    at = np.repeat(starts - 1 - begins, lengths) + np.arange(lengths.sum())
    return at, begins, lengths


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (N * BUCKETS, languages) log-probabilities
    allowed: np.ndarray  # (scripts, languages)
    penalty: float = 8.0
    narrowed: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def candidates(self, script: int) -> tuple[np.ndarray, np.ndarray]:
        """Languages of a script, and their columns of the table."""
        if script not in self.narrowed:
            langs = np.flatnonzero(self.allowed[script])
            self.narrowed[script] = langs, self.table if len(langs) == len(self.langs) else np.ascontiguousarray(self.table[:, langs])
        return self.narrowed[script]

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of every word for the languages of its script; the others are not scored and stay far below."""
        out = np.full((len(starts), len(self.langs)), np.float32(-1e6))
        scripts, codes = scripts_of(data, starts), list(grams(data))
        for script in np.unique(scripts).tolist():
            words, (langs, columns) = np.flatnonzero(scripts == script), self.candidates(script)
            at, begins, _ = gram_starts(starts[words], ends[words])
            total = np.zeros((len(at), len(langs)), np.float32)
            for rows in codes:
                total += columns[rows[at]]
            out[np.ix_(words, langs)] = np.add.reduceat(total, begins) / N
        return out

    def labels(self, emissions: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Best language number of every word."""
        walk, n_words = Padded(counts), len(emissions)
        stays = np.ones(emissions.shape, bool)
        best_before = np.zeros(n_words, np.int16)
        last = np.zeros(len(walk.counts), np.int64)
        state = np.zeros((0, emissions.shape[1]), np.float32)
        for t in range(walk.steps):
            n, rows = walk.at(t)
            if t == 0:
                state = emissions[rows].copy()
            else:
                last[n : len(state)] = state[n:].argmax(1)
                state = state[:n]
                top = state.argmax(1)
                switch = state[np.arange(n), top] - self.penalty
                stay = state >= switch[:, None]
                stays[rows], best_before[rows] = stay, top
                state = np.where(stay, state, switch[:, None]) + emissions[rows]
        last[: len(state)] = state.argmax(1) if len(state) else 0
        out = np.zeros(n_words, np.int64)
        lang = last
        for t in range(walk.steps - 1, -1, -1):
            n, rows = walk.at(t)
            now = lang[:n]
            out[rows] = now
            lang[:n] = np.where(stays[rows, now], now, best_before[rows])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        texts = [t or "" for t in texts]
        data, starts, ends, counts = words_of(texts)
        if not self.langs or not len(starts):
            return [("und", 0.0)] * len(texts)
        label = self.labels(self.emissions(data, starts, ends), counts)
        weight = np.zeros((len(texts), len(self.langs)))
        np.add.at(weight, (np.repeat(np.arange(len(texts)), counts), label), ends - starts)
        top, total = weight.argmax(1), weight.sum(1)
        return [(self.langs[k], float(weight[i, k] / total[i])) if total[i] and has_letter(texts[i]) else ("und", 0.0) for i, k in enumerate(top)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """[start, end) bytes of ``text`` and the language of every span of words."""
        data, starts, ends, counts = words_of([text])
        if not self.langs or not len(starts):
            return []
        label = self.labels(self.emissions(data, starts, ends), counts)
        change = np.flatnonzero(np.diff(label)) + 1
        return [(int(starts[a]) - 1, int(ends[b - 1]) - 1, self.langs[label[a]]) for a, b in zip([0, *change], [*change, len(label)], strict=True)]


def train(docs: DataFrame, sample_docs: int = 4000, smoothing: float = 0.5, penalty: float = 8.0, per_language: int = 200) -> Model:
    """Train on about ``sample_docs`` documents, and on about ``per_language`` or all of a rarer language."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs, total = sorted(sizes), sum(sizes.values())
    if total > sample_docs:
        most = {lang: int(min(1.0, max(sample_docs / total, per_language / n)) * (1 << 40)) + 1 for lang, n in sizes.items()}
        limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("lang")]
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < limit)
    n_scripts = len(SCRIPT_STARTS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                sums = held.setdefault(lang, np.zeros(N * BUCKETS + n_scripts, np.int64))
                for texts in slices([t or "" for t in part["text"]], len, 1_000_000):
                    data, starts, ends, _ = words_of(texts)
                    at, _, _ = gram_starts(starts, ends)
                    for rows in grams(data):
                        sums[: N * BUCKETS] += np.bincount(rows[at], minlength=N * BUCKETS)
                    sums[N * BUCKETS :] += np.bincount(scripts_of(data, starts), minlength=n_scripts)
        for lang, sums in held.items():
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "feature": some.astype(np.int32), "n": sums[some]})

    counted = known.select("lang", "text").mapInPandas(count, "lang string, feature int, n long")
    sums = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most N * BUCKETS rows a language
    seen = np.zeros((N * BUCKETS + n_scripts, len(langs)))
    seen[sums["feature"].to_numpy(), sums["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(dtype=np.int64)] = sums["n"]
    logs = np.zeros((N * BUCKETS, len(langs)), np.float32)
    for n in range(N):
        block = seen[n * BUCKETS : (n + 1) * BUCKETS]
        used = max(1, int((block.sum(1) > 0).sum()))
        logs[n * BUCKETS : (n + 1) * BUCKETS] = np.log((block + smoothing) / (block.sum(0) + smoothing * used))
    scripts = seen[N * BUCKETS :]
    allowed = scripts >= 0.005 * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, logs, allowed, penalty)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N * BUCKETS floats, 1 MB, a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for held in slices(rows, lambda r: len(r[1] or ""), 1_000_000):
                found = shared.value.predict([t for _, t in held])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
