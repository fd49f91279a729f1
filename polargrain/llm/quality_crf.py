"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its bytes and words and of the lines before and after it; the
chain has the labels bad and good. Training lines take their document's label, weights and
transitions maximise one penalised likelihood, in which both labels and all documents of a
label weigh the same (gradients by forward-backward over all training documents at once). A document's raw quality is the mean of its lines' marginals
for good, weighted by line length; two parameters fitted on the training documents turn it
into the probability of label 1.

Training uses at most about ``max_labelled`` labelled documents and the first ``max_lines``
lines of each, chosen by the hash of doc_id, never a held-out one (crc32 of the id as text, modulo 4, equal to 2). Scoring reads
every whole text. Features see the text alone.

Defined results: a null text counts as empty, an empty text is one empty line and is scored
like any other; labels without a value or document are ignored; if all labels agree (or
there are none) every score is that label (0.5); repeated rows are scored each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.llm.bytework import Hasher, Padded, held_out
from polargrain.llm.chunks import slices
from polargrain.llm.common import table

CLASSES = ("lower", "upper", "digit", "space", "plain", "bang", "bar", "symbol", "high")
OWN = ("log_length", "upper", "digit", "plain", "bang", "bar", "symbol", "high", "word_length", "log_words", "repeats", "copy", "empty", "stop")
NEAR = ("upper", "bang", "bar", "symbol", "repeats", "copy")
N_FEATURES = 1 + len(OWN) + 2 * (len(NEAR) + 1)


def _class_table() -> np.ndarray:
    of = np.full(256, CLASSES.index("symbol"), np.uint8)
    for name, chars in (("space", b" \t\x0b\x0c\r"), ("plain", b".,;:'\"?()-"), ("bang", b"!"), ("bar", b"|")):
        of[list(chars)] = CLASSES.index(name)
    for name, (a, b) in (("lower", (97, 123)), ("upper", (65, 91)), ("digit", (48, 58)), ("high", (128, 256))):
        of[a:b] = CLASSES.index(name)
    of[10] = 255
    return of


CLASS_OF = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, their lengths in bytes, and the lines per text."""
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths, kind, n = ends - starts, CLASS_OF[data], len(ends)
    share = {}
    some = np.maximum(lengths, 1)
    for k, name in enumerate(CLASSES):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        share[name] = (sums[ends] - sums[starts]) / some
    letters = np.maximum(share["lower"] + share["upper"], 1e-9)

    solid = (kind != CLASSES.index("space")) & (kind != 255)
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line_of = np.searchsorted(ends, first)
    hasher = Hasher(data)
    words = np.bincount(line_of, minlength=n)
    h = hasher(first, last)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, again, minlength=n) / np.maximum(words, 1)

    doc_of = np.repeat(np.arange(len(texts)), counts)
    key = np.lexsort((hasher(starts, ends), doc_of))
    lh = hasher(starts, ends)[key]
    same = np.zeros(n, bool)
    same[1:] = (lh[1:] == lh[:-1]) & (doc_of[key][1:] == doc_of[key][:-1])
    copy = np.zeros(n)
    copy[key] = same
    copy[lengths == 0] = 0

    final = data[np.maximum(ends - 1, 0)]
    own = {
        "log_length": np.log1p(lengths) / 5, "upper": share["upper"] / letters, "digit": share["digit"], "plain": share["plain"], "bang": share["bang"], "bar": share["bar"], "symbol": share["symbol"], "high": share["high"],
        "word_length": np.minimum(lengths / np.maximum(words, 1), 40) / 10, "log_words": np.log1p(words) / 4, "repeats": repeats, "copy": copy, "empty": (lengths == 0).astype(float), "stop": ((lengths > 0) & np.isin(final, list(b".?!"))).astype(float),
    }
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, 0] = 1
    for k, name in enumerate(OWN, 1):
        out[:, k] = own[name]
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    stops = np.cumsum(counts) - 1
    inner_left, inner_right = np.ones(n, bool), np.ones(n, bool)
    inner_left[begins], inner_right[stops] = False, False
    at = 1 + len(OWN)
    for inside, shift in ((inner_left, -1), (inner_right, 1)):
        near = np.flatnonzero(inside)
        for k, name in enumerate(NEAR):
            out[near, at + k] = own[name][near + shift]
        out[:, at + len(NEAR)] = ~inside
        at += len(NEAR) + 1
    return out, lengths, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def marginals(unary: np.ndarray, trans: np.ndarray, walk: Padded, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: P(good) of every line, pair marginals summed with ``weights`` of documents, log partition (summed)."""
    e = np.exp(np.stack([np.zeros_like(unary), np.clip(unary, -30, 30)], 1))
    m = np.exp(trans)
    docs = len(walk.counts)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    scale = np.empty(len(e))
    for t in range(walk.steps):
        n, rows = walk.at(t)
        a = e[rows] if t == 0 else (alpha[rows - 1] @ m) * e[rows]
        s = a.sum(1)
        alpha[rows], scale[rows] = a / s[:, None], s
    pairs, weight = np.zeros((2, 2)), np.ones(docs) if weights is None else weights[walk.order]
    for t in range(walk.steps - 1, 0, -1):
        n, rows = walk.at(t)
        back = e[rows] * beta[rows] / scale[rows][:, None]
        pairs += ((alpha[rows - 1] * weight[:n, None]).T @ back) * m
        beta[rows - 1] = back @ m.T
    good = alpha * beta
    good = good[:, 1] / good.sum(1)
    return good, pairs, float(np.log(scale).sum()) if docs else 0.0


def fit(x: np.ndarray, counts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Train on the stacked lines of documents with one label each."""
    if len(labels) == 0 or labels.min() == labels.max():
        zero = np.zeros(N_FEATURES)
        return Model(zero, zero + 1, zero, np.zeros((2, 2)), constant=float(labels[0]) if len(labels) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[0], scale[0] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    y = np.repeat(labels.astype(float), counts)
    walk = Padded(counts)
    share = labels.mean()
    per_doc = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    w_doc = per_doc / counts  # of a document's log-likelihood: documents weigh the same, both labels too
    w_line = np.repeat(w_doc, counts)
    total = w_line.sum()
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    params = np.concatenate([w, trans.ravel()])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    seen = np.zeros((2, 2))
    steps = w_doc * np.maximum(counts - 1, 0)
    seen[0, 0], seen[1, 1] = steps[labels == 0].sum(), steps[labels == 1].sum()
    for k in range(1, rounds + 1):
        w, trans = params[:-4], params[-4:].reshape(2, 2)
        good, pairs, _ = marginals(z @ w, trans, walk, w_doc)
        grad_w = z.T @ ((y - good) * w_line) / total - ridge * w
        grad_t = (seen - pairs) / total - 0.02 * trans
        grad = np.concatenate([grad_w, grad_t.ravel()])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad**2
        params = params + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    model = Model(mean, scale, params[:-4], params[-4:].reshape(2, 2))
    raw = _logit(document_means(model, x, lengths, counts))
    slope, shift = 1.0, 0.0
    for _ in range(2000):  # two-parameter logistic fit, every document weighing the same
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        slope = max(0.05, slope + 0.05 * (((labels - p) * raw).mean() - 1e-3 * slope))
        shift += 0.2 * (labels - p).mean()
    model.slope, model.shift = float(slope), float(shift)
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_means(model: Model, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each document's lines."""
    good, _, _ = marginals(model.unary(x), model.trans, Padded(counts))
    weight = lengths + 1.0
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x, lengths, counts = line_features(texts)
    raw = _logit(document_means(model, x, lengths, counts))
    return 1 / (1 + np.exp(-(model.slope * raw + model.shift)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, max_lines: int = 2000) -> Model:
    """Fit on labelled documents of ``docs`` outside the held-out fold."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))  # rows that repeat a document count once, as bad if any is
    total = known.count()
    if total > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(max_labelled / total * (1 << 40)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about max_labelled rows

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["\n".join((t or "").split("\n", max_lines)[:max_lines]) for t in batch["text"]]
            if texts:
                x, lengths, counts = line_features(texts)
                cuts = np.cumsum(counts)[:-1]
                yield pd.DataFrame({"label": batch["label"], "x": [a.tobytes() for a in np.split(x, cuts)], "lengths": [a.astype(np.int64).tobytes() for a in np.split(lengths, cuts)]})

    got = rows.select("text", "label").mapInPandas(features, "label int, x binary, lengths binary").collect()
    got = sorted(got, key=lambda r: (r.label, bytes(r.x)))  # the same model whatever the order of tasks
    lengths = [np.frombuffer(r.lengths, np.int64) for r in got]
    if not got:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0), np.zeros(0))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]).astype(np.float64)
    return fit(x, np.array([len(a) for a in lengths]), np.concatenate(lengths), np.array([r.label for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id and score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            scores = [score_texts(model, held) for held in slices(texts, len, 1_000_000)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(scores) if scores else []})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


THRESHOLD = 0.7


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = [score_texts(model, held) for held in slices(texts, len, 1_000_000)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold)) if scores else batch

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
