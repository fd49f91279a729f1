import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from polargrain.llm import substring_dedup as sd


def brute(texts, window):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in blobs for i in range(len(b) - window + 1))
    out = []
    for b in blobs:
        gone = [False] * len(b)
        last = -1
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                for k in range(max(i, last), i + window):
                    gone[k] = True
                last = i + window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(3)
    rows = sd.remove_repeats(docs, **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    return [tuple(r)[1:5] for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("hot, bucket", [(20_000, 16 << 20), (1, 16 << 20), (20_000, 900), (2, 900), (20_000, 250)])
def test_small_windows_equal_brute_force(spark, hot, bucket):
    rnd = random.Random(5)
    texts = [None, "", "short", "ab" * 60, "x" * 100, "é" * 40]
    base = ["".join(rnd.choice("abcd") for _ in range(120)) for _ in range(12)]
    for _ in range(50):
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = rnd.randrange(100), rnd.randrange(100)
        texts.append(a[i : i + rnd.randrange(60)] + "".join(rnd.choice("efgh") for _ in range(rnd.randrange(30))) + b[j : j + rnd.randrange(80)])
    texts += texts[10:14]
    assert run(spark, texts, window=21, token=7, part_bytes=500, batch_bytes=150, hot=hot, bucket_bytes=bucket) == brute(texts, 21)


def test_whole_small_table(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert run(spark, texts) == brute(texts, 200)


def test_parts_of_several_batches(tmp_path):
    rows = [(1, b"abcdef"), (None, b""), (3, b"ghijkl"), (4, b"m" * 30), (5, b"")]
    part = sd.Part(str(tmp_path), sd.Part.write(str(tmp_path), rows, 10))
    assert len(part.firsts) > 2 and [bytes(part.text(k)) for k in (4, 0, 3, 1, 2)] == [rows[k][1] for k in (4, 0, 3, 1, 2)]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(docs).collect() == []


def test_long_texts_are_hashed_in_pieces():
    rnd = random.Random(6)
    text = bytes(rnd.choice(b"abc") for _ in range(5000))
    pieces = list(sd._pieces([text, b"", b"abc"], 50, most=700))
    got = {}
    for p in pieces:
        columns = sd.anchors([p], 50, 10)
        for row, lo, n, _, token in zip(*columns):
            got.update({(row, lo + k): token for k in range(n)})
    whole = {}
    for row, lo, n, _, token in zip(*sd.anchors([(0, 0, text)], 50, 10)):
        whole.update({(row, lo + k): token for k in range(n)})
    assert got == whole and len(whole) == 4951


def test_multikey_order():
    rnd = random.Random(7)
    for alphabet in (b"ab", bytes(range(256))):
        texts = [b"".join([bytes(rnd.choice(alphabet) for _ in range(8)), bytes([n]), bytes(rnd.choice(alphabet[:2]) for _ in range(n))]) for n in [0, *(rnd.randrange(30) for _ in range(400))]]
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        order, cls = sd.multikey(data, np.cumsum(lengths) - lengths, lengths)
        got = [texts[k] for k in order]
        assert got == sorted(texts)
        assert [a == b for a, b in zip(got, got[1:])] == list(np.diff(cls) == 0)
    assert len(sd.multikey(data, np.zeros(0, int), np.zeros(0, int))[0]) == 0


def test_multikey_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    starts, group = rng.integers(0, 380, 300), rng.integers(0, 3, 300)
    got = sd.repeated_windows(data, starts, group, 11)
    key = [(g, data[s : s + 11].tobytes()) for s, g in zip(starts, group)]
    seen = Counter(key)
    assert list(got) == [seen[k] > 1 for k in key]


def test_null_and_repeated_ids(spark):
    text = "".join(random.Random(8).choice("abcdef ") for _ in range(300))
    docs = spark.createDataFrame([(None, text, 0), (4, text, 0), (4, text, 0), (4, "short", 0), (None, None, 0)], "doc_id long, text string, n int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(docs, bucket_bytes=700).collect())
    assert got == [(0, 0, 0, 0), (0, 300, 300, 1), (4, 5, 0, 0), (4, 300, 300, 1), (4, 300, 300, 1)]
