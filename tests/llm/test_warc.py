import base64
import gzip
import hashlib
import io
import os

import pytest

from polargrain.llm import warc
from polargrain.llm.common import filesystem


def _normalise(data):
    target, index = io.BytesIO(), io.BytesIO()
    n = warc.normalise(io.BytesIO(data), target, index)
    return n, target.getvalue(), [line.split("\t") for line in index.getvalue().decode().splitlines()]


@pytest.mark.parametrize("members", [1, 3])
def test_normaliser_round_trip(members):
    payloads = [b"", b"x", b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", os.urandom(300_000), b"a" * 1_000_000, "é\U0001f600".encode()]
    records = [warc.record(i, f"http://a b/{i}\n", p, 99 if i == 1 else None) for i, p in enumerate(payloads)]
    whole = b"".join(records)
    step = -(-len(whole) // members)
    data = b"".join(gzip.compress(whole[k : k + step]) for k in range(0, len(whole), step))
    n, out, index = _normalise(data)
    assert n == len(payloads) and gzip.decompress(out) == whole
    for (at, size, kind, page), p, r in zip(index, payloads, records, strict=True):
        member = out[int(at) : int(at) + int(size)]
        assert gzip.decompress(member) == r
        fields, http, payload = warc.read_member(member)
        assert kind == fields["warc-type"] and int(http["content-length"]) == len(p)
        assert payload == (b"" if kind == "revisit" else p)


def test_damaged_streams_are_refused():
    data = gzip.compress(warc.record(1, "u", b"payload", None))
    with pytest.raises(ValueError):
        _normalise(data[:-20])
    with pytest.raises(ValueError):
        _normalise(gzip.compress(warc.record(1, "u", b"payload", None)[:-10]))
    assert _normalise(b"")[0] == 0


def brute(rows, min_bytes):
    best = {}
    for page, html in rows:
        p = (html or "").encode()
        if len(p) >= min_bytes and page is not None:
            best[p] = max(best.get(p, page), page)
    out = []
    for page, html in rows:
        p = (html or "").encode()
        top = best.get(p) if len(p) >= min_bytes else None
        refers = top if top is not None and top != page else None
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_archives_equal_brute_force(spark, sf_dir, min_bytes):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (1003, "ab"), (1004, "é" * 9), (1005, "é" * 9), (None, "é" * 9), (None, "alone"), (1006, "twice"), (1006, "twice"), (1007, rows[0][1])]
    pages = spark.createDataFrame([(a, f"http://x/{a}", b, "k") for a, b in rows], "page_id long, url string, html string, key string").repartition(3)
    manifest = warc.write_archives(pages, min_bytes)
    got = warc.read_archives(spark, manifest).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(rows, min_bytes)
    fs, where = filesystem(manifest.first().path)
    assert not [f.path for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(os.path.dirname(where))) if f.path.endswith(".whole")]
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, empty).collect() == []
