import math
import random
import time

import regex

from polargrain.llm import decontaminate


def words(t):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())


def brute(docs, items):
    out = []
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for doc_id, t in docs:
            d = words(t)
            n = len(s & {tuple(d[i : i + k]) for i in range(len(d) - k + 1)})
            if n >= math.ceil(len(s) * 4 / 5):
                out.append((doc_id, item_id, n, len(s), n / len(s)))
    return sorted(out, key=repr)


def test_equals_brute_force_in_any_number_of_blocks(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = items[0][1].split()
    items += [(900, None), (901, ""), (902, "!!"), (903, "Two Words"), (904, "école été"), (905, "a b a b a b a b a b a b"), (903, "again here"), (906, items[0][1])]
    docs += [(5000, None), (5001, ""), (5002, "it has two, words!"), (5003, "ÉCOLE\n... Été."), (5004, "b a b a b a b"), (5005, "Two Words"), (5005, "Two Words")]
    docs += [(6000 + k, "zz " * k + " ".join(long[: len(long) - k]) + " qq" * 3000) for k in range(0, 12)]
    docs += [(6200, "“" + "” — “".join(long) + "…"), (6201, "\u00a0".join(long)), (6202, "हिन्दी शब्द")]
    items += [(907, "“Quoted — words”, here… and there"), (908, "हिन्दी शब्द")]
    docs += [(6203, "a quoted words (here) and—there"), (6204, "हिन दी शब द")]
    docs += [(6100, " ".join(long).upper().replace(" ", " - ")), (6101, " ".join([*long[:15], "oops", *long[15:]]))]
    want = brute(docs, items)
    assert {(6200, items[0][0]), (6201, items[0][0]), (6203, 907), (6202, 908)} <= {(d, i) for d, i, *_ in want} and not any(d == 6204 for d, *_ in want)
    assert len({d for d, *_ in want if 6000 <= d < 6100}) in range(3, 12)
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int").repartition(2)
    b = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    for chars in (20_000_000, 2_000):
        got = decontaminate.contained_items(d, b, block_chars=chars)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    kept = decontaminate.without_items(d, b, block_chars=2_000).collect()
    hit = {x for x, *_ in want}
    assert sorted(r.doc_id for r in kept) == sorted(x for x, _ in docs if x not in hit)
    assert decontaminate.contained_items(d.limit(0), b).collect() == [] == decontaminate.contained_items(d, b.limit(0)).collect()


def test_index_grows_with_its_items():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rnd.choices(words, k=100))) for k in range(4000)]
    began = time.time()
    index = decontaminate.Index(items)
    assert time.time() - began < 20  # 2 million characters
    assert sum(a.nbytes for a in (index.hashes, index.words.starts, index.words.ends)) < 40 * sum(len(t) for _, t in items)
    assert index.match([items[7][1], "x " + items[8][1].upper()]) == [(0, 7, index.size[7]), (1, 8, index.size[8])]
