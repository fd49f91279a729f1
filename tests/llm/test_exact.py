import hashlib

from pyspark.sql import functions as F

from polargrain.llm import exact_dedup

TEXTS = [(1, "Same"), (2, "sAME"), (3, "same"), (4, None), (5, ""), (6, "É same"), (7, "é same"), (8, "É SAME"), (None, "same"), (None, "alone"), (9, "twice"), (9, "TWICE"), (10, "x" * 200_000), (11, "X" * 200_000), (12, "\x00"), (13, " ")]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "y") for i, t in rows], "doc_id long, text string, keep_id int, digest string").repartition(4)


def test_equals_brute_force(spark, sf_dir):
    rows = TEXTS + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = exact_dedup.exact_dedup(docs(spark, rows), salts=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert exact_dedup.exact_dedup(docs(spark, rows).limit(0)).collect() == []


def test_texts_under_one_digest_stay_apart(spark, monkeypatch):
    honest = exact_dedup.normalised
    monkeypatch.setattr(exact_dedup, "normalised", lambda *a, **k: honest(*a, **k).withColumn("digest", F.lit("clash")))
    got = exact_dedup.exact_dedup(docs(spark, TEXTS))
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == sorted([w[:4] for w in brute(TEXTS)], key=repr)


def test_one_row_of_each_text_stays(spark):
    out = exact_dedup.deduplicated(docs(spark, TEXTS)).collect()
    assert sorted(lowered(r.text) for r in out) == sorted({lowered(t) for _, t in TEXTS})
    best = {w[4]: w[1] for w in brute(TEXTS)}
    assert all(r.doc_id == best[hashlib.sha256(lowered(r.text).encode()).hexdigest()] for r in out)
