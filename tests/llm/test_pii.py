import hashlib
import re
import time

from polargrain.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data", "a@b.c%d@e.f, x@y..z p@q.r. s@t.u-v@w.x", "mail: joe.doe+x@mail.example.org.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.09 1.2.3 1.2.3.4.",
    "4111 1111 1111 1111 and 4111-1111-1111-1111-1 and 41111111111111111111111 5500005555555559", "4111 1111 1111 1111  4 - 4242424242424242", "+1 (555) 123-4567, +49.30.1234567 + +1 +12 345",
    "é\U0001f600é a@b.co \U0001f600 +33 1 23 45 67 89 é 8.8.8.8", "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 or DE89370400440532013001",
    "call (555) 123-4567 now; order 555-123-4567", "@@@ a@ @b.c a@b a@b.c@d.e", "1" * 5000, "a" * 30000 + "@b.c", "1.1." * 5000, "1 " * 5000, "x@" + "a." * 5000 + "b", "%$" * 100 + "1-" * 2000,
]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        for kind in PLAIN:
            assert getattr(r, f"n_{kind}") == sum(w[0] == kind for w in want), (r.doc_id, kind, texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), texts[r.doc_id]
        assert [w for w in (x.split(":") for x in r.spans.split(",")) if w[0] in PLAIN] == [[k, str(s), str(e)] for k, s, e in want]


def test_equals_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, email int")
    rows = pii.pii_digest(docs).collect()
    assert len(rows) == len(TEXTS)
    check(rows, TEXTS)


def test_added_kinds_need_checksum_or_context(spark):
    docs = spark.createDataFrame([(0, TEXTS[10]), (1, TEXTS[11])], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    ibans = [x for x in got[0].spans.split(",") if x.startswith("iban")]
    assert [TEXTS[10][int(a) : int(b)] for _, a, b in (x.split(":") for x in ibans)] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    assert [x for x in got[1].spans.split(",") if x.startswith("local")] == ["local_phone:5:19"]


def test_whole_small_table_and_native_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pii.op7_pii(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    check(out.collect(), {r.doc_id: r.text for r in docs.collect()})
    assert pii.pii_digest(docs.limit(0)).collect() == []


def test_many_matches_in_a_long_text(spark):
    texts = [" ".join(f"a{k}@b.co" for k in range(12_000)), " ".join(["10.0.0.1 999.1.1.1"] * 6_000), "a@b.co", None]
    docs = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (3, None)], "doc_id long, text string")
    began = time.time()
    rows = pii.pii_digest(docs).collect()
    assert time.time() - began < 30
    assert len(rows) == 5
    check(rows, texts)
