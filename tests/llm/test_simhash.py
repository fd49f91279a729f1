import numpy as np
import xxhash

from polargrain.llm import simhash
from polargrain.llm.components import components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_forest_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, flips in ((1, 0), (2, 1), (300, 2), (500, 3), (64, 6)):
        centers = rng.integers(0, 2**63, 1 + n // 20, dtype=np.uint64)
        codes = centers[rng.integers(0, len(centers), n)].copy()
        for _ in range(flips):
            codes ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        codes = np.unique(codes)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        a, b = simhash.forest(codes, np.array([0]), 2, chunk=37)
        root = np.arange(len(codes))
        root[a] = b
        assert list(root) == brute_components([int(c) for c in codes], 2)


def test_groups_do_not_mix():
    codes = np.array([0, 1, 0, 1, 3], np.uint64)
    a, b = simhash.forest(codes, np.array([0, 2]), 1)
    assert list(zip(a, b)) == [(1, 0), (3, 2), (4, 2)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_equal_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = texts[0].split()
    texts += [None, "", " \t\n", "one", "One two", "one  TWO", "É é", " ".join(base), " ".join(base[:-1]), " ".join(base[1:]), "x y z " * 3000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "one", 7)], "doc_id long, text string, fp int")
    fps = [brute_fp(t) for t in texts]
    want = brute_components(fps, 2)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        k = texts.index("one") if r.doc_id is None else r.doc_id
        assert (int(r.fingerprint, 16), r.component_id) == (fps[k], want[k])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(9)
    centers = rng.integers(0, 2**63, 6, dtype=np.uint64)
    codes = np.concatenate([centers[rng.integers(0, 6, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)), rng.integers(0, 2**63, 50, dtype=np.uint64)])
    codes = np.unique(codes)
    want = brute_components([int(c) for c in codes], 2)
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    for hot in (500_000, 3):
        root = {r.node: r.root for r in components(simhash.link_fingerprints(fps, 2, hot)).collect()}
        groups = {}
        for c, w in zip(codes.view(np.int64).tolist(), want):
            groups.setdefault(w, set()).add(root.get(c, c))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_few_edges_are_joined_as_by_rounds(spark):
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (240, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7), (-(2**63), 2**63 - 1)]
    table = spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(5)
    one, rounds = ({r.node: r.root for r in components(table, few=few).collect()} for few in (250_000, 0))
    assert one == rounds and one[1200] == 1000 and one[2**63 - 1] == -(2**63)
