import random

from polargrain.llm import near_copies
from polargrain.llm.common import cut


def words(t):
    return (t or "").encode().lower().split()


def brute_heads(rows):
    sets = [{tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [rows[i] for i in range(len(rows)) if find(i) == i]


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_edits_not_picked_by_distance_equal_brute_force(spark, sf_dir):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    long = [t for _, t in rows if t and 100 <= len(t.split()) <= 1500][:60]
    texts = [edited(rng, t, share) for t in long for share in (0.003, 0.01, 0.02, 0.04)]
    passage = " ".join(f"common{k}" for k in range(60))
    texts += [f"{passage} {' '.join(f'own{k}x{m}' for m in range(rng.randrange(1, 30)))}" for k in range(60)]
    texts += [None, "", " \t", "one", "One", "a b c d e", "A b  c d e", "a b c d e f", passage, passage + " x"]
    rows += [(10_000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _ in brute_heads(rows)}
    assert len(want) < len(rows) - 100
    for sample, crowd in ((20_000, 5_000), (1, 3)):
        assert sorted(r.doc_id for r in near_copies.representatives(docs, sample_docs=sample, crowd=crowd).collect()) == sorted(want)


def test_bitmaps_bound_the_difference():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    sets = [set(map(int, h)) for h in near_copies.shingle_hashes(texts)]
    bits = [sum((1 << b) for b in range(near_copies.BITS) if sum(h % near_copies.BITS == b for h in s) % 2) for s in sets[:12]]
    for a in range(12):
        for b in range(a):
            assert (bits[a] ^ bits[b]).bit_count() <= len(sets[a] ^ sets[b])


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text + " z"), (None, "other words stay"), (5, text), (5, text), (9, text + " y")]
    got = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "other words stay"), (5, text), (5, text)], key=repr)
    assert near_copies.representatives(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_lean_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch")
    held = [spark.conf.get(k) for k in keys]
    out = cut(spark.range(1000).repartition("id"), "lean", lean=True)
    assert not shuffle_files(spark) - before
    assert out.count() == 1000
    assert [spark.conf.get(k) for k in keys] == held


def test_whole_texts_are_not_shuffled(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words stay")], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables of any size
    try:
        out = near_copies.representatives(docs)
        assert "BroadcastHashJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(__at" not in plan
        assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_few_files_are_written_whatever_the_partitions(spark, monkeypatch):
    """Every file of a local disk costs processes, which the driver's and executors' memory counts."""
    from pathlib import Path

    from polargrain.llm import components

    text, files = " ".join(f"w{k}" for k in range(40)), []

    def counted(df, name, **how):
        out = cut(df, name, **how)
        files.append((name, len(list(Path(out.cut_path.removeprefix("file:")).glob("part-*")))))
        return out

    monkeypatch.setattr(near_copies, "cut", counted)
    monkeypatch.setattr(components, "cut", counted)
    docs = spark.createDataFrame([(k, f"{text} x{k}" if k < 60 else f"own{k} words of one text") for k in range(120)], "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r.doc_id for r in near_copies.representatives(docs).collect()) == [0, *range(60, 120)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(files) <= 12 and max(n for _, n in files) <= 2 * spark.sparkContext.defaultParallelism, files
