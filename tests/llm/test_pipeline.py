import sentencepiece

import corpus_pipeline
from polargrain.llm import quality_crf
from polargrain.llm.common import cut
from test_decontaminate import brute as brute_items
from test_near_copies import brute_heads
from test_simhash import brute_fp


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_every_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, None, "s", 0), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0)], docs.schema)
    long = max((r for r in docs.collect() if r.source != "src0"), key=lambda r: r.n_chars)
    words = long.text.split(" ")
    tries = (" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(0, len(words), 7))
    near = next(t for t in tries if (brute_fp(t) ^ brute_fp(long.text)).bit_count() <= 2)
    docs = docs.unionByName(extra).unionByName(spark.createDataFrame([(9002, near, "en", "s", 0)], docs.schema))
    model = quality_crf.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, sf_dir), name)
        got = out.collect()
        if k == 4:
            break
        assert out.schema.simpleString() == docs.schema.simpleString()
        if k == 0:
            scores = quality_crf.score_texts(model, [r[1] or "" for r in rows])
            want = [r for r, s in zip(rows, scores) if s >= 0.7]
        elif k == 1:
            best = {}
            for r in rows:
                best[lowered(r[1])] = max(best.get(lowered(r[1]), r), r, key=lambda x: x[0])
            want = list(best.values())
        elif k == 2:
            want = brute_heads(sorted(rows, key=lambda r: r[0]))
        else:
            hit = {d for d, *_ in brute_items([(r[0], r[1]) for r in rows], items)}
            want = [r for r in rows if r[0] not in hit]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr), name
        assert k == 0 or len(got) < len(rows)
        docs, rows = out, [tuple(r) for r in got]
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = {r[0]: sp.encode(r[1] or "", add_bos=True, add_eos=True) for r in rows}
    assert {r.doc_id: r.ids for r in got} == want and all(r.round_trip for r in got)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == [], name


def test_stages_keep_extra_columns(spark, sf_dir):
    names = ("digest", "norm", "fp", "_key", "keep_id", "label", "score", "salt", "component_id", "_head", "least", "item_id", "h")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    docs = docs.withColumns({n: docs["n_chars"].cast("string") for n in names}).drop("source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.filter("cast(n_chars as string) <> keep_id").count() == 0 and out.count() > 30
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
