import numpy as np
import pytest

from polargrain.llm import language_id, quality_crf
from polargrain.llm.bytework import Padded, python_held_out


@pytest.fixture(scope="module")
def small(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = language_id.op5_language_id(spark, small).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == python_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.95


def test_language_spans_and_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    text = {lang: next(r.text for r in docs.filter(f"lang='{lang}' and n_chars between 400 and 3000").collect()).split("\n")[-1] for lang in ("en", "fr")}
    mixed = text["en"] + " " + text["fr"]
    spans = model.spans(mixed)
    data = mixed.encode()
    border = len(text["en"].encode())
    right = sum(max(0, min(e, border) - s) if lang == "en" else max(0, e - max(s, border)) if lang == "fr" else 0 for s, e, lang in spans)
    assert right > 0.85 * len(data)
    assert [p for p, _ in model.predict([None, "", "123 !?", "_", "123 ½", "² ①", "Ⅷ ٣", "—“”…"])] == ["und"] * 8
    rows = [(5, "the end", "en", 1.0), (5, "the end", "en", 1.0), (None, "the end", "fr", 0.0), (7, None, None, 0.5), (8, "la fin " * 100_000, "x", 0.5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language_id.identify(odd, model).collect())
    assert len(got) == 5 and got[1] == got[2] and got[3] == (7, "und")
    assert all(p in model.langs for p, _ in model.predict(["é", "日本語", "\U0001f600 x", "the " * 50_000]))
    assert language_id.identify(docs.limit(0), model).collect() == []
    empty = language_id.train(docs.limit(0))
    assert empty.predict(["the"]) == [("und", 0.0)]


def test_rare_languages_are_trained(spark):
    rare = [i for i in range(5000, 5100) if not python_held_out(i)][:3]
    rows = [(i, "plain english words in a row", "en") for i in range(3000)] + [(i, "zutto kimochi wakaranai yo", "ja") for i in rare]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=40)
    assert [x for x, _ in model.predict(["kimochi wakaranai", "english words"])] == ["ja", "en"]


def test_letters_are_those_of_unicode():
    import random
    import unicodedata

    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(chr(rnd.choice((rnd.randrange(32, 0x500), rnd.randrange(0x2000, 0x2500)))) for _ in range(rnd.randrange(3)))
        assert language_id.has_letter(text) == any(unicodedata.category(c)[0] == "L" for c in text)


def test_emissions_equal_brute_force():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(language_id.N * language_id.BUCKETS, 3)).astype(np.float32)
    allowed = np.ones((len(language_id.SCRIPT_STARTS), 3), bool)
    allowed[0, 2], allowed[2, 0] = False, False  # Latin, Cyrillic
    model = language_id.Model(["a", "b", "c"], table, allowed)
    text = "The слово Été x, мир ab"
    data, starts, ends, counts = language_id.words_of([text])
    got = model.emissions(data, starts, ends)
    words = ["the", "слово", "Été", "x", "мир", "ab"]
    assert len(got) == len(words) == counts[0]
    for k, word in enumerate(words):
        script = 2 if word[0] in "см" else 0
        raw = (" " + "".join(c.lower() if c.isascii() else c for c in word)).encode()
        follow = raw + b" " + "".join(" " + w for w in words[k + 1 :]).encode().lower()[1:] + b"    "
        total = np.zeros(3)
        for at in range(len(raw)):
            code = 0
            for n in range(1, 5):
                piece = bytes(data[starts[k] - 1 + at : starts[k] - 1 + at + n])
                assert n > len(raw) - at or piece == follow[at : at + n]
                code = int.from_bytes(piece, "big")
                h = code * 0x9E3779B1 % (1 << 32)
                total += table[((h ^ h >> 15) & (language_id.BUCKETS - 1)) + (n - 1) * language_id.BUCKETS]
        np.testing.assert_allclose(got[k], np.where(allowed[script], total / 4, -1e6), rtol=1e-4)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((20, 3), bool), penalty=1.5)
    counts = np.array([3, 0, 5, 1])
    e = rng.normal(size=(9, 3)).astype(np.float32) * 2
    got = model.labels(e, counts)
    at = 0
    for n in counts:
        paths = [[]]
        for _ in range(n):
            paths = [p + [k] for p in paths for k in range(3)]
        value = lambda p: sum(e[at + i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023,E731
        assert n == 0 or abs(value(list(got[at : at + n])) - max(map(value, paths))) < 1e-4
        at += n


def test_quality_held_out_accuracy(spark, small):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = quality_crf.op9_quality(spark, small).collect()
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(2)
    counts = np.array([4, 1, 2])
    u, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    good, pairs, logz = quality_crf.marginals(u, trans, Padded(counts))
    at, total_pairs, total_z = 0, np.zeros((2, 2)), 0.0
    for n in counts:
        z, mass, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in np.ndindex(*[2] * n):
            w = np.exp(sum(u[at + i] * k for i, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            z += w
            mass += w * np.array(path)
            for a, b in zip(path, path[1:]):
                pr[a, b] += w
        np.testing.assert_allclose(good[at : at + n], mass / z)
        total_pairs += pr / z
        total_z += np.log(z)
        at += n
    np.testing.assert_allclose(pairs, total_pairs)
    np.testing.assert_allclose(logz, total_z)


def test_quality_edges(spark):
    model = quality_crf.fit(np.zeros((0, quality_crf.N_FEATURES)), np.zeros(0, int), np.zeros(0), np.zeros(0))
    assert list(quality_crf.score_texts(model, ["", "x"])) == [0.5, 0.5]
    docs = spark.createDataFrame([(1, "good line.\nmore.", 0.1), (2, None, 0.2), (None, "BAD!! BAD!!", 0.3), (1, "good line.\nmore.", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    rows = quality_crf.score(docs, quality_crf.train(docs, labels)).collect()
    assert len(rows) == 4
    assert quality_crf.score(docs.limit(0), model).collect() == [] == quality_crf.accepted(docs.limit(0), model).collect()
    rng = np.random.default_rng(5)
    texts = [["buy now!!! | | |", "some words go on here."][k % 2] for k in range(60)]
    x, lengths, counts = quality_crf.line_features(texts)
    fitted = quality_crf.fit(x.astype(float), counts, lengths, np.arange(60) % 2)
    bad, good, mixed = quality_crf.score_texts(fitted, [texts[0], texts[1], "\n".join(rng.choice(texts[:2], 40_000))])
    assert bad < 0.3 < 0.7 < good and 0 < mixed < 1


def test_weighted_gradient_is_that_of_one_likelihood():
    rng = np.random.default_rng(6)
    counts, weights = np.array([3, 1, 4]), np.array([0.2, 1.5, 0.7])
    u, y = rng.normal(size=8), np.array([0, 0, 0, 1, 1, 1, 1, 1])

    def value(trans):
        total, at = 0.0, 0
        for n, w in zip(counts, weights):
            own = u[at : at + n]
            _, _, logz = quality_crf.marginals(own, trans, Padded(np.array([n])))
            path = y[at : at + n]
            total += w * ((own * path).sum() + sum(trans[a, b] for a, b in zip(path, path[1:])) - logz)
            at += n
        return total

    trans = rng.normal(size=(2, 2))
    _, pairs, _ = quality_crf.marginals(u, trans, Padded(counts), weights)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = 0.2 * 2, 0.7 * 3
    for i in range(2):
        for j in range(2):
            step = np.zeros((2, 2))
            step[i, j] = 1e-5
            assert abs((value(trans + step) - value(trans - step)) / 2e-5 - (seen - pairs)[i, j]) < 1e-5
