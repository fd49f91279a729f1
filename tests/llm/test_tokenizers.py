import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from polargrain.llm import piece_codec, token_output  # noqa: E402

ODD = [None, "", " ", "  two  spaces ", "a\nb\n\nc", "▁literal ▁▁ marks", "café é ÉCOLE naïve", "<|endoftext|> x<|startoftext|>y <s> </s> <unk>", "it's we'll 12345 67", "\t tab\r\n  nbsp em \x1c\x85 ctl", "日本語 \U0001f600\U0001f600 한국", "x" * 3000, "İstanbul ΣΣ", "\x00 nul", "the same", "the same", "ÀÉß Straße. ÿ; µm, it's. a.b. x... 5. ... .a Ωmega. <|ENDOFTEXT|>. <|endoftext|>."]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_token_files_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    manifest, dictionary = token_output.write_tokens(_docs(spark, texts).repartition(3), path, shard_bytes=20_000)
    got = {r.doc_id: r for r in token_output.read_tokens(spark, manifest, dictionary).collect()}
    assert manifest.count() > 3
    at = 0
    for i, t in enumerate(texts):
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), (i, t)
        at += len(ids)
    reader = token_output.ShardReader(manifest.first().path, dictionary)
    assert len(reader.ids(0)) == int(reader.index["n_tokens"][0])
    with pytest.raises(ValueError):
        token_output.ShardReader(manifest.first().path, dictionary + b"x")


def test_random_texts_equal_the_library():
    import random

    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok, rnd = Tokenizer.from_file(path), random.Random(8)
    odd = ["İ", "İ:", "ß.", "e\u0301", "e\u0301,", "Å", "\u0345", "ﬁ", "Σ.", "aΣ;", "½", "²", "\u037e", "ก็", "한", "\u0308", "ñ!", "Ǆ?", "½.", "\u200d", "'s"]
    plain = list("abz AZ\n .,!?;:'1<|>_-é") + ["the ", "It's "]
    texts = ["İ:", "xİ: İ.", "éİ;;"] + ["".join(rnd.choice(odd if rnd.random() < 0.35 else plain) for _ in range(rnd.randrange(1, 25))) for _ in range(6000)]
    got = token_output.encode_texts(texts, path, 1)
    for t, ids, e in zip(texts, got, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == [*e.ids, 1], repr(t)


def test_token_files_of_odd_rows(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(5, "one two"), (None, "lost id"), (5, "other"), (5, "one two"), (9, "long words " * 60_000), (None, None), (1, "")]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(3)
    manifest, dictionary = token_output.write_tokens(docs, path, shard_bytes=100)
    got = sorted(token_output.read_tokens(spark, manifest, dictionary).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 5, 5, 5, 9]
    size = {t: len(token_output.encode_texts([t], path, 1)[0]) for _, t in rows}
    assert sorted(r.n_tokens for r in got) == sorted(size[t] for _, t in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    again = token_output.write_tokens(docs.repartition(2), path)[1]
    assert again == dictionary


def test_pieces_of_odd_rows(spark):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(5, "one two"), (5, "one two"), (None, None), (7, "long words " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, ids int, n_tokens int")
    got = sorted(map(tuple, piece_codec.digest_documents(docs, path).select("doc_id", "n_tokens").collect()), key=repr)
    assert got == sorted([(i, len(sp.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows], key=repr)
    assert piece_codec.digest_documents(docs.limit(0), path).collect() == []


def test_trained_character_maps_equal_the_library(tmp_path):
    import io
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rnd = random.Random(4)
    odd = list("ＡｂＣ①½ﬁﬂ㎏Ⅷ　 \u00a0\u200b\u0301\u3099ﾊﾟが각ÅΩΣßİ") + ["e\u0301", "ｶﾞ", "  "]
    texts = ["".join(rnd.choice(odd if rnd.random() < 0.5 else list("abc Xyz.")) for _ in range(rnd.randrange(0, 30))) for _ in range(1500)]
    base = pb.ModelProto()
    with open(str(public_tokenizers.path("piece_bpe_32k.model")), "rb") as f:
        base.ParseFromString(f.read())
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
        spec = pb.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
        own = piece_codec.Normalizer(spec.normalizer_spec.precompiled_charsmap, True, True, True)
        for t in texts:
            out, align = own(t)
            assert out.decode() == library.normalize(t), (rule, t)
            assert len(align) == len(out) + 1 and (np.diff(np.asarray(align)) >= 0).all()

def test_token_files_of_an_empty_table(spark):
    manifest, dictionary = token_output.write_tokens(_docs(spark, []), str(public_tokenizers.path("word_bpe_49k.json")))
    assert token_output.read_tokens(spark, manifest, dictionary).collect() == []


def test_pieces_equal_the_library(spark, sf_dir):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert piece_codec.codec(path).cuttable
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in piece_codec.digest_documents(_docs(spark, texts), path).collect()}
    full = {r.doc_id: r for r in piece_codec.encode_documents(_docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert full[i].ids == ids, (i, t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(np.asarray(ids, "<u4").tobytes())
        assert got[i].decoded_sha256 == sha(sp.decode(ids).encode())
        data = (t or "").encode()
        spans = list(zip(full[i].starts, full[i].ends, strict=True))
        assert b"".join(data[a:b] for a, b in spans) == data
        for piece, (a, b) in zip(sp.id_to_piece(ids), spans, strict=True):
            if piece.startswith("<"):
                continue
            source = data[a:b].decode().replace(" ", piece_codec.MARK)
            assert source == piece or piece_codec.MARK + source == piece


def _darts(keys):
    """A double array for ``keys`` (bytes -> value), built by plain search for free slots."""
    trie = {}
    for k, v in keys.items():
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[None] = v
    units, used = [0] * (1 << 16), {0}

    def place(at, node):
        labels = [0 if c is None else c for c in node]
        off = next(o for o in range(256, 1 << 15, 256) if all((at ^ o ^ c) not in used for c in labels))
        base = at ^ off
        units[at] |= (off << 10) | ((1 << 8) if None in node else 0)
        used.update(base ^ c for c in labels)
        for c in node:
            if c is None:
                units[base] = node[None] | (1 << 31)
            else:
                units[base ^ c] |= c
        for c in node:
            if c is not None:
                place(base ^ c, node[c])

    place(0, trie)
    return np.asarray(units, "<u4").tobytes()


def test_character_map_and_alignment():
    texts, keys = b"", {}
    for k, v in {"Ａ": "A", "①": "1", "fí": "F", "f": "g", "　": " ", "½": "1 2"}.items():
        keys[k.encode()] = len(texts)
        texts += v.encode() + b"\0"
    trie = _darts(keys)
    blob = len(trie).to_bytes(4, "little") + trie + texts
    normal = piece_codec.Normalizer(blob, True, True, True)
    out, align = normal("  Ａfíf　　x½ ")
    mark = piece_codec.MARK
    assert out.decode() == f"{mark}AFg{mark}x1{mark}2"
    assert list(align) == [2, 2, 2, 2, 5, 9, 10, 10, 10, 16, 17, 17, 17, 17, 17, 19]
    assert normal("   ")[0] == b""
    out, align = piece_codec.Normalizer(blob, False, False, False)("f ①")
    assert out == b"g 1" and list(align) == [0, 1, 2, 5]


def test_words_are_tokenised_together_and_chunks_only_once():
    import random

    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok, rnd = Tokenizer.from_file(path), random.Random(9)
    words = ["".join(rnd.choice("abcdeéßñªºµÿ") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(words), "x" * 5000 + " " + ". ".join(words) + ".", "y" * 100 + "! z"]
    token_output._tokenizers.clear()
    cache, asked = token_output._cache(path), []
    encode = cache.encode
    cache.encode = lambda chunks: asked.extend(chunks) or encode(chunks)
    for _ in range(2):
        for t, ids in zip(texts, token_output.encode_texts(texts, path, 1), strict=True):
            assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]
    assert len(asked) == len(set(asked)) + 2  # only the two long chunks are asked for again
    before, split = len(asked), cache.split
    cache.split = lambda chunk: pytest.fail("a kept chunk was split again") if len(chunk) <= cache.longest else split(chunk)
    token_output.encode_texts(texts[:1] + [". ".join(words) + "."], path, 1)
    cache.split = split
    assert len(asked) == before
