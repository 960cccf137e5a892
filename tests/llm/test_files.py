from __future__ import annotations

import io
import json
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import pieces, tokenbin, warc

ODD = ["", " ", "Don't STOP's 'tis", "a\xa0b\x1cc d", "<|endoftext|> x", "é, É́! ñ,ñ.", "×a÷ İstanbul ſ_ß", "a_b c__ d'e ''s", "日本語,text 😀😀. ½", "A.B.C... $5,000.00%", "  a  b ", "\n\n", "▁ marker a▁b", "<s> </s> <0x41>", "\x00\x01", "a" * 700]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("vocabulary", [2, 3, 256, 257, 49408, 50257, 1 << 20])
def test_packing_round_trip_and_random_access(vocabulary):
    rng = np.random.default_rng(vocabulary)
    width = tokenbin.bit_width(vocabulary)
    assert (1 << width) >= vocabulary > (1 << width - 1) or vocabulary == 2
    docs = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 1, 7, 100, 0, 333, 64, 5)]
    sink = Bytes()
    writer = tokenbin.Writer(sink, width, block_ids=64)
    for i, d in enumerate(docs):
        writer.add(None if i == 2 else i, d)
    assert writer.close() == sum(map(len, docs))
    reader = tokenbin.Reader(sink)
    stream = np.concatenate(docs)
    assert [(k, ids.tolist()) for k, _, ids in reader.documents(batch_ids=50)] == [(None if i == 2 else i, d.tolist()) for i, d in enumerate(docs)]
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(stream) + 1, 2))
        assert (reader.ids(a, b) == stream[a:b]).all()
    with pytest.raises(ValueError):
        tokenbin.Writer(Bytes(), width).add(1, np.array([1 << width], np.uint32))


def test_word_encoder_equals_the_tokenizer():
    whole, own = Tokenizer.from_file(path("word_bpe_49k.json")), tokenbin.WordEncoder(path("word_bpe_49k.json"))
    rng = random.Random(1)
    odd = ["".join(rng.choice("aBé'.,!_-<|>1½ \n\xa0ß́⃝😀") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text in ODD + odd:
        assert own([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_every_letter_before_punctuation_equals_the_tokenizer():
    whole, own = Tokenizer.from_file(path("word_bpe_49k.json")), tokenbin.WordEncoder(path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
    texts = ["GELDİ!", "DENEYİ.", "İİ,İ;", *(f"{before}{c}{mark}{after}" for c in letters for before in ("", "ab") for after in ("", "!") for mark in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")]
    wrong = [t for t, ids, e in zip(texts, own(texts), whole.encode_batch(texts, add_special_tokens=False)) if ids.tolist() != e.ids]
    assert wrong == []


def test_token_files(spark, documents):
    rows = [(5, "five words are in here"), (3, None), (None, "no key"), (9, ""), (5, "another text"), (5, "five words are in here"), (1, "long text " * 20_000), *((i, f"text number {i}") for i in range(20, 60))]
    docs, model = documents(rows, extra=True).repartition(3), path("word_bpe_49k.json")
    manifest = tokenbin.write_token_files(docs, lambda: tokenbin.word_encoder(model), tokenbin.vocabulary_size(model), end_id=2)
    got = sorted(tokenbin.read_token_files(manifest, 4).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(model)
    ids = {t: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        values = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(values) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += len(values)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(k), ids[t]) for k, t in rows)
    empty = tokenbin.write_token_files(documents([]), lambda: tokenbin.word_encoder(model), 49408)
    assert tokenbin.read_token_files(empty, 2).collect() == []


def test_piece_codec_equals_sentencepiece():
    codec, real = pieces.Codec(path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aBé.,  \n\t▁日😀x1") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids = [i.tolist() for i in codec.encode(texts)]
    assert ids == real.encode(texts)
    assert codec.decode(ids) == real.decode(ids)
    assert all(codec.restores(t, i) for t, i in zip(texts, ids))
    codec.cut = None  # whole texts at once give the same
    assert [i.tolist() for i in codec.encode(texts[:100])] == ids[:100]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3 | 5) + np.float32(v).tobytes() if isinstance(v, float) else varint(k << 3) + varint(v) for k, v in fields)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_built_by_hand(tmp_path, fallback):
    """Pieces and scores written down here; the sentencepiece library says what they mean."""
    words = [("▁", -3.0), ("a", -4.0), ("b", -4.1), ("ab", -5.0), ("▁a", -4.5), ("▁ab", -6.0), ("c", -4.2), ("bc", -5.5), ("▁abc", -9.0), ("é", -7.0)]
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else []) + [(p, s, 1) for p, s in words]
    model = message(*((1, message((1, p.encode()), (2, float(s)), (3, kind))) for p, s, kind in kinds), (2, message((3, 1), (35, int(fallback)))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    file = tmp_path / "tiny.model"
    file.write_bytes(model)
    codec, real = pieces.Codec(str(file)), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["abc ab", "  a  b ", "cab abc é", "abcabc bca", "", "a x b", "😀 a"]
    assert [i.tolist() for i in codec.encode(texts)] == real.encode(texts)
    if fallback:
        assert codec.decode(codec.encode(texts)) == real.decode(real.encode(texts))


def test_pieces_of_a_table(spark, documents):
    rows = [(1, "Hello world"), (2, None), (None, ""), (3, "日本 \U00013000"), (1, "Hello world"), (4, "long text " * 20_000)]
    got = pieces.encode(documents(rows, extra=True), path("piece_bpe_32k.model")).collect()
    real = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    assert sorted((str(r.doc_id), r.ids, r.ids_crc32, r.n_tokens) for r in got) == sorted((str(k), i, zlib.crc32(np.array(i, "<u4").tobytes()), len(i)) for k, i in ((k, real.encode(t or "")) for k, t in rows))
    assert all(r.restored for r in got) and sum(r.n_bytes for r in got) > 0
    assert pieces.encode(documents([]), path("piece_bpe_32k.model")).collect() == []


def test_warc_derivatives(spark):
    page = '<title>A &amp; B</title><p>Text <a href="/x">one</a> <a href=\'http://other/y\'>two</a></p>'
    rows = [(1, "http://h/é?q=1", page), (1, "http://h/é?q=1", page), (2, None, None), (None, "http://h/\r\nX-Evil: 1", ""), (3, "http://[bad", '<a href="z">z</a>'), (4, "http://h/long", "<p>" + "word " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as path", "'y' as folder").repartition(3)
    responses = warc.write_responses(pages)
    sources = {r.id: r for r in warc.read_files(responses, 2).collect()}
    assert len(sources) == 6 and all(r.type == "response" and r.digest_ok for r in sources.values())
    derived = warc.read_files(warc.build_derivatives(responses, 2), 2).collect()
    meta = {r.refers_to: r for r in derived if r.type == "metadata"}
    text = {r.refers_to: r for r in derived if r.type == "conversion"}
    assert set(meta) == set(text) == set(sources) and len({r.id for r in derived}) == 12
    for source, r in sources.items():
        about = json.loads(bytes(meta[source].block))
        assert text[source].concurrent_to == meta[source].id and meta[source].digest_ok and text[source].digest_ok
        assert about["Payload-Digest-Verified"] and about["Block-Digest-Verified"] and about["Source-Headers"] == r.fields
        assert about["HTTP-Headers"]["Content-Type"] == "text/html; charset=utf-8"
        assert text[source].fields["X-Source-WARC-Payload-Digest".replace("WARC-", "")] == r.fields["WARC-Payload-Digest"]
        assert text[source].target == r.target and text[source].key == r.key
    first = next(s for s, r in sources.items() if r.key == "1")
    about = json.loads(bytes(meta[first].block))
    assert about["Title"] == "A & B" and about["Links"] == ["http://h/x", "http://other/y"] and bytes(text[first].block) == b"A & B\nText one two" or bytes(text[first].block) == b"Text one two"
    none = next(r for r in sources.values() if r.key == "2")
    assert none.target == "urn:x-none:" and bytes(text[none.id].block) == b""
    assert next(r for r in sources.values() if r.key is None).target == "http://h/%0D%0AX-Evil: 1"
    assert warc.read_files(warc.write_responses(pages.where("false")), 2).collect() == []


def test_cut_records_raise():
    data = warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<a>")], b"block")
    assert [b for _, b in warc.read_records(io.BytesIO(data + data))] == [b"block"] * 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-12])))


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("ne", "la", "ti", "mu", "bo", "ri", "ga")]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n))
    clean = [(i, prose(8), "en", "s", 0) for i in range(30)]
    item = " ".join(rng.choice(vocabulary) for _ in range(25))
    near = clean[3][1].replace("\n", " ").split()
    near[5] = "other"
    rows = [*clean, (100, clean[0][1], "en", "s", 0), (101, " ".join(near), None, "s", 0), (102, "1234 !!", "en", "s", 0), (103, prose(2) + "\n" + item, "en", "s", 0), (104, None, "en", None, None), (105, clean[3][1].replace("\n", " "), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r.doc_id for r in docs.collect()) == [*range(30)]  # 101 and 105 are 3 but for a word
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [*range(30)] and all(r.restored and r.n_tokens == len(r.ids) for r in out)
