import random
import time

import numpy as np
import pytest
import sentencepiece

from tessera.llm import pieces

ODD = [
    "", "  Hello   world\n\tfoo  bar ﬁ ", " ", "   ", "日本語 中文", "👍👍 x", "<s> </s> <0x0A> <unk>", "\x00\x01", "a" * 3000, "ab" * 500, "ééé", "  " * 40 + "x", "\n\n\n", " \n \n", "´é", "x\x1cy 12,3 4.5",
]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Vocabulary.load(pieces.default_model()))


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_equals_the_library_and_goes_round(spark, codec):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    for text, got in zip(texts, codec.encode(texts)):
        assert ids(got) == sp.encode(text)
        assert codec.decode(got) == text
    assert codec.decode(codec.encode(["a▁b"])[0]) == "a b"


def test_a_million_letters_without_a_space(codec):
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = "".join(r.choice(words) for _ in range(190_000))[:1_000_000]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    at = time.time()
    got = codec.encode([text])[0]
    assert time.time() - at < 60
    assert ids(got) == sp.encode(text) and codec.decode(got) == text


def test_edges_are_all_occurrences(codec):
    text = "the\0 then\0théa\0 international\0 internationalx\0".replace(" ", pieces.SPACE)
    codes = np.array([ord(c) for c in text])
    table, top = codec.matcher.edges(codes), codec.v.longest
    got = {(i // top, codec.v.normal[p]) for i, p in enumerate(table.tolist()) if p >= 0}
    vocab = set(codec.v.normal)
    assert got == {(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + top) + 1) if text[i:j] in vocab}
    assert all(len(codec.v.normal[p]) == i % top + 1 for i, p in enumerate(table.tolist()) if p >= 0)


def test_query(spark, sf):
    from tessera.llm.registry import op8_sentencepiece

    rows = op8_sentencepiece(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.round_trip for r in rows)
    d = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "x▁y", 3)], "doc_id long, text string, ids int")
    out = pieces.tokenize(d).collect()
    assert [(len(r.ids), r.round_trip) for r in sorted(out, key=lambda r: len(r.ids))] == [(0, True), (0, True), (len(out[-1].ids), False)]
    assert pieces.tokenize(d.limit(0)).count() == 0
