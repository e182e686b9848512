import random
import zlib

import numpy as np
import pytest

from tessera.llm import langid


def brute(text, learned):
    """Longest phrases by substring search; a byte that the language doesn't have begins a phrase and is not looked for."""
    x = langid.normal(text.encode()).tobytes()
    n, cur = 0, b""
    for i in range(len(x)):
        c = x[i : i + 1]
        if i and cur + c in learned:
            cur += c
        else:
            n, cur = n + 1, c if c in learned else b""
    return n


@pytest.mark.parametrize("piece", [langid.PIECE, 16, 5])
def test_phrases_equal_substring_search(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    learned = {"a": b"the cat sat on the mat and the hat ", "b": "der hund über die straße und ".encode()}
    m = langid.Model(learned)
    r = random.Random(2)
    texts = ["the mat", "über den hund!!! 12", "zzz", "The CAT sat " * 200, "é", "".join(learned["a"].decode() for _ in range(9)), " ".join(r.choice("the cat hat und die der sat straße x".split()) for _ in range(900))]
    got = m.phrases([t.encode() for t in texts])
    assert got.tolist() == [[brute(t, learned[k]) for k in m.langs] for t in texts]
    assert m.predict(["the hat", None, "12 !", "", "über"])[0] == ["a", "und", "und", "und", "b"]


def test_whole_texts_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 120)
    rows = [("en", "the cat sat on the mat " * 2)] * 3 + [("en", "a dog ran home " * 2), ("de", "der hund " * 99), ("de", "die lange straße " * 50)]
    d = spark.createDataFrame(rows, "lang string, text string")
    m = langid.learn(d)
    assert m.langs == ["de", "en"]
    # of en both texts, once each; of de, where none fits, the shortest one whole
    assert [round(np.exp(w)) for w in m.weights] == [len("der hund " * 99), 76]


def test_automaton_has_all_substrings():
    codes = np.random.default_rng(1).integers(0, 3, 60).tolist()
    t = langid.suffix_automaton(codes, 3)
    subs = {tuple(codes[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for s in list(subs)[:800]:
        state = 0
        for c in s:
            state = t[state, c]
            assert state >= 0


def test_query(spark):
    from tessera.llm.registry import op6_language_id

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.98


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, "en", 1.0), (None, "abc", None, 2.0), (3, "", "x", 1.0), (3, "", "x", 1.0), (4, "some words here", "en", 0.0)], "doc_id long, text string, lang string, score double")
    rows = langid.identify(d).collect()
    assert len(rows) == 5 and {r.lang_pred for r in rows if r.doc_id in (1, 3)} == {"und"}
    assert langid.identify(d.limit(0)).count() == 0
