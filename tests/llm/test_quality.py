from collections import Counter

import pytest

from tessera.llm import quality
from tessera.llm._common import WORD


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    rep = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


TEXTS = [None, "", " \n\t\n", "a b c d e f g h a b c d e f g h", "x " * 40, "é ü # | \x1c z\x1dq\nz\n\nz\n \nz", "a\x0bb\x0cc\rd\n\x1c\n\x1c", "1 2 3 4 5 6 7 8 9 " * 2 + "end", "wort " * 30000]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert quality.measure(text)[:5] == brute(text)


def test_ledger_and_ablation(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "good " * 3, None, 1)] * 2 + [(99, " ".join(f"wort{i}" for i in range(50)), "y", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    out = {r.doc_id: r for r in quality.judged(d).collect()}
    assert len(out) == len(TEXTS) + 2 and out[99].kept and not out[8].kept and out[8].base_failed
    assert quality.kept(d).collect() == [rows[-1]]
    led = quality.ledger(d).cache()
    ab = {r.rule: r for r in quality.ablation(led, 2).collect()}
    bits = [r.fail_bits for r in led.collect()]
    for rule, r in ab.items():
        others = quality.mask(2) & ~quality.BIT[rule]
        assert r.n_failed == sum(b & quality.BIT[rule] > 0 for b in bits)
        assert r.n_kept_without == sum(b & others == 0 for b in bits)
        assert r.n_only == sum(b & quality.mask(2) == quality.BIT[rule] for b in bits)
    assert quality.judged(d.limit(0)).count() == 0


def test_clashing_columns_and_stored_ledger(spark, tmp_path):
    text = " ".join(f"wort{i}" for i in range(50))
    d = spark.createDataFrame([(1, text, 5, 6, "t", "r", {"a": 1}), (2, "x", 7, 8, "u", "s", None)], "doc_id long, text string, fail_bits int, n_lines int, __text string, row string, m map<string, int>")
    assert quality.kept(d).collect() == d.where("doc_id = 1").collect()
    with pytest.raises(ValueError):
        quality.ledger(d, ("doc_id", "fail_bits"))
    led = quality.store(d, f"{tmp_path}/ledger")
    assert quality.ablation(led, 1).count() == 2 and led.where(quality.verdict(2)).select("doc_id").collect() == [(1,)]
