import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import katz
from tessera.llm._common import WORD


def toks(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts):
        self.u, self.b = Counter(), Counter()
        for t in texts:
            w = toks(t)
            self.u.update(w)
            self.b.update(zip(["<s>", *w[:-1]], w))
        self.n = sum(self.u.values())
        self.hist = Counter()
        for (h, _), c in self.b.items():
            self.hist[h] += c
        of = lambda c: [sum(c.values()), len(c), *(sum(v == r for v in c.values()) for r in range(1, katz.CUT + 2))]
        self.du, self.db = katz.discounts(of(self.u)), katz.discounts(of(self.b))
        kept = sum(self.d(self.du, c) * c for c in self.u.values())
        self.over = self.n if any(c <= katz.CUT for c in self.u.values()) else self.n + 1
        self.left = 1 - kept / self.over if self.over else 1.0
        self.follow = {}
        for (h, w), c in self.b.items():
            self.follow.setdefault(h, {})[w] = c

    @staticmethod
    def d(d, c):
        return d[min(c, katz.CUT + 1)]

    def p1(self, w):
        return self.d(self.du, self.u[w]) * self.u[w] / self.over if w in self.u else self.left

    def p(self, h, w):
        if h not in self.follow:
            return self.p1(w)
        f = self.follow[h]
        over = self.hist[h] + (0 if any(c <= katz.CUT for c in f.values()) else 1)
        if w in f:
            return self.d(self.db, f[w]) * f[w] / over
        return (1 - sum(self.d(self.db, c) * c for c in f.values()) / over) / (1 - sum(map(self.p1, f))) * self.p1(w)

    def score(self, t):
        w = toks(t)
        return sum(math.log10(self.p(h, x)) for h, x in zip(["<s>", *w[:-1]], w)), sum(math.log10((self.u[x] + 0.5) / (self.n + 0.5 * (len(self.u) + 1))) for x in w)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check(spark, rows):
    d = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    m = Plain([t for i, t in rows if not held(i)])
    out = katz.score(d).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out), key=str)
    want = sorted(((i, len(toks(t)), sum(x in m.u for x in toks(t)), round(m.score(t)[1], 6), round(m.score(t)[0], 6)) for i, t in rows), key=str)
    assert got == want and all(r.held_out == held(r.doc_id) and r.train_tokens == m.n for r in out)
    return m


def test_equals_plain_model_and_is_normalised(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abÉ") for _ in range(min(5, int(r.expovariate(0.6)) + 1)))
    rows = [(i, " ".join(["Hot"] * r.randint(0, 9) + [word() for _ in range(r.randint(0, 60))])) for i in range(150)] + [(None, None), (3, "a b"), (3, "a b"), (500, ""), (501, "new \x1c words")]
    m = check(spark, rows)
    for h in ["<s>", "hot", "a", "zzz", *r.sample(sorted(x for x in m.u if x), 5)]:
        assert sum(m.p(h, w) for w in m.u) + m.p(h, "unknown word") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("rows", [[(1, "a b c")], [(1, None)], [(i, "x y " * 40) for i in range(30)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_empty_and_packing(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for x in ([], [0], [5, 1 << 40, 3], list(range(999))):
        assert katz.unpack(katz.pack(np.array(x, np.int64))).tolist() == x


def test_query(spark, sf):
    from tessera.llm.registry import op9_lm_score

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    m = Plain([t for i, t in docs.items() if not held(i)])
    for r in op9_lm_score(spark, sf).collect():
        assert (r.score, r.base_score) == pytest.approx(m.score(docs[r.doc_id]), rel=1e-9)
