import random

import numpy as np
import pytest

from tessera.llm import neardup
from tessera.llm._common import WORD, Scratch


def plain(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    rows, i = [], 1000
    for _ in range(groups):
        base = [word() for _ in range(r.choice((1, 3, 5, 6, 9, 40, 120, 300)))]
        for _ in range(r.choice((1, 1, 2, 5, 12))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                w[r.randrange(len(w))] = word()
            rows.append((i := i - r.randint(1, 3), r.choice((" ", "  \n", "\t")).join(w)))
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = [*corpus(seed), (5000, None), (5001, ""), (5001, " \n "), (None, "a b c"), (None, "a b c"), (7, "A b C"), (7, "other words here of another text")]
        d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, key int")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(d).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_hashes():
    for t in (None, "", "a", "A b\tc\x0bd E f", "x y z " * 50, "ü ö " * 9, "a\x1cb c"):
        assert len(neardup.shingles(t)) == len(plain(t))
    a, b = set(range(1000)), set(range(100, 1100))
    mix = lambda x: neardup._mix(np.array(sorted(x), np.uint64))
    same = (neardup.minima(mix(a)) == neardup.minima(mix(b))).mean()
    assert abs(same - 900 / 1100) < 0.15


@pytest.mark.parametrize("part", [100_000, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 301), (301, 300), (302, 302)]
    r.shuffle(edges)
    got = {x.node: x.root for x in neardup.components(Scratch(spark), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(80)}, 300: 300, 301: 300}


def test_kept_and_empty(spark):
    d = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, None, "z"), (None, "q", "n"), (1, "a b c d e f", "y")], "doc_id long, text string, component_id string")
    assert sorted(r.component_id for r in neardup.kept(d).collect()) == ["n", "y", "z"]
    assert neardup.link(d.limit(0)).count() == 0 and neardup.kept(d.limit(0)).count() == 0


def test_link_behind_many_closer_candidates(spark):
    """All pairs are at 0.745 but x and y at 0.76, which agree in fewer bytes of the signature than the others."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    x = [word() for _ in range(100)]

    def changed(*at):
        return " ".join(word() if i in at else w for i, w in enumerate(x))

    def shared(t):
        s, bands = neardup.signature(neardup.minima(neardup.shingles(t)))
        return not bands[0] == bx[0], sum(bands == bx), sum(a == b for a, b in zip(s, sx))

    sx, bx = neardup.signature(neardup.minima(neardup.shingles(" ".join(x))))
    rows = [(10, " ".join(x)), (20, min((changed(2, 40, 70) for _ in range(400)), key=shared))]
    rows += [(100 + i, changed(3, 40, 70)) for i in range(150)]
    want = sorted(brute(rows))
    assert [d for d, _, c in want if c != d] == [20]
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((d.doc_id, d.n_shingles, d.component_id) for d in got) == want


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(n)]


def swapped(r, base, *at):
    w = list(base)
    for i in at:
        w[i] = words(r, 1)[0]
    return " ".join(w)


def test_only_link_among_hundreds_just_below(spark):
    """Four groups: x is linked with y alone (0.761), and y with 700 others that x is at 0.745 from."""
    r, rows, want = random.Random(8), [], {}
    for g in range(4):
        base, at = words(r, 100), 10_000 * (4 - g)
        rows += [(at + i, swapped(r, base, 0)) for i in range(700)] + [(at + 800, " ".join(base)), (at + 900, swapped(r, base, 30, 60, 97))]
        want |= dict.fromkeys([at + 800, at + 900, *range(at, at + 700)], at)
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {d.doc_id: d.component_id for d in got} == want


def exact(sets):
    """Components by all pairs, as dense sums."""
    place = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    n = m.sum(1)
    both = m @ m.T
    link = 100 * both >= 75 * (n[:, None] + n - both)
    root = np.arange(len(sets))
    while True:
        new = np.array([root[row].min() for row in link])
        if (new == root).all():
            return root.tolist()
        root = new


@pytest.mark.parametrize("group", [10_000_000, 1000])
def test_group_of_thousands_equals_exact_search(spark, monkeypatch, group):
    """Copies of one text at all distances around the threshold: as one cell in blocks, and with a cell for each bucket."""
    monkeypatch.setattr(neardup, "BLOCK", 20_000)
    monkeypatch.setattr(neardup, "GROUP", group)
    r = random.Random(5)
    base = words(r, 90)
    rows = [(i, swapped(r, base, *r.sample(range(90), r.choice((1, 2, 3, 4, 5))))) for i in range(2000 if group > 1000 else 400)]
    want = exact([plain(t) for _, t in rows])
    got = {d.doc_id: d.component_id for d in neardup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    recall = sum(got[i] == c for i, c in enumerate(want)) / len(want)
    assert recall == 1 and len(set(want)) > len(want) / 10


def test_kept_tells_rows_of_one_id_apart(spark):
    d = spark.createDataFrame(
        [(1, "a b c d e f", 1, {"k": 1}), (1, "u v w x y z", 2, {"k": 2}), (2, "u v w x y z", 3, None), (None, "one two", 4, None), (None, "one two", 5, None), (None, " ", 6, None), (None, None, 7, None), (3, "", 8, None), (3, None, 8, None), (1, None, 9, None)],
        "doc_id long, text string, `key` int, `row` map<string, int>",
    )
    got = sorted((r.doc_id, r.key) for r in neardup.kept(d).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 2), (1, 9), (3, 8)]
    none = sorted(r.key for r in neardup.kept(d).collect() if r.doc_id is None)
    assert none in ([4, 6, 7], [5, 6, 7])
