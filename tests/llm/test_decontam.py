import random

from tessera.llm import decontam


def brute(text, item):
    """Share of the item's shingles in the whole text; parts as in the operator."""
    d, c = decontam.terms(text), decontam.terms(item)
    size = min(decontam.SHINGLE, len(c))
    if not size:
        return False
    has = {tuple(d[i : i + size]) for i in range(len(d) - size + 1)}
    q, a = decontam.Index._shingles(c)
    nq, na = len(q & has), len(a & has)
    return nq + na >= 0.75 * (len(q) + len(a)) and nq >= 0.5 * len(q) and na >= 0.5 * len(a)


def test_query_equals_brute_force(spark):
    from tessera.llm.registry import op3_decontamination

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, sf).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if brute(t, x)} and got


def test_planted():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.choice((3, 8, 30, 60, 100, 300))))) for i in range(120)]
    index = decontam.indexes(items)
    for i, text in items:
        w = text.split()
        fill = lambda n: " ".join(word() for _ in range(n))
        assert i in {x[1] for x in decontam.leaks_in([fill(r.randint(0, 300)) + " " + text.upper().replace(" ", ", ") + " " + fill(99)], index)}
        if len(w) >= 60:
            w[len(w) // 2] = "changed"
            assert i in {x[1] for x in decontam.leaks_in([fill(77) + " " + " ".join(w) + " " + fill(9)], index)}
            assert i not in {x[1] for x in decontam.leaks_in([" ".join(w[: len(w) // 2])], index)}
            assert i not in {x[1] for x in decontam.leaks_in([" ".join(reversed(w))], index)}
    assert not decontam.leaks_in([None, "", "!!", fill(500)], index) and not decontam.indexes([(1, None), (2, "?")])


def test_bound_loses_nothing():
    """Every item at or above the threshold in a passage is scored: the block bounds are no smaller than any score."""
    r = random.Random(9)
    items = [(i, " ".join(r.choice(["aa", "bb", "cc", f"w{r.randint(0, 60)}"]) for _ in range(30))) for i in range(60)]
    (index,) = decontam.indexes(items)
    for k, (_, text) in enumerate(items):
        own = {index.vocab[w] for w in decontam.terms(text)}
        per = index.bound[sorted(own)].sum(axis=0)
        for j in range(60):
            score = sum(index.weight[p] for t in own for p in range(index.start[t * index.blocks], index.start[(t + 1) * index.blocks]) if index.item[p] == j)
            assert score <= per[index.block_of[j]] * 1.001


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, 1), (None, "a b c d e f g h", 2), (3, "", 3), (None, "a b c d e f g h", 2)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(7, "A b, c d e f g h"), (None, None), (8, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()] == [(None, 7)] * 2
    assert decontam.leaks(d, b.limit(0)).count() == 0 and decontam.leaks(d.limit(0), b).count() == 0
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [1, 3]


def test_scores_do_not_depend_on_rounds(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MAX_INDEX", 3_000)
    assert len(list(decontam._rounds(bench))) > 2
    more = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in more] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(one, more))
