import re

from tessera.llm import pii
from tessera.llm._common import digest, sha256

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = [int(c) for c in m[0] if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m[0].split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    return sorted((m.start(), r, k, m.end()) for r, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(k, m))


TEXTS = [
    None, "", "é a@b.c_d@e.f g@h..i x@y.z.w", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.1.1.9999 000000000000.1.1.1", "ññ 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (499) 555-6503 +49 30 123 ++1 23456789012 +1234567890123456 +12345678901.", "1" * 30000 + " " + "1-" * 20000 + "@" * 50, "a." * 20000 + "@x.y", "49927398716 378282246310005 6011111111111117 +6011 1111 1111 1117",
    "word\n" * 20 + "call (555) 123-4567 now", "a@b.c" * 3, "x@y.z\n1.1.1.1\n", "\x1c+1\x1c23 𝒳 a@b.co 10.0.0.1",
]


def test_base_equals_plain_expressions(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], 1)] * 2, "doc_id long, text string, base int")
    rows = pii.detect(d).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        b = brute(TEXTS[2 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == sha256(digest(b)), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in b) for k in PLAIN]
        assert not b or set(digest(b).split(",")) <= set(r.spans.split(","))
    assert "phone:105:119" in next(r.spans for r in rows if r.doc_id == 9)
    assert pii.detect(d.limit(0)).count() == 0


def test_held_out_precision_and_recall(spark):
    trees, limits = pii.model(spark)
    lines = spark.createDataFrame(pii.sample(1500, seed=11), "t string, label int")
    rows = pii._prepared(lines).select("label", pii._candidates().alias("c")).where("size(c) = 1").selectExpr("label", "c[0].f as f").collect()
    import numpy as np

    x, y = np.array([r.f for r in rows], float), np.array([r.label for r in rows])
    got = sum(pii._apply(t, x) for t in trees) >= np.vectorize(limits.get)(x[:, 0])
    assert (y[got] == 1).mean() > 0.95 and got[y == 1].mean() > 0.7


def test_native_plan(spark, sf):
    from tessera.llm.registry import op1_pii

    d = op1_pii(spark, sf)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in d.collect():
        assert r.base_sha256 == sha256(digest(brute(texts[r.doc_id])))
