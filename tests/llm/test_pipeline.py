"""The pipeline against brute-force versions of its stages."""

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.pieces import Codec, Vocabulary, default_model

from .test_decontam import brute as leaked
from .test_neardup import brute as grouped
from .test_quality import brute as measured
from .test_secrets import brute as secret_spans


def test_pipeline(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{src}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, src).collect()}
    keep = {}
    for i, t in docs.items():
        n, chars, symbols, dups, repeats = measured(t)
        m = quality.measure(t)
        bad = n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or 2 * m[6] > n or 2 * m[7] > m[8] or (dups >= 3 and 2 * dups > m[5]) or not 2 * n <= chars <= 15 * n
        if not bad:
            keep[i] = t
    keep = {i: keep[i] for i, _, c in grouped(list(keep.items())) if i == c}
    keep = {i: t for i, t in keep.items() if not any(leaked(t, x) for x in items)}
    assert set(rows) == set(keep) and 0 < len(keep) < len(docs)
    codec = Codec(Vocabulary.load(default_model()))
    for i, t in keep.items():
        out, at = "", 0
        for s, _, k, e in secret_spans(t):
            if s >= at:
                out, at = out + t[at:s] + f"<{k}>", e
        assert codec.decode(bytes(b for x in rows[i].ids for b in x.to_bytes(4, "little"))) == out + t[at:]


def test_stages_on_odd_tables(spark):
    d = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x " * 30, "en", "s", 60)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            assert out.count() <= 3 and (name == "sentencepiece" or out.columns == d.columns)
