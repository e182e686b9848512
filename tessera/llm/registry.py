"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, katz, langid, neardup, pieces, pii, quality, secrets, urls
from ._common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.tokenize(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLES: dict[str, str] = {}

ORACLES["op5_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 7) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters
      FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 20 AS f0, 100 * n_repeat_words > 30 * n_words AS f1, 10 * n_symbols > n_words AS f2,
             2 * n_exclaims > n_words AS f3, 2 * n_upper > n_letters AS f4,
             n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines AS f5,
             word_chars > 15 * n_words OR word_chars < 2 * n_words AS f6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
       CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT AS BIGINT) AS fail_bits,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_exclaims AS BIGINT) AS n_exclaims, CAST(n_upper AS BIGINT) AS n_upper, CAST(n_letters AS BIGINT) AS n_letters
FROM f
"""

ORACLES["op2_url_filter"] = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
p AS (SELECT rid, page_id,
             CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(act, rh, rp)),
m AS (SELECT rid, act, rh || rp AS rule FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC) = 1)
SELECT page_id, host, path, rule,
       coalesce(act, CASE WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$')
                          THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (rid)
"""

ORACLES["op7_minhash_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS joint FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * joint >= 75 * (na.n + nb.n - joint)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.x = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
