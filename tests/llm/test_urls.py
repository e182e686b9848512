import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import urls


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, *max(fit)[2:]
    bad = any(host == h or host.endswith("." + h) for h in urls.LISTED)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "example.org/es/", "http://EXAMPLE.org/es/x", "http://a.example.org/en/12?x", "http://a.example.org/en/2", "https://org/", "https://org", "x://notorg/", "http://a.b.com/de/", "http://com/fr/",
    "http://com/de", "http://www.casino-win.example.com/en/", "http://casino-win.example.com/fr/", "http://spam-farm.example.org", "http://xspam-farm.example.net/", "http://..org/a", "http://É.Org/\n/b", "a://b://c.org/",
    "http:///de/", "http://user@h.com:80/de/1", "http://" + "a." * 5000 + "com/de/",
]


def test_judge(spark):
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[3], "h")] * 2, "page_id long, url string, host string")
    out = urls.judge(d).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = URLS[3] if r.page_id is None else URLS[r.page_id]
        h, p, rule, v = brute(url)
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, v), url
    assert urls.judge(d.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.3])
def test_cascade_is_exact(spark, share):
    keys = spark.range(20000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("s")).alias("h2"), (F.col("id") % 1000 < 1000 * share).alias("in")).cache()
    p = keys.toPandas()
    h1, h2, inside = p.h1.to_numpy().view(np.uint64), p.h2.to_numpy().view(np.uint64), p["in"].to_numpy()
    for c in (urls.build((h1[inside], h2[inside]), keys), urls.build_small((h1[inside], h2[inside]), (h1, h2))):
        assert (c.contains(h1, h2) == inside).all() and len(c.levels) > 1
    assert urls.build((h1[:0], h2[:0]), keys).contains(h1, h2).sum() == 0
