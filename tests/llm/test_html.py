import itertools
import re

import pytest

from tessera.llm import html


@pytest.fixture(scope="module")
def model():
    return html.Model.train(html.labelled_pages(300))


def test_held_out_share(model):
    wrong = total = 0
    for page in html.labelled_pages(80, seed=41):
        t = html.Tree(page)
        for i in range(1, len(t.parent)):
            if t.label[i] < 0:
                t.label[i] = t.label[t.parent[i]]
        u = html.Tree(re.sub(r" data-label=\d", "", page))
        p = model.marginals(u)
        for node, _, s in u.pieces:
            if u.group[node] != html.INDEX["hidden"]:
                total += len(s)
                wrong += len(s) * ((p[node] >= 0.5) != (t.label[node] == 2))
    assert wrong / total < 0.03


def test_marginals_equal_enumeration(model):
    t = html.Tree("<body><nav><ul><li><a>x</a></ul></nav><article><h1>T</h1><p>Some text, of a sort.</article></body>")
    n = len(t.parent)
    total, content = 0.0, [0.0] * n
    for y in itertools.product(range(3), repeat=n):
        if y[0] == 0:
            continue
        w = 1.0
        for i in range(1, n):
            a, b = t.shows(i)
            w *= model.edge[y[t.parent[i]]][y[i]] * model.kind[t.group[t.parent[i]]][a][y[i]] * model.shape[t.group[i]][b][y[i]]
        total += w
        for i in range(n):
            content[i] += w * (y[i] == 2)
    for i in range(1, n):
        assert model.marginals(t)[i] == pytest.approx(content[i] / total, abs=1e-9)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<!-- x", ""), ("<script>alert(1)", ""), ('<div class="a>b', ""),
        ("<article><p>a  <b>b\n c</b>d<p>e<br>f &lt;g&#62; &eacute;<ul><li>h<li>i</ul></article>", "a b cd\ne f <g> é\nh\ni"),
    ],
)
def test_blocks(model, page, text):
    assert model.extract(page) == text


def test_query(spark, sf):
    from tessera.llm.registry import op4_html_extract

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_html_extract(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li)>", inner)
        want = [" ".join(html.entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)
    d = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>" * 30000 + "x", 3)], "page_id long, url string, html string, text int")
    assert html.extract(d).count() == 3 and html.extract(d.limit(0)).count() == 0
