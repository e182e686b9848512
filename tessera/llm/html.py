"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the variables, each boilerplate (0), mixed (1) or content (2). A child's
label depends on its parent's, what it shows (tag group, hints in class, id and role, amount of text,
links, punctuation) on its own. One pass of sum-product messages up the tree and one down give every
node's marginals. All tables are counted on labelled pages.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rows_of

#: Groups of element names.
GROUPS = {
    "article": "article main",
    "nav": "nav menu",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset select option button textarea input label datalist",
    "hidden": "script style noscript template head title iframe svg math canvas object embed audio video",
    "title": "h1",
    "heading": "h2 h3 h4 h5 h6 hgroup",
    "para": "p blockquote pre figcaption dd dt address",
    "list": "ul ol dl",
    "item": "li",
    "table": "table thead tbody tfoot tr td th caption",
    "div": "div section center details summary figure dialog",
    "page": "html body",
}
GROUP = {name: i + 1 for i, names in enumerate(GROUPS.values()) for name in names.split()}
INDEX = {g: i + 1 for i, g in enumerate(GROUPS)}
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "xmp", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_FORM = frozenset("input label".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
AWAY = frozenset(
    "ad ads adbox advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus discussion footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets complementary contentinfo alert".split()
)
TOWARDS = frozenset("article articlebody body content copy entry main page post story text".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)"""
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|data-label)\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))""", re.I)
LABEL = re.compile(r"data-label=([012])")
SPLIT = re.compile(r"[^a-z0-9]+")
SENTENCE = re.compile(r"[.!?:;,]")


def _hint(attrs: str) -> int:
    """0 nothing, 1 away from content, 2 towards it; what leads away prevails."""
    if "=" not in attrs:
        return 0
    names = {t for m in ATTR.finditer(attrs) for t in SPLIT.split((m[1] or m[2] or m[3] or "").lower())}
    return 1 if names & AWAY else 2 if names & TOWARDS else 0


class Tree:
    """Block elements of a page in page order, and its text pieces with the node and block that they stand in."""

    def __init__(self, page: str):
        self.parent, self.group, self.hint, self.label = [-1], [0], [0], [1]
        self.n_text, self.n_link, self.n_marks = [0], [0], [0]
        #: (node, block, text); a new block begins wherever a block element does or ends
        self.pieces: list[tuple[int, int, str]] = []
        self._read(page)
        for i in range(len(self.parent) - 1, 0, -1):
            p = self.parent[i]
            self.n_text[p] += self.n_text[i]
            self.n_link[p] += self.n_link[i]
            self.n_marks[p] += self.n_marks[i]

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open elements with the node that holds their text
        is_open: Counter[str] = Counter()
        block, links, at = 0, 0, 0

        def node(name: str, attrs: str) -> int:
            self.parent.append(stack[-1][1])
            self.group.append(GROUP.get(name, 0))
            self.hint.append(_hint(attrs))
            self.label.append(int(m[1]) if "data-label" in attrs and (m := LABEL.search(attrs)) else -1)
            for x in (self.n_text, self.n_link, self.n_marks):
                x.append(0)
            return len(self.parent) - 1

        def text(raw: str) -> None:
            if raw:
                s = entities.unescape(raw) if "&" in raw else raw
                self.pieces.append((stack[-1][1], block, s))
                n, k = len(s) - s.count(" "), stack[-1][1]
                self.n_text[k] += n
                self.n_link[k] += n if links else 0
                self.n_marks[k] += len(SENTENCE.findall(s))

        def close(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                name = stack.pop()[0]
                is_open[name] -= 1
                links -= name == "a"

        def close_open(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
            """Up to the outermost of these within the scope."""
            if any(is_open[x] for x in names):
                to = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in names:
                        to = i
                if to is not None:
                    close(to)

        for m in TOKEN.finditer(page):
            text(page[at : m.start()])
            at = m.end()
            if m["raw"]:
                node(m["raw"].lower(), m["rawattrs"])
                continue
            if not m["name"]:
                continue
            name = m["name"].lower()
            is_block = name in GROUP and name not in INLINE_FORM
            if m["end"]:
                if not is_open[name]:
                    continue
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if is_block:
                    close(i)
                    block += 1
                elif not any(stack[j][0] in GROUP for j in range(i + 1, len(stack))):
                    close(i)
                else:  # an inline end inside a later block: it ends there, the block goes on
                    is_open[name] -= 1
                    links -= name == "a"
                    stack[i] = ("", stack[i][1])
                continue
            if name == "br":
                self.pieces.append((stack[-1][1], block, " "))
                continue
            if name in CLOSES_P:
                close_open(("p",), ("table", "td", "th", "article", "aside", "div", "section", "button"))
            if name in SIBLINGS:
                close_open(SIBLINGS[name], SCOPES[name])
            attrs = m["attrs"] or ""
            block += is_block
            if name in VOID:
                continue
            k = node(name, attrs) if is_block or _hint(attrs) == 1 or "data-label" in attrs else stack[-1][1]
            if name == "a":
                close_open(("a",), ("",))
                links += 1
            stack.append((name, k))
            is_open[name] += 1
        text(page[at:])

    def shows(self, i: int) -> tuple[int, int]:
        """What a node shows: (group and hint), (text, links and marks in its subtree)."""
        n, a, m = self.n_text[i], self.n_link[i], self.n_marks[i]
        size = 0 if not n else 1 if n < 20 else 2 if n < 80 else 3
        link = 0 if 4 * a <= n else 1 if 3 * a <= 2 * n else 2
        return self.group[i] * 3 + self.hint[i], (size * 3 + link) * 2 + (m > 0)


#: Weight of what many siblings say of their common parent through their amounts of text.
TEMPER = 0.5
#: Added to each count; FLOOR to what was never seen: content inside boilerplate.
SMOOTH, FLOOR = 0.5, 1e-9


class Model:
    def __init__(self, edge, kind, shape):
        self.edge, self.kind, self.shape = edge, kind, shape

    @classmethod
    def train(cls, pages: Iterable[str]) -> Model:
        """From pages whose elements carry data-label=0, 1 or 2; those without one have their parent's."""
        edge, kind, shape = Counter(), Counter(), Counter()
        for page in pages:
            t = Tree(page)
            for i in range(1, len(t.parent)):
                p = t.label[t.parent[i]]
                if t.label[i] < 0:
                    t.label[i] = p
                y = t.label[i]
                a, b = t.shows(i)
                edge[p, y] += 1
                kind[t.group[t.parent[i]], y, a] += 1
                shape[y, t.group[i], b] += 1
        n_kind, n_shape, groups = 3 * (len(GROUPS) + 1), 24, len(GROUPS) + 1
        each = range(3)
        e = [[max(FLOOR, (edge[p, y]) / max(1, sum(edge[p, z] for z in each))) for y in each] for p in each]
        within = {(g, y): sum(kind[g, y, a] for a in range(n_kind)) for g in range(groups) for y in each}
        k = [[[(kind[g, y, a] + SMOOTH) / (within[g, y] + SMOOTH * n_kind) for y in each] for a in range(n_kind)] for g in range(groups)]
        total = {(y, g): sum(shape[y, g, b] for b in range(n_shape)) for y in each for g in range(groups)}
        s = [[[((shape[y, g, b] + SMOOTH) / (total[y, g] + SMOOTH * n_shape)) ** TEMPER for y in each] for b in range(n_shape)] for g in range(groups)]
        return cls(e, k, s)

    def marginals(self, t: Tree) -> list[float]:
        """Probability of content of each node."""
        e, n = self.edge, len(t.parent)
        up = [[1.0, 1.0, 1.0] for _ in range(n)]
        sent: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = t.shows(i)
            k, s, u = self.kind[t.group[t.parent[i]]][a], self.shape[t.group[i]][b], up[i]
            x, y, z = u[0] * k[0] * s[0], u[1] * k[1] * s[1], u[2] * k[2] * s[2]
            f = 1 / (x + y + z)
            u[0], u[1], u[2] = x, y, z = x * f, y * f, z * f
            m = tuple(r[0] * x + r[1] * y + r[2] * z for r in e)
            sent[i] = m
            p = up[t.parent[i]]
            x, y, z = p[0] * m[0], p[1] * m[1], p[2] * m[2]
            f = 1 / (x + y + z)
            p[0], p[1], p[2] = x * f, y * f, z * f
        # the root is outside of all elements; a text without any element is content
        up[0] = [0.0, up[0][1], up[0][2]]
        f = 1 / (up[0][1] + up[0][2])
        belief = [[0.0, up[0][1] * f, up[0][2] * f], *([None] * (n - 1))]
        out = [1.0] * n
        for i in range(1, n):
            q, m, u = belief[t.parent[i]], sent[i], up[i]
            w = [q[j] / m[j] if m[j] > 0 else 0.0 for j in (0, 1, 2)]
            b = [u[y] * (w[0] * e[0][y] + w[1] * e[1][y] + w[2] * e[2][y]) for y in (0, 1, 2)]
            f = 1 / (sum(b) or 1.0)
            belief[i] = [x * f for x in b]
            out[i] = belief[i][2]
        if n > 1 and any(t.group[i] for i in range(1, n)):
            out[0] = belief[0][2]
        return out

    def extract(self, page: str | None) -> str:
        """Blocks of content in page order; white space inside a block becomes one space."""
        if not page:
            return ""
        t = Tree(page)
        keep = self.marginals(t)
        lines, last, parts = [], None, []
        for node, block, text in t.pieces:
            if keep[node] < 0.5 or t.group[node] == INDEX["hidden"]:
                continue
            if block != last:
                lines.append("".join(parts))
                last, parts = block, []
            parts.append(text)
        lines.append("".join(parts))
        return "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)


#: Labelled pages that the default model is trained on.
PAGES = 600


def labelled_pages(n: int = PAGES, seed: int = 3) -> list[str]:
    """Synthetic pages of many layouts whose elements carry their label."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        w = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))]
        return " ".join(x + r.choice(("", "", "", "", "", ",")) for x in w)

    sentence = lambda: words(4, 16).capitalize() + r.choice("...!?")
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 5)))
    link = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'
    links = lambda tag="li": "".join(f"<{tag}>{link()}</{tag}>" for _ in range(r.randint(3, 9)))
    some = lambda p, f: f() if r.random() < p else ""
    named = lambda *xs: r.choice(("class", "id")) + f'="{r.choice(xs)}"'

    def paragraph() -> str:
        k = r.random()
        if k < 0.62:
            return f"<p>{prose()}{some(0.15, lambda: ' ' + link() + ' ' + sentence())}</p>"
        if k < 0.74:
            return f"<h{r.randint(2, 4)}>{words(1, 8)}</h2>"
        if k < 0.8:
            return f"<p>{words(1, 4)}</p>"
        if k < 0.86:
            return "<ul>" + "".join(f"<li>{r.choice((sentence(), words(1, 5)))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.9:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if k < 0.97:
            return f"<p><b>{sentence()}<br><p>{prose()}</p>"
        return f"<div><p>{prose()}</p><pre>{words(3, 20)}</pre></div>"

    def inside() -> str:
        """Boilerplate that can stand inside the article."""
        return r.choice(
            (
                lambda: f'<div {named("ad", "advert", "ads", "sponsored")} data-label=0>{prose()}</div>',
                lambda: f'<div {named("share", "social", "related", "newsletter")} data-label=0><p>{words(2, 8)}</p><ul>{links()}</ul></div>',
                lambda: f"<aside data-label=0><p>{prose()}</p></aside>",
                lambda: f'<form action="/" data-label=0><label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button></form>',
                lambda: f"<header data-label=0><p>{words(2, 6)}</p></header>",
                lambda: f"<footer data-label=0><p>{words(2, 9)}</p></footer>",
            )
        )()

    def comments() -> str:
        box = r.choice(("div", "section", "ol", "aside"))
        kinds = (lambda: f"<p>{prose()}</p>", lambda: f"<div><p>{prose()}</p><p>{sentence()}</p></div>", lambda: f"<li><p>{prose()}</p></li>", lambda: f"<article><h4>{words(1, 2)}</h4><p>{prose()}</p></article>")
        one = kinds[min(3, int(r.random() * 3.1))]
        return f'<{box} {named("comments", "comment-list", "replies", "discussion", "user-comments")} data-label=0><h3>{words(1, 3)}</h3>{"".join(one() for _ in range(r.randint(1, 12)))}</{box}>'

    def top() -> str:
        nav = lambda: r.choice((f"<nav data-label=0><ul>{links()}</ul></nav>", f"<nav data-label=0>{links('span')}</nav>", f'<div {named("menu", "navbar", "main-nav")} data-label=0><ul>{links()}</ul></div>', f"<ul data-label=0>{links()}</ul>"))
        head = r.choice((f"<header data-label=0><h1>{words(1, 4)}</h1>{nav()}</header>", f'<div {named("header", "masthead", "topbar")} data-label=0><p>{words(2, 6)}</p></div>' + nav(), nav()))
        notice = some(0.4, lambda: f'<div {named("cookie-notice", "notice", "consent", "banner", "alert")} data-label=0><p>{prose()}</p><button>{words(1, 2)}</button></div>')
        ad = some(0.6, lambda: f'<div {named("ad", "ads", "advert", "banner", "promo")} data-label=0>{r.choice((prose(), "<p>" + prose() + "</p>"))}</div>')
        return "".join(r.sample([head, notice, ad], 3))

    def side() -> str:
        return r.choice(
            (
                f"<aside data-label=0><h3>{words(1, 3)}</h3><ul>{links()}</ul><p>{prose()}</p></aside>",
                f'<div {named("sidebar", "widget", "related", "recommended")} data-label=0><h4>{words(1, 3)}</h4>{"".join(f"<p>{sentence()}</p>" for _ in range(r.randint(1, 4)))}<ul>{links()}</ul></div>',
                f'<section {named("newsletter", "subscribe", "login")} data-label=0><p>{sentence()}</p><form><input><button>{words(1, 2)}</button></form></section>',
                f"<div data-label=0>{links('div')}</div>",
            )
        )

    out = []
    for _ in range(n):
        body = f"<h1>{words(2, 10)}</h1>" * (r.random() < 0.85) + "".join(paragraph() + some(0.06, inside) for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9, 14, 22))))
        box = r.choice(("<article data-label=2>{}</article>", "<main data-label=2>{}</main>", "<article data-label=2>{}</article>", "<article data-label=2><section>{}</section></article>", f'<div {named("content", "article-body", "post", "entry-content", "story")} data-label=2>{{}}</div>', "<div data-label=2>{}</div>"))
        parts = [box.format(body), some(0.5, side), some(0.35, comments)]
        if r.random() < 0.5:
            parts = [parts[1], parts[0], parts[2]]
        middle = "".join(parts)
        middle = r.choice((middle, middle, f"<div data-label=1>{middle}</div>", f'<div {named("wrapper", "container", "page", "main")} data-label=1>{middle}</div>'))
        foot = r.choice((f"<footer data-label=0>&copy; {words(1, 3)} &middot; {sentence()}</footer>", f"<footer data-label=0><p>{words(3, 9)}</p><ul>{links()}</ul></footer>", f'<div {named("footer", "copyright", "legal")} data-label=0><p>{words(2, 9)}</p></div>'))
        head = f"<head data-label=0><title>{words(1, 8)}</title><style>p{{margin:0}}</style></head>" + some(0.5, lambda: "<script data-label=0>track(0);</script>")
        out.append(f"<html data-label=1>{head}<body data-label=1>{top()}{middle}{foot}</body></html>")
    return out


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, labelled: Iterable[str] | None = None) -> DataFrame:
    """page_id, url, main text and its code points for every row.

    A null, empty or textless page has the empty text. Rows are neither merged nor dropped; other columns
    are not carried. labelled: pages to train on, else labelled_pages()."""
    model = Model.train(labelled_pages() if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            texts = [model.extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
