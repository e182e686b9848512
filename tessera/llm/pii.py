"""Personal data by candidate gradient boosting, in SQL expressions only.

Generators propose spans with high recall. Those of the base kinds that pass their own test stay; the
others (phone numbers without a plus sign, written-out e-mail addresses, long IP addresses) are scored by
boosted trees over their format and what stands before them, and selected by calibrated thresholds. The
trees are trained on the driver on SAMPLE synthetic lines, whose features the same expressions compute,
and run as CASE expressions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in the order of the contract. The expressions equal the contract's: possessive loops (the
#: class that follows cannot match what a loop gives up) and, where a start inside a run could only fail
#: again, a start at the run's first character or at the end of the last match.
BASE = ("email", "ip", "card", "phone")
FIND = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HAS = {"email": "instr(t, '@') > 0", "ip": "digits", "card": "digits", "phone": "digits and instr(t, '+') > 0"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Of 1 to 19 digits: every second one from the right is doubled."""
    back = f"rpad(reverse({digits}), 19, '0')"
    terms = []
    for i in range(1, 20):
        d = f"substring({back}, {i}, 1)"
        terms.append(f"cast({d} as int)" if i % 2 else f"cast(translate({d}, '0123456789', '0246813579') as int)")
    return f"({' + '.join(terms)}) % 10 = 0"


VALID = {
    "email": "true",
    "ip": rf"x.m rlike '^{OCTET}(?:[.]{OCTET}){{3}}$'",
    "card": f"length({DIGITS}) between 14 and 19 and {_luhn(DIGITS)}",
    "phone": f"length({DIGITS}) between 10 and 15",
}

#: Generators of further candidates: kind, expression, what the text must have.
MORE = (
    ("phone", r"(?<![0-9A-Za-z+.,/:#$€£-])[(]?[0-9][0-9().\x20-]{5,30}[0-9](?![0-9A-Za-z%€£]|[.,/:-][0-9])", "digits"),
    ("email", r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[a-z0-9-]++)++", "instr(lower(t), 'dot') > 0"),
    ("ip", r"(?i)(?<![0-9a-z:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-z:])", "digits and instr(t, ':') > 0"),
)
CONTEXT = 24
ITEM = "array<struct<s:int,k:int,e:int,m:string,l:string>>"


def _quote(pattern: str) -> str:
    return "r'" + pattern + "'"


def _spans(pattern: str, rank: int, guard: str) -> str:
    """All matches as structs: start, rank, end (code points), the match, what stands before it.

    Matches and the pieces between them come from the same scan order, so lengths add up to places."""
    p = _quote(pattern)
    zipped = f"arrays_zip(regexp_extract_all(t, {p}, 0), split(t, {p}, -1))"
    at = "a.pos + length(x.`1`)"
    item = f"named_struct('s', {at}, 'k', {rank}, 'e', {at} + length(x.`0`), 'm', x.`0`, 'l', right(x.`1`, {CONTEXT}))"
    step = f"if(x.`0` is null, a, named_struct('pos', {at} + length(x.`0`), 'out', concat(a.out, array({item}))))"
    none = f"cast(array() as {ITEM})"
    found = f"aggregate({zipped}, named_struct('pos', 0, 'out', {none}), (a, x) -> {step}, a -> a.out)"
    return f"case when {guard} then {found} else {none} end"


#: Features of a candidate x (its kind's number, format, what stands before).
FEATURES = (
    "x.k",
    f"length({DIGITS})",
    "length(x.m)",
    "size(split(x.m, '[^0-9]+', -1))",
    "array_max(transform(split(x.m, '[^0-9]+', -1), g -> length(g)))",
    "array_min(transform(filter(split(x.m, '[^0-9]+', -1), g -> g <> ''), g -> length(g)))",
    "length(regexp_replace(x.m, '[^.]', ''))",
    "length(regexp_replace(x.m, '[^ ]', ''))",
    "length(regexp_replace(x.m, '[^-]', ''))",
    "int(instr(x.m, '(') > 0 and instr(x.m, ')') > 0)",
    "int(x.m rlike '^[(]?0')",
    r"int(x.m rlike r'^(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|^[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)?[0-9]{2}$')",
    r"int(x.l rlike r'(?i)(?:tel|phone|call|mobile|cell|fax|contact|dial|ring|sms|reach|whatsapp)[^a-z0-9]{0,4}(?:me|us|at|on|no|number|nr)?[^a-z0-9]{0,4}$')",
    r"int(x.l rlike r'(?i)(?:mail|write|contact|send|reach|address)[^a-z0-9]{0,4}(?:me|us|at|to)?[^a-z0-9]{0,4}$')",
    r"int(x.l rlike r'(?i)(?:order|invoice|version|isbn|total|sum|date|since|page|pages|figure|table|serial|ticket|nr|no|id|price|score|range|years?)[^a-z0-9]{0,4}$')",
    r"int(x.l rlike r'[0-9][^a-z0-9]{0,3}$')",
    r"int(x.m rlike r'(?i)[(\[]at[)\]]')",
    r"int(x.m rlike r'(?i)(?:com|net|org|edu|gov|de|fr|es|io|info)$')",
)

#: Rows of the sample that the trees are fitted on, three quarters, and calibrated on, one quarter.
SAMPLE = 4000
ROUNDS, DEPTH, RATE, PRECISION = 40, 3, 0.3, 0.99


def sample(n: int = SAMPLE, seed: int = 7) -> list[tuple[str, int]]:
    """Synthetic lines with one candidate each, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    hx = lambda: f"{r.randrange(65536):x}"
    phone = [
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(2)} {d(4)} {d(4)}",
        lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}",
    ]
    number = [
        lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: d(r.randint(7, 12)), lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"19{d(2)} - 20{d(2)}", lambda: " ".join(d(r.randint(1, 2)) for _ in range(r.randint(4, 9))),
        lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}.{d(3)}", lambda: f"{d(3)}-{d(4)}-{d(6)}",
    ]
    good = ("call ", "tel: ", "phone ", "Tel. ", "mobile: ", "contact us at ", "fax ", "reach me on ", "dial ")
    bad = ("order ", "invoice no ", "version ", "isbn ", "total ", "date ", "since ", "page ", "id ", "serial ")
    at, dot = ("[at]", " [at] ", "(at)", " (at) ", " at "), ("[dot]", " [dot] ", "(dot)", " dot ")
    out = []
    for _ in range(n):
        k = r.random()
        if k < 0.35:
            line, label = f"{w()} {r.choice(good) if r.random() < 0.6 else w() + ' '}{r.choice(phone)()} {w()}", 1
        elif k < 0.7:
            # without a word for telephones, runs of digits that no phone format fits
            line, label = f"{w()} {r.choice(bad) if r.random() < 0.6 else w() + ' '}{r.choice(number)()} {w()}", 0
        elif k < 0.8:
            line, label = f"{w()} {r.choice(('mail ', 'write to ', ''))}{w()}{r.choice(at)}{w()}{r.choice(dot)}{r.choice(('com', 'net', 'org', 'de'))}", 1
        elif k < 0.9:
            line, label = f"{w()} {w()} at {w()} dot {w()} {w()}", 0
        elif k < 0.95:
            line, label = f"{w()} host {':'.join(hx() for _ in range(8))} {w()}", 1
        else:
            line, label = f"{w()} {':'.join(d(2) for _ in range(8))} {w()}", 0
        out.append((line, label))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    """Exact greedy second-order tree: (feature, threshold, below, above), or a leaf's value."""
    total_g, total_h = g.sum(), h.sum()
    best = (1e-6, None, None)
    if depth:
        base = total_g**2 / (total_h + 1)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1) + (total_g - cg[cut]) ** 2 / (total_h - ch[cut] + 1) - base
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, float(v[cut[i]] + v[cut[i] + 1]) / 2)
    if best[1] is None:
        return (-RATE * total_g / (total_h + 1),)
    below = x[:, best[1]] <= best[2]
    return (best[1], best[2], _tree(x[below], g[below], h[below], depth - 1), _tree(x[~below], g[~below], h[~below], depth - 1))


def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple], dict[int, float]]:
    """Trees, and for each kind the lowest raw score from which on held-out precision is PRECISION."""
    n = len(x) * 3 // 4
    trees, f = [], np.zeros(n)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        trees.append(_tree(x[:n], p - y[:n], p * (1 - p), DEPTH))
        f += _apply(trees[-1], x[:n])
    held = sum(_apply(t, x[n:]) for t in trees)
    limits = {}
    for kind in range(len(MORE)):
        of = x[n:, 0] == kind
        order = np.argsort(-held[of], kind="stable")
        s, hit = held[of][order], y[n:][of][order]
        good = np.cumsum(hit) / np.arange(1, len(hit) + 1) >= PRECISION
        limits[kind] = max(0.0, float(s[np.flatnonzero(good)[-1]])) if good.any() else float("inf")
    return trees, limits


def _sql(tree: tuple) -> str:
    if len(tree) == 1:
        return f"{tree[0]:.9f}D"
    return f"if(x.f[{tree[0]}] <= {tree[1]}D, {_sql(tree[2])}, {_sql(tree[3])})"


def _features(spans: str) -> str:
    return f"transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'f', array({', '.join(f'coalesce(int({f}), 0)' for f in FEATURES)})))"


def _prepared(docs: DataFrame) -> DataFrame:
    """t: the text; digits: whether it has any."""
    return docs.withColumn("digits", F.col("t").rlike("[0-9]"))


def _candidates() -> Column:
    return F.expr(_features(f"concat({', '.join(_spans(p, k, guard) for k, (_, p, guard) in enumerate(MORE))})"))


def model(spark: SparkSession, n: int = SAMPLE) -> tuple[list[tuple], dict[int, float]]:
    """Fitted on n synthetic lines; the driver gets their features only."""
    lines = spark.createDataFrame(sample(n), "t string, label int").coalesce(1)
    rows = _prepared(lines).select("t", "label", _candidates().alias("c")).where("size(c) = 1").selectExpr("t", "label", "c[0].f as f").orderBy("t").collect()
    order = np.random.default_rng(0).permutation(len(rows))
    return fit(np.array([r.f for r in rows], float)[order], np.array([r.label for r in rows], float)[order])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and digest, and all spans, of every whole text.

    Null and empty texts have none. Rows are neither merged nor dropped, whatever their id; other columns
    are not carried. Selected spans that overlap a base span give way to it."""
    trees, limits = model(docs.sparkSession)
    d = _prepared(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")))
    for rank, kind in enumerate(BASE):
        d = d.withColumn(kind, F.expr(f"filter({_spans(FIND[kind], rank, HAS[kind])}, x -> {VALID[kind]})"))
    d = d.withColumn("more", _candidates())
    short = lambda spans, k="x.k": f"transform({spans}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"
    d = d.withColumn("base", F.expr(f"array_sort(concat({', '.join(short(k) for k in BASE)}))"))
    score = " + ".join(_sql(t) for t in trees)
    limit = "case x.k " + " ".join(f"when {k} then {v}D" if np.isfinite(v) else f"when {k} then double('Infinity')" for k, v in limits.items()) + " end"
    rank = "case x.k " + " ".join(f"when {i} then {BASE.index(k)}" for i, (k, _, _) in enumerate(MORE)) + " end"
    free = "not exists(base, b -> b.s < x.e and x.s < b.e)"
    d = d.withColumn("chosen", F.expr(f"filter(more, x -> {free} and {score} >= {limit})"))
    d = d.withColumn("spans", F.expr(f"array_sort(concat(base, {short('chosen', rank)}))"))
    names = "array(" + ", ".join(f"'{k}'" for k in BASE) + ")"
    line = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
