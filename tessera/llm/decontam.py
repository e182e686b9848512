"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max pruning.

Every passage of every text is a query. Items stand in blocks; each term has a greatest weight in each
block. The sums of those bound what any item of a block can score, so only passages and blocks whose bound
reaches the threshold are scored, and all items above it are retrieved. A retrieved item counts as leaked
if enough of its word shingles stand in the passage, of its question and of its answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rows_of

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved; 5-word shingles that must be found of the
#: whole item, and of its question and its answer.
RETRIEVE, SHINGLE, OVERLAP, PART = 0.5, 5, 0.75, 0.5
#: The last part of an item counts as its answer.
ANSWER = 0.25
#: Passages are twice so many words for items of at most so many, and begin at each multiple of it.
HALF = 64
BLOCK = 8
MAX_BLOCKS = 32
#: Entries of the tables by term and block.
MAX_TABLE = 1 << 24
#: Scores of pairs of a passage and a block that are held at a time.
CELLS = 4_000_000
#: Bytes of items that an index holds; more are taken in several rounds.
MAX_INDEX = 32 << 20

_READ = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_READ).split()


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Statistics:
    """Of all items of a class of lengths, however many indexes hold them: their number, words, and items by term."""

    def __init__(self, items: Iterable[list[bytes]] = ()):
        self.items, self.words, self.df = 0, 0, Counter()
        for ws in items:
            self.add(ws)

    def add(self, ws: list[bytes]) -> None:
        self.items += 1
        self.words += len(ws)
        self.df.update(set(ws))


class Index:
    """Items of one class of lengths (at most half words), and their weights by term."""

    def __init__(self, items: list[tuple[int, list[bytes]]], half: int, of: Statistics | None = None):
        of = of or Statistics(ws for _, ws in items)
        self.half = half
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        n, v = len(items), len(self.vocab)
        self.size = v
        df = {t: log(1 + (of.items - (m := of.df[w]) + 0.5) / (m + 0.5)) for w, t in self.vocab.items()}
        mean = of.words / of.items
        self.blocks = min(MAX_BLOCKS, -(-n // BLOCK), max(1, MAX_TABLE // v))
        self.block_of = np.arange(n) * self.blocks // n
        rows = []
        for k, c in enumerate(coded):
            own = {t: df[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(c) / mean)) for t, f in Counter(c).items()}
            limit = RETRIEVE * sum(own.values())
            rows += [(t, k, w / limit) for t, w in own.items()]
        rows.sort()
        t, k, w = (np.array(x) for x in zip(*rows))
        self.item, self.weight = k.astype(np.int64), w.astype(np.float64)
        #: postings of term t in block b: from start[t * blocks + b] to the next
        self.start = np.searchsorted(t * self.blocks + self.block_of[k], np.arange(v * self.blocks + 1))
        self.first_of = np.searchsorted(self.block_of, np.arange(self.blocks))
        self.widest = int(np.bincount(self.block_of).max())
        #: greatest weight of each term in each block
        self.bound = np.zeros((v, self.blocks), np.float32)
        np.maximum.at(self.bound, (t, self.block_of[k]), w.astype(np.float32))
        self.shingles = [self._shingles(c) for c in coded]

    @staticmethod
    def _shingles(c: list[int]) -> tuple[set, set]:
        """Those that end in the question, and in the answer."""
        size = min(SHINGLE, len(c))
        cut = len(c) - max(1, round(len(c) * ANSWER))
        q: set[tuple] = set()
        a: set[tuple] = set()
        for i in range(len(c) - size + 1):
            (q if i + size <= cut else a).add(tuple(c[i : i + size]))
        return q, a

    def search(self, coded: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question's and answer's overlap) of the items leaked into texts of term numbers (-1: none)."""
        n = np.array([len(c) for c in coded])
        halves = np.maximum(1, -(-n // self.half))
        base = np.append(0, np.cumsum(halves))
        flat = np.concatenate(coded) if len(coded) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(coded)), n)
        place = np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
        known = flat >= 0
        keys = _distinct((base[text[known]] + place[known] // self.half) * self.size + flat[known])
        if not len(keys):
            return
        half, term = np.divmod(keys, self.size)
        at = np.flatnonzero(np.append(True, half[1:] != half[:-1]))
        sums = np.zeros((base[-1] + 1, self.blocks), np.float32)
        sums[half[at]] = np.add.reduceat(self.bound[term], at, axis=0)
        last = np.zeros(base[-1] + 1, bool)
        last[base[1:] - 1] = True
        sums[:-1] += np.where(last[:-1, None], 0, sums[1:])
        # float32 sums: a little below the threshold still counts
        hit, block = np.nonzero(sums[:-1] >= 0.999)
        starts = np.append(at, len(keys))
        first = np.searchsorted(half[at], np.arange(base[-1] + 1))
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        # passages in slices, so that what is laid out side by side stays bounded
        step = max(1, CELLS // self.widest)
        for i in range(0, len(hit), step):
            for p, items, score in self._score(hit[i : i + step], block[i : i + step], last, starts[first], term):
                self._verify(p, items, score, base, last, coded, found)
        for (t, k), x in sorted(found.items()):
            yield t, self.ids[k], *x

    def _score(self, hit: np.ndarray, block: np.ndarray, last: np.ndarray, begin: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, list[int], list[float]]]:
        """Passages with items at or above the threshold, from pairs of a passage and a block."""

        def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            return which, np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)

        ends = hit + np.where(last[hit], 1, 2)
        pair, at = ranges(begin[hit], begin[ends])
        # a term in both halves counts once
        key = _distinct(pair * self.size + term[at])
        pair, own = np.divmod(key, self.size)
        cell = own * self.blocks + block[pair]
        which, post = ranges(self.start[cell], self.start[cell + 1])
        slot = pair[which] * self.widest + self.item[post] - self.first_of[block[pair[which]]]
        score = np.bincount(slot, self.weight[post], len(hit) * self.widest)
        good = np.flatnonzero(score >= 1)
        by: dict[int, tuple[list[int], list[float]]] = {}
        for s in good.tolist():
            j, k = divmod(s, self.widest)
            items, scores = by.setdefault(int(hit[j]), ([], []))
            items.append(int(self.first_of[block[j]]) + k)
            scores.append(float(score[s]))
        for p, (items, scores) in by.items():
            yield p, items, scores

    def _verify(self, p: int, items: list[int], scores: list[float], base: np.ndarray, last: np.ndarray, coded: list[np.ndarray], found: dict) -> None:
        t = int(np.searchsorted(base, p, side="right")) - 1
        w = coded[t][(p - base[t]) * self.half : (p - base[t] + (1 if last[p] else 2)) * self.half].tolist()
        there: dict[int, set] = {}
        for k, score in zip(items, scores):
            q, a = self.shingles[k]
            size = len(next(iter(q or a)))
            if size not in there:
                there[size] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            nq, na = len(q & there[size]), len(a & there[size])
            if nq + na >= OVERLAP * (len(q) + len(a)) and nq >= PART * len(q) and na >= PART * len(a):
                new = (score * RETRIEVE, nq / len(q) if q else 1.0, na / len(a) if a else 1.0)
                if new[1:] > found.get((t, k), (0, -1.0, -1.0))[1:]:
                    found[t, k] = new


def half_of(ws: list[bytes]) -> int:
    """Its class of lengths: passages of HALF, twice that, and so on."""
    half = HALF
    while half < len(ws):
        half *= 2
    return half


def indexes(items: list[tuple[int, str | None]], of: dict[int, Statistics] | None = None) -> list[Index]:
    """One for each class of lengths. Items without a term are left out. of: the statistics by class, where these are not all items."""
    by: dict[int, list] = {}
    for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        if w := terms(text):
            by.setdefault(half_of(w), []).append((i, w))
    return [Index(x, half, of and of[half]) for half, x in sorted(by.items())]


def leaks_in(texts: list[str | None], of: list[Index]) -> list[tuple[int, int, float, float, float]]:
    split = [terms(t) for t in texts]
    out = []
    for index in of:
        get = index.vocab.get
        out += index.search([np.array([get(w, -1) for w in ws], np.int64) for ws in split])
    return sorted(out)


def _rounds(bench: DataFrame) -> Iterator[list[Index]]:
    """Benchmark items in rounds of at most about MAX_INDEX bytes, indexed one after the other; scores are the same in any number of rounds.

    The driver holds the items of one round, and the number of items of each term."""
    b = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n = 1 + (b.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0) // MAX_INDEX
    of: dict[int, Statistics] | None = None
    if n > 1:
        of = {}
        for r in b.select("text").toLocalIterator():
            if ws := terms(r.text):
                of.setdefault(half_of(ws), Statistics()).add(ws)
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for i in range(n):
        yield indexes([(r.item_id, r.text) for r in b.where(part == i).collect()], of)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """A row for each text and leaked item: score as a share of the item's own, overlaps of its two parts.

    Texts and items that are null or have no letter or digit leak nothing. A repeated document has its
    rows as often; a repeated item counts each time. Other columns are not carried."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for of in _rounds(bench):
        sent = docs.sparkSession.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in rows_of(batches):
                ids = b.column(0).to_pylist()
                rows = [(ids[t], *rest) for t, *rest in leaks_in(b.column(1).to_pylist(), sent.value)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, (pa.int64(), pa.int64(), *(pa.float64(),) * 3))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = d.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows, with all their columns, that no item leaked into; null texts stay."""
    for of in _rounds(bench):
        sent = docs.sparkSession.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in rows_of(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in leaks_in(b.column(b.schema.get_field_index("text")).to_pylist(), sent.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
