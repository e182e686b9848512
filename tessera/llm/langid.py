"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text reads a text in longest phrases that occur in it. The
language that needs fewest, each weighted with the logarithm of its automaton's text, wins. The automata
are complete transition tables (a step that does not exist begins a phrase), so that many texts are read
in lockstep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import remainder, rows_of

#: The bounded sample that automata are built from: whole texts a language, and bytes of these a language and of all languages
#: together (with many languages each has an equal part). A language whose every text is longer has its shortest one.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TOTAL = 400, 60_000, 1_200_000
#: Long texts are read in pieces of so many bytes side by side, which are then joined to what one reading would give.
PIECE = 1024
SPACE = 32
#: Bytes as they are read: letters lower-cased, other ASCII as one space; the rest as it is.
READ = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)], np.uint8)
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def normal(raw: bytes) -> np.ndarray:
    """READ bytes without the second and later of a run of spaces."""
    x = READ[np.frombuffer(raw, np.uint8)]
    blank = x == SPACE
    return x[~(blank & np.append(True, blank[:-1]))] if len(x) else x


def suffix_automaton(codes: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of a text, -1 where there is none; a row for each state."""
    links, length, steps = [-1], [0], [[-1] * size]
    last = 0
    for c in codes:
        new = len(steps)
        steps.append([-1] * size)
        length.append(length[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and steps[p][c] < 0:
            steps[p][c] = new
            p = links[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                links[new] = q
            else:
                clone = len(steps)
                steps.append(steps[q][:])
                length.append(length[p] + 1)
                links.append(links[q])
                links[q] = links[new] = clone
                while p >= 0 and steps[p][c] == q:
                    steps[p][c] = clone
                    p = links[p]
        last = new
    return np.array(steps, np.int32)


class Model:
    """tables: for each language, (row of the next state, times 2, plus 1 if a phrase begins) by row and byte class."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        seen = np.zeros(256, bool)
        for t in texts.values():
            seen[np.frombuffer(t, np.uint8)] = True
        self.classes = np.where(seen, np.cumsum(seen), 0).astype(np.uint8)
        self.size = int(seen.sum()) + 1
        self.tables, self.weights = [], []
        for lang in self.langs:
            raw = texts[lang]
            steps = suffix_automaton(self.classes[np.frombuffer(raw, np.uint8)].tolist(), self.size)
            root = np.maximum(steps[0], 0)
            rows = np.where(steps >= 0, steps * self.size * 2, root * self.size * 2 + 1)
            self.tables.append(rows.astype(np.int32).ravel())
            self.weights.append(log(max(2, len(raw))))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        codes = [self.classes[normal(t)] for t in texts]
        owner, pieces = [], []
        for i, x in enumerate(codes):
            for at in range(0, len(x), PIECE):
                owner.append(i)
                pieces.append(x[at : at + PIECE])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not pieces:
            return out
        n = np.array([len(p) for p in pieces])
        order = np.argsort(-n, kind="stable")
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        n, owner = n[order], np.array(owner)
        grid = np.zeros((n[0], len(pieces)), np.uint8)
        for row, k in enumerate(order.tolist()):
            grid[: n[row], row] = pieces[k]
        alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # pieces with more than i bytes
        seams = np.flatnonzero(owner[1:] == owner[:-1])
        for j, t in enumerate(self.tables):
            out[:, j], apart = self._count(t, grid, alive, lane, owner, seams, n, len(texts))
            for i in apart.tolist():
                out[i, j] = self._read(t, codes[i])
        return out

    @staticmethod
    def _read(t: np.ndarray, x: np.ndarray) -> int:
        """Phrases of one text, read from its start."""
        get, state, count = t.item, 0, 1
        for i, c in enumerate(x.tolist()):
            step = get(state + c)
            count += step & 1 if i else 0
            state = step >> 1
        return count

    @staticmethod
    def _count(t: np.ndarray, grid: np.ndarray, alive: np.ndarray, lane: np.ndarray, owner: np.ndarray, seams: np.ndarray, n: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text, and the texts whose pieces could not be joined.

        Each piece is read as if a phrase began with it. Then the reading of the piece before goes on in it, until a phrase of both begins
        at one place: from there on they are the same, and only the phrases before that place are exchanged."""
        state = np.zeros(grid.shape[1], np.int32)
        begins = np.zeros(grid.shape, bool)
        for i in range(len(grid)):
            k = alive[i]
            x = t[state[:k] + grid[i, :k]]
            begins[i, :k] = x & 1
            state[:k] = x >> 1
        begins[0] = True
        count = np.zeros(texts, np.int64)
        np.add.at(count, owner, begins.sum(axis=0)[lane])
        apart = np.zeros(0, np.int64)
        if len(seams):
            at, text, now = lane[seams + 1], owner[seams], state[lane[seams]]
            for i in range(len(grid)):
                ended = n[at] <= i
                apart = np.append(apart, text[ended])
                at, text, now = at[~ended], text[~ended], now[~ended]
                if not len(at):
                    break
                x = t[now + grid[i, at]]
                mine, its = (x & 1).astype(bool), begins[i, at]
                np.add.at(count, text, mine.astype(np.int64) - its)
                going = ~(mine & its)
                at, text, now = at[going], text[going], (x >> 1)[going]
            apart = np.unique(np.append(apart, text))
        return count, apart

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        if use:
            cost = self.phrases([texts[i].encode("utf-8", "surrogatepass") for i in use]) * np.array(self.weights)
            best = cost.argmin(axis=1)
            two = np.partition(cost, 1, axis=1)[:, :2] if len(self.langs) > 1 else None
            for row, i in enumerate(use):
                lang[i] = self.langs[best[row]]
                score[i] = float(1 - two[row, 0] / two[row, 1]) if two is not None else 1.0
        return lang, score


def learn(docs: DataFrame) -> Model:
    """From the bounded sample of rows with text and a language (columns text and lang).

    Which texts are taken depends on their hashes alone; copies count once, so no source of many copies fills the sample."""
    known = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("place"), F.octet_length("text").alias("size"))
    counts = known.select("lang", "place").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).cache()
    langs = counts.count()
    if not langs:
        return Model({})
    most = min(SAMPLE_BYTES, SAMPLE_TOTAL // langs)
    # about twice as many as are wanted, then the first ones that fit
    share = (F.lit(2 * SAMPLE_ROWS) / F.col("n") * 1_000_000).cast("long") + 1
    some = known.join(counts, "lang").where(F.pmod("place", F.lit(1_000_000)) < share).where(F.col("size") <= most)
    some = some.groupBy("lang", "place").agg(F.first("text").alias("text"), F.first("size").alias("size"))
    w = Window.partitionBy("lang").orderBy("place")
    some = some.withColumn("upto", F.sum(F.col("size") + 1).over(w)).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= SAMPLE_ROWS) & (F.col("upto") <= most))
    texts: dict[str, list[str]] = {}
    for r in some.select("lang", "place", "text").orderBy("lang", "place").toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text)
    if len(texts) < langs:
        rest = known.where(~F.col("lang").isin(list(texts))) if texts else known
        for r in rest.groupBy("lang").agg(F.min(F.struct("size", "place", "text"))["text"].alias("text")).toLocalIterator():
            texts[r.lang] = [r.text]
    counts.unpersist()
    return Model({k: normal(" ".join(v).encode("utf-8", "surrogatepass")).tobytes() for k, v in texts.items()})


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from whole texts.

    Learns from rows with text and lang that are not held out; a prediction sees the text only. Null texts
    and those without a letter are und with score 0, as is everything if no language could be learned. The
    score is one minus the ratio of the best cost to the second (1 if there is one language); of equal costs the first language by
    name wins, with score 0. Rows are
    neither merged nor dropped, other columns not carried."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = d.sparkSession.sparkContext.broadcast(learn(d.where("not held_out")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            lang, score = model.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return d.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)
