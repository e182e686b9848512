"""Katz backoff language model: Good-Turing discounted bigrams and unigrams, exactly normalised.

Texts are taken in blocks of tokens, written once as numbers into each block's own vocabulary. Blocks ask
the owner of a word for its count and number, and the owner of a history (many owners, if the history is
frequent) for counts of word pairs and for what its backoff weight is made of. So each table is
partitioned by key, an owner gets a pair once from each block that has it, and no task holds a whole table.

p(w) = d(c) c / N for a known word and what that leaves for all unknown words together.
p(w | h) = d(c(h w)) c(h w) / c(h) if the pair was seen, else a(h) p(w), where a(h) makes the sum one;
a(h) = 1 for an unknown history. If no discount leaves anything, the denominator is one more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, remainder, rows_of
from .neardup import _BLANK, _LOW, _mix, _Powers

#: Tokens of a block; a text that is longer has a block of its own.
BLOCK = 2_500_000
#: Counts up to this are discounted.
CUT = 5
START = (1 << 32) - 1
#: Fixed hash of the end of a text, which no word has: those of words have bit 63 clear.
END = np.uint64(1 << 63)


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return zstandard.compress(bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    raw = zstandard.decompress(b)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of the end."""
    raw = _LOW[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.append(word >> np.uint64(1), END)


def _sorted_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts, and where each distinct value begins in it."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    return order, np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(x) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the place of each element among them."""
    order, at = _sorted_groups(x)
    place = np.empty(len(x), np.int64)
    place[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
    return x[order[at]], place


BLOCKS = "block long, ids array<long>, held array<boolean>, n array<long>, vocab binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task: documents, the sorted hashes of their words, and the texts as places among those.

    Places are numbered by frequency for the sake of size; vocab holds the hashes in that order."""
    task, done = TaskContext.get().partitionId(), 0
    ids, held, parts, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal done, size
        words, place = _distinct(np.concatenate(parts))
        often = np.argsort(-np.bincount(place), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        # hashes in order of their value, with the ranks, are smaller than in order of rank
        first = pack(np.diff(words, prepend=np.uint64(0)))
        rows = [[(task << 24) + done], [list(ids)], [list(held)], [[len(p) for p in parts]], [len(first).to_bytes(8, "little") + first + pack(rank)], [pack(rank[place])]]
        done += 1
        ids.clear(), held.clear(), parts.clear()
        size = 0
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["block", "ids", "held", "n", "vocab", "tokens"])

    for b in rows_of(batches, 4 << 20):
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            x = tokens(t.as_py())
            if size and size + len(x) > BLOCK:
                yield flush()
            ids.append(i)
            held.append(h)
            parts.append(x)
            size += len(x)
    if parts:
        yield flush()


class Block:
    """A row of BLOCKS, laid out."""

    def __init__(self, row: dict):
        self.block, self.ids, self.held, self.n = row["block"], row["ids"], np.array(row["held"], bool), np.array(row["n"], np.int64)
        cut = 8 + int.from_bytes(row["vocab"][:8], "little")
        self.words, rank = np.cumsum(unpack(row["vocab"][8:cut])), unpack(row["vocab"][cut:]).astype(np.int64)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.token = place[unpack(row["tokens"]).astype(np.int64)]  # place among the sorted words
        self.learns = np.repeat(~self.held, self.n)
        self.first = np.append(0, np.cumsum(self.n))[:-1]

    def owners(self, parts: int) -> np.ndarray:
        return (_mix(self.words) % np.uint64(parts)).astype(np.int64)


ASKED = "p int, block long, a binary, b binary, c binary"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _split(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner that occurs, with the places of its elements in order."""
    order, at = _sorted_groups(owner)
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(owner)]):
        yield int(owner[order[i]]), order[i:j]


def _ask_words(parts: int):
    """Of each owner of words: hashes (a: differences) and counts in texts that are learned from (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = Block(row)
                count = np.bincount(x.token[x.learns], minlength=len(x.words))
                rows = [(p, x.block, pack(np.diff(x.words[at], prepend=np.uint64(0))), pack(count[at]), None) for p, at in _split(x.owners(parts))]
                yield _rows(rows, ASKED)

    return run


TOLD = "p int, block long, a binary, b binary, stats array<long>"


def _stats(counts: np.ndarray) -> list[int]:
    """Sum and number of the counts that aren't zero, and how many are 1, 2, ... CUT + 1."""
    return [int(counts.sum()), int((counts > 0).sum()), *np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()]


def _own_words(parts: int):
    """Tells each block the numbers (a) and counts (b) of its words; a row without a block has the owner's sums."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p = key[0].as_py()
        rows = t.sort_by("block").to_pylist()
        words = [np.cumsum(unpack(r["a"])) for r in rows]
        distinct, place = _distinct(np.concatenate(words))
        counts = np.bincount(place, np.concatenate([unpack(r["b"]) for r in rows]), len(distinct)).astype(np.int64)
        number = np.arange(len(distinct)) * parts + p
        if len(number) and number[-1] >= START:
            raise ValueError("more than 2 ** 32 - 2 numbers of words")
        out, i = [(p, None, None, None, _stats(counts))], 0
        for r, w in zip(rows, words):
            at = place[i : i + len(w)]
            out.append((p, r["block"], pack(number[at]), pack(counts[at]), None))
            i += len(w)
        return pa.Table.from_batches([_rows(out, TOLD)])

    return run


def discounts(stats: list[int]) -> np.ndarray:
    """d(0) .. d(CUT + 1); counts above CUT keep all. Where Good-Turing gives no share between 0 and 1, absolute discounting by a half."""
    n = [0, *stats[2:]]
    d = np.ones(CUT + 2)
    d[0] = 0
    rest = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest != 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Unigrams:
    def __init__(self, stats: list[int]):
        self.total, self.distinct = stats[:2]
        self.d = discounts(stats)
        n = stats[2:]
        kept = self.total - sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, CUT + 1))
        #: what is left for unknown words; at least one count's worth
        self.over = self.total if kept < self.total else self.total + 1
        self.unknown = 1 - kept / self.over if self.over else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, CUT + 1)] * c / max(1, self.over), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _pair_owner(h: np.ndarray, w: np.ndarray, c: np.ndarray, total: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each pair, and whether its history is frequent: such a one is dealt to owners in proportion."""
    share = -(-c * parts // max(1, total))
    mix = lambda x: (_mix(x.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return (mix(h) + mix(w + 1) % np.maximum(1, share)) % parts, share > 1


class Numbered:
    """A block with the numbers and counts that the owners of its words told."""

    def __init__(self, x: Block, told: list[dict]):
        self.x = x
        self.number, self.count = np.zeros(len(x.words), np.int64), np.zeros(len(x.words), np.int64)
        by = {r["p"]: r for r in told}
        for p, at in _split(x.owners(told[0]["parts"])):
            self.number[at], self.count[at] = unpack(by[p]["a"]), unpack(by[p]["b"])
        w = x.token
        before = np.append(-1, w[:-1])
        before[x.first] = -1
        end = np.searchsorted(x.words, END)
        # the start is a history as often as there are ends
        self.h = np.where(before < 0, START, self.number[before])
        self.hc = np.where(before < 0, self.count[end] if end < len(x.words) else 0, self.count[before])
        self.w, self.wc = self.number[w], self.count[w]
        key = self.h.astype(np.uint64) << np.uint64(32) | self.w.astype(np.uint64)
        self.pairs, self.place = _distinct(key)
        one = np.zeros(len(self.pairs), np.int64)
        one[self.place] = np.arange(len(self.place))
        self.pair_hc, self.pair_wc = self.hc[one], self.wc[one]

    def asked(self, total: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Owners and the places of their pairs; pairs of unknown histories need no owner."""
        at = np.flatnonzero(self.pair_hc > 0)
        h, w = (self.pairs[at] >> np.uint64(32)).astype(np.int64), (self.pairs[at] & np.uint64(START)).astype(np.int64)
        owner, _ = _pair_owner(h, w, self.pair_hc[at], total, parts)
        for p, i in _split(owner):
            yield p, at[i]


def _ask_pairs(uni: Unigrams, parts: int):
    """Of each owner of pairs: pairs (a: differences), counts in learned texts (b), counts of the words (c)."""

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            x = Numbered(Block(row), told.to_pylist())
            count = np.bincount(x.place[x.x.learns], minlength=len(x.pairs))
            for p, at in x.asked(uni.total, parts):
                # the word's count only matters where the pair is learned from
                out.append((p, x.x.block, pack(np.diff(x.pairs[at], prepend=np.uint64(0))), pack(count[at]), pack(np.where(count[at] > 0, x.pair_wc[at], 0)), pack(x.pair_hc[at])))
        return pa.Table.from_batches([_rows(out, PAIRED)])

    return run


PAIRED = ASKED + ", d binary"


def _own_pairs(uni: Unigrams, parts: int):
    """Tells each block the counts of its pairs (a) and, for histories that have an unseen pair in it or no
    discounted follower at all, what the weight is made of (b): followers by count up to CUT, the counts above, and the followers' p(w).
    Rows without a block have the sums, and the parts of frequent histories."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p = key[0].as_py()
        rows = t.sort_by("block").to_pylist()
        asked = [np.cumsum(unpack(r["a"])) for r in rows]
        pairs, place = _distinct(np.concatenate(asked))
        cat = lambda c: np.concatenate([unpack(r[c]) for r in rows]).astype(np.int64)
        count = np.bincount(place, cat("b"), len(pairs)).astype(np.int64)
        wc, hc = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        np.maximum.at(wc, place, cat("c"))
        hc[place] = cat("d")
        h = (pairs >> np.uint64(32)).astype(np.int64)
        hist, of = _distinct(h)
        hist_c = np.zeros(len(hist), np.int64)
        hist_c[of] = hc
        seen = count > 0
        made = np.zeros((len(hist), CUT + 2))
        for r in range(1, CUT + 1):
            made[:, r - 1] = np.bincount(of[count == r], minlength=len(hist))
        made[:, CUT] = np.bincount(of[count > CUT], count[count > CUT], len(hist))
        made[:, CUT + 1] = np.bincount(of[seen], uni.p(wc[seen]), len(hist))
        bare = made[:, :CUT].sum(axis=1) == 0  # no discount leaves anything
        hot = -(-hist_c * parts // max(1, uni.total)) > 1
        out = [(p, None, None, None, _stats(count))]
        out += [(p, None, int(i).to_bytes(8, "little"), made[k].tobytes(), None) for k, i in zip(np.flatnonzero(hot).tolist(), hist[hot].tolist())]
        i = 0
        for r, a in zip(rows, asked):
            at = place[i : i + len(a)]
            need = np.zeros(len(hist), bool)
            need[of[at[~seen[at]]]] = True
            need[of[at]] |= bare[of[at]]
            need = np.flatnonzero(need & ~hot)
            out.append((p, r["block"], pack(count[at]), _with(hist[need], made[need]) if len(need) else None, None))
            i += len(a)
        return pa.Table.from_batches([_rows(out, TOLD)])

    return run


def _with(hist: np.ndarray, made: np.ndarray) -> bytes:
    head = pack(hist)
    body = b"".join([len(x := pack(made[:, j].astype(np.int64))).to_bytes(8, "little") + x for j in range(CUT + 1)])
    return len(head).to_bytes(8, "little") + head + body + zstandard.compress(made[:, CUT + 1].tobytes(), 1)


def _without(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    cols, at = [], 0
    for _ in range(CUT + 2):
        n = int.from_bytes(b[at : at + 8], "little")
        cols.append(unpack(b[at + 8 : at + 8 + n]))
        at += 8 + n
    p = np.frombuffer(zstandard.decompress(b[at:]), np.float64)
    return cols[0].astype(np.int64), np.column_stack([*cols[1:], p]).astype(float)


class Bigrams:
    def __init__(self, stats: list[int], hot: dict[int, np.ndarray]):
        self.d = discounts(stats)
        self.hot = hot

    def over(self, made: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator of seen pairs and weight of unseen ones, by what they are made of and the history's count."""
        kept = made[:, :CUT] @ (self.d[1 : CUT + 1] * np.arange(1, CUT + 1)) + made[:, CUT]
        over = np.where(made[:, :CUT].sum(axis=1) > 0, c, c + 1)
        return over, (1 - kept / over) / (1 - made[:, CUT + 1])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(uni: Unigrams, sent, parts: int):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        bi = sent.value
        told = told.to_pylist()
        words, pairs = [r for r in told if r["kind"] == 0], {r["p"]: r for r in told if r["kind"] == 1}
        out = []
        for row in blocks.to_pylist():
            x = Numbered(Block(row), words)
            count = np.zeros(len(x.pairs), np.int64)
            n_hist, n_made = [np.zeros(0, np.int64)], [np.zeros((0, CUT + 2))]
            for p, at in x.asked(uni.total, parts):
                count[at] = unpack(pairs[p]["a"])
                if pairs[p]["b"]:
                    h, m = _without(pairs[p]["b"])
                    n_hist.append(h)
                    n_made.append(m)
            if bi.hot:
                n_hist.append(np.array(list(bi.hot), np.int64))
                n_made.append(np.stack(list(bi.hot.values())))
            hist, made = np.concatenate(n_hist), np.concatenate(n_made)
            order = np.argsort(hist)
            hist, made = hist[order], made[order]
            h = (x.pairs >> np.uint64(32)).astype(np.int64)
            lower = uni.p(x.pair_wc)
            p = lower.copy()
            seen = count > 0
            p[seen] = bi.d[np.minimum(count[seen], CUT + 1)] * count[seen] / x.pair_hc[seen]
            k = np.minimum(np.searchsorted(hist, h), max(0, len(hist) - 1))
            has = hist[k] == h if len(hist) else np.zeros(len(h), bool)
            if has.any():
                over, weight = bi.over(made[k[has]], x.pair_hc[has])
                p[has] = np.where(seen[has], p[has] * x.pair_hc[has] / over, weight * lower[has])
            token = np.log10(p)[x.place]
            sums = lambda v: np.add.reduceat(v, x.x.first)
            base, score, known = sums(uni.base(x.wc)), sums(token), sums((x.wc > 0).astype(np.int64))
            out += zip(x.x.ids, x.x.held.tolist(), x.x.n.tolist(), known.tolist(), [uni.total] * len(x.x.ids), base.tolist(), score.tolist())
        return pa.Table.from_batches([_rows(out, SCORES)])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Counts and log10 probabilities of every whole text, under a model of those that are not held out.

    Null and empty texts are one end. Rows are neither merged nor dropped, repeated ones count each time;
    other columns are not carried. If nothing is learned from, every word is unknown with probability one."""
    spark = docs.sparkSession
    s = Scratch(spark)
    held = (remainder(F.col("doc_id"), 5) == 1).alias("held")
    blocks = s.write(docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(_blocks, BLOCKS), "blocks")
    # as many owners as keep their share of a block's size
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks.count())
    at_once = lambda d: d.repartition(parts, "p")
    words = s.write(at_once(blocks.mapInArrow(_ask_words(parts), ASKED)).groupBy("p").applyInArrow(_own_words(parts), TOLD), "words")
    total = lambda t: [int(x or 0) for x in t.where("stats is not null").agg(*(F.sum(F.col("stats")[i]) for i in range(CUT + 3))).head()]
    uni = Unigrams(total(words))
    words = words.where("block is not null").select("block", F.lit(0).alias("kind"), "p", "a", "b", F.lit(parts).alias("parts"))
    asked = blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_ask_pairs(uni, parts), PAIRED)
    pairs = s.write(at_once(asked).groupBy("p").applyInArrow(_own_pairs(uni, parts), TOLD), "pairs")
    # frequent histories: at most two rows for each owner
    hot: dict[int, np.ndarray] = {}
    for r in pairs.where("block is null and stats is null").select("a", "b").toLocalIterator():
        h = int.from_bytes(r.a, "little")
        hot[h] = hot.get(h, 0) + np.frombuffer(r.b)
    sent = spark.sparkContext.broadcast(Bigrams(total(pairs), hot))
    pairs = pairs.where("block is not null").select("block", F.lit(1).alias("kind"), "p", "a", "b", F.lit(parts).alias("parts"))
    told = words.unionByName(pairs)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(uni, sent, parts), SCORES)
