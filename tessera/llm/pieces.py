"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a word with the spaces before it; pieces never reach over them) are laid
out in one text, whose suffixes are sorted. Every piece of the vocabulary is binary-searched in it: its
range of suffixes are its occurrences, the edges. Sorted by position they tell what any span is. Then the
edges are relaxed as the model says: of adjacent symbols whose union is an edge the best is joined, the
left one of equals, until none is left. What remains without a piece falls back to bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rows_of

SPACE = "▁"
#: Units met lately, with their ids, are kept by a task: up to so many, and the generation before.
CACHE = 300_000
#: Characters of the text that is indexed at a time.
PART = 400_000
#: Units of more characters are relaxed with a heap each, the others side by side in rounds.
LONG = 200


class Vocabulary:
    """Pieces of a model: normal ones with scores, one for each byte, one for what has no piece."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[str]):
        self.pieces = list(pieces)
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.control = {i for i, k in enumerate(kinds) if k == "control"}
        inner = [pieces[i] for i in normal if SPACE in pieces[i].lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces reach over spaces: {inner[:3]}")
        #: pieces as code points, by length; rank: 0 is the best score, equal scores share one
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        best = sorted({scores[i] for i in normal}, reverse=True)
        rank = {s: r for r, s in enumerate(best)}
        order = sorted(normal, key=lambda i: pieces[i])
        self.normal = [pieces[i] for i in order]
        self.ids = np.array(order, np.int64)
        self.ranks = np.array([rank[scores[i]] for i in order], np.int64)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        kind = lambda i: "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal"
        return cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], [kind(i) for i in n])


UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Matcher:
    """Code points of all pieces, laid out once; encodes batches of units."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.lengths = np.array([len(p) for p in v.normal])
        self.grid = np.zeros((len(v.normal), v.longest), np.int64)
        for i, p in enumerate(v.normal):
            self.grid[i, : len(p)] = [ord(c) for c in p]

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """All occurrences of pieces in a text, by position: at place * longest + length - 1 the piece, or -1.

        Suffixes are sorted by their first characters, numbered anew (0: the separator) so that several
        share a 64-bit word. Every piece is binary-searched by as much; of the longer ones each occurrence
        found is compared in the words that follow."""
        alphabet = np.flatnonzero(np.bincount(codes))
        alphabet = alphabet[alphabet > 0]
        out = np.full(len(codes) * self.v.longest, -1, np.int32)
        if not len(alphabet):
            return out
        bits = 8 if len(alphabet) < 255 else 16 if len(alphabet) < 65535 else 32
        per = 64 // bits
        words = -(-self.v.longest // per)
        number = np.searchsorted(alphabet, self.grid)
        there = alphabet[np.minimum(number, len(alphabet) - 1)] == self.grid
        pieces = np.flatnonzero((there | (self.grid == 0)).all(axis=1))
        low = np.zeros((len(pieces), words * per), np.uint64)
        low[:, : self.v.longest] = np.where(self.grid[pieces] > 0, number[pieces] + 1, 0)
        lengths = self.lengths[pieces]
        high = np.where(np.arange(words * per) < lengths[:, None], low, np.uint64((1 << bits) - 1))
        n = len(codes)
        renamed = np.zeros(int(alphabet[-1]) + 1, np.uint64)
        renamed[alphabet] = np.arange(1, len(alphabet) + 1)
        text = np.concatenate([renamed[codes], np.zeros(words * per, np.uint64)])

        def pack(column, at: int) -> np.ndarray:
            w = column(at).copy()
            for i in range(at + 1, at + per):
                w <<= np.uint64(bits)
                w |= column(i)
            return w

        key = pack(lambda i: text[i : i + n], 0)
        suffixes = np.argsort(key)
        rows = key[suffixes]
        first = np.searchsorted(rows, pack(lambda i: low[:, i], 0), side="left")
        count = np.searchsorted(rows, pack(lambda i: high[:, i], 0), side="right") - first
        which = np.repeat(np.arange(len(pieces)), count)
        place = suffixes[np.repeat(first, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        long = np.flatnonzero(lengths[which] > per)
        same = np.ones(len(which), bool)
        for w in range(1, words):
            at = text[np.minimum(place[long, None] + np.arange(w * per, (w + 1) * per), len(text) - 1)]
            want = low[which[long], w * per : (w + 1) * per]
            same[long] &= ((at == want) | (want == 0)).all(axis=1)
        place, which = place[same], which[same]
        out[place * self.v.longest + lengths[which] - 1] = pieces[which]
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as bytes of little-endian 32-bit numbers; the text of at most PART units' characters at a time."""
        out: list[bytes] = []
        part, size = [], 0
        for u in units:
            part.append(u)
            size += len(u) + 1
            if size >= PART:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part) if part else out

    def _encode(self, units: list[str]) -> list[bytes]:
        v, n_units = self.v, len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        table = self.edges(codes)
        n, top = len(codes), v.longest
        ends = np.cumsum(sizes + 1) - 1  # places of the separators
        #: symbols as a doubly linked list over places; a separator is no symbol and never joined
        right = np.arange(1, n + 1)
        size = np.ones(n, np.int64)
        symbol = np.full(n, -1, np.int64)

        def look(at: np.ndarray, length: np.ndarray) -> np.ndarray:
            """The piece of each span, or -1."""
            return np.where(length <= top, table[at * top + np.minimum(length, top) - 1], -1)

        is_end = np.zeros(n + 1, bool)
        is_end[ends] = is_end[n] = True
        places = np.flatnonzero(~is_end[:n])
        symbol[places] = look(places, size[places])
        unit_of = np.repeat(np.arange(n_units), sizes + 1)
        # rank of joining the symbol at a place with the next one; the best of a unit is joined in each round
        none = np.iinfo(np.int64).max
        joint = np.full(n, -1, np.int64)
        rank = np.full(n, none)

        def weigh(at: np.ndarray) -> None:
            nxt = right[at]
            ok = ~is_end[nxt]
            joint[at], rank[at] = -1, none
            at, nxt = at[ok], nxt[ok]
            p = look(at, size[at] + size[nxt])
            joint[at] = p
            rank[at] = np.where(p >= 0, v.ranks[np.maximum(p, 0)], none)

        weigh(places)
        left = np.arange(-1, n - 1)
        for i in np.flatnonzero(sizes > LONG).tolist():
            a, b = int(ends[i] - sizes[i]), int(ends[i])
            size[a:b], symbol[a:b] = self._relax(table[a * top : b * top], symbol[a:b])
            rank[a:b] = none
        while len(live := np.flatnonzero(rank < none)):
            # places ascend, so the first of a unit's best is its left one
            u = unit_of[live]
            start = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            best = np.minimum.reduceat(rank[live], start)
            chosen = live[rank[live] == np.repeat(best, np.diff(np.append(start, len(live))))]
            chosen = chosen[np.append(True, unit_of[chosen][1:] != unit_of[chosen][:-1])]
            gone = right[chosen]
            symbol[chosen] = joint[chosen]
            size[chosen] += size[gone]
            right[chosen] = right[gone]
            inner = right[chosen] < n
            left[right[chosen][inner]] = chosen[inner]
            size[gone], rank[gone] = 0, none
            before = left[chosen]
            before = before[before >= 0]
            weigh(np.concatenate([chosen, before[~is_end[before]]]))
        # what is left: pieces, or single characters that fall back to bytes
        heads = np.flatnonzero((size > 0) & ~is_end[:n])
        owner, ids = unit_of[heads], np.where(symbol[heads] >= 0, v.ids[np.maximum(symbol[heads], 0)], -1)
        bounds = np.searchsorted(owner, np.arange(n_units + 1))
        raw = ids.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in dict.fromkeys(owner[ids < 0].tolist()):
            spelled: list[int] = []
            for k in range(bounds[i], bounds[i + 1]):
                spelled += [int(ids[k])] if ids[k] >= 0 else self.spell(chr(codes[heads[k]]))
            out[i] = np.array(spelled, "<i4").tobytes()
        return out

    def _relax(self, table: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes (0: part of the symbol before) and pieces of the symbols of one unit, whose edges are given by place."""
        n, top, look, ranks = len(symbol), self.v.longest, table.item, self.v.ranks.tolist()
        size, piece = [1] * n, symbol.tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def pair(at: int) -> tuple[int, int, int, int] | None:
            """rank, place, size and piece of a symbol with the next one."""
            nxt = right[at]
            if nxt >= n or (long := size[at] + size[nxt]) > top:
                return None
            p = look(at * top + long - 1)
            return (ranks[p], at, long, p) if p >= 0 else None

        heap = [x for at in range(n) if (x := pair(at))]
        heapify(heap)
        while heap:
            _, at, long, p = heappop(heap)
            # pairs that changed since have another size, or their symbol is gone
            if not size[at] or right[at] >= n or size[at] + size[right[at]] != long:
                continue
            gone = right[at]
            size[at], size[gone], piece[at] = long, 0, p
            right[at] = nxt = right[gone]
            if nxt < n:
                left[nxt] = at
            for k in (left[at], at):
                if k >= 0 and (x := pair(k)):
                    heappush(heap, x)
        return np.array(size), np.array(piece)

    def spell(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.v.byte_ids[b] for b in raw] if all(b in self.v.byte_ids for b in raw) else [self.v.unknown]


class Codec:
    """Encodes and decodes whole texts; keeps the ids of units in caches of bounded size."""

    def __init__(self, v: Vocabulary):
        self.v, self.matcher = v, Matcher(v)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        long = {c for p in v.normal if len(p) > 1 for c in p}
        #: single characters that stand in no longer piece end units, so that units stay short
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in long and chr(c) != " ")
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else UNIT.pattern)
        byte_of = {i: b for b, i in v.byte_ids.items()}
        self.bytes = [bytes([byte_of[i]]) if i in byte_of else b"" if i in v.control else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]

    def units(self, text: str) -> list[str]:
        """Whole of a text, spaces marked, one before its start."""
        return self.unit.findall((SPACE + text).replace(" ", SPACE)) if text else []

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.units(t or "") for t in texts]
        found = [list(map(self.young.get, s)) for s in split]
        new = {u for s, f in zip(split, found) if None in f for u, x in zip(s, f) if x is None}
        if new:
            if len(self.young) + len(new) > CACHE:
                self.old, self.young = self.young, {}
            fresh = {u: x for u in new if (x := self.old.get(u)) is not None}
            rest = [u for u in new if u not in fresh]
            fresh.update(zip(rest, self.matcher.encode_units(rest)))
            self.young.update(fresh)
            found = [[fresh[u] if x is None else x for u, x in zip(s, f)] if None in f else f for s, f in zip(split, found)]
        return [b"".join(f) for f in found]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, bytes put together, the mark before the start taken off."""
        text = b"".join([self.bytes[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def _codec(name: str) -> Codec:
    """One for each worker: the sorted pieces are the same for all its tasks."""
    return Codec(Vocabulary.load(SparkFiles.get(name)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenize(docs: DataFrame, model: str | None = None, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, ids (array of int), n_tokens and round_trip: whether decoding gives the text back.

    Null and empty texts have no ids; of a null text the round trip is true. Rows are neither merged nor
    dropped; columns that are not in keep are not carried. model: a SentencePiece model file on the
    driver, sent to all executors."""
    path = model or default_model()
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>, n_tokens long, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for b in rows_of(batches, 4 << 20):
            at = b.schema.get_field_index("__text")
            texts = b.column(at).to_pylist()
            encoded = codec.encode(texts)
            same = [codec.decode(e) == (t or "") for e, t in zip(encoded, texts)]
            sizes = np.array([len(e) // 4 for e in encoded], np.int64)
            flat = pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)
            rest = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), ids, pa.array(sizes), pa.array(same)], [*rest, "ids", "n_tokens", "round_trip"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)
