"""URL filters on a Bloom filter cascade.

Level 1 encodes the listed keys; level 2 those keys of the corpus that pass level 1 though they aren't
listed; level 3 the listed keys that pass level 2; and so on until a level has no false positive. Over
the key universe that it was built for, membership is exact, and asking needs neither a join nor the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules (action, host, start of the path) and listed hosts of production.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ZONES = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{n}.{z}" for n in LISTED_NAMES for z in LISTED_ZONES)

MAX_LEVELS = 64
MAX_BYTES = 256 << 20


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> list[np.ndarray]:
    """Bits of each key in a level: double hashing, mixed anew for each level."""
    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (h2 + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        b ^= (b >> np.uint64(29)) & ~np.uint64(1)
        return [((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(m) for i in range(k)]


class Cascade:
    """Levels of (number of hashes, bits); a key is a member if the first level that it fails is an even one."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    @property
    def nbytes(self) -> int:
        return sum(words.nbytes for _, words in self.levels)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        k, words = self.levels[level]
        ok = np.ones(len(h1), bool)
        for p in _positions(h1, h2, level, k, len(words) * 64):
            ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """0-based count of levels passed in a row: odd means listed."""
        depth = np.zeros(len(h1), np.int64)
        alive = np.arange(len(h1))
        for level in range(len(self.levels)):
            alive = alive[self.passes(level, h1[alive], h2[alive])]
            depth[alive] += 1
        return depth % 2 == 1


def _sizes(n: int, rate: float) -> tuple[int, int]:
    """Hashes and 64-bit words of a level of n keys."""
    rate = min(0.5, max(rate, 1e-9))
    bits = max(64, math.ceil(1.4427 * n * math.log2(1 / rate)))
    return max(1, round(math.log2(1 / rate))), -(-bits // 64)


def _encode(h1: np.ndarray, h2: np.ndarray, level: int, rate: float) -> tuple[int, np.ndarray]:
    k, size = _sizes(len(h1), rate)
    if size * 8 > MAX_BYTES:
        raise ValueError(f"a level of {size * 8} bytes is more than {MAX_BYTES}; split the list")
    words = np.zeros(size, np.uint64)
    for p in _positions(h1, h2, level, k, size * 64):
        np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
    return k, words


Hashes = tuple[np.ndarray, np.ndarray]


def _without(a: Hashes, b: Hashes) -> Hashes:
    """The distinct keys of a that are not in b."""
    kind = np.dtype([("1", np.uint64), ("2", np.uint64)])
    x, y = (np.array(list(zip(*k)), kind) for k in (a, b))
    left = np.setdiff1d(x, y)
    return left["1"], left["2"]


def _levels(cascade: Cascade, ours: Hashes, others: Hashes) -> Cascade:
    """Further levels, until no key of others passes where it shouldn't; each halves what is left."""
    while len(others[0]):
        level = len(cascade.levels)
        if level >= MAX_LEVELS:
            raise ValueError("the cascade doesn't end: two keys share both hashes")
        cascade.levels.append(_encode(*others, level, 0.5))
        still = cascade.passes(level, *ours)
        ours, others = others, (ours[0][still], ours[1][still])
    return cascade


def build_small(listed: Hashes, universe: Hashes) -> Cascade:
    """A cascade over keys that are all here."""
    if not len(listed[0]):
        return Cascade([])
    cascade = Cascade([_encode(*listed, 0, 0.5)])
    others = _without(universe, listed)
    passing = cascade.passes(0, *others)
    return _levels(cascade, listed, (others[0][passing], others[1][passing]))


def build(listed: Hashes, universe: DataFrame) -> Cascade:
    """A cascade of the listed keys over all keys of a table with columns h1 and h2.

    The table is only read: tasks test its keys against level 1, whose rate leaves about 0.7 of them for
    each listed key, and these alone are made distinct and sent. So no shuffle grows with the corpus, and
    the driver gets no more than in proportion to the list that it holds anyway."""
    n = len(listed[0])
    if not n:
        return Cascade([])
    s = universe.agg(F.approx_count_distinct("h1")).head()[0]
    cascade = Cascade([_encode(*listed, 0, min(0.5, 0.7 * n / max(1, s)))])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
            yield b.filter(pa.array(cascade.passes(0, h1, h2)))

    rows = universe.select("h1", "h2").mapInArrow(test, "h1 long, h2 long").distinct().collect()
    found = tuple(np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (0, 1))
    return _levels(cascade, listed, _without(found, listed))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    raw = F.regexp_extract(F.substr(url, at + 3), r"\A[^/?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(at, F.lit(0)) > 0, lower).otherwise("")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    at = F.instr(url, "://")
    raw = F.regexp_extract(F.substr(url, at + 3), r"\A[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, raw).otherwise("")


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def keys(host_col: str, path_col: str, labels: int, lengths: Sequence[int]) -> Column:
    """Every key that a rule or list could hold for this host and path: suffixes of at most so many
    labels, with starts of the path of the lengths that occur. Longest first, then the longer host."""
    parts = F.split(F.col(host_col), r"\.")
    n = F.size(parts)
    hosts = [F.when(n >= i, F.array_join(F.slice(parts, F.greatest(n - i + 1, F.lit(1)), F.lit(i)), ".")) for i in range(labels, 0, -1)]
    made = [
        F.when(F.length(path_col) >= size, F.struct((-(F.length(h) + size)).alias("a"), (-F.length(h)).alias("b"), F.concat(h, F.substring(path_col, 1, size)).alias("key")))
        for h in hosts
        for size in lengths
    ]
    return F.transform(F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull() & x["key"].isNotNull())), lambda x: x["key"])


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] = LISTED, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Host, path, rule and verdict of every row.

    The longest rule that fits decides (of equal ones that of the longer host); else a row is blocked if
    its host or a domain above it is listed. Null urls, and those without ://, have an empty host and path
    and are allowed. Rows are neither merged nor dropped; other columns are not carried. Rules and list are
    the driver's own, so their size is the caller's; what tasks get are filters of at most MAX_BYTES a level."""
    spark: SparkSession = pages.sparkSession
    for _, h, p in rules:
        if p[:1] != "/" or "/" in h:
            raise ValueError(f"a rule is a host and a path that starts with /: {h}{p}")
    labels = max([len(h.split(".")) for h in [*listed, *(h for _, h, _ in rules)]], default=1)
    lengths = sorted({0, *(len(p) for _, _, p in rules)}, reverse=True)
    of = {a: [f"{h}{p}" for b, h, p in rules if b == a] for a in ("allow", "block")}
    site = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host(F.col(f"`{url_col}`")).alias("host"), path(F.col(f"`{url_col}`")).alias("path"))
    site = site.withColumn("keys", keys("host", "path", labels, lengths))
    universe = site.select(F.explode("keys").alias("key")).select(*_hash(F.col("key")))
    listed_keys = sorted({*of["allow"], *of["block"], *listed})
    rows = spark.createDataFrame([(k,) for k in listed_keys], "key string").select("key", *_hash(F.col("key"))).collect()
    hashed_keys = {r.key: (r.h1, r.h2) for r in rows}
    hashes = lambda names: tuple(np.array([hashed_keys[k][i] for k in sorted(set(names))], np.int64).view(np.uint64) for i in (0, 1))
    every = hashes(listed_keys)
    # membership over the corpus's keys; then, among members, which are rules and which of those block
    member = build(every, universe)
    is_rule, blocks = build_small(hashes([*of["allow"], *of["block"]]), every), build_small(hashes(of["block"]), every)
    sent = spark.sparkContext.broadcast((member, is_rule, blocks))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, is_rule, blocks = sent.value
        for b in batches:
            n = b.num_rows
            lists = b.column(3)
            start = np.asarray(lists.offsets).astype(np.int64)
            row = np.repeat(np.arange(n), np.diff(start))
            h1, h2 = (np.asarray(b.column(i).flatten()).view(np.uint64) for i in (4, 5))
            hit = np.flatnonzero(member.contains(h1, h2))
            ruled = np.zeros(len(h1), bool)
            ruled[hit] = is_rule.contains(h1[hit], h2[hit])
            rule, verdict = np.full(n, -1), np.full(n, "allow", object)
            verdict[row[hit[~ruled[hit]]]] = "block"
            at = np.flatnonzero(ruled)[::-1]  # of a row's rules the first, the longest, is written last
            rule[row[at]] = at
            found = np.flatnonzero(rule >= 0)
            verdict[found] = np.where(blocks.contains(h1[rule[found]], h2[rule[found]]), "block", "allow")
            names = lists.flatten().take(pa.array(rule, mask=rule < 0))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), names.cast(pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    hashed = site.withColumn("h1", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("h2", F.transform("keys", lambda k: F.xxhash64(k, F.lit("second"))))
    return hashed.mapInArrow(decide, SCHEMA)
