"""Near duplicates by MinHash: banded minima, signature check, links confirmed on full sets, components.

Copies (equal shingle sets) are one class from the start, so a group of copies costs no pairs. Buckets of
the bands are never paired out: each has LEADERS members, the first in so many random orders of all classes,
that all others are compared with; as buckets of different bands hold different classes, so do leaders differ. Candidates pass a test of sizes and of signatures, then the
best candidate of every class is confirmed on whole sets. Last, the other candidates and buckets that still hold several components:
every class outside of the greatest one is compared with all others, block by block, on whole sets. Components come from alternating
large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, rows_of

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at the threshold meets in no band with probability (1 - 0.75 ** ROWS) ** BANDS = 5e-6.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
LEADERS = 4
#: Shingles of a block of the closing pass at first, blocks a side until they grow, and most shingles of a block and of a group that is one cell.
BLOCK, SIDES, MOST = 48_000, 8, 4_000_000
GROUP = SIDES * MOST
#: Equal bytes of two signatures, of MINIMA: five standard deviations below the threshold.
ALIKE = int(MINIMA * 0.75 - 5 * (MINIMA * 0.75 * 0.25) ** 0.5)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])
_SEED = np.random.default_rng(20240901)
_A = _SEED.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, MINIMA, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up, down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles; of the whole sequence if there are fewer words."""
    raw = _LOW[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        # a word is a polynomial of its bytes, shifted to its start; its length goes in as well
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        size = min(SHINGLE, len(word))
        n = len(word) - size + 1
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = out * np.uint64(0x2545F4914F6CDD1D) + word[i : i + n]
        out = np.sort(_mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


def minima(s: np.ndarray) -> np.ndarray:
    """Of each of MINIMA universal hashes the least value over a set that isn't empty."""
    best = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 256):
            h = _A[:, None] * s[None, i : i + 256]
            h += _B[:, None]
            np.minimum(best, h.min(axis=1), out=best)
    return best


def key_of(s: np.ndarray) -> bytes | None:
    """Equal sets have equal keys; None for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


_SALT = _SEED.integers(1, 1 << 62, (BANDS, ROWS), np.uint64)


def signature(best: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A byte of each minimum, and a 64-bit hash of each band."""
    with np.errstate(over="ignore"):
        mixed = _mix(best)
        bands = _mix((mixed.reshape(BANDS, ROWS) * (_SALT | np.uint64(1))).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes(), bands.view(np.int64)


SIGNED = "doc_id long, n_shingles long, key binary, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        n, keys, sigs, bands = [], [], [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            n.append(len(s))
            keys.append(key_of(s))
            sig, band = signature(minima(s)) if len(s) else (None, None)
            sigs.append(sig)
            bands.append(band)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "key", "sig", "bands"],
        )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, MINIMA) for i in (2, 3))
            same = (x == y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64())], ["a", "b", "same"]).filter(pa.array(same >= ALIKE))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        good = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])


SETS = "key binary, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, text) the key and the set, where the text has the key that it was looked up for: ids can repeat with other texts."""
    for b in rows_of(batches):
        sets = [shingles(t.as_py()) for t in b.column(1)]
        good = [k.as_py() in (None, key_of(x)) for k, x in zip(b.column(0), sets)]
        yield pa.RecordBatch.from_arrays([pa.array(map(key_of, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "shingles"]).filter(pa.array(good, pa.bool_()))


#: What a task of the closing pass gets: a class as member of block j, or as one outside of block i that is compared with block j. Small cells share a pack.
LAID = ("pack", "i", "j", "cell", "key", "n", "sig", "shingles", "root", "member", "outside")
LINKS = "a binary, b binary"


def _linked(t: pa.Table) -> pa.Table:
    """Links that join components, among all pairs of an outside class of block i and a member of block j.

    Signatures and sizes rule pairs out, then whole sets are intersected: the shingles of all members are numbered, those of one
    class marked, and the marks counted for each member. Components joined here are one from then on, so that at most as many
    links are told as there are components less one."""
    t = t.sort_by("key")
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    keys, n = t.column("key").to_pylist(), t.column("n").to_numpy()
    member, outside = (t.column(c).to_numpy(zero_copy_only=False) for c in ("member", "outside"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
    flat = np.frombuffer(b"".join(t.column("shingles").to_pylist()), np.uint64)
    values, number = np.unique(flat, return_inverse=True)
    first = np.append(0, np.cumsum(n))
    _, root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)
    cell = t.column("cell").to_numpy()
    marked = np.zeros(len(values), bool)
    rows: list[tuple[bytes, bytes]] = []
    for x in np.flatnonzero(outside & (~member | (i == j))).tolist():
        # a pair of two outside classes is met in blocks (i, j) and (j, i), and twice in (i, i): once is enough
        twice = outside & (np.arange(len(keys)) <= x) if i == j else outside & (i > j)
        good = member & (cell == cell[x]) & ~twice & (root != root[x]) & (100 * np.minimum(n, n[x]) >= PERCENT * np.maximum(n, n[x]))
        at = np.flatnonzero(good)
        at = at[(sig[at] == sig[x]).sum(axis=1) >= ALIKE]
        if not len(at):
            continue
        marked[number[first[x] : first[x + 1]]] = True
        spans = np.append(0, np.cumsum(n[at]))
        both = np.add.reduceat(marked[number[np.repeat(first[at] - spans[:-1], n[at]) + np.arange(spans[-1])]].astype(np.int64), spans[:-1])
        marked[number[first[x] : first[x + 1]]] = False
        at = at[100 * both >= PERCENT * (n[at] + n[x] - both)]
        for y in at[np.unique(root[at], return_index=True)[1]].tolist():
            rows.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
            root[root == root[y]] = root[x]
    return pa.table([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _closing(s: Scratch, classes: DataFrame, open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that meet in open buckets (h, key, root), all pairs looked at.

    Buckets that share classes are one cell, so that a class is sent once for all of its buckets; only where such a group is
    greater than GROUP shingles each bucket is a cell of its own. Each class that isn't in its cell's greatest component is compared with
    all of the cell's classes, by blocks of about BLOCK shingles against each other, at most SIDES a side until blocks reach MOST.
    Cells of one block are packed to about as much."""
    least = open_rows.groupBy("h").agg(F.min("key").alias("b"))
    edges = s.write(open_rows.join(least, "h").where("key <> b").select(F.col("key").alias("a"), "b"), "grouped")
    groups = components(s, edges, "groups")
    rows = open_rows.select("key", "root").distinct().join(groups.select(F.col("node").alias("key"), F.col("root").alias("team")), "key").join(classes.select("key", "n"), "key")
    rows = s.write(rows.select("key", "root", "team", "n"), "teams")
    heavy = s.write(rows.groupBy("team").agg(F.sum("n").alias("weight")).where(f"weight > {GROUP}").select("team"), "heavy")
    light = rows.select(F.xxhash64("team").alias("cell"), "key", "root", "n", "team")
    if heavy.head():
        split = rows.join(heavy, "team", "left_semi").join(open_rows.select("h", "key"), "key").select(F.xxhash64("team", "h").alias("cell"), "key", "root", "n")
        rows = s.write(light.join(heavy, "team", "left_anti").drop("team").unionByName(split.distinct()), "celled")
    else:
        rows = light.drop("team")
    parts = rows.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).groupBy("cell")
    parts = parts.agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("w").alias("w"))
    parts = parts.withColumn("blocks", F.greatest(F.least(F.ceil(F.col("w") / BLOCK), F.lit(SIDES)), F.ceil(F.col("w") / MOST)).cast("int"))
    packs = max(1, -(-int(rows.agg(F.sum("n")).head()[0]) // BLOCK))
    rows = rows.join(parts.select("cell", "main", "blocks"), "cell").withColumn("own", F.pmod(F.xxhash64("key", "cell"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("pack", F.when(F.col("blocks") == 1, F.pmod("cell", F.lit(packs))).otherwise(F.col("cell"))).withColumn("outside", F.col("root") != F.col("main"))
    # as a member of its own block j with all i, and, if outside, in its own block i with all other j
    to = F.struct(F.col("k").alias("i"), F.col("own").alias("j"), F.lit(True).alias("member"))
    out = F.struct(F.col("own").alias("i"), F.col("k").alias("j"), F.lit(False).alias("member"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("outside") & (F.col("k") != F.col("own")), F.array(to, out)).otherwise(F.array(to))))
    laid = rows.select("pack", "at.*", "cell", "key", "n", "root", "outside").join(classes.select("key", "sig"), "key").join(sets, "key").select(*LAID)
    out = s.write(laid.groupBy("pack", "i", "j").applyInArrow(_linked, LINKS), "closing")
    s.drop("grouped", "groups", "teams", "heavy", "celled")
    return out


#: Most rows of keys that are sent to all tasks, 24 bytes each.
BROADCAST_ROWS = 500_000


#: Edges that one task contracts.
PART = 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (u, v) of a task a star for each of their components: each node with the least one."""
    parent: dict = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kind = None
    for b in batches:
        kind = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((some, [find(x) for x in some]), kind)], ["u", "v"])


def components(scratch: Scratch, edges: DataFrame, name: str, most: int = 100, whole: bool = True) -> DataFrame:
    """(node, root) for every node of the written edges (a, b) with a <> b: root is the least node of its component.

    Tasks of at most PART edges contract these to stars. Large-star and small-star steps alternate, each round's
    distinct edges (joins may be broadcasts, which leave equal ones in several tasks) contracted again, until all edges are stars around least nodes; raises if that takes more than most rounds. Unless
    whole: only contracts, and equal roots still mean one component, but not the other way round. A node of many
    edges has its minimum pre-aggregated, and the join that follows reads two written tables, so that skewed parts of it can be split."""
    made: list[str] = []

    def write(df: DataFrame, what: str) -> DataFrame:
        made.append(what)
        return scratch.write(df, what)

    def contracted(e: DataFrame, what: str) -> DataFrame:
        return write(e.coalesce(max(1, -(-e.count() // PART))).mapInArrow(_contract, ", ".join(f"{c} {e.schema[0].dataType.simpleString()}" for c in "uv")), what)

    e = contracted(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), f"{name}/0")
    for i in range(1, most + 1) if whole else ():
        # a star forest: no node is a member twice, or a member and a centre
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("member")), F.struct(F.col("v").alias("x"), F.lit(0).alias("member")))).alias("p")
        if not e.select(ends).select("p.*").groupBy("x").agg(F.sum("member").alias("n"), F.min("member").alias("least")).where("n > 1 or n = 1 and least = 0").head():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}/l{i}")
        large = write(both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), f"{name}/el{i}")
        m = write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}/s{i}")
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")
        small = write(large.join(m, "u").select(pairs).select("p.u", "p.v").where("u <> v").distinct(), f"{name}/es{i}")
        e = contracted(small, f"{name}/{i}")
        scratch.drop(*made[:-1])
        made = made[-1:]
    else:
        if whole:
            raise RuntimeError(f"components are not done after {most} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def _sets_of(d: DataFrame, asked: DataFrame) -> DataFrame:
    """key and set of the classes asked for (key, rep), from a row with that id and that key."""
    few = asked.count() <= BROADCAST_ROWS
    wanted = asked.where("rep is not null").withColumnRenamed("rep", "doc_id")
    found = d.join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "text").mapInArrow(_sets, SETS)
    if asked.where("rep is null").head():  # classes of rows without an id, by their text's key
        lost = d.where("doc_id is null").select(F.lit(None).cast("binary").alias("key"), "text").mapInArrow(_sets, SETS)
        found = found.unionByName(lost.join(asked.where("rep is null").select("key"), "key", "left_semi"))
    return found.groupBy("key").agg(F.first("shingles").alias("shingles"))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row, from whole texts.

    Texts that are null or without a word have an empty set, link with nothing and are their own component.
    Rows with equal sets are one component whatever their ids; its id is the least doc_id in it that isn't
    null. A repeated doc_id is kept as often as it occurs. Other columns are not carried."""
    signed, of, s = _rooted(docs)
    named = of.join(of.groupBy("root").agg(F.min("rep").alias("component")), "root").select("key", "component")
    out = signed.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """doc_id, n_shingles and key (of its set) of each row; key, rep (its least id) and root (of its component) of each class; both written."""
    s = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = s.write(d.mapInArrow(_sign, SIGNED), "signed")
    classes = s.write(
        signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    signed = signed.select("doc_id", "n_shingles", "key")
    # buckets with two classes and more
    rows = classes.select("key", F.explode("bands").alias("h"))
    shared = rows.groupBy("h").count().where("count > 1").select("h")
    rows = s.write(rows.join(shared, "h"), "buckets")
    least = lambda j: F.min(F.struct(F.xxhash64("key", F.lit(j)).alias("o"), F.col("key").alias("k")))["k"]
    leaders = s.write(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*(least(j) for j in range(LEADERS)))).alias("leaders")), "leaders")
    pairs = rows.join(leaders, "h").select("key", F.explode("leaders").alias("leader")).where("key <> leader")
    pairs = pairs.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    sig = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    near = s.write(near.select("a", "b", "sa", "sb").mapInArrow(_alike, "a binary, b binary, same long"), "near")
    # sets of the classes that are in question: candidates, and all in buckets with pairs of classes that are no leaders
    wide = leaders.where("n - size(leaders) > 1").select("h")
    asked = near.select(F.explode(F.array("a", "b")).alias("key")).unionByName(rows.join(wide, "h").select("key")).distinct()
    asked = s.write(asked.join(classes.select("key", "rep"), "key"), "asked")
    sets = s.write(_sets_of(d, asked), "sets")
    one = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}"))
    best = near.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "same"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "same"))).alias("p"))
    best = best.groupBy("p.x").agg(F.max(F.struct("p.same", "p.y"))["y"].alias("y"))
    best = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    best = s.write(best.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_confirm, LINKS + ", good boolean"), "best")
    links = best.where("good").select("a", "b")
    roots = s.write(components(s, links, "c1"), "roots1")
    # what is open: other candidates, and buckets where classes that were no leaders are in several components
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    left = near.join(best, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left").where("not coalesce(ra = rb, false)")
    left = left.select(F.xxhash64("a", "b").alias("h"), F.explode(F.array(F.struct(F.col("a").alias("key"), F.coalesce("ra", "a").alias("root")), F.struct(F.col("b").alias("key"), F.coalesce("rb", "b").alias("root")))).alias("p")).select("h", "p.*")
    rooted = s.write(rows.join(wide, "h").join(roots.withColumnRenamed("node", "key"), "key", "left").select("h", "key", F.coalesce("root", "key").alias("root")), "wide")
    parted = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    open_rows = s.write(rooted.join(parted, "h").unionByName(left), "open")
    if open_rows.head():
        third = _closing(s, classes, open_rows, sets)
        roots = components(s, links.unionByName(third), "c2")
    s.drop("buckets", "leaders", "near", "asked", "sets", "wide", "open")
    # a class stands for itself unless it is in a component
    of = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    of = s.write(of, "rooted")
    s.drop("classes", "best", "c1", "roots1", "closing", "c2")
    return signed, of, s


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        keys = pa.array([key_of(shingles(t.as_py())) for t in b.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], keys], ["row", "id", "o", "key"])


def _hashed(docs: DataFrame) -> Column:
    """A hash of all columns; maps have no hash of their own and count as JSON."""
    return F.xxhash64(*(F.to_json(F.array(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields))


def kept(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of one document of each component: that of the least id that isn't null.

    Of several such rows one whole row stays, the least by its columns' hash; of a component without any id one row stays as well.
    Rows of one id with different texts are told apart by their texts. Of texts without a word one row stays for each
    id, and all that have no id."""
    signed, of, s = _rooted(docs)
    chosen = of.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("c")).select("c.rep", "c.key")
    chosen = s.write(chosen, "chosen")
    # an id with rows of one class needs no look at the text
    several = signed.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("key").alias("x"), F.max("key").alias("y"), F.min(F.col("key").isNull()).alias("blank"), F.max(F.col("key").isNull()).alias("some"))
    several = s.write(several.where("x <> y or some").select("id", "blank"), "several")
    mixed = several.where("not blank").select("id")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"), _hashed(docs).alias("o"))
    asked = chosen.where("rep is not null").select(F.col("rep").alias("id")).join(mixed, "id", "left_anti").unionByName(several.where("blank").select("id"))
    one = lambda d, *by: d.groupBy(*by).agg(F.min_by("row", "o").alias("row")).select("row.*")
    out = one(rows.select("id", "row", "o").join(asked, "id", "left_semi"), "id")
    few = rows.where("id is null").unionByName(rows.join(mixed, "id", "left_semi").select(rows.columns))
    schema = T.StructType([*(rows.schema[c] for c in ("row", "id", "o")), T.StructField("key", T.BinaryType())])
    few = few.select("row", "id", "o", "t").mapInArrow(_keys, schema)
    stay = few.where("key is not null").join(chosen.withColumnRenamed("rep", "of"), "key").where("id <=> of")
    blank = few.where("key is null")
    out = out.unionByName(one(stay, "key")).unionByName(one(blank.where("id is not null"), "id")).unionByName(blank.where("id is null").select("row.*"))
    return out
