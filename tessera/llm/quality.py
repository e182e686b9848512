"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds its measurements and one failure bit a
rule. A policy is a versioned mask of rules: applying one, or working out what each of its rules does
alone, needs the bits only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import rows_of, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_upper", "n_letters")
SYMBOLS, UPPER, LOWER, SPACE = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b" \t\n\x0b\x0c\r"

#: The rules in the order of their bits; a row fails a rule if its condition holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamations": "2 * n_exclaims > n_words",
    "upper_case": "2 * n_upper > n_letters",
    "duplicate_lines": "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Policies by version: names of the rules that reject. The base rules are in each.
BASE = ("few_words", "repeated_windows")
POLICIES = {1: BASE, 2: tuple(RULES)}


def mask(version: int) -> int:
    return sum(BIT[r] for r in POLICIES[version])


def repeated_words(w: list[str]) -> int:
    """Words in 8-word windows that are found twice or more. Hashes find candidates, the words decide."""
    n = len(w) - WINDOW + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    candidates = order[np.append(same, False) | np.append(False, same)]
    runs: dict[int, list[int]] = {}
    for i in candidates.tolist():
        runs.setdefault(int(key[i]), []).append(i)
    covered = np.zeros(len(w) + 1, np.int64)
    for places in runs.values():
        seen = Counter(tuple(w[i : i + WINDOW]) for i in places)
        for i in places:
            if seen[tuple(w[i : i + WINDOW])] > 1:
                covered[i] += 1
                covered[i + WINDOW] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    w = words(text)
    lines = [x for x in text.split("\n") if x and (x[0] not in " \t\x0b\x0c\r" or words(x))]
    upper = count(UPPER)
    return (len(w), len(text) - count(SPACE), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(w), len(lines), raw.count(b"!"), upper, upper + count(LOWER))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns (row, text): row and the measures of the text."""
    for b in rows_of(batches):
        cols = list(zip(*(measure(t.as_py()) for t in b.column(1)))) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["row", *MEASURES])


def bits() -> Column:
    """One expression for all rules."""
    e = F.lit(0).cast("long")
    for name, rule in RULES.items():
        e = e + F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
    return e


def _ledger(docs: DataFrame, carried: Sequence[str], text_col: str) -> DataFrame:
    """row (a struct of the carried columns, so that no name of theirs clashes), MEASURES and fail_bits of each row."""
    # a struct of no columns is none
    row = F.struct(*(F.col(f"`{c}`") for c in carried)) if carried else F.lit(True)
    rows = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return rows.mapInArrow(_measured, schema).withColumn("fail_bits", bits())


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep, MEASURES and fail_bits for each row; a kept column may not be named as one of these.

    Null and empty texts measure 0 throughout and fail few_words. Rows are neither merged nor dropped;
    columns that are not in keep are not carried."""
    if clash := {*keep} & {*MEASURES, "fail_bits"}:
        raise ValueError(f"columns of the ledger: {sorted(clash)}")
    return _ledger(docs, keep, text_col).select(*(F.col(f"row.`{c}`") for c in keep), *MEASURES, "fail_bits")


def store(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger, written once to a folder that policies and ablations then read."""
    ledger(docs, keep).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def verdict(version: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: rows that fail it, that it alone rejects, and that stay without it.

    One pass groups the ledger by its bits (at most 2 ** len(RULES) groups); everything else is arithmetic on those."""
    groups = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[version]))).alias("r")
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("fail_bits").bitwiseAND(F.lit(mask(version)).bitwiseAND(F.bitwise_not(F.col("r.bit")))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return (
        groups.select("*", rules)
        .groupBy("r.rule")
        .agg(total(hit).alias("n_failed"), total(hit & rest).alias("n_only"), total(rest).alias("n_kept_without"))
    )


VERSION = 2


def judged(docs: DataFrame, version: int = VERSION) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(1))) != 0
    return ledger(docs).select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & verdict(version)).alias("kept"), "fail_bits", *MEASURES[5:])


def kept(docs: DataFrame, version: int = VERSION) -> DataFrame:
    """The rows, with all their columns, that the policy keeps; they may have any names, also those of measures."""
    return _ledger(docs, docs.columns, "text").where(verdict(version)).select("row.*")
