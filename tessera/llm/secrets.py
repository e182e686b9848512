"""Secret scans: keyword automaton, anchored expressions near its hits, checksum validation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import digest, rows_of, sha256

#: Keyword -> kind of the expression that is anchored at a hit.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
BASE = ("assign", "access", "hex")
KINDS = {k: i for i, k in enumerate((*BASE, "github", "npm"))}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ANCHORED = {
    "assign": re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
HEX_RUN = re.compile(rb"[0-9a-f]+")
HEX_STEP = 32
HEX_SAMPLE = re.compile(rb"[0-9a-f]")


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def checksum_ok(body: bytes, check: bytes) -> bool:
    """Tokens of these kinds end in the CRC-32 of what stands before, in base 62."""
    return base62(zlib.crc32(body)).encode() == check


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    return checksum_ok(m[1], m[2])


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _hex_spans(raw: bytes) -> Iterator[tuple[int, int]]:
    """Runs of 32 and more. Each covers a place of every 32nd; only around such a place is the expression tried."""
    done = 0
    for hit in HEX_SAMPLE.finditer(raw[HEX_STEP - 1 :: HEX_STEP]):
        at = hit.start() * HEX_STEP + HEX_STEP - 1
        if at < done:
            continue
        end = HEX_RUN.match(raw, at).end()
        start = at
        while start > done and HEX_SAMPLE.match(raw, start - 1):
            start -= 1
        done = end
        if end - start >= 32:
            yield start, end


def find(text: str | None, automat: ahocorasick.Automaton) -> list[tuple[int, int, str, int]]:
    """All spans (start, rank, kind, end) of a whole text in code points."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str, int]] = []
    done = dict.fromkeys(KINDS, 0)
    # bytes.lower() touches A-Z only, and latin-1 keeps one character for each byte
    for last, (kind, n) in automat.iter(raw.lower().decode("latin-1")):
        at = last + 1 - n
        if at < done[kind] or not (m := ANCHORED[kind].match(raw, at)):
            continue
        done[kind] = m.end()
        if _valid(kind, m):
            found.append((at, KINDS[kind], kind, m.end()))
    found += [(s, KINDS["hex"], "hex", e) for s, e in _hex_spans(raw)]
    if found and len(raw) != len(text or ""):
        found.sort()
        places = sorted({p for s, _, _, e in found for p in (s, e)})
        at, chars, to = 0, 0, {}
        for p in places:
            chars += len(raw[at:p].decode("utf-8", "surrogatepass"))
            to[p], at = chars, p
        found = [(to[s], r, k, to[e]) for s, r, k, e in found]
    return sorted(found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automat = automaton()
    for b in rows_of(batches):
        out = []
        for text in b.column(1):
            spans = find(text.as_py(), automat)
            base = [s for s in spans if s[2] in BASE]
            counts = [sum(s[2] == k for s in base) for k in BASE]
            out.append((*counts, sha256(digest(base)), digest(spans)))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of the secrets of every whole text.

    A null or empty text has no span. Rows stay as they are, repeated ones and those with a null id
    included; other columns are not carried. Kinds of one start stand in the order of KINDS."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automat = automaton()
    for b in rows_of(batches):
        at = b.schema.get_field_index("text")
        out = [redacted(t.as_py(), automat) for t in b.column(at)]
        cols = list(b.columns)
        cols[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(cols, b.schema.names)


def redacted(text: str | None, automat: ahocorasick.Automaton) -> str | None:
    """The text with every span, and all that overlap as one, replaced by its first kind in angle brackets."""
    if text is None or not (spans := find(text, automat)):
        return text
    out, at = [], 0
    merged: list[list] = []
    for s, _, k, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"<{k}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in text are replaced. Null texts stay null."""
    return docs.mapInArrow(_redact, docs.schema)
