"""Small catalogs, parsed strictly on the driver, and names of folders."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable
from hashlib import sha256

#: Characters that no folder name may have, and names that some systems reserve.
FORBIDDEN = r'<>:"/\|?*'
RESERVED = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}


def parse_json(text: str) -> object:
    """JSON of which no object has a key twice, and which has no NaN or infinity."""

    def once(pairs: list[tuple[str, object]]) -> dict[str, object]:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("an object has a key twice")
        return out

    def refuse(word: str) -> None:
        raise ValueError(f"not a JSON number: {word}")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def parse_csv(text: str) -> list[dict[str, str]]:
    """Rows of a CSV text with a header of distinct names; a row of another width raises, empty lines don't count."""
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r]
    except csv.Error as e:
        raise ValueError(f"not a CSV table: {e}") from e
    if not rows or len(set(rows[0])) < len(rows[0]):
        raise ValueError("a table needs a header of distinct names")
    bad = next((i for i, r in enumerate(rows) if len(r) != len(rows[0])), None)
    if bad is not None:
        raise ValueError(f"row {bad} has {len(rows[bad])} of {len(rows[0])} cells")
    return [dict(zip(rows[0], r)) for r in rows[1:]]


def labels(pairs: Iterable[tuple[object, object]]) -> dict[str, str]:
    """Code (upper case) to label. Codes are plain names, labels have a character, and a code has one label."""
    out: dict[str, str] = {}
    for code, label in pairs:
        if not (isinstance(code, str) and isinstance(label, str)):
            raise ValueError("codes and labels are texts")
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", code) or not label.strip():
            raise ValueError(f"no code, or no label: {code!r}")
        if out.setdefault(code.upper(), label.strip()) != label.strip():
            raise ValueError(f"two labels of {code.upper()}")
    return out


def labels_of_json(text: str) -> dict[str, str]:
    d = parse_json(text)
    version = d.get("schema_version") if isinstance(d, dict) else None
    if isinstance(version, bool) or version != 1 or not isinstance(version, int) or not isinstance(d.get("names"), dict) or not isinstance(d.get("source", {}), dict):
        raise ValueError("a catalog has schema_version 1 and names")
    return labels(d["names"].items())


def labels_of_csv(text: str) -> dict[str, str]:
    rows = parse_csv(text)
    if rows and not {"index_code", "industry_name"} <= rows[0].keys():
        raise ValueError("a catalog has the columns index_code and industry_name")
    return labels((r["index_code"], r["industry_name"]) for r in rows)


def folder_names(names: Iterable[str]) -> dict[str, str]:
    """A folder for each distinct name, different even where case does not count.

    A plain name is its own folder; any other, and one that is taken, gets part of its hash behind it."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in dict.fromkeys(names):
        plain = "".join("_" if c in FORBIDDEN or ord(c) < 32 else c for c in name)[:100].rstrip(" .") or "unnamed"
        if plain.split(".")[0].lower() in RESERVED:
            plain = f"_{plain}"
        digest = sha256(name.encode("utf-8", "surrogatepass")).hexdigest()
        tries = [plain] if plain == name else []
        tries += [f"{plain}-{digest[:n]}" for n in range(10, 65)]
        out[name] = next(t for t in tries if t.lower() not in taken)
        taken.add(out[name].lower())
    return out
