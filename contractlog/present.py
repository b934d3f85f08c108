"""Reports on the driver: the compact text notation, JSON envelopes, discovery of stores.

Everything here works on rows that a caller has asked to see.
"""

from __future__ import annotations

import json
import math
import os
import re

from contractlog.contract import ContractError, load_contract

ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
#: What is never left bare, and what reads as a number.
BARE_NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")
WORDS, MARKS, STARTS = ("true", "false", "null"), ':"\\[]{},', "-#"
#: Names of a store's contract, by the store's stem, in order of preference.
CONTRACT_NAMES = ("schema-{}.yaml", "schema-{}.yml", "{}.schema.yaml", "{}.schema.yml", "{}.yaml", "{}.yml")
#: Folders that are never searched.
SKIPPED = {"node_modules", "__pycache__", "venv", ".venv", "target", "dist", "build", "vendor", "site-packages"}
#: Folders below a start that a search enters by itself, and stores that it shows.
DEPTH, MOST = 3, 20


def escape(text: str) -> str:
    return "".join(ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text)


def quoted(text: str) -> str:
    return f'"{escape(text)}"'


def _blank_edges(text: str) -> bool:
    return not text or text[0] in " \t" or text[-1] in " \t" or any(c < " " for c in text)


def needs_quotes(text: str) -> bool:
    return _blank_edges(text) or text in WORDS or text[0] in STARTS or any(c in MARKS for c in text) or bool(BARE_NUMBER.fullmatch(text))


def number(x: float) -> str:
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "null"
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else repr(x)


def _plain(x) -> str | None:
    """What isn't text: null, booleans and numbers."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    return number(x) if isinstance(x, (int, float)) else None


def _spelt(x) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def scalar(x) -> str:
    """A value where commas separate and a colon names: quoted unless it can't be misread."""
    plain = _plain(x)
    if plain is not None:
        return plain
    text = _spelt(x)
    return quoted(text) if needs_quotes(text) else text


def alone(x) -> str:
    """A value that has a line of its own: only its ends and control characters need quotes."""
    plain = _plain(x)
    if plain is not None:
        return plain
    text = _spelt(x)
    return quoted(text) if _blank_edges(text) else text


def _name(key) -> str:
    return quoted(str(key)) if needs_quotes(str(key)) else str(key)


def _flat(x) -> bool:
    return not isinstance(x, (dict, list))


def notation(value: dict, depth: int = 0) -> str:
    """Nested objects by indentation; lists of flat objects as tables."""
    pad, out = "  " * depth, []
    for key, x in value.items():
        if isinstance(x, dict) and x:
            out += [f"{pad}{_name(key)}:", notation(x, depth + 1)]
        elif isinstance(x, dict):
            out.append(f"{pad}{_name(key)}: {{}}")
        elif isinstance(x, list):
            head, body = listed(x)
            out.append(f"{pad}{_name(key)}{head}")
            out += [f"{pad}  {line}" for line in body]
        else:
            out.append(f"{pad}{_name(key)}: {scalar(x)}")
    return "\n".join(out)


def listed(items: list) -> tuple[str, list[str]]:
    """What follows a list's name, and the lines below it.

    Flat objects: a table whose head holds their fields as they are spelt. Scalars: one line,
    or a line each where some text has a blank or a comma. Anything else: JSON as a quoted text.
    """
    if not items:
        return ": []", []
    count = len(items)
    if all(isinstance(x, dict) for x in items):
        fields = [str(f) for f in dict.fromkeys(f for x in items for f in x)]
        if all(_flat(v) for x in items for v in x.values()):
            return f"[{count}]{{{','.join(fields)}}}:", [",".join(scalar(x.get(f)) for f in fields) for x in items]
    if not all(map(_flat, items)):
        return f"[{count}]:", [scalar(json.dumps(x, ensure_ascii=False)) for x in items]
    if any(isinstance(x, str) and (" " in x or "," in x) for x in items):
        return f"[{count}]:", [alone(x) for x in items]
    return f"[{count}]: " + ",".join(map(scalar, items)), []


def truncated(x, most: int):
    """(text cut to so many characters, its full length or None if it wasn't cut)."""
    return (x[:most] + "...", len(x)) if isinstance(x, str) and len(x) > most else (x, None)


def from_home(path: str) -> str:
    """The path with ~ for the user's folder."""
    home = os.path.expanduser("~").rstrip("/")
    return "~" + path[len(home) :] if home and (path == home or path.startswith(home + "/")) else path


def envelope(store, limit: int | None = None, fields: list[str] | None = None) -> dict:
    """{revision, records, bad_lines} of one snapshot."""
    from contractlog.operators.fold import ordered

    at = store.snapshot()
    rows = [json.loads(r.record) for r in ordered(store.live(at), limit).collect()]
    rows = [{f: r.get(f) for f in fields} for r in rows] if fields else rows
    return {"revision": at.revision, "records": rows, "bad_lines": store.first_bad_lines(at)}


def find_contract(store_path: str) -> str | None:
    folder, stem = os.path.split(re.sub(r"\.jsonl$", "", store_path))
    return next((p for n in CONTRACT_NAMES if os.path.isfile(p := os.path.join(folder, n.format(stem)))), None)


def _stores_below(folder: str, depth: int):
    """Paths of stores, folder by folder: .jsonl files, and folders that hold a log and its commits."""
    entries = sorted(os.scandir(folder), key=lambda e: e.name)
    inner = []
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if os.path.isdir(os.path.join(e.path, "_commits")):
                yield e.path
            elif not e.name.startswith(".") and e.name not in SKIPPED:
                inner.append(e.path)
        elif e.name.endswith(".jsonl"):
            yield e.path
    if depth > 0:
        for path in inner:
            yield from _stores_below(path, depth - 1)


def discover(folder: str, depth: int = DEPTH, most: int | None = MOST, count=None) -> tuple[list[dict], bool]:
    """Stores below a folder, and whether there are more than shown.

    count: called with a store's path and contract for its number of live keys; stores without
    a contract have none to count by.
    """
    found = []
    for path in _stores_below(folder, depth):
        if most is not None and len(found) == most:
            return found, True
        at = find_contract(path)
        row = {"file": os.path.relpath(path, folder), "contract": at and os.path.relpath(at, folder), "records": 0}
        if at:
            try:
                contract = load_contract(at)
                row["records"] = count(path, contract) if count else 0
            except (ContractError, OSError):
                row["contract"] += " (invalid)"
        found.append(row)
    return found, False
