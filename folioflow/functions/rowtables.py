"""Rows of the tables that a note's script blocks hold, as data and not as a program."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROW = "struct<path:string,name:string,tags:array<string>,excerpt:string,ctime:string,mtime:string>"
# How a block is marked, and the lists and calls in it that hold rows.
BLOCK = r"(?s)```dataviewjs\s*\n(.*?)```"
LIST = re.compile(r"\b(?:noteListRows|rows|data|notes)\s*=\s*(?=\[)")
CALL = re.compile(r"\bdv\.table\s*\(\s*(?=\[)")

#: A string in either quotes, a mark, white space, or a run of anything else.
TOKEN = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[\[\]{}(),:;]|\s+|[^\s"'\[\]{}(),:;]+|.""", re.S)
BARE = re.compile(r"[A-Za-z0-9_$]+")


def literal(text: str, at: int) -> list[str] | None:
    """The tokens of the bracketed value that begins at ``at``; null if it does not end. Brackets in strings do not count."""
    depth, found = 0, []
    for m in TOKEN.finditer(text, at):
        found.append(m[0])
        depth += (m[0] in "[{") - (m[0] in "]}")
        if depth == 0:
            return found
    return None


def repaired(tokens: list[str]) -> str:
    """JSON of a script's literal: bare keys get quotes, single quotes become double ones, commas before a closing bracket go."""
    solid = [t for t in tokens if not t.isspace()]
    out = []
    for i, t in enumerate(solid):
        after = solid[i + 1] if i + 1 < len(solid) else ""
        if t == "," and after in ("]", "}"):
            continue
        if t[0] == "'" and len(t) > 1:
            t = json.dumps(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1], flags=re.S))
        elif after == ":" and BARE.fullmatch(t) and i and solid[i - 1] in ("{", ","):
            t = f'"{t}"'
        out.append(t)
    return "".join(out)


def value(tokens: list[str] | None) -> list:
    """A list as it stands, or as it is repaired; empty if it is neither."""
    for source in (lambda: "".join(tokens or ()), lambda: repaired(tokens or [])):
        try:
            found = json.loads(source(), strict=False)
        except ValueError:
            continue
        return found if isinstance(found, list) else []
    return []


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _first(row: dict, *names: str) -> str | None:
    return _text(next((row[k] for k in names if row.get(k)), row.get(names[0])))


def _record(row: dict) -> tuple:
    tags = row.get("tags")
    tags = tags.split() if isinstance(tags, str) else [s for s in (str(t).strip() for t in tags) if s] if isinstance(tags, list) else None
    return (_text(row.get("path")), _first(row, "name", "title", "file"), tags, _first(row, "excerpt", "preview"), _first(row, "ctime", "created"), _first(row, "mtime", "modified"))


def _cells(row: list) -> tuple:
    name, excerpt, ctime, mtime = ([_text(x) for x in row] + [None] * 4)[:4]
    return (None, name, None, excerpt, ctime, mtime)


def rows_of(block: str) -> Iterator[tuple]:
    """Rows of a block's lists of objects, then of its table calls."""
    for m in LIST.finditer(block):
        tokens = literal(block, m.end())
        if tokens and block[m.end() + sum(map(len, tokens)) :].lstrip().startswith(";"):
            yield from (_record(r) for r in value(tokens) if isinstance(r, dict))
    for m in CALL.finditer(block):
        head = literal(block, m.end())
        if head is None:
            continue
        at = m.end() + sum(map(len, head))
        comma = re.compile(r"\s*,\s*(?=\[)").match(block, at)
        if comma:
            yield from (_cells(r) for r in value(literal(block, comma.end())) if isinstance(r, list))


def row_tables(text: Column) -> Column:
    """Array of ROW of a note's script blocks, block by block. Only the blocks go to Python; most notes have none."""

    @F.pandas_udf(f"array<{ROW}>")
    def run(blocks: pd.Series) -> pd.Series:
        names = ("path", "name", "tags", "excerpt", "ctime", "mtime")
        return pd.Series([[dict(zip(names, r, strict=True)) for b in (some if some is not None else ()) for r in rows_of(b)] for some in blocks], dtype=object)

    return run(F.regexp_extract_all(text, F.lit(BLOCK), 1))
