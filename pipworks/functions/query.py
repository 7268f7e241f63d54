"""The search language: `player:smith event:"club cup" year:2019.. len:5..9 has:cube,gammon by:octocat final`.

A text becomes a `Search`, a `Search` one Catalyst predicate, and back to its normal text. All clauses hold together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipworks.functions.text import normalise

#: Bits of the catalog's flags (fixed values).
FLAGS = {"gammon": 1, "cube": 2, "analysis": 4, "resign": 8, "attachment": 16, "video": 32, "illegal": 64}
_WORDS = ("player", "event", "round", "by")

Range = tuple[int | str | None, int | str | None]


@dataclass
class Search:
    player: list[str] = field(default_factory=list)
    event: list[str] = field(default_factory=list)
    round: list[str] = field(default_factory=list)
    by: list[str] = field(default_factory=list)
    year: Range | None = None
    date: Range | None = None
    len: Range | None = None
    has: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


_TOKEN = re.compile(r'(?:([A-Za-z]+):)?(?:"([^"]*)(?:"|$)|(\S*))')


def tokens(text: str) -> list[tuple[str | None, str]]:
    """(key or None, value) pairs; quotes group words and an unclosed one runs to the end."""
    found, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(text, at)
        found.append((m[1].lower() if m[1] else None, m[3] if m[2] is None else m[2]))
        at = max(m.end(), at + 1)
    return found


def number_range(text: str, money: bool = False) -> Range | None:
    text = text.strip().lower()
    if money and text == "money":
        return 0, 0
    if text.isascii() and text.isdigit():
        return int(text), int(text)
    m = re.fullmatch(r"([0-9]*)\.\.([0-9]*)", text)
    if not m or not (m[1] or m[2]):
        return None
    return tuple(int(x) if x else None for x in m.groups())


def iso_date(text: str) -> str | None:
    """A day or month in ISO order, whichever way round it is written; months to 12 and days to 31, not a calendar check."""
    parts = re.split(r"[-/.]", text.strip())
    if not 2 <= len(parts) <= 3 or not all(p.isascii() and p.isdigit() for p in parts):
        return None
    if len(parts[0]) != 4:
        parts.reverse()
    if [len(p) for p in parts][0] != 4 or any(not 1 <= len(p) <= 2 for p in parts[1:]):
        return None
    if not 1 <= int(parts[1]) <= 12 or (len(parts) == 3 and not 1 <= int(parts[2]) <= 31):
        return None
    return "-".join([parts[0], *(p.zfill(2) for p in parts[1:])])


def date_range(text: str) -> Range | None:
    ends = text.split("..")
    if len(ends) > 2:
        return None
    dates = [iso_date(e) if e.strip() else None for e in ends]
    if any(e.strip() and d is None for e, d in zip(ends, dates, strict=True)) or not any(dates):
        return None
    return (dates[0], dates[-1])


def parse(text: str) -> Search:
    search = Search()
    for key, value in tokens(text):
        key = "player" if key == "vs" else key
        if key is None:
            search.text += [value] if value else []
        elif key in _WORDS:
            getattr(search, key).extend([value.removeprefix("@") if key == "by" else value] if value else [])
        elif key in ("year", "len", "date"):
            got = date_range(value) if key == "date" else number_range(value, money=key == "len")
            if got:
                setattr(search, key, got)
            else:
                search.errors.append(f"{key}:{value} is no value or range")
        elif key == "has":
            for flag in filter(None, (p.strip().lower() for p in value.split(","))):
                if flag not in FLAGS:
                    search.errors.append(f"unknown flag {flag}")
                elif flag not in search.has:
                    search.has.append(flag)
        else:
            search.errors.append(f"unknown filter {key}:")
    search.has.sort(key=FLAGS.__getitem__)
    return search


def _quoted(value: str) -> str:
    return '"' + value.replace('"', "") + '"' if value == "" or re.search(r'[\s"]', value) else value


def _range_text(r: Range, money: bool = False) -> str:
    if money and r == (0, 0):
        return "money"
    low, high = ("" if x is None else str(x) for x in r)
    return low if low == high else f"{low}..{high}"


def to_text(search: Search) -> str:
    """The normal text of a search; parsing it gives the search again."""
    out = [f"{k}:{_quoted(v)}" for k in _WORDS for v in getattr(search, k)]
    out += [f"{k}:{_range_text(getattr(search, k), k == 'len')}" for k in ("year", "date", "len") if getattr(search, k)]
    if search.has:
        out.append("has:" + ",".join(search.has))
    return " ".join([*out, *map(_quoted, search.text)])


def _normal(words: list[str]) -> list[Column]:
    return [normalise(F.lit(w)) for w in words if w.strip()]


def _within(column: Column, r: Range) -> Column:
    bounds = [column >= F.lit(r[0])] if r[0] is not None else []
    bounds += [column <= F.lit(r[1])] if r[1] is not None else []
    return reduce(Column.__and__, bounds)


def predicate(search: Search) -> Column:
    """The rows of a catalog (p0, p1, n0, n1, event, round, date, year, len, flags, by_login, hay) that a search finds. Comparisons of year, len and flags reach the scan."""
    clauses: list[Column] = []
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if search.year:
        clauses.append(F.col("year").isNotNull() & _within(F.col("year"), search.year))
    if search.len:
        clauses.append(_within(F.col("len"), search.len))
    if search.date:
        low, high = search.date
        precise = max(len(low or ""), len(high or ""))
        clauses.append(F.length(text("date")) >= precise)
        if low:
            clauses.append(F.substring("date", 1, len(low)) >= low)
        if high:
            clauses.append(F.substring("date", 1, len(high)) <= high)
    if search.has:
        need = sum(FLAGS[f] for f in search.has)
        clauses.append(F.col("flags").bitwiseAND(need) == need)
    for column in ("event", "round"):
        clauses += [F.contains(normalise(text(column)), w) for w in _normal(getattr(search, column))]
    clauses += [F.lower(text("by_login")) == b.lower() for b in search.by]
    names = _normal(search.player)
    side = lambda n, w: F.contains(text(n), w)
    if len(names) == 1:
        clauses.append(side("n0", names[0]) | side("n1", names[0]))
    elif len(names) == 2:
        a, b = names
        clauses.append((side("n0", a) & side("n1", b)) | (side("n0", b) & side("n1", a)))
    elif names:
        clauses.append(F.lit(False))
    clauses += [F.contains(text("hay"), w) for w in _normal(search.text)]
    return reduce(Column.__and__, clauses, F.lit(True))


def current_token(text: str) -> tuple[int, str | None, str] | None:
    """(start, key, value so far) of the word being typed at the end, or None after a blank."""
    quoted, start = False, None
    for i, c in enumerate(text):
        quoted ^= c == '"'
        if c.isspace() and not quoted:
            start = None
        elif start is None:
            start = i
    if start is None:
        return None
    m = re.match(r"(?:([A-Za-z]+):)?(.*)", text[start:], re.DOTALL)
    return start, m[1].lower() if m[1] else None, m[2].removeprefix('"').removesuffix('"')
