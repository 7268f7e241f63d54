"""What the name of a match file proposes about the match: date, time, number in a series, round and event.

A name is read as a row of tokens (numbers, words, signs). A small grammar goes over it once from the left; at each token
the longest phrase that one of its rules knows is taken as one fact, and tokens that belong to no fact are what the event
is made of. Rules look at kinds and values of tokens only, so a new writing is a new row of the grammar.

Defined cases: an empty name proposes nothing; of facts given twice the first counts, but another stage
goes before `Final`; folders before the name do not count; a phrase that looks like a date but
names no day of the calendar stays what it is, a row of numbers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

# Months, stages and words that say nothing about the event.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
STAGES = {"quarter": "Quarter-final", "qf": "Quarter-final", "semi": "Semi-final", "sf": "Semi-final"}
FINAL = {"final", "finals", "finale"}
ORDINALS = {"st", "nd", "rd", "th"}
POINTS = {"p", "point", "points", "pnt", "pnts", "pt", "pts"}
SAYS_NOTHING = POINTS - {"p"} | {
    "v", "vs", "versus", "match", "matches", "game", "games", "money", "rated", "unrated", "file", "copy", "fixed", "merged", "ptr", "xg", "xghuge", "xgroller", "bmab", "doublingcube",
}


@dataclass
class Proposal:
    event: str | None = None
    round: str | None = None
    date: str | None = None
    time: str | None = None
    number: int | None = None
    of: int | None = None
    stage: str | None = None


@dataclass
class Token:
    text: str
    kind: str  # number, word, sign

    @property
    def low(self) -> str:
        return self.text.lower()


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def tokens(text: str) -> list[Token]:
    """Numbers, words and single signs; a blank is a sign."""
    kinds = (("number", r"\d+"), ("word", r"[^\W\d_]+"), ("sign", r"[\W_]"))
    return [Token(m[0], m.lastgroup) for m in re.finditer("|".join(f"(?P<{k}>{p})" for k, p in kinds), text)]


class _Reader:
    """Tokens from one place on; every method answers None where the row does not go on as asked."""

    def __init__(self, row: list[Token], at: int):
        self.row, self.at = row, at

    def peek(self, ahead: int = 0) -> Token | None:
        return self.row[self.at + ahead] if 0 <= self.at + ahead < len(self.row) else None

    def number(self, *digits: int) -> int | None:
        t = self.peek()
        if t is None or t.kind != "number" or (digits and len(t.text) not in digits):
            return None
        self.at += 1
        return int(t.text)

    def word(self, choice) -> str | None:
        t = self.peek()
        if t is None or t.kind != "word" or t.low not in choice:
            return None
        self.at += 1
        return t.low

    def sign(self, choice: str) -> bool:
        t = self.peek()
        if t is None or t.kind != "sign" or t.text not in choice:
            return False
        self.at += 1
        return True

    def gap(self, most: int = 3) -> None:
        """Passes blanks, dashes and underscores."""
        for _ in range(most):
            if not self.sign(" -_"):
                return

    def apart(self) -> bool:
        """Whether what was read last does not run on into a letter or digit."""
        t = self.peek()
        return t is None or t.kind == "sign"


def _day(y: int | None, m: int | None, d: int | None) -> str | None:
    if y is None or m is None or d is None or not (1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= 31):
        return None
    return f"{y}-{m:02}-{d:02}"


def _clock(r: _Reader) -> str | None:
    """A time of day after a date."""
    start = r.at
    r.word({"t"}) or r.gap()
    h = r.number(2)
    m = r.number(2) if h is not None and r.sign("-_.:") else None
    if m is None or h > 23 or m > 59:
        r.at = start
        return None
    before = r.at
    if not (r.sign("-_.:") and r.number(2) is not None):
        r.at = before
    return f"{h:02}:{m:02}"


def _date(r: _Reader) -> dict | None:
    t = r.peek()
    if t.kind != "number":
        return None
    if len(t.text) == 8:
        day = _day(int(t.text[:4]), int(t.text[4:6]), int(t.text[6:]))
        r.at += 1
        return day and {"date": day}
    first = r.number(2, 4)
    if first is None:
        return None
    if first >= 100 and (month := r.word(MONTHS)):
        day = _day(first, MONTHS.index(month) + 1, r.number(2))
        return day and {"date": day}
    if not r.sign("-._"):
        return None
    middle = r.number(2)
    last = r.number(2 if first >= 100 else 4) if middle is not None and r.sign("-._") else None
    day = _day(first, middle, last) if first >= 100 else _day(last, middle, first)
    if not day:
        return None
    time = _clock(r) if first >= 100 else None
    return {"date": day, "time": time} if time else {"date": day}


def _one_of(r: _Reader) -> dict | None:
    """`2 of 5`"""
    n = r.number(1, 2)
    r.gap()
    if n is None or not r.word({"of"}):
        return None
    r.gap()
    of = r.number(1, 2)
    return None if of is None else {"number": n, "of": of}


def _counted(r: _Reader) -> dict | None:
    """`9pnts`, `2. match`, `3rd round`, `1st match`, `4R`"""
    n = r.number(1, 2)
    if n is None:
        return None
    t = r.peek()
    if t is not None and t.text == "R" and t.kind == "word":
        r.at += 1
        return {"stage": f"Round {n}"} if r.apart() else None
    dotted = r.word(ORDINALS) is not None
    if not dotted:
        r.gap(1)
        dotted = r.sign(".")
    r.gap()
    if not dotted and r.word(POINTS):
        return {} if r.apart() else None
    if dotted and r.word({"match"}):
        return {"number": n}
    return {"stage": f"Round {n}"} if r.word({"round"}) and r.apart() else None


def _named(r: _Reader) -> dict | None:
    """`match 3`, `match_14045043` (a number of a server), `round of 16`, `round 2`, `R2`"""
    word = r.word({"match", "round", "r"})
    if word is None:
        return None
    if word != "r":
        r.gap()
    if word == "round" and r.word({"of"}):
        r.gap()
        n = r.number(1, 2, 3)
        return None if n is None else {"stage": f"Round of {n}"}
    if word == "match":
        r.sign("#")
    t = r.peek()
    n = r.number()
    if n is None or not (word != "r" or r.apart()):
        return None
    if word == "match":
        return {} if len(t.text) >= 5 else {"number": n} if len(t.text) <= 2 else None
    return {"stage": f"Round {n}"} if len(t.text) <= 2 else None


def _hash(r: _Reader) -> dict | None:
    """`#4`"""
    if not r.sign("#"):
        return None
    r.gap()
    n = r.number(1, 2)
    return None if n is None else {"number": n}


def _stage(r: _Reader) -> dict | None:
    """`semi-final`, `QF2`, `finals`"""
    word = r.word(set(STAGES) | FINAL | {k + f for k in ("quarter", "semi") for f in FINAL})
    if word is None:
        return None
    if word in FINAL:
        return {"stage": "Final"} if r.apart() else None
    name = next(v for k, v in STAGES.items() if word.startswith(k))
    if word in ("quarter", "semi"):
        r.gap()
        if r.word(FINAL) is None:
            return None
    before = r.at
    r.gap()
    n = r.number(1, 2)
    if n is None:
        r.at = before
    return {"stage": name if n is None else f"{name} {n}"}


RULES: list[Callable[[_Reader], dict | None]] = [_date, _one_of, _counted, _named, _hash, _stage]


def _longest(row: list[Token], at: int) -> tuple[int, dict] | None:
    """The end and the facts of the longest phrase that begins here; of equally long ones the first rule's."""
    before = row[at - 1] if at else None
    if before is not None and before.kind != "sign" and before.kind == row[at].kind:
        return None
    best = None
    for rule in RULES:
        r = _Reader(row, at)
        facts = rule(r)
        if facts is not None and (best is None or r.at > best[0]):
            best = r.at, facts
    return best


def _without_players(row: list[Token], players: list[str]) -> list[Token]:
    """Blanks in place of the words of the players' names."""
    theirs = {t.low for p in players for t in tokens(_bare(p or "")) if t.kind == "word" and len(t.text) > 2}
    glued = {"".join(t.low for t in tokens(_bare(p or "")) if t.kind != "sign") for p in players}
    out = list(row)
    for k, t in enumerate(row):
        after = row[k + 1] if k + 1 < len(row) else None
        if after is not None and t.kind == "word" and after.kind == "number" and t.low + after.text in glued:
            out[k] = out[k + 1] = Token(" ", "sign")
        elif t.kind == "word" and t.low in theirs:
            out[k] = Token(" ", "sign")
    return out


def _event(rest: list[Token]) -> tuple[str | None, str | None]:
    """The event and the year among the tokens that say nothing else; an event has a word of three letters."""
    year = next((t.text for t in rest if t.kind == "number" and len(t.text) == 4 and t.text[:2] in ("19", "20")), None)
    words: list[str] = []
    glue = False
    for k, t in enumerate(rest):
        lone = not any(0 <= j < len(rest) and rest[j].kind == "word" for j in (k - 1, k + 1))
        if t.kind == "word" and t.low in SAYS_NOTHING or t.kind == "number" and (lone or t.text == year):
            glue = False
        elif t.kind == "sign":
            if t.text in ".'&+,;:" and words and glue and t.text not in ",;:":
                words[-1] += t.text
            else:
                glue = False
                if t.text in "&+":
                    words.append(t.text)
        elif glue:
            words[-1] += t.text
        else:
            words.append(t.text)
            glue = True
    text = " ".join(words).strip(" ,;:.&+-")
    if not re.search(r"[^\W\d_]{3,}", text):
        return None, year
    return (f"{text} {year}" if year else text), year


def propose(base: str, players: list[str] | None = None) -> Proposal:
    """A proposal from a file name without its extension; the players' names are taken out first."""
    text = _bare(re.split(r"[/\\]", base)[-1])
    if " " not in text and "_" not in text:  # WordsRunTogether
        text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    row = _without_players(tokens(text), players or [])
    out, rest, at = Proposal(), [], 0
    if len(row) > 2 and [t.text for t in row[-3::2]] == ["(", ")"] and row[-2].kind == "number" and len(row[-2].text) == 1:
        row = row[:-3]  # the mark of a copy
    while at < len(row):
        phrase = _longest(row, at)
        if phrase is None:
            rest.append(row[at])
            at += 1
            continue
        at, facts = phrase
        rest.append(Token(" ", "sign"))
        if out.number is not None:
            facts = {k: v for k, v in facts.items() if k not in ("number", "of")}
        for name, value in facts.items():
            if getattr(out, name) is None or name == "stage" and out.stage == "Final":  # another stage says more
                setattr(out, name, value)
    out.event, year = _event(rest)
    out.date = out.date or year
    series = None if out.number is None else f"Match {out.number}" + (f" of {out.of}" if out.of else "")
    out.round = " - ".join(p for p in (out.stage, series) if p) or None
    return out
