"""Binary files of the XG kind: the match, in the form that texts are read to.

A file begins with RGMH and holds zlib streams; the largest one made of whole records of 2,560 bytes, the first of which
is a header, is the match. A record is laid over numpy types by its kind, the byte at place 8, and all records of a kind
are decoded at once; the games are then cut at the game headers.

Defined cases: a damaged stream is passed over; no match stream, a record outside a game, a game without an end, players
without names, dice that are none or a step that goes back give a FormatError; a roll without a play is left out.
"""

from __future__ import annotations

import zlib
from datetime import datetime, timedelta

import numpy as np

from pipworks.kernels.match_text import FormatError
from pipworks.kernels.rules import BAR, OFF

#: Fixed values of the format: size of a record, the length that means money, starts of zlib streams, kinds of records.
SIZE, MONEY = 2560, 99_999
STREAMS = (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
HEADER, GAME, CUBE, MOVE, END = 0, 1, 2, 3, 4
#: Fields by kind of record: place, type and how many (fixed values).
LAYOUTS = {
    HEADER: {"first": (9, "u1", 41), "second": (50, "u1", 41), "length": (92, "<i4", 1), "switches": (100, "u1", 3), "date": (128, "<f8", 1), "site": (283, "u1", 41)},
    GAME: {"score": (12, "<i4", 2), "number": (48, "<i4", 1)},
    CUBE: {"player": (12, "<i4", 1), "doubled": (16, "<i4", 1), "answer": (20, "<i4", 1), "evaluation": (124, "<f4", 144), "level": (92, "<i4", 1), "equities": (152, "<f4", 3), "error": (200, "<f8", 1), "answer_error": (216, "<f8", 1)},
    MOVE: {"player": (64, "<i4", 1), "steps": (68, "<i4", 8), "dice": (100, "<i4", 2), "board": (9, "i1", 26), "error": (2312, "<f8", 1), "level": (2472, "<i4", 1)},
    END: {"winner": (24, "<i4", 1), "points": (28, "<i4", 1), "how": (32, "<i4", 1)},
}


def _type(layout: dict) -> np.dtype:
    formats = [base if n == 1 else (base, (n,)) for _, base, n in layout.values()]
    return np.dtype({"names": list(layout), "formats": formats, "offsets": [at for at, _, _ in layout.values()], "itemsize": SIZE})


TYPES = {kind: _type(layout) for kind, layout in LAYOUTS.items()}


def _streams(data: bytes):
    """Every zlib stream of a file, unpacked; the search goes on behind one that was read."""
    at = 8
    while True:
        starts = [p for p in (data.find(s, at) for s in STREAMS) if p >= 0]
        if not starts:
            return
        at = min(starts)
        reader = zlib.decompressobj()
        try:
            out = reader.decompress(data[at:])
        except zlib.error:
            at += 1
            continue
        if reader.eof:
            yield out
            at = len(data) - len(reader.unused_data)
        else:
            at += 1


def records(data: bytes) -> np.ndarray:
    """The records of the match, one row of bytes each."""
    if not data.startswith(b"RGMH"):
        raise FormatError("no file of the XG kind")
    fit = [s for s in _streams(data) if len(s) >= 3 * SIZE and len(s) % SIZE == 0 and s[8] == HEADER]
    if not fit:
        raise FormatError("no records of a match in the XG file")
    return np.frombuffer(max(fit, key=len), dtype=np.uint8).reshape(-1, SIZE)


def by_kind(rows: np.ndarray) -> dict[int, np.ndarray]:
    """The records of each kind, typed."""
    return {kind: np.frombuffer(rows[rows[:, 8] == kind].tobytes(), dtype=t) for kind, t in TYPES.items()}


def _text(field: np.ndarray) -> str:
    raw = field.tobytes()
    return raw[1 : 1 + min(raw[0], 40)].split(b"\0")[0].decode("cp1252", "replace").strip()


def _moment(days: float) -> tuple[str | None, str | None]:
    if not 20_000 < days < 80_000:
        return None, None
    then = datetime(1899, 12, 30) + timedelta(days=int(days), minutes=int((days % 1) * 1440 + 1e-6))
    return then.strftime("%Y-%m-%d"), then.strftime("%H:%M")


def _side(player: int, what: str) -> int:
    if player not in (1, -1):
        raise FormatError(f"{what} of an unknown player")
    return 0 if player == 1 else 1


def _steps(raw: np.ndarray) -> list[tuple[int, int]]:
    """Steps from pairs of squares counted from 0, the bar 24, off below 0."""
    steps = []
    for start, end in raw.reshape(4, 2).tolist():
        if start == -1:
            break
        if not (0 <= start <= 24 and -6 <= end <= 23 and end < start):
            raise FormatError(f"a step from {start} to {end}")
        steps.append((BAR if start == 24 else start + 1, OFF if end < 0 else end + 1))
    return steps


def parse(data: bytes) -> dict:
    """The match of a file, not validated yet."""
    rows = records(data)
    kinds = rows[:, 8]
    typed = by_kind(rows)
    place = np.zeros(len(rows), int)
    for kind in TYPES:
        place[kinds == kind] = np.arange((kinds == kind).sum())
    head = typed[HEADER][0]
    names = [_text(head["first"]), _text(head["second"])]
    length = 0 if head["length"] == MONEY else int(head["length"])
    if not all(names) or not 0 <= length <= 99:
        raise FormatError("names or length of the match can't be read")
    games: list[dict] = []
    ended, row = True, 0
    for kind, at in zip(kinds[1:].tolist(), place[1:].tolist(), strict=True):
        if kind not in (GAME, CUBE, MOVE, END):
            continue
        record = typed[kind][at]
        if kind == GAME:
            if not ended:
                raise FormatError(f"game {games[-1]['index']} has no end")
            games.append({"index": int(record["number"]), "start": record["score"].tolist(), "actions": [], "declared": None})
            ended, row = False, 0
            continue
        if not games:
            raise FormatError("a record outside a game")
        actions, number = games[-1]["actions"], games[-1]["index"]
        if kind == END:
            games[-1]["declared"] = {"winner": _side(record["winner"], "the result"), "points": int(record["points"]), "ends_match": False, "line": None}
            ended = True
        elif kind == CUBE and record["doubled"] == 1:
            side = _side(record["player"], "a double")
            if record["answer"] not in (0, 1):
                raise FormatError(f"game {number}: a beaver")
            row += 1
            cube = 2 ** (1 + sum(a["kind"] == "take" for a in actions))
            actions += [{"side": side, "kind": "double", "cube": cube, "line": None}, {"side": 1 - side, "kind": "take" if record["answer"] else "drop", "line": None}]
        elif kind == MOVE and record["steps"].any():
            dice = record["dice"].tolist()
            if not all(1 <= d <= 6 for d in dice):
                raise FormatError(f"game {number}: dice {dice}")
            row += 1
            side = _side(record["player"], "a play")
            actions.append({"side": side, "kind": "move", "dice": dice, "steps": _steps(record["steps"]), "hidden": False, "line": None, "row": row, "dump": None})
    if not games or not ended:
        raise FormatError("the file stops in the middle of a game")
    numbers = np.abs(typed[CUBE]["evaluation"])
    date, time = _moment(float(head["date"]))
    crawford, jacoby, beaver = (head["switches"] == 1).tolist()
    return {
        "sides": [{"name": n, "rating": None} for n in names], "match_length": length,
        "rules": {"crawford": crawford, "jacoby": None if length else jacoby, "beaver": None if length else beaver, "cube_limit": None},
        "date": date, "time": time, "event": None, "round": None, "games": games, "illegal": [], "remarks": [], "dialect": "xg-binary",
        "site": _text(head["site"]) or None, "analysed": bool(((numbers > 1e-4) & (numbers < 4)).any()),
    }
