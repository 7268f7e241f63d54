"""Smart Game Format: trees of properties, and matches of the backgammon dialect (GM[6])."""

from __future__ import annotations

import re

from pipworks.kernels.match_text import FormatError
from pipworks.kernels.rules import BAR, OFF

_PROPERTY = re.compile(r"\s*([A-Za-z]+)((?:\s*\[(?:\\.|[^\]\\])*\])+)", re.DOTALL)
_VALUE = re.compile(r"\[((?:\\.|[^\]\\])*)\]", re.DOTALL)


def trees(text: str) -> list[list[dict[str, list[str]]]]:
    """Per game its nodes, each a map from property to values; values of a repeated property are added."""
    games: list[list[dict[str, list[str]]]] = []
    depth, at = 0, 0
    while at < len(text):
        c = text[at]
        if c == "(":
            if depth == 0:
                games.append([])
            depth += 1
            at += 1
        elif c == ")":
            depth -= 1
            at += 1
        elif c == ";" and depth:
            games[-1].append({})
            at += 1
        elif m := _PROPERTY.match(text, at) if depth and games[-1] else None:
            values = [re.sub(r"\\(.)", r"\1", v, flags=re.DOTALL) for v in _VALUE.findall(m[2])]
            games[-1][-1].setdefault("".join(x for x in m[1] if x.isupper()), []).extend(values)
            at = m.end()
        elif c.isspace():
            at += 1
        else:
            raise FormatError(f"{text[at : at + 10]!r} is no part of an SGF file")
    return games


def _point(letter: str, white: bool) -> int:
    if letter == "y":
        return BAR
    if letter == "z":
        return OFF
    number = ord(letter) - 96
    return number if white else 25 - number


def parse(text: str) -> dict:
    """All games of a file as one match; black is side 0."""
    found = trees(text)
    if not found or not found[0]:
        raise FormatError("no game")
    first = found[0][0]
    if first.get("GM", ["6"])[0].strip() != "6":
        raise FormatError("not a backgammon file")
    info = {k.strip(): v for item in first.get("MI", []) for k, _, v in [item.partition(":")]}
    rules = " ".join(first.get("RU", [])).lower()
    games = []
    for number, nodes in enumerate(found, 1):
        head = {k.strip(): v for item in nodes[0].get("MI", []) for k, _, v in [item.partition(":")]}
        game = {"index": number, "start": [int(head.get("bs", 0) or 0), int(head.get("ws", 0) or 0)], "actions": [], "declared": None}
        cube = 1
        for node in nodes[1:]:
            for key, side in (("B", 0), ("W", 1)):
                for value in node.get(key, []):
                    if value == "double":
                        cube *= 2
                        game["actions"].append({"side": side, "kind": "double", "cube": cube, "line": None})
                    elif value in ("take", "drop"):
                        game["actions"].append({"side": side, "kind": value, "line": None})
                    elif re.match(r"[1-6]{2}", value):
                        pairs = value[2:]
                        steps = [(_point(pairs[i], side == 1), _point(pairs[i + 1], side == 1)) for i in range(0, len(pairs) - 1, 2)]
                        game["actions"].append({"side": side, "kind": "move", "dice": [int(value[0]), int(value[1])], "steps": steps, "hidden": False, "line": None, "row": None})
        if m := re.match(r"([WB])\+(\d+)(R?)", nodes[0].get("RE", [""])[0]):
            game["declared"] = {"winner": int(m[1] == "W"), "points": int(m[2]), "ends_match": False}
        games.append(game)
    one = lambda key: (first.get(key) or [None])[0]
    return {
        "sides": [{"name": one("PB"), "rating": None}, {"name": one("PW"), "rating": None}],
        "match_length": int(info.get("length", 0) or 0),
        "rules": {"crawford": "crawford" in rules, "jacoby": "jacoby" in rules, "beaver": None, "cube_limit": None},
        "date": one("DT"),
        "time": None,
        "event": one("EV"),
        "round": one("RO"),
        "games": games,
        "remarks": [],
        "dialect": "gnubg-sgf",
        "site": one("PC"),
        "analysed": any("A" in node or "DA" in node for nodes in found for node in nodes),
    }
