"""The identity of a match: what was played, whatever it was called and however it was written.

The content is the version, the length and the games; a game is its start score and its actions with the resulting
positions. The side that rolled first in the first game comes first, so the order of players does not matter. Hidden and
abandoned plays are left out; a game known by its result only contributes that.
"""

from __future__ import annotations

import hashlib
import json

from pipworks.kernels.rules import position_text

VERSION = 1


def content(match: dict) -> list:
    counted = lambda a: a["kind"] != "move" or not (a.get("hidden") or a.get("abandoned"))
    first = next((a["side"] for a in match["games"][0]["actions"] if a["kind"] == "move" and counted(a)), 0)
    turn = (lambda pair: list(pair)) if first == 0 else (lambda pair: [pair[1], pair[0]])
    label = lambda side: side ^ first

    def action(a: dict) -> list:
        if a["kind"] == "move":
            return ["m", label(a["side"]), "".join(map(str, sorted(a["dice"], reverse=True))), position_text(tuple(turn(a["position"])))]
        if a["kind"] == "double":
            return ["d", label(a["side"]), a["cube"]]
        return ["t" if a["kind"] == "take" else "p", label(a["side"])]

    games = []
    for g in match["games"]:
        bare = [["s", label(g["result"]["winner"]), g["result"]["points"]]] if not g["actions"] and g.get("result") else []
        games.append([turn(g["start"]), *bare, [action(a) for a in g["actions"] if counted(a)]])
    return [VERSION, match["match_length"], games]


def content_hash(match: dict) -> str:
    return hashlib.sha256(json.dumps(content(match), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def roll_tokens(match: dict) -> list[list[str]]:
    """Per game what was rolled and doubled, sides numbered by the alphabetical order of their names."""
    names = [s["name"] or "" for s in match["sides"]]
    number = {0: 0, 1: 1} if names[0] <= names[1] else {0: 1, 1: 0}
    word = lambda a: "m{}:{}".format(number[a["side"]], "".join(map(str, sorted(a["dice"], reverse=True)))) if a["kind"] == "move" else f"{'p' if a['kind'] == 'drop' else a['kind'][0]}{number[a['side']]}"
    return [[word(a) for a in g["actions"] if not a.get("hidden")] for g in match["games"]]
