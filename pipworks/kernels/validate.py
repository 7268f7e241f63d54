"""Replaying a match: every play against the rules, the cube, the points and the score; problems become diagnostics.

A diagnostic is (severity, code, message, game, action). Errors refuse the match, warnings accept and flag it.
"""

from __future__ import annotations

import copy

from pipworks.kernels import rules as R
from pipworks.kernels.match_text import FormatError, dumped_position


def diagnostic(severity: str, code: str, message: str, game: int | None = None, action: int | None = None) -> dict:
    return {"severity": severity, "code": code, "message": message, "game": game, "action": action}


def _needs(length: int, score: list[int], side: int) -> int:
    return max(0, length - score[side]) if length else 10**9


class _Game:
    """The state while one game is replayed."""

    def __init__(self, match: dict, game: dict, at: int, crawford: bool, found: list[dict]):
        self.match, self.game, self.at, self.crawford, self.found = match, game, at, crawford, found
        self.position, self.cube, self.owner, self.offered, self.turn = R.START, 1, None, None, None
        self.end: tuple[int, str] | None = None  # winner and how

    def say(self, severity: str, code: str, message: str, k: int | None = None) -> None:
        self.found.append(diagnostic(severity, code, message, self.at + 1, k))

    def move(self, k: int, a: dict, last: bool) -> None:
        side, dice = a["side"], tuple(a["dice"])
        if self.offered is not None:
            self.say("error", "V-CUBE", "a play although a double is not answered", k)
        if self.turn == side:
            self.say("error", "V-TURN", "the same side rolls twice", k)
        self.turn = side
        if a["hidden"]:
            if not last:
                self.say("error", "V-DAMAGED", "a hidden play inside a game", k)
            elif dice != (0, 0) and (self.game["declared"] or {}).get("winner") == side:
                self.bear_off(k, a)
            return
        if a.get("dump") and not self.dumped(k, a):
            return
        steps = [tuple(s[:2]) for s in a["steps"]]
        plays, used = R.legal_plays(self.position, side, dice)
        done = R.apply_written(self.position, side, steps)
        if done is None:
            self.say("error", "V-LEGAL", "a checker is missing or a point is held", k)
            return
        after, played = done
        if after not in plays:
            if self.declared(a):
                a["illegal"] = True
                self.say("warning", "V-ILLEGAL", "an illegal play, kept as it was made", k)
            elif not steps and not last:
                self.say("error", "V-DAMAGED", "no play is written although there is one", k)
            elif last and R.is_unfinished(self.position, side, dice, steps):
                a["abandoned"] = True
                self.say("info", "V-RESULT", "the last roll was not played to its end", k)
            else:
                self.say("error", "V-LEGAL", f"no legal play of {dice[0]}{dice[1]}", k)
        a["played"], a["position"] = played, after
        self.position = after
        if after[side][R.OFF] == R.CHECKERS:
            self.end = side, "bearOff"

    def declared(self, a: dict) -> bool:
        """Whether the source calls this play illegal; a declaration is used once."""
        if a.get("dump"):
            return True
        name = self.match["sides"][a["side"]]["name"]
        for d in self.match.get("illegal", []):
            if not d.get("used") and d["game"] == self.game["index"] and d["row"] == a.get("row") and d["player"] in (None, name):
                d["used"] = True
                return True
        return False

    def dumped(self, k: int, a: dict) -> bool:
        """Puts the steps that lead to a dumped position in place of the dump."""
        dump, names = a["dump"], [(s["name"] or "").casefold() for s in self.match["sides"]]
        given = [n.casefold() for n in dump["names"]]
        problem = None
        if sorted(given) != sorted(names) or names[0] == names[1]:
            problem = "names other players"
        elif self.match["match_length"] and dump["length"] != self.match["match_length"]:
            problem = "is of a match of another length"
        else:
            first = names.index(given[0])
            if dump["scores"] != [self.game["start"][first], self.game["start"][1 - first]]:
                problem = "is for another score"
            else:
                after = dumped_position(dump, first)
                steps = R.steps_between(self.position, after, a["side"]) if after and R.fault(after) is None else None
                following = next((b for b in self.game["actions"][k:] if b["kind"] == "move" and not b.get("hidden")), None)
                if following and not following.get("dump") and sorted(following["dice"]) != sorted(dump["dice"]):
                    problem = "is followed by another roll"
                elif steps is None:
                    problem = "does not follow by one play"
                else:
                    a["steps"] = steps
        if problem:
            self.say("error", "V-DAMAGED", f"the dumped position {problem}", k)
        return problem is None

    def bear_off(self, k: int, a: dict) -> None:
        """Reads a hidden last play of the stated winner as the bear-off of all checkers left, if the roll allows it."""
        side = a["side"]
        plays, _ = R.legal_plays(self.position, side, tuple(a["dice"]))
        finish = next((p for p in plays if p[side][R.OFF] == R.CHECKERS), None)
        steps = R.steps_between(self.position, finish, side) if finish else None
        if steps:
            a.update(hidden=False, reconstructed=True, steps=steps, position=finish, played=R.apply_written(self.position, side, steps)[1])
            self.position, self.end = finish, (side, "bearOff")
            self.say("info", "V-RESULT", "the last play is not written: the roll bears off every checker left", k)

    def double(self, k: int, a: dict) -> None:
        side = a["side"]
        if self.offered is not None:
            self.say("error", "V-CUBE", "a double although one is not answered", k)
        if self.turn == side:
            self.say("error", "V-CUBE", "a double when it is not that side's turn", k)
        if self.crawford:
            self.say("error", "V-CUBE", "a double in the Crawford game", k)
        if self.owner is not None and self.owner != side:
            self.say("error", "V-CUBE", "the other side owns the cube", k)
        if a["cube"] != 2 * self.cube:
            self.say("error", "V-CUBE", f"doubled from {self.cube} to {a['cube']}", k)
        limit = self.match["rules"].get("cube_limit")
        if limit and a["cube"] > limit:
            self.say("warning", "V-CUBE", f"beyond the limit of {limit}", k)
        self.offered = side, a["cube"]

    def answer(self, k: int, a: dict) -> None:
        if self.offered is None or self.offered[0] == a["side"]:
            self.say("error", "V-CUBE", "an answer without a double of the other side", k)
            return
        side, cube = self.offered
        self.offered = None
        if a["kind"] == "take":
            self.cube, self.owner = cube, a["side"]
        else:
            self.end = side, "drop"

    def run(self) -> None:
        actions = self.game["actions"]
        for k, a in enumerate(actions, 1):
            if self.end:
                self.say("error", "V-RESULT", "an action after the end of the game", k)
                return
            if a["kind"] == "move":
                self.move(k, a, all(b["kind"] == "move" and b.get("hidden") for b in actions[k:]))
            elif a["kind"] == "double":
                self.double(k, a)
            else:
                self.answer(k, a)

    def result(self, score: list[int], following: list[int] | None) -> dict | None:
        """Winner, points, kind, how and cube; points as they count towards the match."""
        length, declared = self.match["match_length"], self.game["declared"]
        if self.end:
            winner, how = self.end
            size = R.win_size(self.position, winner) if how == "bearOff" else 1
            if how == "bearOff" and length == 0 and self.match["rules"].get("jacoby") and self.cube == 1 and self.owner is None:
                size = 1
            points = self.cube * size
            last = next((x for x in reversed(self.game["actions"]) if x["kind"] == "move"), None)
            if declared and declared["winner"] != winner and how == "bearOff" and last and declared.get("line") is not None and declared["line"] == last.get("line"):
                self.say("info", "V-RESULT", "the result stands in the free cell beside the last play")
                declared["winner"] = winner
            stated = declared["points"] if declared else None
            if declared and declared["winner"] != winner:
                self.say("error", "V-SCORE", "the result names the other side")
            elif stated is not None and stated != points:
                if length and _needs(length, score, winner) <= stated < points:  # some sites write what the match still needed
                    self.say("info", "V-SCORE", f"{stated} points stated, as many as the match needed; {points} played for")
                else:
                    self.say("error", "V-SCORE", f"{stated} points stated, {points} played for")
        elif declared:
            winner, how, points = declared["winner"], "resign", declared["points"]
            needs = _needs(length, score, winner)
            if points > 3 * self.cube:  # more than a backgammon: a mark of the site, or what it capped
                points = min(needs, 3 * self.cube)
                if points == needs:
                    self.say("info", "V-RESULT", f"{declared['points']} points stated, {points} needed")
                else:
                    self.say("warning", "V-SCORE", f"{declared['points']} points stated with the cube at {self.cube}")
            elif points % self.cube and points != needs:
                self.say("warning", "V-SCORE", f"{points} points with the cube at {self.cube}")
            size = min(max(points // self.cube, 1), 3)
            self.say("info", "V-RESULT", "the game ended by resignation")
        elif following is not None and sum(n > o for n, o in zip(following, score, strict=True)) == 1:
            winner = next(s for s in (0, 1) if following[s] > score[s])
            how, points = "resign", following[winner] - score[winner]
            size = min(max(points // self.cube, 1), 3)
            self.say("warning", "V-RESULT", "the result is known by the next score only")
        else:
            self.say("warning", "V-RESULT", "the game is not finished")
            return None
        kind = ("single", "gammon", "backgammon")[size - 1]
        return {"winner": winner, "points": points, "kind": kind, "how": how, "cube": self.cube}


def validate(match: dict) -> tuple[dict, list[dict]]:
    """The match with positions, results and score filled in, and its diagnostics."""
    found: list[dict] = []
    games, length = match["games"], match["match_length"]
    score, crawford_over = list(games[0]["start"]), False
    if any(score):
        found.append(diagnostic("warning", "V-PARTIAL", "the first game does not start at 0", 1))
    for k, side in enumerate(match["sides"]):
        if not side["name"]:
            found.append(diagnostic("warning", "V-META", f"side {k} has no name"))
    for at, game in enumerate(games):
        start = game["start"]
        if start != score:
            forward = all(s >= o for s, o in zip(start, score, strict=True))
            found.append(diagnostic("warning" if forward else "error", "V-PARTIAL" if forward else "V-SCORE", f"starts at {start}, {score} before", at + 1))
            score = list(start)
        crawford = bool(length > 1 and match["rules"].get("crawford") and not crawford_over and sum(length - s == 1 for s in score) == 1)
        crawford_over |= crawford
        game["crawford"] = crawford
        state = _Game(match, game, at, crawford, found)
        state.run()
        result = state.result(score, games[at + 1]["start"] if at + 1 < len(games) else None)
        if result:
            game["result"] = {**result, "ends_match": bool(length) and score[result["winner"]] + result["points"] >= length}
            score[result["winner"]] += result["points"]
            if length and max(score) >= length and at + 1 < len(games):
                found.append(diagnostic("error", "V-SCORE", "games after the end of the match", at + 2))
        else:
            game["result"] = None
    won = [length and s >= length for s in score]
    for d in match.get("illegal", []):
        if not d.get("used"):
            found.append(diagnostic("warning", "V-ILLEGAL", f"no illegal play in row {d['row']}", d["game"]))
    match["result"] = {"score": score, "winner": won.index(True) if any(won) else None, "finished": any(won)}
    return match, found


#: Errors that say the plays of a game can't be read, while its result may be known (fixed values).
UNREADABLE = {"V-LEGAL", "V-DAMAGED", "V-TURN", "V-CUBE"}


def confirmed(match: dict, at: int) -> dict | None:
    """The stated result of a game, if the next start score or the end of the match agrees with it."""
    game, length = match["games"][at], match["match_length"]
    stated = game["declared"]
    if not length or not stated or stated["points"] < 1:
        return None
    after = list(game["start"])
    after[stated["winner"]] += stated["points"]
    if at + 1 < len(match["games"]):
        return stated if match["games"][at + 1]["start"] == after else None
    return stated if stated["ends_match"] or max(after) >= length else None


def salvage(match: dict) -> tuple[dict, list[dict]]:
    """Validation that keeps what is clear of a damaged match of several games: an unreadable game becomes its confirmed result or is left out, one that breaks off at the end is left out. At least one game must remain readable, and the winner known; otherwise the match stays refused."""
    first = copy.deepcopy(match)
    done, found = validate(copy.deepcopy(match))
    errors = [d for d in found if d["severity"] == "error"]
    games = first["games"]
    last = len(games)
    cut = last > 1 and done["games"][-1]["result"] is None and games[-1]["declared"] is None
    errors = [d for d in errors if not (cut and d["game"] == last)]
    if not (errors or cut) or last < 2 or any(d["code"] not in UNREADABLE or d["game"] is None for d in errors):
        return done, found
    notes, kept, readable = [], [], 0
    for at, game in enumerate(games):
        bad = any(d["game"] == at + 1 for d in errors)
        if cut and at + 1 == last:
            notes.append(diagnostic("warning", "V-PARTIAL", "the file stops inside this game: left out", at + 1))
        elif not bad:
            kept.append(game)
            readable += 1
        elif confirmed(first, at):
            kept.append({**game, "actions": []})
            notes.append(diagnostic("warning", "V-PARTIAL", "the plays can't be read; kept by its confirmed result", at + 1))
        elif first["match_length"] and at + 1 == last:
            return done, found
        else:
            notes.append(diagnostic("warning", "V-PARTIAL", "the plays can't be read: left out", at + 1))
    if not readable:
        return done, found
    again, rest = validate({**first, "games": kept})
    if any(d["severity"] == "error" for d in rest) or (first["match_length"] and not cut and not again["result"]["finished"]):
        return done, found
    return again, notes + rest


def read(text: str, salvaged: bool = False) -> tuple[dict | None, list[dict]]:
    """Parsed and validated; a text that can't be read gives no match and one error."""
    from pipworks.kernels.match_text import parse

    try:
        return (salvage if salvaged else validate)(parse(text))
    except FormatError as e:
        return None, [diagnostic("error", "V-FORMAT", f"{e}" + (f" (line {e.line})" if e.line else ""))]
