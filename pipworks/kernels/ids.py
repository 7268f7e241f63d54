"""Position and match identifiers used by analysis programs."""

from __future__ import annotations

import base64
from dataclasses import dataclass, replace

from pipworks.kernels.rules import BAR, CHECKERS, OFF, Position


@dataclass(frozen=True)
class Context:
    on_roll: int = 0
    cube: int = 1
    owner: int | None = None
    dice: tuple[int, int] | None = None
    score: tuple[int, int] = (0, 0)
    length: int = 0
    crawford: bool = False
    jacoby: bool = False
    cube_limit: int = 10


def _exponent(cube: int) -> int:
    if cube < 1 or cube & (cube - 1) or cube > 1 << 15:
        raise ValueError(f"{cube} is no cube value")
    return cube.bit_length() - 1


def _with_off(on_board: list[int]) -> tuple[int, ...]:
    left = CHECKERS - sum(on_board[1:])
    if left < 0:
        raise ValueError("more than 15 checkers")
    return (left, *on_board[1:])


def to_xgid(position: Position, context: Context) -> str:
    """26 squares from the view of the side on roll, then cube, owner, turn, dice, scores, flag, length and cube limit."""
    side = context.on_roll
    me, other = position[side], position[1 - side]
    letter = lambda mine, theirs: chr(64 + mine) if mine else chr(96 + theirs) if theirs else "-"
    board = letter(0, other[BAR]) + "".join(letter(me[p], other[25 - p]) for p in range(1, 25)) + letter(me[BAR], 0)
    owner = 0 if context.owner is None else 1 if context.owner == side else -1
    dice = "".join(map(str, sorted(context.dice, reverse=True))) if context.dice else "00"
    flag = int(context.crawford if context.length else context.jacoby)
    fields = [board, _exponent(context.cube), owner, 1, dice, context.score[side], context.score[1 - side], flag, context.length, context.cube_limit]
    return "XGID=" + ":".join(map(str, fields))


def parse_xgid(text: str) -> tuple[Position, Context]:
    """The position with the player of the capital letters as side 0."""
    fields = text.strip().removeprefix("XGID=").split(":")
    if len(fields) < 10 or len(fields[0]) != 26:
        raise ValueError("an XGID has ten fields and 26 squares")
    sides = [[0] * 26, [0] * 26]
    for at, c in enumerate(fields[0]):
        if c == "-":
            continue
        side = 0 if "A" <= c <= "O" else 1 if "a" <= c <= "o" else None
        if side is None:
            raise ValueError(f"{c} is no square of an XGID")
        point = BAR if at in (0, 25) else at if side == 0 else 25 - at
        sides[side][point] += ord(c) - (64 if side == 0 else 96)
    exponent, owner, turn = map(int, fields[1:4])
    s0, s1, flag, length, limit = map(int, fields[5:10])
    rolled = fields[4] if len(fields[4]) == 2 and fields[4].isdigit() and "0" not in fields[4] else None
    context = Context(on_roll=int(turn == -1), cube=1 << exponent, owner={0: None, 1: 0}.get(owner, 1), dice=(int(rolled[0]), int(rolled[1])) if rolled else None, score=(s0, s1), length=length, crawford=length > 0 and bool(flag & 1), jacoby=length == 0 and bool(flag & 1), cube_limit=limit)
    return (_with_off(sides[0]), _with_off(sides[1])), context


class _Bits:
    """A number filled from its lowest bit."""

    def __init__(self, value: int = 0):
        self.value, self.at = value, 0

    def put(self, value: int, width: int) -> _Bits:
        self.value |= (value & (1 << width) - 1) << self.at
        self.at += width
        return self

    def take(self, width: int) -> int:
        out = self.value >> self.at & (1 << width) - 1
        self.at += width
        return out

    def text(self, size: int) -> str:
        return base64.b64encode(self.value.to_bytes(size, "little")).decode().rstrip("=")


def _bits_of(text: str, size: int) -> _Bits:
    data = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    if len(data) != size:
        raise ValueError(f"{text} does not have {size} bytes")
    return _Bits(int.from_bytes(data, "little"))


def to_position_id(position: Position, on_roll: int) -> str:
    """80 bits: for either side, the one not on roll first, as many ones as checkers on each point and a zero, the bar last."""
    bits = _Bits()
    for side in (1 - on_roll, on_roll):
        for point in (*range(1, 25), BAR):
            bits.put((1 << position[side][point]) - 1, position[side][point] + 1)
        bits.at = 40 if side != on_roll else 80
    return bits.text(10)


def to_match_id(context: Context) -> str:
    bits = _Bits().put(_exponent(context.cube), 4).put(3 if context.owner is None else context.owner, 2).put(context.on_roll, 1).put(int(context.crawford), 1)
    bits.put(1, 3).put(context.on_roll, 1).put(0, 3)
    for die in context.dice or (0, 0):
        bits.put(die, 3)
    return bits.put(context.length, 15).put(context.score[0], 15).put(context.score[1], 15).text(9)


def to_gnubg_id(position: Position, context: Context) -> str:
    return f"{to_position_id(position, context.on_roll)}:{to_match_id(context)}"


def parse_gnubg_id(text: str) -> tuple[Position, Context]:
    """A position id, with or without a match id; without one side 1 is on roll."""
    where, _, match = text.strip().partition(":")
    context = Context(on_roll=1)
    if match:
        bits = _bits_of(match, 9)
        cube, owner, on_roll, crawford = bits.take(4), bits.take(2), bits.take(1), bits.take(1)
        bits.take(7)
        dice, length, score = (bits.take(3), bits.take(3)), bits.take(15), (bits.take(15), bits.take(15))
        context = Context(on_roll, 1 << cube, None if owner == 3 else owner, dice if all(dice) else None, score, length, bool(crawford))
    bits = _bits_of(where, 10)
    sides = {}
    for side, begin in ((1 - context.on_roll, 0), (context.on_roll, 40)):
        bits.at, counts = begin, [0] * 26
        for point in (*range(1, 25), BAR):
            while bits.take(1) and bits.at < begin + 40:
                counts[point] += 1
        sides[side] = _with_off(counts)
    return (sides[0], sides[1]), replace(context)


def pip_difference(position: Position) -> int:
    return sum(p * (position[0][p] - position[1][p]) for p in range(OFF, 26))
