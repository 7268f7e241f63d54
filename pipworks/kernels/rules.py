"""The rules of moving: positions, legal plays, applying what was written.

A side is a tuple of 26 counts in its own numbering: index 0 is off, 1 to 24 its points, 25 the bar; own point p is the
other side's 25 - p. A position is a pair of sides. Positions are immutable, so sets of them serve as search frontiers.
"""

from __future__ import annotations

from collections.abc import Iterator

BAR, OFF = 25, 0
CHECKERS = 15
Side = tuple[int, ...]
Position = tuple[Side, Side]
Step = tuple[int, int]

_START = {24: 2, 13: 5, 8: 3, 6: 5}
START: Position = (tuple(_START.get(p, 0) for p in range(26)),) * 2


def _swapped(position: Position, side: int) -> tuple[Side, Side]:
    return position if side == 0 else (position[1], position[0])


def _changed(counts: Side, *changes: tuple[int, int]) -> Side:
    new = list(counts)
    for point, by in changes:
        new[point] += by
    return tuple(new)


def moved(position: Position, side: int, start: int, end: int) -> Position | None:
    """The position after one checker goes from `start` to `end`, a blot there being hit; None where no checker is or the point is held."""
    me, other = _swapped(position, side)
    if me[start] < 1 or not 0 <= end < start:
        return None
    me = _changed(me, (start, -1), (end, 1))
    if end != OFF:
        there = other[25 - end]
        if there > 1:
            return None
        if there == 1:
            other = _changed(other, (25 - end, -1), (BAR, 1))
    return (me, other) if side == 0 else (other, me)


def single_moves(position: Position, side: int, die: int) -> Iterator[tuple[Step, Position]]:
    """Every legal move of one checker by one die."""
    me = position[side]
    starts = [BAR] if me[BAR] else [p for p in range(1, 25) if me[p]]
    highest = max((p for p in range(1, 26) if me[p]), default=0)
    for start in starts:
        end = start - die
        if end <= 0:
            if highest > 6 or (end < 0 and start < highest):
                continue
            end = OFF
        after = moved(position, side, start, end)
        if after:
            yield (start, end), after


def legal_plays(position: Position, side: int, dice: tuple[int, int]) -> tuple[set[Position], int]:
    """The positions a roll can lead to, and the number of dice that must be played. As many dice as possible, the larger one if only one can be."""
    orders = [(dice[0],) * 4] if dice[0] == dice[1] else [dice, dice[::-1]]
    reached: list[tuple[int, int, set[Position]]] = []
    for order in orders:
        frontier, used = {position}, 0
        for die in order:
            after = {q for p in frontier for _, q in single_moves(p, side, die)}
            if not after:
                break
            frontier, used = after, used + 1
        reached.append((used, order[0], frontier))
    most = max(used for used, _, _ in reached)
    if most == 0:
        return {position}, 0
    best = [(first, f) for used, first, f in reached if used == most]
    if most == 1 and len(orders) == 2:
        larger = [f for first, f in best if first == max(dice)]
        return (larger[0] if larger else best[0][1]), 1
    return set().union(*(f for _, f in best)), most


def apply_written(position: Position, side: int, steps: list[Step]) -> tuple[Position, list[tuple[int, int, bool]]] | None:
    """The position after written steps, made in whatever order works, and the steps in that order with their hits."""
    if not steps:
        return position, []
    tried = set()
    for k, step in enumerate(steps):
        if step in tried:
            continue
        tried.add(step)
        after = moved(position, side, *step)
        if after:
            rest = apply_written(after, side, steps[:k] + steps[k + 1 :])
            if rest:
                hit = after[1 - side][BAR] > position[1 - side][BAR]
                return rest[0], [(*step, hit), *rest[1]]
    return None


def is_unfinished(position: Position, side: int, dice: tuple[int, int], steps: list[Step]) -> bool:
    """Whether the steps are the beginning of a legal play that uses more dice."""
    _, most = legal_plays(position, side, dice)
    if len(steps) >= most:
        return False
    for order in {(dice[0],) * 4} if dice[0] == dice[1] else {dice, dice[::-1]}:
        states = {(position, tuple(sorted(steps)))}
        for die in order[: len(steps)]:
            states = {(q, tuple(sorted(_without(left, s)))) for p, left in states for s, q in single_moves(p, side, die) if s in left}
        frontier = {p for p, left in states if not left}
        for die in order[len(steps) : most]:
            frontier = {q for p in frontier for _, q in single_moves(p, side, die)}
        if frontier:
            return True
    return False


def _without(steps: tuple[Step, ...], step: Step) -> list[Step]:
    left = list(steps)
    left.remove(step)
    return left


def pips(counts: Side) -> int:
    return sum(p * n for p, n in enumerate(counts))


def win_size(position: Position, winner: int) -> int:
    """1 single, 2 gammon, 3 backgammon."""
    loser = position[1 - winner]
    if loser[OFF]:
        return 1
    return 3 if loser[BAR] or any(loser[19:25]) else 2


def fault(position: Position) -> str | None:
    """What makes a position impossible, or None."""
    for side, counts in enumerate(position):
        if min(counts) < 0:
            return f"side {side} has a negative count"
        if sum(counts) != CHECKERS:
            return f"side {side} has {sum(counts)} checkers"
    shared = next((p for p in range(1, 25) if position[0][p] and position[1][25 - p]), None)
    return f"both sides hold point {shared}" if shared else None


def hits_between(before: Position, after: Position, side: int) -> list[int] | None:
    """Points, in the mover's numbering, where blots were hit; None if the other side changed in another way."""
    old, new = before[1 - side], after[1 - side]
    left = [p for p in range(1, 25) if old[p] != new[p]]
    if any(old[p] != 1 or new[p] != 0 for p in left) or new[BAR] - old[BAR] != len(left) or old[OFF] != new[OFF]:
        return None
    return [25 - p for p in left]


def steps_between(before: Position, after: Position, side: int) -> list[Step] | None:
    """Steps that lead from one position to the next for a side moving forward, through the points where it hit; None if none do."""
    hits = hits_between(before, after, side)
    if hits is None:
        return None
    change = [a - b for a, b in zip(after[side], before[side], strict=True)]
    left = [p for p in range(25, -1, -1) for _ in range(-change[p])]
    reached = [p for p in range(25, -1, -1) for _ in range(change[p])]
    if len(left) != len(reached) or any(a <= b for a, b in zip(left, reached, strict=True)):
        return None
    steps = list(zip(left, reached, strict=True))
    for point in hits:
        if all(end != point for _, end in steps):
            over = next((s for s in steps if s[0] > point > s[1]), None)
            if over is None:
                return None
            at = steps.index(over)
            steps[at : at + 1] = [(over[0], point), (point, over[1])]
    done = apply_written(before, side, steps)
    return steps if done and done[0] == after else None


def position_text(position: Position) -> str:
    """Points 1 to 24 and the bar of either side, and what is off."""
    return "|".join([*(".".join(map(str, s[1:])) for s in position), ".".join(str(s[OFF]) for s in position)])
