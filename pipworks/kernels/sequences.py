"""Comparing sequences of rolls: longest common subsequences by bit-parallel arithmetic on Python's integers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

#: Share of rolls in common from which on two transcripts are of one match (fixed value).
SAME_MATCH = 0.95


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence; one big-integer step per element of `b`."""
    if not len(a) or not len(b):
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def shared_rolls(a: list[list[str]], b: list[list[str]]) -> tuple[float, tuple[int, int] | None]:
    """The share of tokens in common over all games, and the first difference as (game, position); 1 where there are none."""
    common = longest = 0
    first = None
    for g, (x, y) in enumerate(zip_longest(a, b, fillvalue=())):
        common += lcs_length(x, y)
        longest += max(len(x), len(y))
        if first is None and list(x) != list(y):
            first = g, next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return (common / longest if longest else 1.0), first
