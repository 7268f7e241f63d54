"""Comparing sequences and words: upper bounds, longest common subsequences, edit distances within a limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pipworks.kernels.sequences import lcs_length

__all__ = ["common", "edit_distance_at_most", "lcs_length"]


def common(a: Sequence, b: Sequence) -> int:
    """Elements in common, each as often as in both: an upper bound of any common subsequence."""
    return (Counter(a) & Counter(b)).total()


def edit_distance_at_most(a: str, b: str, limit: int) -> bool:
    """Whether optimal string alignment (insert, delete, replace, swap neighbours) needs at most `limit` steps."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return False
    return row[-1] <= limit
