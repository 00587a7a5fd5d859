"""One-to-one matching of numbered items: pure Python."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from itertools import count


def equal_pairs(left: Sequence[Hashable], right: Sequence[Hashable]) -> list[tuple[int, int]]:
    """The k-th place of a key on the left with its k-th place on the right, by place; None is no key."""

    def ranked(keys: Sequence[Hashable]) -> dict[tuple[Hashable, int], int]:
        seen: dict[Hashable, count] = {}
        return {(k, next(seen.setdefault(k, count()))): i for i, k in enumerate(keys) if k is not None}

    there = ranked(right)
    return [(i, there[key]) for key, i in ranked(left).items() if key in there]


def greedy_pairs(ranked: Iterable[tuple]) -> list[tuple]:
    """Of tuples ``(rank, left, right, ...)`` the best-ranked ones that share no left and no right."""
    left, right, out = set(), set(), []
    for x in sorted(ranked, key=lambda x: x[0]):
        if x[1] not in left and x[2] not in right:
            left.add(x[1])
            right.add(x[2])
            out.append(x)
    return out
