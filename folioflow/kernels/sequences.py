"""Longest common subsequences by bit-parallel rows: pure Python."""

from __future__ import annotations

from collections.abc import Iterator


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """A row of bits for each prefix of ``b``: the zeros below ``i`` count the LCS with ``a[:i]``."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    yield v
    for t in b:
        u = v & where.get(t, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def bit_places(a: list[str]) -> dict[str, int]:
    """A bit for each place of each token."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    return where


def lcs_length(a: list[str], b: list[str], where: dict[str, int] | None = None, least: int = 0) -> int:
    """Bit-parallel length of the longest common subsequence, 0 if it is less than ``least``; ``where`` is ``bit_places(a)``."""
    where = bit_places(a) if where is None else where
    at = [where[t] for t in b if t in where]  # others change nothing
    if len(at) < least:
        return 0
    full = (1 << len(a)) - 1
    v = full
    for x in at:
        if u := v & x:
            v = ((v + u) | (v - u)) & full
    n = len(a) - v.bit_count()
    return n if n >= least else 0


def lcs_pairs(a: list[str], b: list[str], most_bits: int = 64_000_000) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order. The rows of bits take at most ``most_bits``
    where ``b`` can be halved; each half then gets its part of ``a``."""
    out: list[tuple[int, int]] = []
    common = set(a) & set(b)
    stack = [([i for i, t in enumerate(a) if t in common], [j for j, t in enumerate(b) if t in common])]
    while stack:
        left, right = stack.pop()
        n, x, y = len(left), [a[i] for i in left], [b[j] for j in right]
        if not x or not y:
            continue
        if n * len(y) > most_bits and len(y) > 1:
            half = len(y) // 2
            for v in _rows(x, y[:half]):
                fore = v
            for v in _rows(x[::-1], y[: half - 1 : -1]):
                back = v
            up, down = bin(fore | 1 << n)[:2:-1], bin(back | 1 << n)[:2:-1]
            here = most = down.count("0")
            at = 0
            for k in range(n):
                here += (up[k] == "0") - (down[n - 1 - k] == "0")
                if here > most:
                    most, at = here, k + 1
            stack += [(left[:at], right[:half]), (left[at:], right[half:])]
            continue
        rows = [v.to_bytes((n + 7) // 8, "little") for v in _rows(x, y)]
        bit = lambda i, j: rows[j][i >> 3] >> (i & 7) & 1
        i, j = n, len(y)
        while i and j:
            if bit(i - 1, j):
                i -= 1
            elif not bit(i - 1, j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[i], right[j]))
    return sorted(out)
