"""String similarity kernels on 0-100 (Jaro-Winkler: 0-1), and their Arrow UDF.

ratio is the normalised indel similarity, 200 LCS / (|a| + |b|); the LCS runs bit-parallel on Python integers. Two empty strings are equal (100; Jaro-Winkler 1.0);
the token-set ratio of an empty side is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    return where


def _common(where: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return n - s.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence. What both begin or end with is in it as it is."""
    least, start = min(len(a), len(b)), 0
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    return start + end + (_common(_places(a), len(a), b) if a and b else 0)


def ratio(a: str, b: str) -> float:
    if a == b:
        return 100.0
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens and the common tokens with either remainder."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = x & y
    if common and (x <= y or y <= x):
        return 100.0
    base, left, right = (" ".join(sorted(t)) for t in (common, x - y, y - x))
    one, two = (f"{base} {r}".strip() for r in (left, right))
    best = ratio(one, two)
    return max(best, ratio(base, one), ratio(base, two)) if base else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against the windows of its length in the longer one, cut windows at both ends included."""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(*sorted((a, b), key=len))


def _windows(short: str, long: str) -> float:
    """Windows are tried by falling upper bound, the ratio that their common characters in any order would give."""
    if short in long:
        return 100.0
    n, m, where, held, shared = len(short), len(long), _places(short), {}, 0
    need = {c: bits.bit_count() for c, bits in where.items()}
    bounds = []
    for end in range(1, m + n):
        if end <= m:
            c = long[end - 1]
            held[c] = held.get(c, 0) + 1
            shared += held[c] <= need.get(c, 0)
        if end > n:
            c = long[end - n - 1]
            shared -= held[c] <= need.get(c, 0)
            held[c] -= 1
        bounds.append((200.0 * shared / (n + min(end, m) - max(0, end - n)), end))
    bounds.sort(reverse=True)
    best = 0.0
    for bound, end in bounds:
        if bound <= best:
            break
        window = long[max(0, end - n) : end]
        best = max(best, 200.0 * _common(where, n, window) / (n + len(window)))
    return best


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity, raised by the common prefix (up to 4) where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for k, c in enumerate(a):
        at = next((j for j in range(max(0, k - reach), min(len(b), k + reach + 1)) if not used[j] and b[j] == c), None)
        if at is not None:
            used[at] = True
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro) if jaro > 0.7 else jaro


SCORERS = {"ratio": ratio, "token_set_ratio": token_set_ratio, "token_sort_ratio": token_sort_ratio, "partial_ratio": partial_ratio, "jaro_winkler": jaro_winkler}


def similarities(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct of scores in one Python pass: {name: (scorer, left, right)}. Null sides count as empty; equal pairs are scored once per worker while remembered."""
    names, scorers = list(wanted), [w[0] for w in wanted.values()]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels = [lru_cache(50_000)(SCORERS[s]) for s in scorers]
        for sides in batches:
            columns = [sides.iloc[:, k].tolist() for k in range(sides.shape[1])]
            yield pd.DataFrame({n: [f(a, b) for a, b in zip(columns[2 * k], columns[2 * k + 1], strict=True)] for k, (n, f) in enumerate(zip(names, kernels, strict=True))}, dtype="float64")

    empty = F.lit("")
    return score(F.struct(*(F.coalesce(side, empty).alias(f"s{k}_{i}") for k, w in enumerate(wanted.values()) for i, side in enumerate(w[1:]))))
