"""Similarities that need a matcher: Arrow-batched functions over the standard library's difflib.

Ratcliff-Obershelp ratios are neither symmetric nor an edit distance, so only the same matcher gives the same
numbers. Every use is behind an equi-join, as a ratio costs the product of its lengths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of the lower-cased, stripped values; 0 where either is empty."""
    pairs = ((str(x or "").strip().lower(), str(y or "").strip().lower()) for x, y in zip(a, b))
    return pd.Series([_ratio(x, y) if x and y else 0.0 for x, y in pairs])


@F.pandas_udf(T.DoubleType())
def exact_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of the values as they are."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)])


def _conflict(x: str, y: str) -> float:
    x, y = x.strip().lower(), y.strip().lower()
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    wx, wy = set(x.split()), set(y.split())
    overlap = len(wx & wy) / max(len(wx | wy), 1)
    return 0.5 * _ratio(x, y) + 0.3 * overlap + 0.2 * (0.5 if x in y or y in x else 0.0)


@F.pandas_udf(T.DoubleType())
def conflict_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Half the ratio, three tenths the word overlap, and a tenth where one value contains the other; equal values are 1."""
    return pd.Series([_conflict(str(x or ""), str(y or "")) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def mean_conflict_similarity(values: pd.Series) -> pd.Series:
    """Mean of ``conflict_similarity`` over the pairs of an array of distinct values; null for less than two. Pairs that a batch repeats are compared once."""
    from functools import lru_cache
    from itertools import combinations

    one = lru_cache(maxsize=100_000)(_conflict)
    pairs = ([one(x, y) for x, y in combinations(v, 2)] if v is not None else [] for v in values)
    return pd.Series([sum(p) / len(p) if p else None for p in pairs], dtype="float64")


def fuzzy_match(a, b, threshold: float = 0.8):
    """Whether the ratio of the lower-cased values reaches ``threshold``."""
    return fuzzy_ratio(a, b) >= threshold


@F.pandas_udf(T.DoubleType())
def sequence_score(window: pd.Series, target: pd.Series) -> pd.Series:
    """Four fifths the ratio and one fifth the ratio of lengths."""

    def one(x: str, y: str) -> float:
        longest = max(len(x), len(y))
        return 0.8 * _ratio(x.lower(), y.lower()) + 0.2 * (min(len(x), len(y)) / longest if longest else 0.0)

    return pd.Series([one(x or "", y or "") for x, y in zip(window, target)])


@F.pandas_udf(T.StringType())
def segmented(texts: pd.Series, pieces: pd.Series) -> pd.Series:
    """Run-together words split by the known ``pieces`` (lower-cased, at most 20 letters) that come with each.

    Known pieces cost nothing, unknown ones of three characters or more their length; the cheapest split wins,
    then the one with the longest last piece. A text over 20 characters that falls into at most two pieces
    stays as it was.
    """

    def one(text: str | None, words: set) -> str | None:
        if not text:
            return text
        low = text.lower()
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(low) + 1):
            options = []
            for start in range(max(0, end - 20), end):
                piece = low[start:end]
                cost = 0.0 if piece in words else float(end - start) if end - start >= 3 else float("inf")
                options.append((best[start][0] + cost, start))
            best.append(min(options))
        if best[-1][0] == float("inf"):
            return text
        cuts, at = [], len(low)
        while at:
            cuts.append(text[best[at][1] : at])
            at = best[at][1]
        return text if len(cuts) <= 2 and len(text) > 20 else " ".join(reversed(cuts))

    return pd.Series([one(t, set(p)) for t, p in zip(texts, pieces)])
