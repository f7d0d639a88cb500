"""String measures that Spark lacks, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a boost for up to four equal first characters."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def weighted_edit_distance(a: list[str], b: list[str], v: float) -> float:
    """Edit distance of token lists; an edit at place i weighs 1 / (e^(i - v) + 1), a substitution twice that."""
    weight = [1 / (math.exp(min(50.0, i - v)) + 1) for i in range(max(len(a), len(b)) + 1)]
    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + weight[j])
    for i, x in enumerate(a):
        last, row = row, [row[0] + weight[i]]
        for j, y in enumerate(b):
            row.append(last[j] if x == y else min(last[j + 1] + weight[i], row[j] + weight[i], last[j] + 2 * weight[i]))
    return row[-1]


def common_subsequence(a: list, b: list) -> list:
    """Longest common subsequence of two lists; of equals, the one that leaves the first list's end first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_substring(texts: list[str]) -> str:
    """The leftmost longest part of the first text that all others contain; one text alone has none."""
    if len(texts) < 2:
        return ""
    first, rest = texts[0], texts[1:]
    for n in range(len(first), 0, -1):
        for i in range(len(first) - n + 1):
            if all(first[i : i + n] in t for t in rest):
                return first[i : i + n]
    return ""


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(jaro_winkler(x, y), 3) or None for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def edit_distance_udf(a: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([weighted_edit_distance(list(x), list(y), w) for x, y, w in zip(a, b, v, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def common_subsequence_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def common_substring_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([common_substring(list(t)) for t in texts])
