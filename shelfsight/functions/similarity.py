"""String similarity. Jaro is the one measure Spark has no function for; it runs as an
Arrow UDF on pairs that blocking has already chosen."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, f in zip(b, free) if not f]
    half = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    j = jaro_udf(a, b)
    def shared(n):
        return (F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.least(F.length(a), F.length(b)) >= n)
    prefix = F.when(shared(4), 4).when(shared(3), 3).when(shared(2), 2).when(shared(1), 1).otherwise(0)
    return j + prefix * 0.1 * (F.lit(1.0) - j)


def word_overlap(a: Column, b: Column) -> Column:
    wa, wb = F.split(a, " "), F.split(b, " ")
    return F.size(F.filter(wa, lambda w: F.array_contains(wb, w))) / F.greatest(F.size(wa), F.size(wb))


def edit_ratio(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def contained_as_words(a: Column, b: Column) -> Column:
    """The first occurrence of a in b starts and ends at a blank or at an end of b."""
    at = F.instr(b, a)
    before = (at == 1) | (F.substr(b, at - 1, F.lit(1)) == " ")
    end = at + F.length(a)
    after = (end == F.length(b) + 1) | (F.substr(b, end, F.lit(1)) == " ")
    return (at > 0) & before & after


def contained_score(a: Column, b: Column) -> Column:
    return F.lit(1.0) - ((F.length(b) - F.length(a)) / F.length(b)) * 0.2
