"""Fuzzy name scores: a weighted edit distance by way of the longest common subsequence.

Inserting or deleting a character costs a half and replacing one costs one, as much as deleting
and inserting. So the distance is (m + n) / 2 - LCS, and the score 1 - distance / max(m, n).
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A term up to this length fits the bits of one BIGINT; ANSI arithmetic needs two to spare.
MAX_BITS = 61


def lcs_of_literal(term: str, content: Column) -> Column:
    """Length of the longest common subsequence of a literal of at most MAX_BITS characters and a
    column, in one native pass over the column's characters: bit i of the state is 0 where taking
    i + 1 characters of the term made the subsequence longer."""
    m = len(term)
    if m == 0:
        return F.lit(0)
    if m > MAX_BITS:
        raise ValueError(f"the literal has {m} characters, more than {MAX_BITS}")
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(term):
        where[c] |= 1 << i
    masks = F.create_map(*[F.lit(x) for c, bits in where.items() for x in (c, bits)]).cast("map<string,bigint>")
    every = F.lit((1 << m) - 1).cast("long")

    def step(v: Column, c: Column) -> Column:
        u = v.bitwiseAND(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long")))
        return (v + u).bitwiseOR(v - u).bitwiseAND(every)

    return F.lit(m) - F.bit_count(F.aggregate(F.split(content, ""), every, step))


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two columns of any length, with the bits in one long integer."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        every = v = (1 << len(x)) - 1
        for c in y:
            u = v & where.get(c, 0)
            v = (v + u | v - u) & every
        out.append(len(x) - v.bit_count())
    return pd.Series(out, dtype="Int32")


def _from_lcs(common: Column, m: Column, n: Column) -> Column:
    longest = F.greatest(m, n)
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - ((m + n) * F.lit(0.5).cast("double") - common) / longest)


def distance(a: Column, b: Column) -> Column:
    """The weighted edit distance of two columns, case included."""
    return (F.length(a) + F.length(b)) * F.lit(0.5).cast("double") - lcs(a, b)


def score(term: str | Column, content: Column) -> Column:
    """From 0 to 1, without regard to case; two empty strings score 1. Lengths count code points."""
    content = F.lower(content)
    if isinstance(term, str):
        term = term.lower()
        common = lcs_of_literal(term, content) if len(term) <= MAX_BITS else lcs(F.lit(term), content)
        return _from_lcs(common, F.lit(len(term)), F.length(content))
    term = F.lower(term)
    return _from_lcs(lcs(term, content), F.length(term), F.length(content))
