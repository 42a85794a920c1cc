"""Comparing category spellings: stems, prefix variants, opposites and a similarity ratio."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions import vocab
from scrubline.functions.words import lookup


def expand_and_stem(
    c: Column,
    acronyms: dict[str, str] = vocab.ACRONYMS,
    abbreviations: dict[str, str] = vocab.ABBREVIATIONS,
) -> Column:
    """Comparison form of a category value: plain words, abbreviations written out, singular."""
    text = F.regexp_replace(F.lower(c), r"(?U)\s*&\s*", " and ")
    text = F.replace(text, F.lit("-"), F.lit(" "))
    text = F.regexp_replace(text, "[^a-z0-9 ]", "")
    text = F.btrim(F.regexp_replace(text, " +", " "), F.lit(" "))
    words = lookup(abbreviations)
    written_out = F.array_join(
        F.transform(F.split(text, " "), lambda w: F.coalesce(words[w], w)), " "
    )
    return singular(F.coalesce(lookup(acronyms)[text], written_out))


def singular(c: Column) -> Column:
    def cut(n: int) -> Column:
        return F.left(c, F.length(c) - n)

    return (
        F.when(c.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(c.rlike("(?:x|ch|sh)es$"), cut(2))
        .when(c.endswith("s") & ~c.endswith("ss"), cut(1))
        .otherwise(c)
    )


def is_negation_pair(a: Column, b: Column) -> Column:
    """One word is the other with a negating prefix (active / inactive)."""
    tests = [(a == F.concat(F.lit(p), b)) | (b == F.concat(F.lit(p), a)) for p in vocab.NEGATION_PREFIXES]
    return reduce(Column.__or__, tests)


def _starts_either_way(a: Column, b: Column, at_least: int) -> Column:
    return (F.least(F.length(a), F.length(b)) >= at_least) & (F.startswith(a, b) | F.startswith(b, a))


def is_prefix_variant(a: Column, b: Column) -> Column:
    """The shorter text (4 letters or more) begins the longer one."""
    return _starts_either_way(a, b, vocab.MIN_PREFIX_LENGTH)


def is_token_prefix_variant(a: Column, b: Column) -> Column:
    """Same number of words (two or more), each pair of words being prefix-related."""
    left, right = F.split(a, " "), F.split(b, " ")
    related = F.forall(
        F.arrays_zip(left.alias("l"), right.alias("r")),
        lambda t: _starts_either_way(t["l"], t["r"], vocab.MIN_TOKEN_PREFIX_LENGTH),
    )
    return F.when((F.size(left) == F.size(right)) & (F.size(left) >= 2), related).otherwise(False)


def longest_common(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence; anything below ``least`` once it can not be reached.

    A letter of ``b`` updates all places of ``a`` at once: they are the bits of one number, in which a
    cleared bit marks a place where the length grows.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if start + min(len(a), len(b)) < least:
        return 0
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << i
    full = flat = (1 << len(a)) - 1
    for i, letter in enumerate(b):
        hit = flat & where.get(letter, 0)
        if hit:
            flat = (flat + hit | flat - hit) & full
        if i % 64 == 63 and start + len(a) - flat.bit_count() + len(b) - i - 1 < least:
            return 0
    return start + len(a) - flat.bit_count()


@F.pandas_udf(T.LongType())
def _common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else longest_common(x, y) for x, y in zip(a, b)], dtype="Int64")


def common_subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts."""
    return _common_length(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 x (1 - insertions and deletions / total length), i.e. 200 x LCS / (len a + len b)."""
    total = F.length(a) + F.length(b)
    return (
        F.when(a == b, 100.0)
        .when(total > 0, F.lit(200.0) * common_subsequence_length(a, b) / total)
    )


def ratio_at_least(a: Column, b: Column, threshold: float) -> Column:
    """``indel_ratio(a, b) >= threshold``, given up as soon as too few letters are left to reach it."""

    @F.pandas_udf(T.BooleanType())
    def reached(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            least = math.ceil((threshold - 1e-9) * (len(x) + len(y)) / 200)
            out.append(x == y or (len(x) + len(y) > 0 and longest_common(x, y, least) >= least))
        return pd.Series(out, dtype="boolean")

    return reached(a, b)
