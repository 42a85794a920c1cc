"""Row and column rules: exact duplicates, capping, and the whole rule layer."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.columns import as_double, col, measure_columns, nan_to_null
from scrubline.operators.quantiles import exact_quantiles
from scrubline.operators.text import Conversions, normalize_text, standardize_missing, trim_whitespace
from scrubline.operators.typed import (
    TypeFit, apply_casing, apply_casts, apply_types, fit_casts, fit_types, standardize_dates,
)
from scrubline.storage import spread, write_table

FENCE = 1.5


def remove_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each distinct row, NULLs being equal.

    Copies are folded inside each task before the shuffle, so a hot row costs one record per
    task. Map columns, which can not be grouped as distinct keys, go through their entries.
    """
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    entries = df.withColumns({c: F.array_sort(F.map_entries(col(c))) for c in maps})
    return entries.dropDuplicates().withColumns({c: F.map_from_entries(col(c)) for c in maps})


def fit_caps(
    df: DataFrame,
    cols: Iterable[str] | None = None,
    protect: Iterable[str] = (),
    skip_zero_iqr: bool = False,
) -> dict[str, tuple[float, float]]:
    """Tukey fences per measure column."""
    names = [c for c in measure_columns(df, cols) if c not in set(protect)]
    quartiles = exact_quantiles(df, {c: as_double(df, c) for c in names}, [0.25, 0.75])
    fences = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is None or (skip_zero_iqr and q1 == q3):
            continue
        fences[c] = (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
    return fences


def apply_caps(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    # least and greatest skip NULLs, so a missing value needs the guard to stay missing.
    return df.withColumns({
        c: F.when(as_double(df, c).isNotNull(),
                  F.least(F.greatest(as_double(df, c), F.lit(low)), F.lit(high)))
        for c, (low, high) in fences.items()
    }) if fences else df


def cap_outliers_iqr(
    df: DataFrame,
    cols: Iterable[str] | None = None,
    protect: Iterable[str] = (),
    skip_zero_iqr: bool = False,
) -> DataFrame:
    """Clip every measure column to its quartiles -/+ 1.5 interquartile ranges."""
    return apply_caps(df, fit_caps(df, cols, protect, skip_zero_iqr))


@dataclass
class RuleFit:
    types: TypeFit
    date_columns: list[str] = field(default_factory=list)
    casts: dict[str, str] = field(default_factory=dict)
    caps: dict[str, tuple[float, float]] = field(default_factory=dict)


def _normalized(df: DataFrame) -> DataFrame:
    return standardize_missing(trim_whitespace(nan_to_null(df)))


def _before_caps(df: DataFrame, fit: RuleFit) -> DataFrame:
    """``df`` is normalised already."""
    df = apply_casing(apply_types(df, fit.types), fit.types)
    df = remove_exact_duplicates(df)
    if fit.date_columns:
        df = standardize_dates(df, fit.date_columns)
    return df


def apply_rules(df: DataFrame, fit: RuleFit) -> DataFrame:
    """Repeat a fitted rule layer on another table of the same columns."""
    df = _before_caps(_normalized(df), fit)
    return apply_caps(apply_casts(df, fit.casts), fit.caps)


def fit_rules(
    df: DataFrame,
    date_columns: Iterable[str] | None = None,
    type_map: dict[str, str] | None = None,
    convert_currency: bool = False,
    write: bool = True,
) -> tuple[DataFrame, RuleFit]:
    """Learn and apply the rule layer.

    The table without duplicates comes out of the one full shuffle; with ``write`` it is stored
    in the shared folder, so that no later step repeats the shuffle, and so is the normalised table,
    so that ``df`` is read once.
    """
    if write:
        df, conversions, _ = normalize_text(nan_to_null(df))
        return fit_normalized(df, conversions, date_columns, type_map, convert_currency)
    return fit_normalized(_normalized(df), None, date_columns, type_map, convert_currency)


def fit_normalized(
    df: DataFrame,
    conversions: Conversions | None,
    date_columns: Iterable[str] | None = None,
    type_map: dict[str, str] | None = None,
    convert_currency: bool = False,
) -> tuple[DataFrame, RuleFit]:
    """``fit_rules`` of a table that ``normalize_text`` stored; without its counts nothing is stored."""
    if conversions is not None:
        df = spread(df, conversions.rows)
    types = fit_types(df, convert_currency)
    fit = RuleFit(types, list(date_columns or ()))
    df = _before_caps(df, fit)
    fit.casts = fit_casts(df, dict(type_map or {}))
    df = apply_casts(df, fit.casts)
    if conversions is not None:
        df = write_table(df, "deduplicated")
    fit.caps = fit_caps(df, protect=types.protected)
    return apply_caps(df, fit.caps), fit


def run_rule_cleaning(
    df: DataFrame,
    date_columns: Iterable[str] | None = None,
    type_map: dict[str, str] | None = None,
    convert_currency: bool = False,
) -> DataFrame:
    """Trim, clean types, drop duplicates, force dates and types, cap."""
    return fit_rules(df, date_columns, type_map, convert_currency)[0]
