"""Filling missing values: nearest neighbours, medians, most common words."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.columns import agg_row, as_double, col, drop_id_like, has_hint, numeric_columns, present
from scrubline.functions import vocab
from scrubline.operators.detect import detect_categorical
from scrubline.operators.neighbours import Donors, fit_donors, nearest_means
from scrubline.operators.quantiles import exact_quantiles

WHOLE_SHARE = 0.98
WHOLE_TOLERANCE = 1e-8


@dataclass
class NumericFit:
    """What filling needs: the columns with gaps, their whole-number range and the fill source."""

    columns: list[str]
    whole_range: dict[str, tuple[float, float]] = field(default_factory=dict)
    medians: dict[str, float] | None = None
    donors: Donors | None = None


def _target_stats(df: DataFrame, cols: Iterable[str] | None, exclude_ids: bool) -> tuple[list[str], dict, int]:
    names = present(df, cols) if cols else numeric_columns(df)
    if exclude_ids:
        names = drop_id_like(names)
    aggs: dict = {"rows": F.count(F.lit(1))}
    for c in names:
        v = as_double(df, c)
        part = F.pmod(v, F.lit(1.0))
        aggs[c, "count"] = F.count(v)
        aggs[c, "whole"] = F.count_if(part <= WHOLE_TOLERANCE)
        aggs[c, "min"] = F.min(v)
        aggs[c, "max"] = F.max(v)
    seen = agg_row(df, aggs)
    rows = seen["rows"]
    # A column without any value has nothing to be filled from.
    return [c for c in names if 0 < seen[c, "count"] < rows], seen, rows


def _fit_base(df: DataFrame, cols, exclude_ids: bool) -> tuple[NumericFit, int]:
    names, seen, rows = _target_stats(df, cols, exclude_ids)
    whole = {
        c: (seen[c, "min"], seen[c, "max"]) for c in names
        if seen[c, "whole"] / seen[c, "count"] >= WHOLE_SHARE
    }
    return NumericFit(names, whole), rows


def fit_median(df: DataFrame, cols: Iterable[str] | None = None, exclude_ids: bool = False) -> NumericFit:
    fit, _ = _fit_base(df, cols, exclude_ids)
    return _with_medians(df, fit)


def _with_medians(df: DataFrame, fit: NumericFit) -> NumericFit:
    found = exact_quantiles(df, {c: as_double(df, c) for c in fit.columns}, [0.5])
    fit.medians = {c: q[0] for c, q in found.items()}
    return fit


def fit_knn(
    df: DataFrame, cols: Iterable[str] | None = None, k: int = 5, exclude_ids: bool = False
) -> NumericFit:
    """Nearest neighbours, whatever the size of the table; the donors are stored."""
    fit, _ = _fit_base(df, cols, exclude_ids)
    if fit.columns:
        fit.donors = fit_donors(_values(df, fit.columns), k)
    return fit


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    # Zero has one form, so that equal rows have equal hashes.
    return df.select(*[(as_double(df, c) + 0.0).alias(f"v{i}") for i, c in enumerate(columns)])


def apply_numeric_fill(df: DataFrame, fit: NumericFit) -> DataFrame:
    """Fill the gaps, then round whole-number columns and hold them in their observed range."""
    cols = fit.columns
    if not cols:
        return df
    if fit.medians is not None:
        filled = {c: F.coalesce(as_double(df, c), F.lit(fit.medians[c])) for c in cols}
    else:
        found = nearest_means(_values(df, cols), fit.donors).select(
            F.col("x").alias("__x__"), F.col("filled").alias("__filled__"))
        # Rows with equal values are filled alike: one row of ``found`` for all of them.
        own = F.array(*[as_double(df, c) + 0.0 for c in cols])
        df = df.withColumn("__own__", own).join(found, F.col("__own__") == F.col("__x__"), "left").drop("__own__", "__x__")
        filled = {c: F.coalesce(as_double(df, c), F.col("__filled__")[i]) for i, c in enumerate(cols)}
    df = df.withColumns(filled).drop("__filled__")
    return round_integer_like(df, fit.whole_range)


def round_integer_like(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Whole numbers again (ties to even), inside the range seen before filling."""
    return df.withColumns({
        c: F.when(as_double(df, c).isNotNull(),
                  F.least(F.greatest(F.rint(as_double(df, c)), F.lit(low)), F.lit(high)))
        for c, (low, high) in fitted.items()
    }) if fitted else df


def impute_knn(
    df: DataFrame, cols: Iterable[str] | None = None, k: int = 5, exclude_ids: bool = False
) -> DataFrame:
    """Fill numeric gaps from the ``k`` nearest rows; ``impute_median`` is the cheap way."""
    return apply_numeric_fill(df, fit_knn(df, cols, k, exclude_ids))


def impute_median(
    df: DataFrame, cols: Iterable[str] | None = None, exclude_ids: bool = False
) -> DataFrame:
    return apply_numeric_fill(df, fit_median(df, cols, exclude_ids))


def fit_modes(df: DataFrame, cols: Iterable[str] | None = None) -> dict[str, str]:
    """The most common value of each column that has gaps; ties go to the smallest value.

    Counts per value are summed inside the tasks and across the cluster before one row per
    column is picked, so neither a hot value nor a large vocabulary meets in one task.
    """
    names = present(df, detect_categorical(df) if cols is None else cols)
    names = [c for c in names if not has_hint(c, vocab.MODE_BLOCKED_HINTS)]
    if not names:
        return {}
    gaps = agg_row(df, {c: F.count_if(col(c).isNull()) for c in names})
    names = [c for c in names if gaps[c] > 0]
    if not names:
        return {}
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names
    ])
    counts = (
        df.select(F.inline(entries)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    )
    return {r["column"]: r["value"] for r in best.collect()}


def apply_modes(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in modes.items()
    }) if modes else df


def impute_mode(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Fill category gaps with the most common value; never names, contacts or ids."""
    return apply_modes(df, fit_modes(df, cols))
