"""Whole-table quality profile. Every table here is one small frame built from one wide scan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.columns import (
    agg_row, as_double, col, nan_to_null, numeric_columns, percent_of, rows_to_long,
)


def profile_missing(df: DataFrame) -> DataFrame:
    """One row per column: missing count, missing percent (two decimals) and type name."""
    df = nan_to_null(df)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    return rows_to_long(counted, [
        {
            "column": F.lit(f.name),
            "missing_count": F.col("n") - F.col(f"c{i}"),
            "missing_pct": percent_of(F.col("n") - F.col(f"c{i}"), F.col("n")),
            "dtype": F.lit(f.dataType.simpleString()),
        }
        for i, f in enumerate(df.schema)
    ])


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit fingerprints that equal rows share, each over all columns and where they are NULL.

    The second has another seed and the columns in reverse, so that what collides in one does not
    in the other. Zero has one form and NaN too, as in grouping. Columns whose equality is not that of
    their bytes (nested, variant or collated ones) stand for themselves.
    """
    simple = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)
        and (not isinstance(f.dataType, T.StringType) or f.dataType == T.StringType())
    ]
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    values = [F.when(col(c) == 0, F.lit(0.0)).otherwise(col(c)) if c in floats else col(c) for c in simple]
    # A hash passes over NULLs, so their places are hashed as well.
    parts = [part for c, v in zip(simple, values) for part in (col(c).isNull(), v)]
    keys = [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))] if parts else []
    return [k.alias(f"__key{i}__") for i, k in enumerate(keys)] + [col(c) for c in df.columns if c not in simple]


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat another row in every column (NULLs equal), counted beyond the first.

    Rows are told apart by 128 bits of fingerprints, so 16 bytes a row are exchanged whatever its
    width, and equal ones are folded before: one row copied a billion times costs one record per task.
    Among a trillion rows two unlike ones share a key with a chance of about one in 10^15.
    """
    copies = df.select(*row_keys(df))
    copies = copies.groupBy(*[col(c) for c in copies.columns]).agg(F.count(F.lit(1)).alias("__copies__"))
    totals = copies.agg(
        F.coalesce(F.sum(F.col("__copies__") - 1), F.lit(0)).alias("extra"),
        F.coalesce(F.sum("__copies__"), F.lit(0)).alias("n"),
    )
    return totals.select(
        F.col("extra").alias("exact_duplicate_rows"),
        percent_of(F.col("extra"), F.col("n")).alias("exact_duplicate_pct"),
    )


def _moments(df: DataFrame, names: list[str]) -> dict:
    return {
        (c, kind): f(as_double(df, c))
        for c in names for kind, f in (("mean", F.avg), ("std", F.stddev_pop))
    }


def _far_counts(df: DataFrame, names: list[str], moments: dict, z_thresh: float) -> DataFrame:
    aggs = []
    for i, c in enumerate(names):
        mean, std = moments[c, "mean"], moments[c, "std"]
        away = F.abs((as_double(df, c) - mean) / std) if std else F.lit(0.0)
        far = ~F.isnan(away) & (away > z_thresh)  # with infinities there is no deviation
        aggs.append(F.count_if(far).alias(f"c{i}"))
    counted = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    return rows_to_long(counted, [
        {
            "column": F.lit(c),
            "outlier_count": F.col(f"c{i}"),
            "outlier_pct": percent_of(F.col(f"c{i}"), F.col("n")),
        }
        for i, c in enumerate(names)
    ])


def profile_outliers(df: DataFrame, z_thresh: float = 3.0) -> DataFrame:
    """Per numeric column, how many values lie more than ``z_thresh`` population deviations off.

    Two scans whatever the number of columns: moments first, then the counts.
    """
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], OUTLIERS)
    return _far_counts(df, names, agg_row(df, _moments(df, names)), z_thresh)


MISSING = "column string, missing_count long, missing_pct double, dtype string"
OUTLIERS = "column string, outlier_count long, outlier_pct double"


@dataclass(frozen=True)
class Profile:
    rows: int
    columns: int
    missing: DataFrame
    duplicates: DataFrame
    outliers: DataFrame

    def as_frame(self) -> DataFrame:
        """All figures as (section, column, metric, value) rows."""
        shape = self.missing.sparkSession.createDataFrame(
            [("shape", None, "rows", float(self.rows)), ("shape", None, "columns", float(self.columns))],
            "section string, column string, metric string, value double",
        )

        def melt(frame: DataFrame, section: str, name, metrics: list[str]) -> DataFrame:
            return frame.select(
                F.lit(section).alias("section"), name.alias("column"),
                F.explode(F.create_map(*[
                    x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))
                ])).alias("metric", "value"),
            )

        return (
            shape
            .unionByName(melt(self.missing, "missing", F.col("column"), ["missing_count", "missing_pct"]))
            .unionByName(melt(self.duplicates, "duplicates", F.lit(None).cast("string"),
                              ["exact_duplicate_rows", "exact_duplicate_pct"]))
            .unionByName(melt(self.outliers, "outliers", F.col("column"), ["outlier_count", "outlier_pct"]))
        )


def profile_aggregates(df: DataFrame) -> dict:
    """What ``profile_dataset`` needs of a first scan, for callers that read the table anyway."""
    return {
        "rows": F.count(F.lit(1)), **{(c, "n"): F.count(col(c)) for c in df.columns},
        **_moments(df, numeric_columns(df)),
    }


def profile_dataset(df: DataFrame, z_thresh: float = 3.0, seen: dict | None = None) -> Profile:
    """All figures, evaluated now: one scan for counts and moments (left out if ``seen`` has the
    values of ``profile_aggregates``), one for the outliers (numeric columns only) and one shuffle for
    the duplicates.
    """
    df = nan_to_null(df)
    spark = df.sparkSession
    names = numeric_columns(df)
    if seen is None:
        seen = agg_row(df, profile_aggregates(df))
    rows = seen["rows"]
    missing = [
        (f.name, rows - seen[f.name, "n"],
         float(np.rint((rows - seen[f.name, "n"]) / rows * 1e4) / 100) if rows else 0.0,
         f.dataType.simpleString())
        for f in df.schema
    ]
    # One row per numeric column at most: these are figures, not data.
    outliers = _far_counts(df, names, seen, z_thresh).collect() if names else []
    duplicates = profile_duplicates(df)
    return Profile(
        rows=rows,
        columns=len(df.columns),
        missing=spark.createDataFrame(missing, MISSING),
        duplicates=spark.createDataFrame(duplicates.collect(), duplicates.schema),
        outliers=spark.createDataFrame(outliers, OUTLIERS),
    )
