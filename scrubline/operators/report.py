"""Before/after figures of a cleaning run as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.columns import OUTLIER_FLAG, agg_row, col, nan_to_null
from scrubline.operators.profile import Profile

SCHEMA = "section string, column string, metric string, value double"


def cleaning_report(before: Profile, after: DataFrame) -> DataFrame:
    """(section, column, metric, value): summary, missing before, duplicates, outliers, flagged rows
    and what is still missing. The cleaned table is scanned once.
    """
    clean = nan_to_null(after)
    aggs: dict[tuple, Column] = {("rows",): F.count(F.lit(1))}
    for c in clean.columns:
        aggs["present", c] = F.count(col(c))
    if OUTLIER_FLAG in clean.columns:
        aggs["flagged",] = F.count_if(col(OUTLIER_FLAG))
    seen = agg_row(clean, aggs)
    rows = seen["rows",]
    left = {c: rows - seen["present", c] for c in clean.columns}
    missing_before = {r["column"]: r for r in before.missing.collect()}

    out: list[tuple] = [
        ("summary", None, "rows_before", before.rows),
        ("summary", None, "rows_after", rows),
        ("summary", None, "rows_removed", before.rows - rows),
        ("summary", None, "missing_before", sum(r["missing_count"] for r in missing_before.values())),
        ("summary", None, "missing_after", sum(left.values())),
    ]
    for name, r in missing_before.items():
        out += [("missing_before", name, m, r[m]) for m in ("missing_count", "missing_pct")]
    for r in before.duplicates.collect():
        out += [("duplicates_before", None, m, r[m]) for m in ("exact_duplicate_rows", "exact_duplicate_pct")]
    for r in before.outliers.collect():
        out += [("outliers_before", r["column"], m, r[m]) for m in ("outlier_count", "outlier_pct")]
    if ("flagged",) in seen:
        out.append(("flagged", OUTLIER_FLAG, "flagged_rows", seen["flagged",]))
    for name, n in left.items():
        if n:
            out.append(("missing_after", name, "missing_count", n))
            out.append(("missing_after", name, "missing_pct", round(n / rows * 100, 2)))
    return after.sparkSession.createDataFrame(
        [(s, c, m, float(v)) for s, c, m, v in out], SCHEMA
    )
