"""Column picking and naming helpers shared by all operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTLIER_FLAG = "__is_outlier__"
ID_NAME = r"(^|_)(id|no|num|number|code)$"


def col(name: str) -> Column:
    """The column of this literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def measure_columns(df: DataFrame, cols: Iterable[str] | None, id_pattern: str = ID_NAME) -> list[str]:
    """Numeric columns that hold quantities: no ids, no outlier flag."""
    names = list(cols) if cols else numeric_columns(df)
    return drop_id_like([c for c in names if c != OUTLIER_FLAG], id_pattern)


def drop_id_like(cols: Iterable[str], pattern: str = ID_NAME) -> list[str]:
    return [c for c in cols if not re.search(pattern, c.lower())]


def has_hint(name: str, hints: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(h in lowered for h in hints)


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    known = set(df.columns)
    return [c for c in cols if c in known]


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as missing."""
    kind = df.schema[name].dataType
    c = col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return c if isinstance(kind, T.DoubleType) else c.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above every number and does not count it as missing; make it NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats}) if floats else df


def round2(c: Column) -> Column:
    """Two decimals, ties to even."""
    return F.rint(c * 100) / 100


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round2(part / whole * 100)).otherwise(F.lit(0.0))


def rows_to_long(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row frame of aggregates into one row per dict, without an action."""
    structs = [F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows]
    return one_row.select(F.inline(F.array(*structs)))


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def agg_row(df: DataFrame, aggs: dict[str, Column], chunk: int = 400) -> dict:
    """Run many aggregates in one scan (split only when the generated code would get too big)."""
    out: dict = {}
    names = list(aggs)
    for part in chunks(names, chunk):
        row = df.agg(*[aggs[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[i] for i, n in enumerate(part)})
    return out
