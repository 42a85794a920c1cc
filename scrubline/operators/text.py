"""Text normalisation: whitespace, missing-value words, casing."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.columns import col, present, text_columns
from scrubline.functions.text import missing_as_null, placeholder_words, strip, title_case, trimmed
from scrubline.operators.detect import detect_categorical
from scrubline.storage import write_and_observe

NAME_COLUMN = r"(^|_)name($|_)"


def _chosen(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    return text_columns(df) if cols is None else present(df, cols)


def trim_whitespace(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Strip both ends, collapse inner whitespace; the literal text ``nan`` becomes NULL."""
    return df.withColumns({c: trimmed(col(c)) for c in _chosen(df, cols)})


def standardize_missing(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Words that stand for "no value" become NULL.

    Ambiguous words such as ``pending`` stay in columns whose name contains ``status``.
    """
    return df.withColumns({
        c: missing_as_null(col(c), placeholder_words(c)) for c in _chosen(df, cols)
    })


@dataclass(frozen=True)
class Conversions:
    """What normalising the text columns did: rows of the table and, per column, values that became
    NULL and values that only lost white space.
    """

    rows: int = 0
    made_missing: dict[str, int] = field(default_factory=dict)
    squeezed: dict[str, int] = field(default_factory=dict)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c, n, self.squeezed[c]) for c, n in self.made_missing.items()],
            "column string, made_missing long, squeezed long")


def normalize_text(
    df: DataFrame, trim: bool = True, also: dict[str, Column] | None = None
) -> tuple[DataFrame, Conversions, dict]:
    """``standardize_missing`` of ``trim_whitespace``, stored, with the number of conversions.

    One pass over ``df`` writes the table and counts; ``also`` are further aggregates over the columns
    of ``df``, returned by their key. With ``trim=False`` only the words for missing values go.
    """
    also = also or {}
    names = text_columns(df)
    new = {c: f"__text{i}__" for i, c in enumerate(names)}
    done = df.withColumns({new[c]: trimmed(col(c)) if trim else col(c) for c in names}).withColumns({
        new[c]: missing_as_null(col(new[c]), placeholder_words(c)) for c in names})
    counters = {
        "rows": F.count(F.lit(1)),
        **{(c, "made_missing"): F.count_if(col(c).isNotNull() & col(new[c]).isNull()) for c in names},
        **{(c, "squeezed"): F.count_if(col(new[c]) != col(c)) for c in names},
    }
    stored, seen = write_and_observe(
        done, "normalized", {**{("own", k): v for k, v in counters.items()}, **also},
        {c: col(new.get(c, c)) for c in df.columns})
    conversions = Conversions(seen["own", "rows"], *[
        {c: seen["own", (c, kind)] for c in names} for kind in ("made_missing", "squeezed")])
    return stored, conversions, {k: seen[k] for k in also}


def standardize_casing(
    df: DataFrame, cols: Iterable[str] | None = None, mode: str = "title"
) -> DataFrame:
    """Title, lower or upper case; NULLs stay NULL and any other mode leaves the text alone."""
    change = {"title": title_case, "lower": F.lower, "upper": F.upper}.get(mode)
    if change is None:
        return df
    chosen = _chosen(df, list(cols) if cols else None)
    return df.withColumns({c: change(col(c)) for c in chosen})


def _title(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    kept = set(text_columns(df))
    return df.withColumns({c: title_case(strip(col(c))) for c in cols if c in kept})


def standardize_category_casing(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return _title(df, detect_categorical(df) if cols is None else cols)


def detect_name_columns(df: DataFrame) -> list[str]:
    """Text columns whose name has the word ``name`` (a test of the schema alone)."""
    return [
        c for c in text_columns(df)
        if re.search(NAME_COLUMN, c.lower()) and "username" not in c.lower()
    ]


def standardize_name_casing(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return _title(df, detect_name_columns(df) if cols is None else cols)
