"""CSV with column types found from the values, keeping identifier columns as text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.columns import agg_row, col, has_hint
from scrubline.functions import vocab
from scrubline.functions.numbers import FLOAT_TEXT
from scrubline.functions.text import strip

FILE = "_metadata.file_path"  # of any table read from files
WHOLE_TEXT = r"^[+-]?\d+$"
LOGICAL = ("True", "TRUE", "true", "False", "FALSE", "false")


def _number_text(c: Column) -> Column:
    return strip(c).rlike(FLOAT_TEXT)


def infer_types(
    df: DataFrame, force_text_hints: Iterable[str] = vocab.IDENTIFIER_HINTS
) -> dict[str, str]:
    """Column -> ``bigint``, ``double`` or ``boolean`` where every value fits; from one scan."""
    hints = tuple(force_text_hints)
    names = [c for c in df.columns if not has_hint(c, hints)]
    aggs: dict = {"rows": F.count(F.lit(1))}
    for c in names:
        v = col(c)
        whole = strip(v).rlike(WHOLE_TEXT)
        aggs[c, "values"] = F.count(v)
        aggs[c, "numbers"] = F.count_if(_number_text(v))
        aggs[c, "whole"] = F.count_if(F.when(whole, strip(v).try_cast("bigint")).isNotNull())
        aggs[c, "logical"] = F.count_if(v.isin(*LOGICAL))
    seen = agg_row(df, aggs)
    types = {}
    for c in names:
        n = seen[c, "values"]
        if n and seen[c, "logical"] == n == seen["rows"]:
            types[c] = "boolean"
        elif seen[c, "whole"] == n == seen["rows"] and n:
            types[c] = "bigint"
        elif seen[c, "numbers"] == n:
            types[c] = "double"  # whole numbers with gaps, too
    return types


def torn_lines(spark: SparkSession, path: str, options: dict) -> int:
    """Number of lines that, read by themselves, end inside a quoted field.

    A quote opens a field only where the field begins; elsewhere, as in ``5" pipe``, it is a letter.
    In a file with a line break inside quotes the first such line ends there, so none means that every
    line is a record.
    """
    if not options["quote"]:
        return 0
    whole = whole_line(
        options["quote"], options["escape"], options.get("sep", options.get("delimiter", ",")),
        str(options.get("ignoreLeadingWhiteSpace", False)).lower() == "true")
    kept = {k: v for k, v in options.items() if k in ("lineSep", "pathGlobFilter", "recursiveFileLookup")}
    line = F.col("value")
    torn = F.contains(line, F.lit(options["quote"])) & ~line.rlike(whole)
    return spark.read.options(**kept).text(path).agg(F.count_if(torn)).first()[0]


def whole_line(quote: str, escape: str, sep: str, blanks: bool = False) -> str:
    """Pattern of the lines whose quoted fields all end. It never goes back, however long the line."""
    q, s = re.escape(quote), re.escape(sep)
    other = rf"(?!{s})[\s\S]"
    if escape and escape != quote:
        e = re.escape(escape)
        inside = rf"(?:(?!{q}|{e})[\s\S]|{e}[\s\S])*+"
    else:
        inside = rf"(?:(?!{q})[\s\S]|{q}{q})*+"
    lead = r"[ \t]*+" if blanks else ""
    # What follows a closing quote up to the separator belongs to the field.
    field = rf"(?:{lead}{q}{inside}{q}(?:{other})*+|(?!{lead}{q})(?:{other})*+)"
    return rf"\A{field}(?:{s}{field})*+\z"


def read_csv(
    spark: SparkSession,
    path: str,
    force_text_hints: Iterable[str] = vocab.IDENTIFIER_HINTS,
    na_tokens: Iterable[str] = vocab.CSV_NA_TOKENS,
    source_col: str | None = None,
    **options,
) -> DataFrame:
    """Read CSV files with a header; ``source_col`` adds the file that each row comes from.

    Everything is read as text; missing-value tokens become NULL; then the columns whose every
    value is a number or a logical word are cast. Names with an identifier hint (phone, zip, ...)
    stay text and keep their leading zeros. Spark's own inference is not used: it would turn date
    text into dates before the cleaning rules see it.

    Files are split at line breaks, so that a large one is read by many tasks. A line break inside
    quotes would tear a record apart: if there is one, reading fails with the advice to pass
    ``multiLine=True``, which reads such files whole. Quotes inside unquoted fields are letters.
    """
    given = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', **options}
    if str(given.get("multiLine", False)).lower() != "true":
        torn = torn_lines(spark, path, given)
        if torn:
            raise ValueError(f"{torn} lines of {path} end inside quotes: pass multiLine=True")
    raw = spark.read.options(**given).csv(path)
    tokens = tuple(na_tokens)
    values = [F.when(~col(c).isin(*tokens), col(c)).alias(c) for c in raw.columns]
    types = infer_types(raw.select(*values), force_text_hints)
    text = raw.select(*values, *[F.col(FILE).alias(c) for c in (source_col,) if c])
    return text.withColumns({c: strip(col(c)).try_cast(t) for c, t in types.items()}) if types else text
