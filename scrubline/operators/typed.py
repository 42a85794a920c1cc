"""Cleaning text columns into the type they hold, and bounds on what a quantity can be."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from scrubline.columns import agg_row, col, has_hint, numeric_columns, present
from scrubline.functions import vocab
from scrubline.functions.dates import date_text, has_time_of_day, parse_datetime
from scrubline.functions.numbers import parse_gpa, parse_numeric
from scrubline.functions.words import (
    parse_boolean, repaired_email, standard_gender, standard_study_year,
)
from scrubline.operators import detect
from scrubline.operators.currency import CurrencyFit, apply_currency, fit_currency
from scrubline.operators.text import (
    detect_name_columns, normalize_text, standardize_category_casing, standardize_name_casing,
)
from scrubline.storage import spread


def _mapped(df: DataFrame, cols: Iterable[str], change) -> DataFrame:
    return df.withColumns({c: change(col(c)) for c in present(df, cols)})


def clean_numeric_text(
    df: DataFrame, cols: Iterable[str] | None = None, convert_currency: bool = False
) -> DataFrame:
    cols = detect.detect_numeric_text(df) if cols is None else cols
    return _mapped(df, cols, lambda c: parse_numeric(c, convert_currency))


def standardize_dates_auto(
    df: DataFrame, cols: Iterable[str] | None = None, as_type: str = "text"
) -> DataFrame:
    """Mixed formats to one: with the time of day if any value of the column has one.

    ``as_type="timestamp"`` keeps the parsed moment instead of text.
    """
    cols = present(df, detect.detect_date_columns(df) if cols is None else cols)
    if as_type == "timestamp":
        return _mapped(df, cols, parse_datetime)
    if not cols:
        return df
    timed = agg_row(df, {c: F.count_if(has_time_of_day(parse_datetime(col(c)))) for c in cols})
    return df.withColumns({c: date_text(col(c), timed[c] > 0) for c in cols})


def standardize_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The given columns as ``yyyy-MM-dd`` text; anything else becomes NULL."""
    return df.withColumns({c: date_text(col(c).cast("string"), False) for c in present(df, cols)})


TYPE_NAMES = {
    "int": "bigint", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint",
    "float": "double", "float64": "double", "float32": "float", "str": "string", "object": "string",
    "category": "string", "bool": "boolean", "boolean": "boolean", "datetime": "timestamp_ntz",
    "datetime64": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz", "datetime64[us]": "timestamp_ntz",
}


def fit_casts(df: DataFrame, type_map: dict[str, str]) -> dict[str, str]:
    """The casts that all values of their column survive; the others are warned about.

    Besides Spark's names of types those of TYPE_NAMES are known, in any case.
    """
    wanted = {}
    for c, t in type_map.items():
        name = TYPE_NAMES.get(t.lower(), t)
        try:
            DataType.fromDDL(name)
        except ParseException:
            warnings.warn(f"column {c!r} stays as it is: {t!r} is not a type", stacklevel=2)
            continue
        if c in df.columns:
            wanted[c] = name
    bad = agg_row(df, {
        c: F.count_if(col(c).isNotNull() & col(c).try_cast(t).isNull()) for c, t in wanted.items()
    }) if wanted else {}
    for c in wanted:
        if bad[c]:
            warnings.warn(f"column {c!r} stays as it is: {bad[c]} values are no {wanted[c]}", stacklevel=2)
    return {c: t for c, t in wanted.items() if not bad[c]}


def apply_casts(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Apply fitted casts to the columns that are there; values that do not fit become NULL."""
    return df.withColumns({c: col(c).try_cast(t) for c, t in casts.items() if c in df.columns})


def cast_columns(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """Force types; a column with any value that does not fit, or an unknown type, is left as it is."""
    return apply_casts(df, fit_casts(df, type_map))


def standardize_boolean(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return _mapped(df, detect.detect_boolean(df) if cols is None else cols, parse_boolean)


def standardize_gender(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return _mapped(df, detect.detect_gender(df) if cols is None else cols, standard_gender)


def standardize_year_of_study(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    cols = detect.detect_year_of_study(df) if cols is None else cols
    return _mapped(df, cols, standard_study_year)


def clean_email(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return _mapped(df, detect.detect_email(df) if cols is None else cols, repaired_email)


def standardize_gpa(
    df: DataFrame, cols: Iterable[str] | None = None, scale_max: float = 4.0
) -> DataFrame:
    cols = detect.detect_gpa(df) if cols is None else cols
    return _mapped(df, cols, lambda c: parse_gpa(c, scale_max))


def _impossible(name: str, c: Column, age_above: int, age_max: int) -> Column | None:
    """The first bound whose name test fits the column."""
    lowered = name.lower()
    if lowered == "age" or lowered.endswith("_age"):
        return (c <= age_above) | (c > age_max)
    if has_hint(name, vocab.PERCENT_HINTS):
        return (c < 0) | (c > 100)
    if has_hint(name, vocab.POSITIVE_HINTS):
        return c <= 0
    if has_hint(name, vocab.NON_NEGATIVE_HINTS):
        return c < 0
    return None


def enforce_domain_bounds(df: DataFrame, age_max: int = 120) -> DataFrame:
    """Impossible quantities become NULL: ages, percentages, pay and prices out of bounds.

    Tables about students (by their column names) take 14 as the age to be exceeded, not 0.
    """
    students = any(has_hint(c, vocab.STUDENT_HINTS) for c in df.columns)
    changed = {}
    for name in numeric_columns(df):
        bad = _impossible(name, col(name), 14 if students else 0, age_max)
        if bad is not None:
            changed[name] = F.when(~bad, col(name))
    return df.withColumns(changed) if changed else df


@dataclass
class TypeFit:
    """Everything learned from the data that type cleaning needs to be repeated."""

    roles: detect.TypeRoles
    currency: list[CurrencyFit] = field(default_factory=list)
    convert_currency: bool = False
    categories: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    @property
    def protected(self) -> list[str]:
        """Columns whose converted amounts must not be capped."""
        return [amount for amount, _ in self.roles.currency_pairs] + self.roles.multi_currency


def apply_types(df: DataFrame, fit: TypeFit) -> DataFrame:
    """One projection over all typed columns, then the bounds (after ``standardize_missing``)."""
    roles = fit.roles
    for part in fit.currency:
        df = apply_currency(df, part)
    changes = {c: date_text(col(c), timed) for c, timed in roles.dates.items()}
    for names, change in (
        (roles.booleans, parse_boolean),
        (roles.genders, standard_gender),
        (roles.study_years, standard_study_year),
        (roles.emails, repaired_email),
        (roles.gpas, parse_gpa),
        (roles.numeric, lambda c: parse_numeric(c, fit.convert_currency)),
    ):
        changes.update({c: change(col(c)) for c in names})
    return enforce_domain_bounds(df.withColumns(changes) if changes else df)


def fit_types(df: DataFrame, convert_currency: bool = False) -> TypeFit:
    """Learn the roles of ``df``, whose missing-value words are NULL already."""
    roles = detect.detect_roles(df, convert_currency)
    fit = TypeFit(roles, convert_currency=convert_currency)
    fit.currency = [fit_currency(df, amount, code) for amount, code in roles.currency_pairs]
    typed = apply_types(df, fit)
    fit.categories = detect.detect_categorical(typed)
    fit.names = detect_name_columns(typed)
    return fit


def apply_casing(df: DataFrame, fit: TypeFit) -> DataFrame:
    return standardize_name_casing(standardize_category_casing(df, fit.categories), fit.names)


def run_type_cleaning(df: DataFrame, convert_currency: bool = False) -> tuple[DataFrame, list[str]]:
    """Placeholders, typed columns, bounds and casing; also the columns to protect from capping.

    The table without placeholders is stored, as the detectors read it several times.
    """
    df, conversions, _ = normalize_text(df, trim=False)
    df = spread(df, conversions.rows)
    fit = fit_types(df, convert_currency)
    return apply_casing(apply_types(df, fit), fit), fit.protected
