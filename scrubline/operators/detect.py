"""Finding out what each text column holds.

A detector is a share of values that pass a test, plus tests of the column name. All shares of
all columns come from one aggregation over the table, so the number of jobs does not grow with
the number of columns; each task sends one row of counters.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.columns import col, has_hint, text_columns
from scrubline.functions import vocab
from scrubline.functions.dates import has_time_of_day, looks_like_date, parse_datetime
from scrubline.functions.numbers import has_currency_mark, parse_numeric
from scrubline.functions.text import strip
from scrubline.functions.words import is_boolean_word, study_year


def is_gender_name(name: str) -> bool:
    return "gender" in name.lower() or name.lower() == "sex"


# What each detector counts among the values of a column.
TESTS = {
    "numeric": lambda v, moment: F.count(parse_numeric(v)),
    "currency_code": lambda v, moment: F.count_if(F.lower(strip(v)).isin(*vocab.CURRENCY_CODES)),
    "currency_mark": lambda v, moment: F.count_if(has_currency_mark(v)),
    "date_look": lambda v, moment: F.count_if(looks_like_date(v)),
    "date": lambda v, moment: F.count(moment),
    "time": lambda v, moment: F.count_if(has_time_of_day(moment)),
    "boolean": lambda v, moment: F.count_if(is_boolean_word(v)),
    "study_year": lambda v, moment: F.count(study_year(v)),
    "at_sign": lambda v, moment: F.count_if(F.contains(v, F.lit("@"))),
}
# Columns that a detector leaves out because of their name.
NAME_RULES = {
    "numeric": lambda name: not has_hint(name, vocab.IDENTIFIER_HINTS),
    "boolean": lambda name: not is_gender_name(name),
    "study_year": lambda name: "year" in name.lower(),
}


def _eligible(kind: str, name: str) -> bool:
    return NAME_RULES.get(kind, lambda _: True)(name)


def text_values(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) rows of the given text columns.

    Aggregates over this form are written, compiled and run once whatever the number of columns;
    each task folds its rows to one per column before anything is exchanged.
    """
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in names
    ])))


class Shares:
    """Counts per (column, test), with ``share`` relative to the non-NULL values."""

    def __init__(self, df: DataFrame, kinds: list[str], cols: Iterable[str] | None = None):
        wanted = None if cols is None else set(cols)
        self.columns = [c for c in text_columns(df) if wanted is None or c in wanted]
        self.counts = {(c, "values"): 0 for c in self.columns}
        if not self.columns:
            return
        aggs = [F.count("value").alias("values")]
        for kind in kinds:
            names = [c for c in self.columns if _eligible(kind, c)]
            value = F.col("value")
            if len(names) < len(self.columns):
                value = F.when(F.col("column").isin(*names), value) if names else F.lit(None).cast("string")
            moment = F.when(value.isNotNull(), F.col("moment")) if kind in ("date", "time") else None
            aggs.append(TESTS[kind](value, moment).alias(kind))
        values = text_values(df, self.columns)
        if {"date", "time"} & set(kinds):
            names = [c for c in self.columns if any(_eligible(k, c) for k in ("date", "time") if k in kinds)]
            # Read once, in a projection of its own, for all the tests that need it.
            values = values.withColumn("moment", parse_datetime(F.when(F.col("column").isin(*names), F.col("value"))))
        counted = values.groupBy("column").agg(*aggs)
        for row in counted.collect():  # one row per column
            self.counts[row["column"], "values"] = row["values"]
            for kind in kinds:
                if _eligible(kind, row["column"]):
                    self.counts[row["column"], kind] = row[kind]

    def values(self, c: str) -> int:
        return self.counts[c, "values"]

    def count(self, c: str, kind: str) -> int:
        return self.counts.get((c, kind), 0)

    def share(self, c: str, kind: str) -> float:
        n = self.values(c)
        return self.count(c, kind) / n if n else 0.0

    # The rules, one per role.

    def numeric(self, min_parse_ratio: float = 0.7) -> list[str]:
        return [c for c in self.columns if (c, "numeric") in self.counts and self.values(c)
                and self.share(c, "numeric") >= min_parse_ratio]

    def multi_currency(self) -> list[str]:
        return [c for c in self.columns if self.count(c, "currency_mark")]

    def currency_pairs(self) -> list[tuple[str, str]]:
        codes = [c for c in self.columns if self.share(c, "currency_code") >= 0.9]
        return [
            (amount, code) for code in codes for amount in self.columns
            if amount != code and has_hint(amount, vocab.AMOUNT_HINTS)
        ]

    def dates(self, min_parse_ratio: float = 0.7) -> list[str]:
        found = []
        for c in self.columns:
            named = has_hint(c, vocab.DATE_HINTS)
            parsed = self.share(c, "date")
            if (named or self.share(c, "date_look") >= 0.5) and parsed >= 0.5 and (
                named or parsed >= min_parse_ratio
            ):
                found.append(c)
        return found

    def booleans(self) -> list[str]:
        return [c for c in self.columns if self.share(c, "boolean") >= 0.9]

    def genders(self) -> list[str]:
        return [c for c in self.columns if is_gender_name(c)]

    def study_years(self) -> list[str]:
        return [c for c in self.columns if self.share(c, "study_year") >= 0.5]

    def emails(self) -> list[str]:
        return [c for c in self.columns if "email" in c.lower() or self.share(c, "at_sign") >= 0.5]

    def gpas(self) -> list[str]:
        return [c for c in self.columns if has_hint(c, vocab.GPA_HINTS)]


def detect_numeric_text(df: DataFrame, min_parse_ratio: float = 0.7) -> list[str]:
    """Text columns of which at least the given share reads as quantities; identifiers never."""
    return Shares(df, ["numeric"]).numeric(min_parse_ratio)


def detect_multi_currency(df: DataFrame) -> list[str]:
    """Text columns in which any value carries a currency mark."""
    return Shares(df, ["currency_mark"]).multi_currency()


def detect_currency_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """(amount column, currency-code column) pairs among the text columns."""
    return Shares(df, ["currency_code"]).currency_pairs()


def detect_date_columns(df: DataFrame, min_parse_ratio: float = 0.7) -> list[str]:
    """Columns named or written like dates; the share parsed is taken over all values."""
    return Shares(df, ["date_look", "date"]).dates(min_parse_ratio)


def detect_boolean(df: DataFrame) -> list[str]:
    return Shares(df, ["boolean"]).booleans()


def detect_gender(df: DataFrame) -> list[str]:
    return [c for c in text_columns(df) if is_gender_name(c)]


def detect_year_of_study(df: DataFrame) -> list[str]:
    named = [c for c in text_columns(df) if "year" in c.lower()]
    return Shares(df, ["study_year"], named).study_years()


def detect_email(df: DataFrame) -> list[str]:
    return Shares(df, ["at_sign"]).emails()


def detect_gpa(df: DataFrame) -> list[str]:
    return [c for c in text_columns(df) if has_hint(c, vocab.GPA_HINTS)]


@dataclass
class TypeRoles:
    """Which treatment each column gets."""

    currency_pairs: list[tuple[str, str]] = field(default_factory=list)
    multi_currency: list[str] = field(default_factory=list)
    dates: dict[str, bool] = field(default_factory=dict)  # column -> carries a time of day
    booleans: list[str] = field(default_factory=list)
    genders: list[str] = field(default_factory=list)
    study_years: list[str] = field(default_factory=list)
    emails: list[str] = field(default_factory=list)
    gpas: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)


def detect_roles(df: DataFrame, convert_currency: bool = False) -> TypeRoles:
    """Give every text column its role from one scan; the first role in this order claims it:
    currency amount, date, boolean, gender, year of study, e-mail, grade points, quantity.
    """
    kinds = ["numeric", "date_look", "date", "time", "boolean", "study_year", "at_sign"]
    if convert_currency:
        kinds += ["currency_code", "currency_mark"]
    shares = Shares(df, kinds)
    roles = TypeRoles()
    claimed: set[str] = set()

    def claim(names: list[str]) -> list[str]:
        free = [c for c in names if c not in claimed]
        claimed.update(free)
        return free

    if convert_currency:
        for amount, code in shares.currency_pairs():
            if claim([amount]):  # the first currency column wins
                roles.currency_pairs.append((amount, code))
        roles.multi_currency = [c for c in shares.multi_currency() if c not in claimed]
    roles.dates = {c: shares.count(c, "time") > 0 for c in claim(shares.dates())}
    roles.booleans = claim(shares.booleans())
    roles.genders = claim(shares.genders())
    roles.study_years = claim(shares.study_years())
    roles.emails = claim(shares.emails())
    roles.gpas = claim(shares.gpas())
    roles.numeric = claim(shares.numeric())
    return roles


def detect_categorical(
    df: DataFrame,
    max_unique_ratio: float = 0.5,
    max_avg_length: int = 40,
    min_unique: int = 2,
    max_unique: int = 200,
) -> list[str]:
    """Text columns with a small vocabulary of short values (no e-mails, dates, gender, study year).

    A first scan rules out columns by length, ``@`` and an estimate of the vocabulary. Only
    columns whose vocabulary is small are then counted exactly, their values folded per task.
    """
    names = [
        c for c in text_columns(df)
        if not has_hint(c, vocab.NOT_CATEGORY_HINTS) and not is_gender_name(c)
    ]
    if not names:
        return []
    years = [c for c in names if _eligible("study_year", c)]
    value = F.col("value")
    year = study_year(F.when(F.col("column").isin(*years), value)) if years else F.lit(None)
    seen = {
        r["column"]: r for r in text_values(df, names).groupBy("column").agg(
            F.count(value).alias("n"),
            F.count_if(F.contains(value, F.lit("@"))).alias("at"),
            F.avg(F.length(value)).alias("length"),
            F.approx_count_distinct(value).alias("distinct"),
            F.count(year).alias("years"),
        ).collect()
    }

    def possible(r) -> bool:
        return (
            r["n"] > 0
            and r["at"] / r["n"] < 0.3
            and r["length"] <= max_avg_length
            and r["years"] / r["n"] < 0.5
            and r["distinct"] <= 1.5 * max_unique + 10
        )

    left = [c for c in names if c in seen and possible(seen[c])]
    if not left:
        return []
    vocabularies = text_values(df, left).where(value.isNotNull()).distinct()
    sizes = {r["column"]: r["count"] for r in vocabularies.groupBy("column").count().collect()}
    return [
        c for c in left
        if min_unique <= sizes[c] <= max_unique and sizes[c] / seen[c]["n"] <= max_unique_ratio
    ]
