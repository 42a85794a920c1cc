"""Converting an amount column by a currency-code column of the same row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.columns import col
from scrubline.functions import vocab
from scrubline.functions.numbers import parse_numeric
from scrubline.functions.text import strip
from scrubline.operators.quantiles import grouped_quantiles
from scrubline.storage import write_table

MIN_GROUP = 10
FENCE = 1.5


@dataclass
class CurrencyFit:
    amount: str
    code: str
    fences: DataFrame  # code, low, high: one row per currency with enough values
    rates: dict[str, float]


def _code(c: Column) -> Column:
    """Currency key; rows without a code (NULL) form a group of their own."""
    return F.lower(strip(c))


def fit_currency(
    df: DataFrame, amount: str, code: str, rates: dict[str, float] = vocab.CODE_RATES
) -> CurrencyFit:
    """Tukey fences of the parsed amounts inside each currency that has ten values or more."""
    parsed = df.select(
        _code(col(code)).alias("code"), parse_numeric(col(amount).cast("string")).alias("amount")
    )
    q = grouped_quantiles(parsed, F.col("code"), F.col("amount"), [0.25, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    # Stored, as the fences are read again by every use of the converted column.
    fences = write_table(q.where(F.col("n") >= MIN_GROUP).select(
        F.col("key").alias("__code__"),
        (q1 - FENCE * (q3 - q1)).alias("__low__"),
        (q3 + FENCE * (q3 - q1)).alias("__high__"),
    ), "currency-fences")
    return CurrencyFit(amount, code, fences, rates)


def apply_currency(df: DataFrame, fit: CurrencyFit) -> DataFrame:
    """Clip inside the currency first, so that a bad amount is not blown up by the rate.

    The fences hold one row per currency. The join carries no hint: adaptive execution
    broadcasts them when they turn out small and splits hot currencies when they do not.
    """
    rates = F.create_map(*[F.lit(x) for pair in fit.rates.items() for x in pair])
    parsed = parse_numeric(col(fit.amount).cast("string"))
    joined = df.withColumns({"__key__": _code(col(fit.code)), fit.amount: parsed}).join(
        fit.fences, F.col("__key__").eqNullSafe(F.col("__code__")), "left"
    )
    value = col(fit.amount)
    clipped = F.when(
        value.isNotNull(), F.least(F.greatest(value, F.col("__low__")), F.col("__high__"))
    )
    rate = F.coalesce(rates[F.col("__key__")], F.lit(1.0))
    return joined.withColumn(fit.amount, clipped * rate).drop(
        "__key__", "__code__", "__low__", "__high__"
    )


def convert_currency_by_column(
    df: DataFrame,
    amount: str,
    currency: str,
    rates: dict[str, float] = vocab.CODE_RATES,
    target: str = "pkr",
) -> DataFrame:
    """Amounts in the target currency; unknown or missing codes count as the target itself.

    ``rates`` are the values of one unit of each currency on any common scale.
    """
    scale = rates.get(target.lower(), 1.0)
    scaled = {k: v / scale for k, v in rates.items()}
    return apply_currency(df, fit_currency(df, amount, currency, scaled))
