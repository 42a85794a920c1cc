"""Reading quantities out of text: amounts, currency marks, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions import vocab
from scrubline.functions.text import strip

# ---- Fixed values: what counts as a number, a payment period and a currency mark -----------
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
PERIOD = (
    r"/\s*(?:month|mo|year|yr|annum|week|wk|day)\b"
    r"|\bper\s+(?:month|year|week|day|annum)\b"
    r"|\b(?:monthly|yearly|annually|weekly|daily)\b"
)
CURRENCY_NOISE = r"rs\.?|pkr|usd|inr|eur|gbp|[$€£,]|(?U:\s)"
MARKS = {"usd": r"\$|\busd\b", "eur": r"€|\beur\b", "gbp": r"£|\bgbp\b"}
# ---- end of fixed values -------------------------------------------------------------------

# Text with any of these can not be a quantity: a word longer than all that may stand beside a
# number, or a character that is neither removed nor part of a number. One pass, left at the first hit.
NO_QUANTITY = r"(?U)[A-Za-z]{9}|[^0-9A-Za-z\s$€£,./-]"
FLOAT_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def word_number(c: Column) -> Column:
    pairs = [F.lit(x) for i, w in enumerate(vocab.NUMBER_WORDS) for x in (w, float(i))]
    return F.create_map(*pairs)[c]


def currency_rate(c: Column, rates: dict[str, float] = vocab.MARKER_RATES) -> Column:
    """Exchange rate of the first currency mark found (dollar, then euro, then pound), else NULL."""
    lowered = F.lower(c)
    return F.coalesce(*[
        F.when(lowered.rlike(pattern), F.lit(rates[code])) for code, pattern in MARKS.items()
    ])


def has_currency_mark(c: Column) -> Column:
    return F.lower(c).rlike("|".join(MARKS.values()))


def parse_numeric(
    c: Column, convert_currency: bool = False, rates: dict[str, float] = vocab.MARKER_RATES
) -> Column:
    """The quantity written in ``c`` as double; NULL when any other text is left over."""
    text = F.lower(strip(c))
    # Every payment period has one of these letters; most amounts have none.
    amount_text = F.when(c.rlike("[mwyMWY]"), F.regexp_replace(text, PERIOD, "")).otherwise(text)
    digits = F.regexp_replace(amount_text, CURRENCY_NOISE, "")
    amount = F.regexp_extract(digits, PLAIN_NUMBER, 0).try_cast("double")  # "" is NULL
    if convert_currency:
        amount = amount * F.coalesce(currency_rate(amount_text, rates), F.lit(1.0))
    # Bare numbers, and text that can not be a number, skip the pattern work.
    return (
        F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))
        .when(c.rlike(r"\d") & ~c.rlike(NO_QUANTITY), amount)
        .otherwise(word_number(text))
    )


def float_text(c: Column) -> Column:
    """Strict decimal or exponent notation only (Spark's own cast also takes ``5d`` and ``NaN``)."""
    value = F.when(c.rlike(FLOAT_TEXT), c.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_gpa(c: Column, scale_max: float = 4.0) -> Column:
    """Grade points; ``90.2%`` is rescaled to ``scale_max``; outside [0, scale_max] is NULL."""
    text = F.lower(strip(c))
    bare = F.regexp_replace(text, r"(?U)[,\s]|%+$", "")
    value = F.when(text.endswith("%"), float_text(bare) / 100.0 * scale_max).otherwise(float_text(bare))
    return F.when(value.between(0.0, scale_max), value)
