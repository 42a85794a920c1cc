"""Column expressions for text: whitespace, casing, missing-value words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions import vocab


# Unicode white space, by code point.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
)))


def squeeze_spaces(c: Column) -> Column:
    """Collapse every run of (Unicode) whitespace to one space and strip both ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def trimmed(c: Column) -> Column:
    """Squeezed text, with the literal word ``nan`` read as missing."""
    return F.nullif(squeeze_spaces(c), F.lit("nan"))


def placeholder_words(column_name: str) -> tuple[str, ...]:
    words = vocab.PLACEHOLDERS
    return words if "status" in column_name.lower() else words + vocab.CONTEXT_PLACEHOLDERS


def missing_as_null(c: Column, words: tuple[str, ...]) -> Column:
    return F.when(~F.lower(strip(c)).isin(*words), c)


def title_case(c: Column) -> Column:
    """A capital after every non-letter, everything else lower case (``o'neil`` -> ``O'Neil``).

    ``initcap`` does the same for plain letters and spaces and is much cheaper, so it takes those.
    """
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])")
    capital = F.transform(
        pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
    )
    return F.when(c.rlike("^[A-Za-z ]*$"), F.initcap(c)).otherwise(F.array_join(capital, ""))
