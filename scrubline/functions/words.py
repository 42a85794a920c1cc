"""Small vocabularies: booleans, gender, year of study, e-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions import vocab
from scrubline.functions.text import strip

# ---- Fixed value: the form of a valid address ----------------------------------------------
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# ---- end of fixed values -------------------------------------------------------------------


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def parse_boolean(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*vocab.TRUE_WORDS), True).when(word.isin(*vocab.FALSE_WORDS), False)


def is_boolean_word(c: Column) -> Column:
    return F.lower(strip(c)).isin(*vocab.TRUE_WORDS, *vocab.FALSE_WORDS)


def standard_gender(c: Column) -> Column:
    return F.coalesce(lookup(vocab.GENDER_WORDS)[F.lower(strip(c))], c)


def study_year(c: Column) -> Column:
    """``1st Year`` .. ``4th Year``, or NULL when the value is no year of study."""
    plain = F.regexp_replace(F.lower(c), r"[.\-_]", "")
    plain = F.btrim(F.regexp_replace(plain, r"(?U)\s+", " "), F.lit(" "))
    year = F.lit(None).cast("string")
    for label, words in vocab.STUDY_YEAR_WORDS.items():
        starts = [F.startswith(F.lit(w), plain) for w in words]
        matched = starts[0]
        for other in starts[1:]:
            matched = matched | other
        year = F.coalesce(year, F.when((F.length(plain) >= 3) & matched, label))
    return F.coalesce(lookup(vocab.STUDY_YEAR_NAMES)[plain], year)


def standard_study_year(c: Column) -> Column:
    return F.coalesce(study_year(c), c)


def repaired_email(c: Column) -> Column:
    """Spaces dropped and doubled ``@`` collapsed; NULL when the result is no address."""
    fixed = F.regexp_replace(F.replace(strip(c), F.lit(" "), F.lit("")), "@@+", "@")
    return F.when(fixed.rlike(EMAIL), fixed)
