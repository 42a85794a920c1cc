"""Reading dates written in mixed formats, month first, without throwing on bad text.

A value is rewritten step by step into the ISO form that Spark's own ``try_cast`` reads. Every
step uses the previous one exactly once, so the expression stays small, is evaluated once per
value and remains inside generated code; no parser object, time zone or exception is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.text import squeeze_spaces

# ---- Fixed value: the look of a date with separators ---------------------------------------
DATE_LOOK = r"^\s*\d{1,4}\s*[-/]\s*[A-Za-z0-9]{1,9}\s*[-/]\s*\d{1,4}\s*$"
# ---- end of fixed values -------------------------------------------------------------------

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (
    r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\b\.?"
)
# The common case, three numbers, is rewritten in fewer steps than the rest.
THREE_NUMBERS = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
# What any readable date starts with; everything else is turned away by this one test.
# A plain number with a fraction is none.
START = r"(?i)^(?!\s*[\d,]+\.\d+\s*$)\s*(?:\d{1,4}\s*[-/.,\sT]|\d{4}\s*$|\d{8}\s*(?:$|[T ])|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b)"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2})?)?$"
# At the end, or behind a time that comes first.
AFTERNOON = r"(?i)\d ?pm\s*$|^\s*\d{1,2}:\d{2}(?::\d{2})? ?pm\b"
CLOCK = r"[t ](\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?(?: ?([ap]m))?z?$"
_YEAR, _SHORT_YEAR, _MONTH, _DAY = r"(\d{4})", r"(\d{2})", r"(0?[1-9]|1[0-2])", r"(\d{1,2})"
_NAMED = r"m(\d{1,2})"

# Shapes of a date whose separators are "-" (or, between digits, "."), whose month names are "m1"
# .. "m12" and whose time, if any, follows an "@"; with what each group is. The first match counts:
# month before day, day before month only where the first number can not be a month.
SHAPES = (
    (rf"{_YEAR}[-/.]{_DAY}[-/.]{_DAY}", "ymd"),
    (rf"{_YEAR}(\d\d)(\d\d)", "ymd"),
    (rf"{_YEAR}-{_NAMED}-{_DAY}", "ymd"),
    (rf"{_DAY}-{_NAMED}-{_YEAR}", "dmy"),
    (rf"{_DAY}-{_NAMED}-{_SHORT_YEAR}", "dmy"),
    (rf"{_NAMED}-{_DAY}-{_YEAR}", "mdy"),
    (rf"{_NAMED}-{_YEAR}", "my"),
    (rf"{_MONTH}[-/.]{_DAY}[-/.]{_YEAR}", "mdy"),
    (rf"{_DAY}[-/.]{_MONTH}[-/.]{_YEAR}", "dmy"),
    (rf"{_MONTH}[-/.]{_DAY}[-/.]{_SHORT_YEAR}", "mdy"),
    (rf"{_DAY}[-/.]{_MONTH}[-/.]{_SHORT_YEAR}", "dmy"),
    (rf"{_YEAR}-{_DAY}", "ym"),
    (_YEAR, "y"),
)


# Forms that are first rewritten into one of the shapes; everything else skips that.
UNUSUAL = (
    r"(?i)^\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\b|\d(?:st|nd|rd|th)\b|:\d{2}(?:\.\d+)?\s*(?:z|utc|gmt|[+-]\d{2}:?(?:\d{2})?)\s*$"
    r"|^\s*\d{8}T\d{4}|^\s*(?:0?[1-9]|1[0-2])[-/]\d{4}\s*$|^\s*\d{1,2}:\d{2}|\sat\s|^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}\s*$"
)
REWRITES = (
    (r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b[.,]?\s*", ""),  # weekday
    (r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b,?", "$1"),
    (r"(?i)\s+at\s+", " "),
    (r"(?i)(:\d{2}(?:\.\d+)?)\s*(?:z|utc|gmt|[+-]\d{2}:?(?:\d{2})?)\s*$", "$1"),  # offset: the clock stays
    (r"(?i)^\s*(\d{8})T(\d{2})(\d{2})(\d{2})?$", "$1 $2:$3:0$4"),
    (r":0(\d{2})$", ":$1"),
    (r":0$", ":00"),
    (r"^\s*(0?[1-9]|1[0-2])[-/](\d{4})\s*$", "$2-$1"),
    (r"(?i)^\s*(\d{1,2}:\d{2}(?::\d{2})?(?: ?[ap]m)?)[\s,]+(\S.*)$", "$2 $1"),  # time first
    (r"^\s*(\d{4}-\d{1,2}-\d{1,2})[ T](\d{1,2})\s*$", "$1 $2:00"),
)


def _one_pattern() -> tuple[str, str]:
    """All shapes as alternatives of one pattern. Groups of the shapes that did not match are
    empty, so writing all year groups, all month groups and all day groups gives y-m-d.
    """
    groups: dict[str, list[int]] = {"y": [], "m": [], "d": []}
    for part in "".join(parts for _, parts in SHAPES):
        groups[part].append(sum(map(len, groups.values())) + 1)
    ordered = ["".join(f"${g}" for g in groups[part]) for part in "ymd"]
    return "^(?:" + "|".join(shape for shape, _ in SHAPES) + ")(?=@|$)", "-".join(ordered)


def _year_first(text: Column) -> Column:
    text = F.regexp_replace(text, *_one_pattern())
    text = F.regexp_replace(text, r"^([0-5]\d|6[0-8])-", "20$1-")
    return F.regexp_replace(text, r"^(\d\d)-", "19$1-")


def _iso_text(c: Column) -> Column:
    # Unusual forms are rewritten first; weekdays and the like never look like a month.
    text = F.when(c.rlike(UNUSUAL), _rewritten(c)).otherwise(c)
    text = F.lower(squeeze_spaces(text))
    name = F.regexp_extract(F.lower(c), MONTH_NAME, 1)
    number = (F.instr(F.lit(MONTHS), name) + 2) / 3
    text = F.when(
        c.rlike("[A-Za-z]{3}"),
        F.regexp_replace(text, F.lit(MONTH_NAME), F.concat(F.lit("m"), number.cast("int").cast("string"))),
    ).otherwise(text)
    # 12 am / 12 pm count from zero; the afternoon is added after the cast.
    text = F.regexp_replace(text, r"([t ])12(:\d{2}(?::\d{2})?) ?([ap]m)$", "$10$2$3")
    text = F.regexp_replace(text, CLOCK, "@$1$2")
    text = F.regexp_replace(text, r"[\s,/-]+", "-")
    text = _year_first(text)
    text = F.regexp_replace(text, r"-(?=[-@]|$)", "-1")  # absent month or day
    text = F.regexp_replace(text, r"@((?:0?\d|1[01]):.*)[ap]m$", "@$1")
    return F.replace(text, F.lit("@"), F.lit(" "))


def _rewritten(c: Column) -> Column:
    for pattern, to in REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return c


def parse_datetime(c: Column) -> Column:
    """The moment written in ``c`` (``timestamp_ntz``), NULL when unreadable.

    With an offset from UTC the moment is what the clock showed: the offset is left out.
    """
    iso = F.regexp_extract(_iso_text(c), ISO, 0)  # empty, hence NULL, for any other text
    moment = F.when(c.rlike(f"{START}|{UNUSUAL}") & c.rlike(r"\d{2}"), iso.try_cast("timestamp_ntz"))
    afternoon = F.when(c.rlike(AFTERNOON), F.expr("interval 12 hours"))
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("timestamp_ntz"))
        .when(c.rlike(THREE_NUMBERS), F.regexp_extract(_year_first(c), ISO, 0).try_cast("timestamp_ntz"))
        .otherwise(moment + F.coalesce(afternoon, F.expr("interval 0 hours")))
    )


def parse_date(c: Column) -> Column:
    return parse_datetime(c).cast("date")


def has_time_of_day(moment: Column) -> Column:
    return ~F.endswith(moment.cast("string"), F.lit("00:00:00"))


def looks_like_date(c: Column) -> Column:
    return c.rlike(DATE_LOOK)


def date_text(c: Column, with_time: bool) -> Column:
    """Canonical text: ``yyyy-MM-dd``, or ``yyyy-MM-dd HH:mm:ss`` for columns that carry times."""
    # Casts of timestamp_ntz use no time zone, unlike date_format.
    moment = parse_datetime(c)
    return moment.cast("string") if with_time else moment.cast("date").cast("string")
