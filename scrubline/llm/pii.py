"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits of ``number`` pass the Luhn check."""
    digits = F.filter(F.split(F.reverse(digits_of(number)), ""), lambda d: d != "")
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9))),
        F.lit(0), lambda a, b: a + b,
    )
    return (F.size(digits) > 0) & (total % 10 == 0)


def mod_97(account: Column) -> Column:
    """True if an account number (country, check digits, account) leaves 1 when divided by 97."""
    bare = F.upper(F.regexp_replace(account, "[ -]", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55  # A is 10
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(
            (rest * 100 + letter) % 97
        )

    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c)
    ) == 1


def small_parts(address: Column) -> Column:
    """True if each dotted part is at most 255; leading zeros count for nothing."""
    return F.forall(F.split(address, r"\."), lambda part: (
        (F.length(F.ltrim(part, F.lit("0"))) <= 3)
        & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    ))


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda text: F.length(digits_of(text)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` proposes spans, without backtracking over long runs; it is tried on texts that
    ``hint`` matches. ``confirm`` decides. ``weight`` is the score of a confirmed span, to which
    ``bonus`` is added if one of the words of ``context`` stands within the window before it. If
    ``ahead``, the pattern takes one character and captures the span from there on, so that a proposal
    that fails hides no later one; of confirmed spans that overlap the first is kept.
    """

    name: str
    hint: str
    pattern: str
    confirm: Callable[[Column], Column]
    weight: float
    context: str
    bonus: float = 0.2
    ahead: bool = False


#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """The country's length if it fits, whatever follows after a blank; else in one piece, else all
    that follows, else in groups of four.
    """
    fixed = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}+{{end}}" for n, codes in IBAN_LENGTHS.items()]
    head = "[A-Z]{2}[0-9]{2}"
    others = [head + "[A-Z0-9]{11,30}+{end}", head + "(?:[ -]?[A-Z0-9]){11,30}+{end}",
              head + "(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?{end}"]
    forms = "|".join([*fixed, *others]).replace("{end}", "(?![A-Za-z0-9])")
    return f"(?<![A-Za-z0-9])(?={head})(?=({forms}))[A-Z]"


# A proposal starts where its run of characters starts or where the previous proposal ended: from
# within a run the plain pattern can only succeed if it does from the start. The quantifiers are
# possessive because what follows them can not begin with what they take. So no text, however
# long, is scanned more than a few times. A card is a whole chain of digits with single
# separators; chains of other lengths fail as a whole.
KINDS = (
    Kind("email", "@",
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.8, r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b"),
    Kind("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", small_parts, 0.6,
         r"(?i)\b(?:ip|address|host|server|login|from)\b"),
    Kind("card", "",
         r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", luhn, 0.8,
         r"(?i)\b(?:card|credit|debit|visa|mastercard|payment|cvv)\b"),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", digit_count(9, 15), 0.7,
         r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell)\b"),
    Kind("iban", "",
         iban_pattern(), mod_97, 0.9,
         r"(?i)\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b", ahead=True),
)
BASE = ("email", "ip", "card", "phone")


def proposals(text: Column, kind: Kind) -> Column:
    """Array of (start, end, match), code points, end exclusive, of a kind's proposals.

    Splitting by the pattern gives the texts between the matches, whose lengths place them.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), 1 if kind.ahead else 0)
    gaps = F.split(text, kind.pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,end:int,match:string>>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + (F.lit(1) if kind.ahead else F.length(x["m"]))).alias("at"),
            F.concat(acc["found"], F.array(F.struct(
                (acc["at"] + F.length(x["g"])).alias("start"),
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                x["m"].alias("match"),
            ))).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    likely = F.lit(True) if not kind.hint else F.contains(text, F.lit(kind.hint))
    return F.when(likely, placed).otherwise(
        F.array().cast("array<struct<start:int,end:int,match:string>>")
    )


def spans_of(text: Column, kind: Kind, window: int = 40) -> Column:
    """Array of (kind, start, end, score) of the confirmed proposals, by start.

    The score is the kind's weight, plus its bonus if a context word lies in the ``window``
    characters before the span.
    """
    kept = F.filter(proposals(text, kind), lambda s: kind.confirm(s["match"]))
    if kind.ahead:
        kept = F.aggregate(
            kept, F.array().cast("array<struct<start:int,end:int,match:string>>"),
            lambda acc, s: F.when(
                (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= s["start"]), F.concat(acc, F.array(s))
            ).otherwise(acc))
    return F.transform(kept, lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        (F.lit(kind.weight) + F.when(
            F.substring(text, F.greatest(s["start"] - window, F.lit(0)) + 1,
                        F.least(s["start"], F.lit(window))).rlike(kind.context),
            kind.bonus,
        ).otherwise(0.0)).alias("score"),
    ))


def find_pii(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with ``pii_<kind>``, an array of (kind, start, end, score), for every kind.

    Whole texts are searched; a null or empty text has empty arrays. Equal rows give equal results,
    other columns stay (those named ``pii_<kind>`` are replaced). Account numbers (``iban``) overlap
    no span of the other kinds that was found first. Column expressions only, no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumns({f"pii_{k.name}": spans_of(body, k) for k in kinds})
    names = [k.name for k in kinds]
    if "iban" in names and len(names) > 1:
        others = F.concat(*[F.col(f"pii_{n}") for n in names if n != "iban"])
        found = found.withColumn("pii_iban", F.filter("pii_iban", lambda s: ~F.exists(
            others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))
    return found


def span_list(*arrays: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(F.concat(*arrays), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
