"""Column expressions on single values."""

import pytest

from scrubline.functions import categories as cat
from scrubline.functions import dates, numbers, text, words


def test_numbers(run):
    values = ["260,882/month", "50000 per year", "$1,191.00", "100 EUR", "£100", "Rs. 5,000",
              "Customer 1", "five", "-", "", None, " -7 ", "1.5.2", "12000 monthly"]
    assert run(numbers.parse_numeric, values) == [
        260882.0, 50000.0, 1191.0, 100.0, 100.0, 5000.0, None, 5.0, None, None, None, -7.0, None, 12000.0]


def test_conversion(run):
    values = ["$1,191.00", "100 EUR", "£100", "Rs. 5,000", "100 usd", "100usd"]
    # Without a word boundary "100usd" keeps its number and gets no rate.
    assert run(lambda c: numbers.parse_numeric(c, True), values) == [
        333480.0, 30500.0, 35500.0, 5000.0, 28000.0, 100.0]
    assert run(numbers.currency_rate, ["$5 eur", "5 eur", "£", "5", None]) == [280.0, 305.0, 355.0, None, None]


def test_gpa(run):
    got = run(numbers.parse_gpa, ["3.5", "90.2%", "-1.0", "5.5", "4", "abc", "NaN", "1e0", "inf", None])
    assert got[1] == pytest.approx(3.608)
    assert [got[0], *got[2:]] == [3.5, None, None, 4.0, None, None, 1.0, None, None]


def test_dates(run):
    cases = {
        "01/02/2023": "2023-01-02", "13/01/2023": "2023-01-13", "01-Jan-2023": "2023-01-01",
        "Jan 5, 2023": "2023-01-05", "20230105": "2023-01-05", "2023-1-5 10:30": "2023-01-05",
        "March 2023": "2023-03-01", "2023": "2023-01-01", "2023/13/01": None, "02-30-2023": None,
        "5": None, "123.45": None, "10:30": None, "2023-01-05T10:30:00Z": "2023-01-05",
        "1/5/23": "2023-01-05", "1/5/95": "1995-01-05", "5 September 2021": "2021-09-05",
        "not a date": None, "31.12.2020": "2020-12-31", "": None, None: None, "2023-5": "2023-05-01",
        "user12": None, "3-May-21": "2021-05-03",
    }
    assert run(lambda c: dates.date_text(c, False), list(cases)) == list(cases.values())


def test_times(run):
    values = ["2023-1-5 10:30", "01/02/2023 10:30 PM", "01/02/2023 12:05 am", "2023-01-05 25:00", "2023-01-05"]
    assert run(lambda c: dates.date_text(c, True), values) == [
        "2023-01-05 10:30:00", "2023-01-02 22:30:00", "2023-01-02 00:05:00", None, "2023-01-05 00:00:00"]


def test_unusual_dates(run):
    cases = {
        "2023-01-15T10:30:00+05:00": "2023-01-15 10:30:00", "2023-01-15 10:30:00+00:00": "2023-01-15 10:30:00",
        "2023-01-15 10:30:00.123-0800": "2023-01-15 10:30:00", "2023-01-15T10:30Z": "2023-01-15 10:30:00",
        "Mon, 15 Jan 2023": "2023-01-15 00:00:00", "Monday, January 16, 2023": "2023-01-16 00:00:00",
        "5th January 2023": "2023-01-05 00:00:00", "Jan 5th, 2023": "2023-01-05 00:00:00",
        "20230105T103000": "2023-01-05 10:30:00", "20230105T1030": "2023-01-05 10:30:00", "01/2023": "2023-01-01 00:00:00",
        "12:15 AM 01/02/2023": "2023-01-02 00:15:00", "10:05 pm, 01/02/2023": "2023-01-02 22:05:00",
        "5 Jan 2023 at 10:30": "2023-01-05 10:30:00", "2023-01-15 10": "2023-01-15 10:00:00",
        "Sunday": None, "meet at 10:30": None, "10:30": None, "21st": None, "Monday at noon": None, "13/2023": None,
    }
    assert run(lambda c: dates.date_text(c, True), list(cases)) == list(cases.values())


def test_title_case_is_after_every_non_letter(run):
    values = ["o'neil", "3rd", "drop-out", "hello  WORLD", "élan vital", "a1b", "", None, "x"]
    assert run(text.title_case, values) == [v.title() if v is not None else None for v in values]


def test_whitespace(run):
    assert run(text.trimmed, ["  a \t b  c ", "nan", " nan ", "", None]) == ["a b c", None, None, "", None]


def test_study_year(run):
    values = ["4th Year", "Fresh.", "Soph.", "Sr.", "Jr.", "Freshman", "fr", "Unknown", "2nd  year", None]
    assert run(words.study_year, values) == [
        "4th Year", "1st Year", "2nd Year", "4th Year", "3rd Year", "1st Year", None, None, "2nd Year", None]
    assert run(words.standard_study_year, ["Unknown", "jun"]) == ["Unknown", "3rd Year"]


def test_small_vocabularies(run):
    assert run(words.standard_gender, ["F", "Female", "M", "MALE", "nonbinary", "x", None]) == [
        "Female", "Female", "Male", "Male", "Other", "x", None]
    assert run(words.parse_boolean, [" Yes", "0", "t", "maybe", None]) == [True, False, True, None, None]
    assert run(words.repaired_email, ["a@@b.com", "a b@c.d", "a@b", "a", None]) == [
        "a@b.com", "ab@c.d", None, None, None]


def test_stems(run):
    pairs = [("Bba", "Business Administration"), ("Cs", "Computer Science"), ("Elec. Engg", "Electrical Engineering"),
             ("Ib", "Internet Banking"), ("Atm W/D", "Atm Withdrawal"), ("Bill Pmt", "Bill Payment"),
             ("Ops", "Operations"), ("Human Resource", "Human Resources"), ("HR", "Human Resources"),
             ("Sales", "sale"), ("Cust. Support", "Customer Support"), ("Boxes", "Box"), ("Groceries", "grocery"),
             ("Home & Kitchen", "home and kitchen"), ("Drop-Out", "drop out")]
    assert run(cat.expand_and_stem, [a for a, _ in pairs]) == run(cat.expand_and_stem, [b for _, b in pairs])
    assert run(cat.expand_and_stem, ["class", "watches", "MobileApp", "活动"]) == ["class", "watch", "mobileapp", ""]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio_matches_definition(frame):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    pairs = [("active", "inactive"), ("dropped out", "drop out"), ("", ""), ("", "a"), ("abc", "abc")]
    pairs += [("".join(rnd.choices("abc ", k=rnd.randint(1, 12))), "".join(rnd.choices("abc ", k=rnd.randint(1, 12))))
              for _ in range(150)]
    df = frame(pairs, "a string, b string").select(
        "a", "b", cat.indel_ratio(F.col("a"), F.col("b")).alias("r"),
        cat.ratio_at_least(F.col("a"), F.col("b"), 85).alias("ok"))
    for r in df.collect():
        total = len(r["a"]) + len(r["b"])
        want = 200.0 * lcs(r["a"], r["b"]) / total if total else 100.0
        assert r["r"] == pytest.approx(want)
        assert r["ok"] == (want >= 85)


def test_pair_rules(frame):
    from pyspark.sql import functions as F

    rows = [("active", "inactive"), ("cloth", "clothing"), ("an", "analysis"), ("bus admin", "business administration"),
            ("a bc", "a bcd"), ("street", "street road")]
    a, b = F.col("a"), F.col("b")
    got = {(r[0], r[1]): tuple(r)[2:] for r in frame(rows, "a string, b string").select(
        a, b, cat.is_negation_pair(a, b), cat.is_prefix_variant(a, b), cat.is_token_prefix_variant(a, b)).collect()}
    assert list(got.values()) == [
        (True, False, False), (False, True, False), (False, False, False), (False, False, True),
        (False, True, False), (False, True, False)]
