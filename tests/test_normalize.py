"""The normalised table that is stored once, and the counts gathered while it is written."""

from pyspark.sql import functions as F

import scrubline as sl
from scrubline import storage
from scrubline.operators.profile import profile_aggregates
from scrubline.operators.rules import fit_rules

SCHEMA = "name string, status string, `a.b` string, x double, n int"
ROWS = [
    (" Ann  Lee ", "pending", "N/A", 1.5, 1), ("nan", "Unknown", " - ", float("nan"), None),
    (None, None, None, None, 3), ("Bob", "open", "tba", 2.5, 4), ("Bob", "open", "tba", 2.5, 4),
]


def counted_reads(spark, df):
    """``df`` behind a step that counts the rows that go through it."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(watch, plain.schema).toDF(*df.columns), seen


def test_conversions_are_counted_while_the_table_is_written(spark):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    watched, seen = counted_reads(spark, raw)
    stored, conversions, more = sl.normalize_text(watched, also={("n", "max"): F.max("n")})
    assert seen.value == len(ROWS)
    expected = sl.standardize_missing(sl.trim_whitespace(raw))
    assert stored.schema == expected.schema
    assert sorted(map(str, stored.collect())) == sorted(map(str, expected.collect()))
    assert conversions.rows == 5
    assert conversions.made_missing == {"name": 1, "status": 1, "a.b": 4}
    assert conversions.squeezed == {"name": 1, "status": 0, "a.b": 0}
    assert more == {("n", "max"): 4}
    assert [tuple(r) for r in conversions.as_frame(spark).collect()] == [("name", 1, 1), ("status", 1, 0), ("a.b", 4, 0)]


def test_normalize_text_of_odd_tables(spark):
    empty, conversions, _ = sl.normalize_text(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and conversions.rows == 0 and conversions.made_missing["name"] == 0
    plain, conversions, _ = sl.normalize_text(spark.range(7))
    assert plain.count() == 7 and conversions.rows == 7 and conversions.made_missing == {}
    assert conversions.as_frame(spark).count() == 0
    untrimmed, conversions, _ = sl.normalize_text(spark.createDataFrame(ROWS, SCHEMA), trim=False)
    assert untrimmed.where("name = ' Ann  Lee '").count() == 1 and conversions.squeezed["name"] == 0


def test_clean_reads_its_source_three_times(spark):
    rows = [(f" P{i % 40} ", "yes" if i % 3 else "n/a", "open", float(i % 17), i) for i in range(400)]
    df, seen = counted_reads(spark, spark.createDataFrame(rows, SCHEMA))
    result = sl.clean(df, sl.CleaningConfig(numeric_fill="median"))
    assert result.df.count() == 400
    # The normalised table with the first figures of the profile, the outliers and the duplicates.
    assert seen.value == 3 * len(rows)
    assert result.conversions.made_missing["status"] == 134
    assert result.before.rows == 400
    direct = sl.profile_dataset(spark.createDataFrame(rows, SCHEMA))
    as_rows = lambda p: sorted(map(str, p.as_frame().collect()))
    assert as_rows(result.before) == as_rows(direct)
    result.release()


def test_first_figures_of_the_profile_with_missing_numbers(spark):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    df = raw.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    _, _, seen = sl.normalize_text(df, also=profile_aggregates(df))
    as_rows = lambda p: sorted(map(str, p.as_frame().collect()))
    assert as_rows(sl.profile_dataset(df, seen=seen)) == as_rows(sl.profile_dataset(raw))


def test_rules_are_the_same_whether_tables_are_stored_or_spread(spark, monkeypatch):
    rows = [(f" P{i % 40} ", "pending", str(i % 7), float(i % 17), i % 90) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    as_rows = lambda out: sorted(map(str, out.collect()))
    kept = as_rows(fit_rules(df, write=False)[0])
    assert as_rows(fit_rules(df)[0]) == kept
    monkeypatch.setattr(storage, "SPREAD_ROWS", 10)
    assert as_rows(fit_rules(df)[0]) == kept
