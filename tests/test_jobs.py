"""Sources, mapping and the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import scrubline as sl
from scrubline.columns import OUTLIER_FLAG
from scrubline.operators.mapping import numbered_values
from scrubline.sources.tables import JdbcPartitioning, jdbc_options
from scrubline.storage import new_path

def write_text(spark, lines):
    path = new_path(spark, "test-csv")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_csv_types(spark):
    path = write_text(spark, [
        "id,phone,price,gap,flag,day,empty,odd",
        "1,0300,1.5,1,True,2023-01-01,,5d",
        '2,0301,"2",NA,False,N/A,null,7',
    ])
    df = sl.read_csv(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "phone": "string", "price": "double", "gap": "double", "flag": "boolean",
        "day": "string", "empty": "double", "odd": "string"}
    assert tuple(df.where("id = 2").first()) == (2, "0301", 2.0, None, False, None, None, "7")


def test_load_dispatch(spark):
    with pytest.raises(ValueError):
        sl.load(spark, "telepathy", path="x")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x")
    assert jdbc_options("jdbc:x", table="t", query="select 1")["query"] == "select 1"
    ranged = jdbc_options("jdbc:x", query="select 1", partition=JdbcPartitioning("id", 0, 100, 4))
    assert ranged["dbtable"] == "(select 1) AS source_query" and ranged["numPartitions"] == "4"
    assert "query" not in ranged


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2.5, 2)], "extra double, id int")
    out = sl.union_with_source({"a": a, "b": b}).orderBy("id").collect()
    assert [(r["id"], r["s"], r["extra"], r["__source_sheet__"]) for r in out] == [
        (1, "x", None, "a"), (2, None, 2.5, "b")]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_written_table_reads_back(spark, fmt):
    df = spark.createDataFrame([(" a \"q\", b ", 1), (None, 2)], "s string, n int")
    path = new_path(spark, "test-sink")
    sl.write_clean(df, path, fmt)
    back = spark.read.csv(path, header=True, escape='"') if fmt == "csv" else spark.read.parquet(path)
    assert {r["s"] for r in back.collect()} == {" a \"q\", b ", None}
    with pytest.raises(ValueError):
        sl.write_clean(df, path, "xlsx")


def test_positions_are_dense_and_sorted(spark):
    df = spark.range(500).select(F.format_string("v%05d", "id").alias("v")).repartition(7)
    got = [(r["value"], r["position"]) for r in numbered_values(df, "v").orderBy("position").collect()]
    assert got == [(f"v{i:05d}", i) for i in range(500)]
    batches = sl.distinct_value_batches(df, "v", 50).collect()
    assert sorted(r["batch"] for r in batches) == list(range(10))
    assert {len(r["values"]) for r in batches} == {50}


def test_mapper_status(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")

    def failing(column, values):
        raise RuntimeError("down")

    def partly(column, values):
        if "a" in values:
            raise RuntimeError("down")
        return {v: v.upper() for v in values}

    assert sl.standardize_with_mapper(df, "s", None)[1].startswith("skipped")
    assert sl.standardize_with_mapper(df, "absent", failing)[1].startswith("skipped")
    assert sl.standardize_with_mapper(df, "s", failing)[1].startswith("failed")
    assert sl.standardize_with_mapper(df, "s", lambda c, v: {})[1].startswith("empty")
    out, status = sl.standardize_with_mapper(df, "s", partly, batch_size=1)
    assert status.startswith("partial")
    assert {r["s"] for r in out.collect()} == {"a", "B", None}
    out, messages = sl.run_mapping(df, ["s"], lambda c, v: {x: None for x in v})
    assert messages[0].startswith("success") and {r["s"] for r in out.collect()} == {"a", "b", None}


def test_suggestions_stop_at_max_rows(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x", i * 10) for i in range(20)], "id int, s string, n int")
    out = sl.suggest_missing(df, "s", ["n"], lambda c, row: f"n{row['n']}", "id", max_rows=3)
    assert [r["s"] for r in out.orderBy("id").collect()][:8] == ["x", "n10", "x", "n30", "x", "n50", "x", None]


def people():
    """205 rows: 200 customers of which five are repeated, with gaps and two absurd values."""
    rng = np.random.default_rng(11)
    cities = ["LA", "NYC", "Los Angeles", "NEW YORK", "new york", "New York", "los angeles"]
    ages = rng.integers(18, 70, 200).astype(float)
    pay = rng.normal(45000, 14000, 200).round(2)
    ages[10], pay[5] = 150, 999999.0
    rows = []
    for i in range(200):
        age = "" if i % 13 == 3 else str(ages[i])
        salary = "" if i % 20 == 15 else str(pay[i])
        rows.append(f"{i + 1},  Customer {i + 1} ,{cities[rng.integers(7)]},{age},{salary},2023-{i % 12 + 1:02d}-{i % 28 + 1:02d}")
    return rows + rows[:5]


def test_whole_job(spark):
    lines = people()
    raw = sl.read_csv(spark, write_text(spark, ["customer_id,name,city,age,salary,signup_date", *lines]))
    result = sl.clean(raw)
    cells = [line.split(",") for line in lines]
    report = {(r["section"], r["column"], r["metric"]): r["value"] for r in result.report.collect()}
    assert report["summary", None, "rows_before"] == 205
    assert report["summary", None, "rows_after"] == 200
    assert report["missing_before", "age", "missing_count"] == sum(c[3] == "" for c in cells)
    assert report["missing_before", "salary", "missing_count"] == sum(c[4] == "" for c in cells)
    assert report["summary", None, "missing_after"] == 0
    assert report["duplicates_before", None, "exact_duplicate_rows"] == 5
    assert report["outliers_before", "salary", "outlier_count"] == 1
    assert report["flagged", OUTLIER_FLAG, "flagged_rows"] == 4
    for name, place, top in (("age", 3, 120), ("salary", 4, 1e9)):
        values = [float(c[place]) for c in cells[:200] if c[place] and 0 < float(c[place]) <= top]
        q1, q3 = np.quantile(values, [0.25, 0.75])
        assert result.plan.rules.caps[name] == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    # The id is neither capped nor flagged on; names are title-cased but not merged.
    assert set(result.plan.rules.caps) == {"age", "salary"}
    assert result.df.select("name").distinct().count() == 200
    # Spelling can join New York's variants, not an abbreviation and its long form.
    cities = {r["city"]: r["count"] for r in result.df.groupBy("city").count().collect()}
    want: dict[str, int] = {}
    for c in cells[:200]:
        want[c[2].title()] = want.get(c[2].title(), 0) + 1
    assert cities == want and set(want) == {"La", "Nyc", "New York", "Los Angeles"}
    again = result.plan.apply(raw)
    assert again.columns == result.df.columns
    assert again.exceptAll(result.df).count() == 0 == result.df.exceptAll(again).count()
