"""Fingerprints of rows, plans that outlive their job, files that are known, stray quotes, repeated keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import scrubline as sl
from scrubline.operators import neighbours, profile
from scrubline.sources.csv import whole_line
from scrubline.storage import new_path
from tests.test_jobs import write_text


def by_grouping(df):
    counts = df.groupBy(*df.columns).count()
    return counts.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def duplicates(df):
    return sl.profile_duplicates(df).first()["exact_duplicate_rows"]


def test_fingerprints_count_as_grouping_does(spark):
    nan, rows = float("nan"), []
    for a in (None, "", "a", "ab"):
        for b in (None, "", "a", "b"):
            for x in (None, 0.0, -0.0, nan, 1.5):
                rows += [(a, b, x, x)] * (1 + len(a or "") + len(b or ""))
    df = spark.createDataFrame(rows, "a string, b string, x double, y float").repartition(5)
    assert duplicates(df) == by_grouping(df) > 0
    nested = df.withColumns({
        "list": F.array("a", "b"), "pair": F.struct("x", "a"),
        "map": F.create_map(F.lit("k"), "a"), "when": F.lit("2024-01-01").cast("timestamp"),
        "price": F.lit(3).cast("decimal(30,2)"), "raw": F.col("b").cast("binary")})
    assert duplicates(nested) == by_grouping(nested) > 0
    assert duplicates(df.limit(0)) == 0
    assert duplicates(spark.range(7).select(F.lit(None).alias("n"))) == 6


def test_rows_that_collide_in_one_fingerprint_stay_apart(spark, monkeypatch):
    keys = profile.row_keys

    def colliding(df):
        first, *rest = keys(df)
        return [F.lit(0).cast("long").alias("__key0__"), *rest]

    monkeypatch.setattr(profile, "row_keys", colliding)
    df = spark.range(1000).select((F.col("id") % 300).alias("v"))
    assert duplicates(df) == 700


def test_only_keys_are_exchanged(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("wide"))
    plan = sl.profile_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "__key0__" in line and "wide" not in line
    assert "__key0__" in plan


@pytest.fixture
def messy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        a = float(rng.normal(50, 10))
        rows.append((
            i, None if i % 9 == 0 else a, None if i % 7 == 3 else a * 2 + float(rng.normal()),
            ["Biology", "biology ", "Biologie", "Physics"][i % 4], "usd" if i % 3 else "eur",
            f"{100 + i % 17}", f"2024-01-{1 + i % 28:02d}"))
    return spark.createDataFrame(
        rows, "row_id long, height double, weight double, subject string, currency string, price string, seen string")


@pytest.mark.parametrize("fill", ["knn", "median"])
def test_a_saved_plan_does_what_the_fitted_one_does(spark, messy, fill):
    if fill == "median":
        messy = messy.select("row_id", "height", "seen")
    config = sl.CleaningConfig(convert_currency=True, numeric_fill=fill, fuzzy_columns=("subject",))
    result = sl.clean(messy, config)
    want = sorted(map(str, result.plan.apply(messy).collect()))
    path = new_path(spark, "plan")
    sl.save_plan(result.plan, spark, path)
    with pytest.raises(FileExistsError):
        sl.save_plan(result.plan, spark, path)
    assert result.scratch.paths
    result.release()
    assert not result.scratch.paths
    again = sl.load_plan(spark.newSession(), path)
    assert sorted(map(str, again.apply(messy).collect())) == want
    assert again.rules.caps == result.plan.rules.caps
    assert all((x == y).all() for x, y in zip(again.learned.forest.trees, result.plan.learned.forest.trees))


def test_a_saved_plan_keeps_the_cells_of_many_donors(spark, messy, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    result = sl.clean(messy, sl.CleaningConfig(fuzzy_columns=()))
    assert result.plan.learned.fill.donors.tree.size > 4
    want = sorted(map(str, result.plan.apply(messy).collect()))
    path = new_path(spark, "plan")
    sl.save_plan(result.plan, spark, path)
    result.release()
    again = sl.load_plan(spark.newSession(), path)
    assert again.learned.fill.donors.tree == result.plan.learned.fill.donors.tree
    assert sorted(map(str, again.apply(messy).collect())) == want


def test_a_saved_plan_keeps_all_views_of_the_donors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 8)
    df = spark.range(3000).selectExpr(
        "case when id % 3 > 0 then pmod(id * 7919, 100003) / 7.0D end as height", "pmod(id * 104729, 997) / 13.0D as weight",
        "case when id % 5 > 0 then pmod(id * 31, 89) / 2.0D end as width", "case when id % 11 > 0 then pmod(id * 17, 41) / 2.0D end as depth")
    result = sl.clean(df, sl.CleaningConfig(fuzzy_columns=()))
    assert result.plan.learned.fill.donors.further
    want = sorted(map(str, result.plan.apply(df).collect()))
    path = new_path(spark, "plan")
    sl.save_plan(result.plan, spark, path)
    result.release()
    again = sl.load_plan(spark.newSession(), path)
    assert [v.first_group for v in again.learned.fill.donors.views] == [v.first_group for v in result.plan.learned.fill.donors.views]
    assert sorted(map(str, again.apply(df).collect())) == want


def test_a_plan_of_another_version_is_refused(spark):
    path = new_path(spark, "plan")
    spark.createDataFrame([('{"version": 0, "plan": null}',)], "value string").write.text(f"{path}/plan")
    with pytest.raises(ValueError, match="version 0"):
        sl.load_plan(spark, path)


def test_rows_know_their_file(spark):
    a, b = write_text(spark, ["id,x", "1,2", "2,3"]), write_text(spark, ["y,id", "z,7"])
    got = sl.load_files(spark, "csv", [a, b])
    assert dict(got.dtypes) == {"id": "bigint", "x": "bigint", "__source_file__": "string", "y": "string"}
    rows = {r["id"]: r for r in got.collect()}
    assert a.split("/")[-1] in rows[1]["__source_file__"] and b.split("/")[-1] in rows[7]["__source_file__"]
    assert rows[2]["y"] is None and rows[7]["y"] == "z"
    plain = sl.load(spark, "csv", path=a)
    assert plain.columns == ["id", "x"]
    with pytest.raises(ValueError):
        sl.load_files(spark, "csv", [])


def test_quotes_inside_unquoted_fields_are_letters(spark):
    path = write_text(spark, ["id,size,note", '1,5" pipe,a', '2,"3"" rod, long",b', '3,6",c"', '4,,""'])
    rows = {r["id"]: (r["size"], r["note"]) for r in sl.read_csv(spark, path).collect()}
    assert rows[1] == ('5" pipe', "a") and rows[2] == ('3" rod, long', "b") and rows[3] == ('6"', 'c"')
    for torn in (['1,"open', 'end",x'], ['1,5" pipe,"open', 'end"'], ['1,"a""', 'b",x']):
        with pytest.raises(ValueError, match="multiLine"):
            sl.read_csv(spark, write_text(spark, ["id,size,note", *torn]))


def test_whole_lines_of_any_length(spark, run):
    quoted = ",".join(['"a""b"'] * 50_000)
    many = '"' + '""' * 100_000 + '"'
    lines = [quoted, quoted + ',"', many, many[:-1], "", "x", 'x|"y', '"x"y,z', '"x\ny"']
    pattern = whole_line('"', '"', ",")
    assert run(lambda c: c.rlike(pattern), lines) == [True, False, True, False, True, True, True, True, True]
    slashed = whole_line('"', "\\", "|")
    assert run(lambda c: c.rlike(slashed), ['"a\\""|b', '"a\\"|b', 'x|"y', "a,b"]) == [True, False, False, True]


def test_repeated_keys_get_one_suggestion(spark):
    df = spark.createDataFrame(
        [(1, None, "b"), (1, None, "a"), (1, 5.0, "c"), (None, None, "d"), (2, None, "8")], "k int, v double, t string")
    got = sl.suggest_missing(df, "v", ["t"], lambda column, row: {"a": "1", "b": "2"}.get(row["t"], row["t"]), "k")
    assert sorted(map(str, got.select("k", "v", "t").collect())) == sorted(
        f"Row(k={k}, v={v}, t='{t}')" for k, v, t in
        [(1, 1.0, "b"), (1, 1.0, "a"), (1, 5.0, "c"), (None, None, "d"), (2, 8.0, "8")])
