"""Operators on small frames, including empty, all-NULL and skewed columns."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import scrubline as sl
from scrubline.operators import neighbours
from scrubline.columns import OUTLIER_FLAG
from scrubline.operators import detect
from scrubline.operators.quantiles import exact_quantiles, grouped_quantiles


def column(df, name):
    return [r[name] for r in df.collect()]


# Profile

def test_profile_counts_nan_as_missing_and_survives_empty(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None)], "x double, s string")
    got = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in sl.profile_missing(df).collect()}
    assert got == {"x": (2, 66.67), "s": (2, 66.67)}
    empty = sl.profile_dataset(df.limit(0))
    assert empty.rows == 0
    assert [tuple(r) for r in empty.duplicates.collect()] == [(0, 0.0)]
    assert {r["missing_pct"] for r in empty.missing.collect()} == {0.0}
    assert column(empty.outliers, "outlier_count") == [0]


def test_duplicates_take_nulls_as_equal_and_accept_maps(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None)], "a int, b string")
    assert tuple(sl.profile_duplicates(df).first()) == (2, 50.0)
    assert sl.remove_exact_duplicates(df).count() == 2
    maps = df.select("a", F.create_map(F.lit("k"), F.col("a")).alias("m"))
    assert sl.profile_duplicates(maps).first()[0] == 2
    assert sl.remove_exact_duplicates(maps).count() == 2


def test_outliers_use_population_deviation(spark):
    values = [0.0] * 30 + [100.0]
    df = spark.createDataFrame([(v, 5.0) for v in values], "x double, constant double")
    got = {r["column"]: (r["outlier_count"], r["outlier_pct"]) for r in sl.profile_outliers(df).collect()}
    assert got == {"x": (1, 3.23), "constant": (0, 0.0)}


# Quantiles

@pytest.mark.parametrize("shape", ["normal", "hot", "whole", "edge"])
def test_closing_in_finds_exact_quantiles(spark, shape):
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=4000),
        "hot": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(7, 3, size=4000)),
        "whole": rng.integers(0, 50, 4000).astype(float),
        "edge": np.concatenate([np.full(3000, 1.0), rng.random(1000)]),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4)
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, probs, max_distinct=10, max_list=20, sketch=100)["x"]
    assert got == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_grouped_quantiles_split_off_the_large_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("big", float(v)) for v in rng.normal(size=3000)] + [(None, float(i)) for i in range(5)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = grouped_quantiles(df, F.col("k"), F.col("v"), [0.25, 0.75], max_distinct=100, max_list=20, sketch=100)
    out = {r["key"]: (r["n"], r["q"]) for r in got.collect()}
    assert out["big"][1] == pytest.approx(list(np.quantile([v for k, v in rows if k == "big"], [0.25, 0.75])))
    assert out[None] == (5, [1.0, 3.0])
    assert out["none"][0] == 0


# Text and types

def test_placeholders_depend_on_the_column_name(spark):
    df = spark.createDataFrame([("Active", "IT", "ATM"), ("Pending", "Pending", "Tbc")],
                               "employment_status string, department string, channel string")
    assert [tuple(r) for r in sl.standardize_missing(df).collect()] == [("Active", "IT", "ATM"), ("Pending", None, None)]


def test_casing_keeps_nulls(spark):
    df = spark.createDataFrame([("ab c", None)], "a string, b string")
    assert tuple(sl.standardize_casing(df, mode="title").first()) == ("Ab C", None)
    assert tuple(sl.standardize_casing(df, ["a"], "upper").first()) == ("AB C", None)


def test_detectors_refuse_names_and_phones(spark):
    df = spark.createDataFrame([(f"Customer {i}", "03001234567") for i in range(20)], "customer_name string, phone string")
    assert sl.detect_numeric_text(df) == []
    assert sl.detect_name_columns(df.withColumn("username", F.lit("x"))) == ["customer_name"]
    assert sl.drop_id_like(["id", "order_no", "no_of_items", "zip_code", "amount"]) == ["no_of_items", "amount"]


def test_detectors_on_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None)] * 3, "order_date string, email string")
    for found in (sl.detect_numeric_text, sl.detect_date_columns, sl.detect_boolean, sl.detect_categorical,
                  sl.detect_multi_currency, sl.detect_currency_pairs, sl.detect_year_of_study):
        assert found(df) == []
        assert found(df.limit(0)) == []
    assert sl.detect_email(df) == ["email"]


def test_first_role_claims_a_column(spark):
    rows = [("2023-01-05", "f", "90%", "12", "x@y.z", "1st"), ("2023-01-06 10:00", "F", "3.1", "13", "bad", "junior")] * 5
    df = spark.createDataFrame(rows, "joined string, sex string, gpa string, qty string, email string, year string")
    roles = detect.detect_roles(df)
    # A share of exactly one half with the look is enough, and one value has a time of day.
    assert roles.dates == {"joined": True}
    assert roles.genders == ["sex"] and roles.booleans == []
    assert roles.gpas == ["gpa"] and roles.numeric == ["qty"]
    assert roles.emails == ["email"] and roles.study_years == ["year"]


def test_dates_without_hint_need_the_look(spark):
    df = spark.createDataFrame([("01/02/2023",), ("2023-03-04",), (None,), ("x",)] * 3, "joined string")
    assert sl.detect_date_columns(df) == []  # two thirds parse, 0.7 needed
    assert sl.detect_date_columns(df.withColumnRenamed("joined", "start_date")) == ["start_date"]
    # A missing value does not make the column carry times.
    assert set(column(sl.standardize_dates_auto(df, ["joined"]), "joined")) == {"2023-01-02", "2023-03-04", None}
    moments = sl.standardize_dates_auto(df, ["joined"], as_type="timestamp")
    assert moments.schema["joined"].dataType.simpleString() == "timestamp_ntz"


def test_bounds(spark):
    df = spark.createDataFrame([(100.0, 50000.0, 30000.0, 25.0, 50.0), (-50.0, 0.0, 0.0, -5.0, 101.0)],
                               "price double, salary double, semester_fee double, age double, score_pct double")
    assert [tuple(r) for r in sl.enforce_domain_bounds(df).collect()] == [
        (100.0, 50000.0, 30000.0, 25.0, 50.0), (None,) * 5]
    young = spark.createDataFrame([(14, "x"), (15, "y")], "age int, major string")
    assert column(sl.enforce_domain_bounds(young), "age") == [None, 15]
    assert column(sl.enforce_domain_bounds(young.drop("major")), "age") == [14, 15]


def test_cast_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "x")], "a string, b string")
    out = sl.cast_columns(df, {"a": "int", "b": "int", "absent": "int"})
    assert out.dtypes == [("a", "bigint"), ("b", "string")]


def test_currency_groups_are_clipped_before_the_rate(spark):
    rows = [(str(100 + i), "USD") for i in range(12)] + [("100000", "usd"), ("50", None), ("oops", "eur"), ("7", "xyz")]
    df = spark.createDataFrame(rows, "amount string, currency string")
    out = sl.convert_currency_by_column(df, "amount", "currency")
    got = {(r["currency"], r["amount"]) for r in out.collect()}
    usd = [100.0 + i for i in range(12)] + [100000.0]
    q1, q3 = np.quantile(usd, [0.25, 0.75])
    assert ("usd", pytest.approx((q3 + 1.5 * (q3 - q1)) * 280.0)) in [(c, a) for c, a in got if c == "usd"]
    assert {(None, 50.0), ("eur", None), ("xyz", 7.0)} <= got


def test_caps_keep_missing_values(spark):
    df = spark.createDataFrame([(float(i), i, 1.0) for i in range(20)] + [(1e6, 99, 9.0), (None, 100, None)],
                               "x double, row_id int, flat double")
    out = sl.cap_outliers_iqr(df)
    assert out.where("row_id = 100").first()["x"] is None
    assert out.agg(F.max("x")).first()[0] == pytest.approx(30.0)
    assert out.agg(F.max("row_id")).first()[0] == 100
    assert out.agg(F.max("flat")).first()[0] == 1.0  # no spread: everything becomes the constant
    assert sl.cap_outliers_iqr(df, skip_zero_iqr=True).agg(F.max("flat")).first()[0] == 9.0


# Learned layer

def brute_knn(rows, k):
    rows = np.array(rows, dtype=float)
    out = rows.copy()
    for i, j in zip(*np.where(np.isnan(rows))):
        near = []
        for d in rows:
            both = ~np.isnan(rows[i]) & ~np.isnan(d)
            if not np.isnan(d[j]) and both.any():
                near.append((np.sqrt(rows.shape[1] / both.sum() * ((rows[i] - d)[both] ** 2).sum()), d[j]))
        out[i, j] = np.mean([v for _, v in sorted(near)[:k]]) if near else np.nanmean(rows[:, j])
    return out


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 12, (80, 3)).astype(float) + 0.5
    rows[rng.random(rows.shape) < 0.2] = np.nan
    rows[0] = np.nan
    data = [tuple(None if np.isnan(x) else float(x) for x in r) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "k int, a double, b double, c double")
    got = np.array([tuple(r)[1:] for r in sorted(sl.impute_knn(df, ["a", "b", "c"]).collect())], dtype=float)
    assert got == pytest.approx(brute_knn(rows, 5))


def gappy(n, width, seed):
    """Columns that depend on each other, a tenth of the cells absent, every row another pattern."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 1, (n, 3)) @ rng.normal(0, 1, (3, width)) * np.linspace(1, 30, width)
    rows = rows.round(1) + 0.05
    rows[rng.random(rows.shape) < 0.1] = np.nan
    rows[0, :] = rows[1, 1:] = np.nan  # a row without values, and one with a single value
    rows[np.arange(2, 2 + width) % n, np.arange(width)] = np.nan
    rows[n // 2:n // 2 + 7] = rows[n // 2]  # equal rows
    return rows


def filled_by_knn(spark, rows):
    names = [f"c{i}" for i in range(rows.shape[1])]
    pdf = pd.DataFrame(rows, columns=names)
    pdf.insert(0, "k", np.arange(len(rows)))
    df = spark.createDataFrame(pdf).select("k", *[F.nanvl(c, F.lit(None)).alias(c) for c in names])
    return sl.impute_knn(df, names).orderBy("k").toPandas()[names].to_numpy(float)


@pytest.mark.parametrize("width", [33, 64, 100])
def test_knn_over_many_columns(spark, width):
    rows = gappy(90, width, width)
    assert filled_by_knn(spark, rows) == pytest.approx(brute_knn(rows, 5))


def test_knn_over_many_cells(spark, monkeypatch):
    """Cuts, limits and groups, with cells small enough to need them."""
    for name, n in (("CELL_ROWS", 16), ("GROUP_ROWS", 64), ("SAMPLE_ROWS", 300), ("MAX_CELLS", 24)):
        monkeypatch.setattr(neighbours, name, n)
    rows = gappy(900, 9, 1)
    rows[:200, 2:] = rows[300, 2:]  # very common values
    assert filled_by_knn(spark, rows) == pytest.approx(brute_knn(rows, 5))


def test_rows_start_where_their_gap_is_known():
    """A row's own cell may hold no donor with the column it lacks: without a bound it went to all cells."""
    rng = np.random.default_rng(8)
    rows = rng.normal(0, 10, (2400, 3))
    rows[np.arange(0, 2400, 2), rng.integers(0, 3, 1200)] = np.nan
    cells = neighbours.Tree(rows, 150).cells(rows)
    order = np.argsort(cells, kind="stable")
    rows, cells = rows[order], cells[order]
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    boxes = neighbours.Boxes.around(rows, starts)
    gaps = rows[np.isnan(rows).any(1)]
    reach = boxes.least_distances(gaps)
    row, cell = boxes.promising(reach, gaps)
    axis = np.isnan(gaps).argmax(1)
    assert sorted(row) == list(range(len(gaps))) and boxes.some[cell, axis[row]].all()
    far, value = np.full(gaps.shape, -1.0), np.full(gaps.shape, -np.inf)
    for r, c in zip(row, cell):
        part = rows[starts[c]:np.append(starts[1:], len(rows))[c]]
        donors = part[~np.isnan(part[:, axis[r]])]
        who, donor, d = neighbours._candidates(gaps[r:r + 1], np.full((1, 3), np.inf), donors)
        far[r, axis[r]], value[r, axis[r]] = sorted(zip(d, donors[donor, axis[r]]))[min(4, len(d) - 1)]
    assert boxes.needed(reach, far, value).sum(1).mean() < len(starts) / 4
    # At distance zero only smaller values come before.
    far[row, axis[row]], value[row, axis[row]] = 0.0, rows[~np.isnan(rows)].min()
    assert not boxes.needed(reach, far, value).any()


def test_rows_without_the_widest_column_visit_few_groups(spark, monkeypatch):
    """Cuts follow the widest column: rows that lack it can not tell its cells apart and went to nearly all groups."""
    for name, n in (("CELL_ROWS", 16), ("GROUP_ROWS", 64)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(12)
    rows = np.column_stack([rng.uniform(0, 1000, 5000), rng.uniform(0, 60, 5000), rng.uniform(0, 40, 5000), rng.integers(0, 3, 5000)])
    rows[::4, 0] = np.nan
    rows[::7, 3] = np.nan
    rows[5::900, 1:] = np.nan
    visits, search = [], neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda v, donors: (visits.append(v.count()), search(v, donors))[1])
    got = filled_by_knn(spark, rows)
    assert sum(visits) < 8 * np.isnan(rows).any(1).sum()
    some = np.r_[:5000:200, 5:5000:900]
    want = rows[some].copy()
    for at, i in enumerate(some):
        both = ~np.isnan(rows[i]) & ~np.isnan(rows)
        n = both.sum(1)
        d = np.sqrt(4 / np.maximum(n, 1) * np.where(both, (rows[i] - rows) ** 2, 0).sum(1))
        for j in np.flatnonzero(np.isnan(rows[i])):
            near = np.flatnonzero(~np.isnan(rows[:, j]) & (n > 0))
            want[at, j] = rows[near[np.lexsort((rows[near, j], d[near]))[:5]], j].mean()
    want[:, 3] = np.where(np.isnan(rows[some, 3]), np.rint(want[:, 3]), want[:, 3])
    assert got[some] == pytest.approx(want)


def test_equal_values_are_not_cut():
    """Their mean is off by rounding, which looked like a spread."""
    rows = np.column_stack([np.full(15, 3.608), np.full(15, np.nan)])
    assert neighbours.Tree(rows, 5).size == 1


def test_alike_rows_are_searched_once(monkeypatch):
    """Donors without the column that tells rows apart were compared with every row: as many as the table has."""
    rng = np.random.default_rng(21)
    y = np.column_stack([rng.integers(0, 5, 1500), rng.integers(0, 90, 1500), rng.uniform(0, 1000, 1500), rng.uniform(0, 9, 1500)])
    y[:1200, 2] = np.nan
    y[rng.random((1500, 4)) < 0.1] = np.nan
    x = np.column_stack([rng.integers(0, 5, 3000), rng.integers(0, 3, 3000), rng.uniform(0, 1000, 3000), np.full(3000, np.nan)])
    x[rng.random((3000, 4)) < 0.2] = np.nan
    x[:, 3] = np.nan
    pairs, candidates = [0], neighbours._candidates

    def counted(x, limits, y, values=None):
        pairs[0] += len(x) * len(y)
        return candidates(x, limits, y, values)

    monkeypatch.setattr(neighbours, "_candidates", counted)
    gap = np.isnan(x)
    first = np.cumsum(gap.sum(1)) - gap.sum(1)

    def found(search, donors, far, value):
        best_d, best_v = np.full((len(far), 4), np.inf), np.zeros((len(far), 4))
        pairs[0] = 0
        listed = pa.array([[None if np.isnan(v) else v for v in row] for row in donors], pa.list_(pa.float64()))
        search(x, gap, first, far.copy(), value.copy(), best_d, best_v,
               pa.table({"x": listed, "n": 1 + np.arange(len(donors)) % 3}), 4, 4, np.ones(4, bool))
        before = (best_d < far[:, None]) | ((best_d == far[:, None]) & (best_v < value[:, None]))
        return np.where(before, best_d, np.inf), np.where(before, best_v, 0.0), pairs[0]

    open_ = np.full(int(gap.sum()), np.inf), np.zeros(int(gap.sum()))
    limits = rng.uniform(0, 400, len(open_[0])).round(), rng.uniform(0, 9, len(open_[0]))
    for far, value in (open_, limits):
        want_d, want_v, _ = found(neighbours._scan, y, far, value)
        got_d, got_v, _ = found(neighbours._scan_alike, y, far, value)
        assert np.array_equal(got_d, want_d) and np.array_equal(got_v, want_v)
        assert np.isfinite(want_d).any()
    assert 2 * found(neighbours._scan_alike, y, *open_)[2] < found(neighbours._scan, y, *open_)[2]
    # No donor has the column: a row of each kind is searched.
    want, got = (found(search, y[:1000], *open_) for search in (neighbours._scan, neighbours._scan_alike))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1]) and 20 * got[2] < want[2]


def test_infinite_values_are_no_neighbours(spark):
    rows = [(0, 1.0, None), (1, float("inf"), 9.0), (2, 1.5, 4.0), (3, 2.0, float("-inf")), (4, float("inf"), None), (5, None, 6.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r.k: (r.a, r.b) for r in sl.impute_knn(df, ["a", "b"], k=1).collect()}
    assert got[0] == (1.0, 4.0) and got[5][0] == 1.5
    assert got[4][1] == pytest.approx(19 / 3)  # shares no column with any donor: the mean


def test_least_distances_hold():
    rng = np.random.default_rng(6)
    rows = rng.normal(0, 5, (400, 6))
    rows[rng.random(rows.shape) < .3] = np.nan
    tree = neighbours.Tree(rows, 12)
    cells = tree.cells(rows)
    order = np.argsort(cells, kind="stable")
    rows, cells = rows[order], cells[order]
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    low = neighbours.Boxes.around(rows, starts).least_distances(rows)
    assert len(starts) > 6
    for c, (s, e) in enumerate(zip(starts, np.append(starts[1:], len(rows)))):
        row, donor, d = neighbours._candidates(rows, np.full(rows.shape, np.inf), rows[s:e])
        assert (d >= low[row, c]).all()


def test_knn_of_a_large_table_is_still_knn(spark):
    """Beyond 20,000 rows, with a very common value, against brute force on some of the gaps."""
    rng = np.random.default_rng(4)
    rows = np.column_stack([rng.normal(0, 1000, 24_000), rng.integers(0, 5, 24_000), rng.normal(0, 1, 24_000)]).round(2)
    rows[:8000, :2] = (100.0, 2.0)
    rows[np.arange(0, 24_000, 400), rng.integers(0, 3, 60)] = np.nan
    rows[1] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(24_000), "a": rows[:, 0], "b": rows[:, 1], "c": rows[:, 2]}))
    df = df.select("k", *[F.nanvl(c, F.lit(None)).alias(c) for c in "abc"])
    got = np.array([tuple(r)[1:] for r in sorted(sl.impute_knn(df, ["a", "b", "c"]).where("k % 400 = 0 or k = 1").collect())], dtype=float)
    ids = [0, 1, *range(400, 24_000, 400)]
    want = rows[ids].copy()
    for at, i in enumerate(ids):
        for j in np.flatnonzero(np.isnan(rows[i])):
            both = ~np.isnan(rows[i]) & ~np.isnan(rows)
            n, known = both.sum(1), ~np.isnan(rows[:, j])
            d = np.sqrt(3 / np.maximum(n, 1) * np.where(both, (rows[i] - rows) ** 2, 0).sum(1))
            near = np.flatnonzero(known & (n > 0))
            near = near[np.lexsort((rows[near, j], d[near]))[:5]]
            want[at, j] = rows[near, j].mean() if len(near) else rows[known, j].mean()
    whole = np.isnan(rows[ids][:, 1])
    want[whole, 1] = np.rint(want[whole, 1])
    assert got == pytest.approx(want)


def test_medians_and_whole_columns_stay_whole(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None), (None, None)], "x int, y double")
    out = sl.impute_median(df)
    assert sorted(column(out, "x")) == [1.0, 2.0, 2.0, 4.0]
    assert column(out, "y") == [None] * 4  # nothing to learn from
    half = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (9.0,)], "x double")
    assert column(sl.round_integer_like(half, {"x": (1.0, 5.0)}), "x") == [1.0, 2.0, 2.0, 5.0]


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b", "q"), ("a", None), ("b", None), ("a", "q"), (None, "q")], "grade string, user_name string")
    out = sl.impute_mode(df, ["grade", "user_name", "absent"])
    assert sorted(column(out, "grade")) == ["a", "a", "a", "b", "b"]
    assert column(out, "user_name").count(None) == 2


def test_forest_flags_the_planted_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1000, 2)))]
    rows += [(5000 + i, 40.0 + i, -40.0 - i) for i in range(5)] + [(9000, None, 1.0)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double")
    first = sl.flag_outliers_isolation_forest(df)
    flagged = {r["row_id"] for r in first.where(F.col(OUTLIER_FLAG)).collect()}
    assert {5000 + i for i in range(5)} <= flagged
    assert 9000 not in flagged
    assert 15 <= len(flagged) <= 21  # two percent of 1005 complete rows
    again = {r["row_id"] for r in sl.flag_outliers_isolation_forest(df).where(F.col(OUTLIER_FLAG)).collect()}
    assert again == flagged


def test_forest_without_measures(spark):
    df = spark.createDataFrame([(1, "x")], "row_id int, s string")
    assert column(sl.flag_outliers_isolation_forest(df), OUTLIER_FLAG) == [False]
    nulls = spark.createDataFrame([(None,)], "a double")
    assert column(sl.flag_outliers_isolation_forest(nulls), OUTLIER_FLAG) == [False]


def test_infinities_are_no_outliers(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), 2.0), (1.0, 3.0), (2.0, 4.0)], "a double, b double")
    assert {r["column"]: r["outlier_count"] for r in sl.profile_outliers(df).collect()} == {"a": 0, "b": 0}


def test_casts_know_other_names_and_leave_what_does_not_fit(spark):
    df = spark.createDataFrame([("1", "2.5", "2024-01-02", "x")], "a string, b string, c string, d string")
    with pytest.warns(UserWarning) as said:
        out = sl.cast_columns(df, {"a": "int64", "b": "float64", "c": "datetime64[ns]", "d": "int64", "e": "object", "b ": "nonsense"})
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "string"}
    assert len([w for w in said if "stays as it is" in str(w.message)]) == 2


def test_fitted_casts_do_not_depend_on_the_next_table(spark):
    from scrubline.operators.rules import apply_rules, fit_rules

    first = spark.createDataFrame([("x1", "1"), ("x2", "2")], "note string, amount_code string")
    later = spark.createDataFrame([("x3", "no number"), ("x4", "4")], "note string, amount_code string")
    _, fit = fit_rules(first, type_map={"amount_code": "int64"}, write=False)
    out = apply_rules(later, fit)
    assert fit.casts == {"amount_code": "bigint"} and dict(out.dtypes)["amount_code"] == "bigint"


def test_line_breaks_in_quotes_are_not_torn(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"line one\nline two"\n2,"with ""quotes"""\n')
    with pytest.raises(ValueError, match="multiLine=True"):
        sl.read_csv(spark, str(path))
    got = sl.read_csv(spark, str(path), multiLine=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "line one\nline two"), (2, 'with "quotes"')]


def test_suggestions_cover_all_gaps(spark):
    df = spark.range(200).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'x' END AS s", "id * 10 AS n")
    out = sl.suggest_missing(df, "s", ["n"], lambda c, row: f"n{row['n']}", "id")
    assert out.where("s IS NULL").count() == 0


def test_forest_flags_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)).round(1))]
    df = spark.createDataFrame(rows + [(3000, 50.0, 50.0), (3001, None, 1.0)], "k int, a double, b double")
    flagged = [
        {r["k"] for r in sl.flag_outliers_isolation_forest(d, ["a", "b"], n_trees=30).where("__is_outlier__").collect()}
        for d in (df, df.repartition(7), df.orderBy("b"))
    ]
    assert flagged[0] == flagged[1] == flagged[2]
    assert 3000 in flagged[0] and 3001 not in flagged[0] and 20 < len(flagged[0]) <= 60
