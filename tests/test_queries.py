"""Registered queries against their SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_SMALL
from verification.compare import duck, rows_of
from verification.spark_side import QUERIES
from verification.sql_side import SQL


def test_every_query_but_the_forest_has_sql():
    assert set(QUERIES) - set(SQL) == {"flag_outliers_isolation_forest"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [
    "read_csv", "cleaning_report", "profile_dataset", "convert_currency_by_column",
    "detect_categorical", "standardize_dates_auto", "run_type_cleaning", "fuzzy_standardize_parts",
    "distinct_value_batches", "standardize_with_mapper",
])
def test_matches_sql(spark, name):
    df = queries()[name](spark, SF_SMALL)
    got = rows_of(df.columns, df.collect())
    cursor = duck(SF_SMALL).execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_flagship_matches_sql(spark):
    df = entry(spark)
    cursor = duck(SF_SMALL).execute(oracle_sql()["clean"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
