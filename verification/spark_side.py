"""One query per operator, run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scrubline as sl
from scrubline.columns import col, numeric_columns, text_columns
from scrubline.functions import categories, numbers
from scrubline.functions.text import title_case, trimmed
from scrubline.operators.detect import Shares
from scrubline.storage import new_path
from verification.fixtures import MIXED, read_table, spark_view

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, d, name):
    return read_table(spark, d, name)


def customers(spark, d):
    return spark_view(spark, d, "messy_customer")


def orders(spark, d):
    return spark_view(spark, d, "messy_orders")


def events(spark, d):
    return spark_view(spark, d, "messy_events")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded for comparison; other columns untouched."""
    return df.withColumns({
        f.name: F.round(col(f.name), places) for f in df.schema if f.dataType.simpleString() == "double"
    })


def found(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, detected) for every text column."""
    return df.sparkSession.createDataFrame(
        [(c, c in names) for c in text_columns(df)], "column string, detected boolean"
    )


# Sources and sinks

@query
def read_csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv-source")
    sl.write_clean(orders(spark, d), path, "csv")
    return sl.load(spark, "CSV", path=path)


@query
def load_parquet(spark, d):
    return sl.load(spark, "Parquet", path=f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )


@query
def load_files(spark, d):
    """Two written folders with unlike columns, one row per file they hold."""
    root = new_path(spark, "provenance")
    orders_in = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders_in.where("o_orderstatus = 'F'").drop("o_orderstatus").write.parquet(f"{root}/finished")
    orders_in.where("o_orderstatus <> 'F'").write.parquet(f"{root}/open")
    return sl.load_files(spark, "parquet", [f"{root}/finished", f"{root}/open"], "file").select(
        F.regexp_extract("file", "/([a-z]+)/[^/]+$", 1).alias("folder"),
        "o_orderkey", "o_totalprice", "o_orderstatus")


@query
def union_with_source(spark, d):
    return sl.union_with_source({
        "customer": table(spark, d, "customer").select(
            F.col("c_custkey").alias("party_id"), F.col("c_name").alias("name"),
            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "supplier": table(spark, d, "supplier").select(
            F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("balance")),
    })


@query
def write_clean(spark, d):
    path = new_path(spark, "csv-sink")
    sl.write_clean(sl.trim_whitespace(orders(spark, d)), path, "csv")
    return spark.read.csv(path, header=True)


@query
def preview(spark, d):
    return sl.preview(table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey"), 10).select(
        "o_orderkey", "o_totalprice"
    )


@query
def cleaning_report(spark, d):
    raw = customers(spark, d)
    after = sl.remove_exact_duplicates(sl.standardize_missing(raw))
    return sl.cleaning_report(sl.profile_dataset(raw), after)


# Profiling

@query
def profile_missing(spark, d):
    return sl.profile_missing(sl.standardize_missing(customers(spark, d)))


@query
def profile_duplicates(spark, d):
    return sl.profile_duplicates(customers(spark, d))


@query
def profile_outliers(spark, d):
    return sl.profile_outliers(customers(spark, d))


@query
def profile_outliers_lineitem(spark, d):
    return sl.profile_outliers(table(spark, d, "lineitem"))


@query
def profile_dataset(spark, d):
    return sl.profile_dataset(events(spark, d)).as_frame()


# Text

@query
def trim_whitespace(spark, d):
    return sl.trim_whitespace(customers(spark, d)).select("customer_id", "full_name", "email", "segment")


@query
def standardize_missing(spark, d):
    return sl.standardize_missing(customers(spark, d)).select(
        "customer_id", "email", "gender", "is_active", "account_status", "major", "gpa", "study_year"
    )


@query
def normalize_text_conversions(spark, d):
    _, conversions, _ = sl.normalize_text(customers(spark, d))
    return conversions.as_frame(spark).withColumn("n_rows", F.lit(conversions.rows).cast("long"))


@query
def standardize_casing(spark, d):
    df = customers(spark, d).select("customer_id", "full_name", "segment", "major", "email")
    df = sl.standardize_casing(df, ["full_name", "segment"], "title")
    df = sl.standardize_casing(df, ["major"], "upper")
    return sl.standardize_casing(df, ["email"], "lower")


@query
def title_case_priority(spark, d):
    return orders(spark, d).select("order_id", title_case(trimmed(F.col("priority"))).alias("priority"))


@query
def detect_categorical(spark, d):
    df = sl.standardize_missing(sl.trim_whitespace(customers(spark, d)))
    return found(df, sl.detect_categorical(df))


@query
def standardize_category_casing(spark, d):
    df = sl.trim_whitespace(customers(spark, d)).select("customer_id", "phone", "segment", "account_status", "major")
    return sl.standardize_category_casing(df)


@query
def detect_name_columns(spark, d):
    df = customers(spark, d)
    return df.agg(F.count("*").alias("n")).select(
        "n", F.lit(",".join(sl.detect_name_columns(df))).alias("names")
    )


@query
def standardize_name_casing(spark, d):
    return sl.standardize_name_casing(sl.trim_whitespace(customers(spark, d))).select("customer_id", "full_name")


# Typed columns

@query
def parse_numeric(spark, d):
    p = F.col("total_price")
    return orders(spark, d).select(
        "order_id", numbers.parse_numeric(p).alias("plain"),
        F.round(numbers.parse_numeric(p, True), 4).alias("converted"),
    )


@query
def detect_currency_rate(spark, d):
    return orders(spark, d).select("order_id", numbers.currency_rate(F.col("total_price")).alias("rate"))


@query
def detect_numeric_text(spark, d):
    df = orders(spark, d)
    return found(df, sl.detect_numeric_text(df))


@query
def detect_numeric_text_shares(spark, d):
    df = sl.standardize_missing(customers(spark, d))
    shares = Shares(df, ["numeric"])
    return spark.createDataFrame(
        [(c, shares.values(c), shares.count(c, "numeric")) for c in shares.columns],
        "column string, n long, parsed long",
    )


@query
def clean_numeric_text(spark, d):
    return sl.clean_numeric_text(orders(spark, d)).select("order_id", "total_price", "fee_amount", "priority")


@query
def detect_multi_currency(spark, d):
    df = orders(spark, d)
    return found(df, sl.detect_multi_currency(df))


@query
def detect_currency_pairs(spark, d):
    return spark.createDataFrame(sl.detect_currency_pairs(orders(spark, d)), "amount string, currency string")


@query
def convert_currency_by_column(spark, d):
    out = sl.convert_currency_by_column(orders(spark, d), "total_price", "currency")
    return rounded(out.select("order_id", "total_price"), 3)


@query
def detect_date_columns(spark, d):
    df = orders(spark, d)
    return found(df, sl.detect_date_columns(df))


@query
def standardize_dates_auto(spark, d):
    return sl.standardize_dates_auto(orders(spark, d)).select("order_id", "order_date")


@query
def standardize_dates(spark, d):
    df = events(spark, d).select("event_id", F.col("event_ts").cast("string").alias("event_ts"))
    return sl.standardize_dates(df, ["event_ts"])


@query
def detect_date_columns_mixed(spark, d):
    df = spark_view(spark, d, "mixed_dates")
    return found(df, sl.detect_date_columns(df))


@query
def standardize_dates_auto_mixed(spark, d):
    return sl.standardize_dates_auto(spark_view(spark, d, "mixed_dates"))


@query
def standardize_dates_mixed(spark, d):
    return sl.standardize_dates(spark_view(spark, d, "mixed_dates"), ["order_date", "note"])


@query
def cast_columns(spark, d):
    df = orders(spark, d).select("order_id", "total_price", "fee_amount")
    return sl.cast_columns(df, {"total_price": "float", "fee_amount": "float", "order_id": "str"})


@query
def detect_boolean(spark, d):
    df = sl.standardize_missing(customers(spark, d))
    return found(df, sl.detect_boolean(df))


@query
def standardize_boolean(spark, d):
    return sl.standardize_boolean(sl.standardize_missing(customers(spark, d))).select("customer_id", "is_active")


@query
def standardize_gender(spark, d):
    return sl.standardize_gender(customers(spark, d)).select("customer_id", "gender")


@query
def standardize_year_of_study(spark, d):
    return sl.standardize_year_of_study(customers(spark, d)).select("customer_id", "study_year")


@query
def detect_email(spark, d):
    df = customers(spark, d).withColumnRenamed("email", "contact")
    return found(df, sl.detect_email(df))


@query
def clean_email(spark, d):
    return sl.clean_email(customers(spark, d)).select("customer_id", "email")


@query
def standardize_gpa(spark, d):
    return rounded(sl.standardize_gpa(customers(spark, d)).select("customer_id", "gpa"))


@query
def drop_id_like(spark, d):
    df = table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "line_no")
    kept = sl.drop_id_like(numeric_columns(df))
    return df.agg(*[F.round(F.sum(c), 2).cast("double").alias(c) for c in kept if c.startswith("l_") and not c.endswith("key")],
                  F.lit(",".join(kept)).alias("kept"))


@query
def enforce_domain_bounds(spark, d):
    return sl.enforce_domain_bounds(customers(spark, d)).select(
        "customer_id", "age", "salary", "attendance_pct", "balance"
    )


@query
def run_type_cleaning(spark, d):
    out, protected = sl.run_type_cleaning(sl.trim_whitespace(orders(spark, d)), convert_currency=True)
    return rounded(out.withColumn("protected", F.lit(",".join(sorted(protected)))), 3)


# Rows and statistics

@query
def remove_exact_duplicates(spark, d):
    return sl.remove_exact_duplicates(customers(spark, d)).select("customer_id", "full_name", "balance")


@query
def cap_outliers_iqr(spark, d):
    return rounded(sl.cap_outliers_iqr(events(spark, d)).select("event_id", "amount"))


@query
def cap_outliers_lineitem(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return rounded(sl.cap_outliers_iqr(df, ["l_quantity", "l_extendedprice", "l_discount"]))


@query
def run_rule_cleaning(spark, d):
    return rounded(sl.run_rule_cleaning(customers(spark, d)))


# Learned layer

@query
def impute_knn(spark, d):
    df = customers(spark, d).select("customer_id", "age", "salary")
    return rounded(sl.impute_knn(df, ["age", "salary"]))


@query
def impute_knn_mixed_gaps(spark, d):
    return rounded(sl.impute_knn(spark_view(spark, d, "mixed_gaps"), MIXED))


@query
def impute_median(spark, d):
    return rounded(sl.impute_median(events(spark, d)).select("event_id", "amount"))


@query
def round_integer_like(spark, d):
    df = customers(spark, d).select("customer_id", (F.col("salary") / 8).alias("x"))
    return sl.round_integer_like(df, {"x": (100.0, 8000.0)})


@query
def impute_mode(spark, d):
    df = sl.standardize_missing(customers(spark, d))
    return sl.impute_mode(df, ["major", "study_year", "gender", "email"]).select(
        "customer_id", "major", "study_year", "gender", "email"
    )


@query
def flag_outliers_isolation_forest(spark, d):
    out = sl.flag_outliers_isolation_forest(events(spark, d).select("event_id", "amount"))
    return out.select("event_id", "amount", "__is_outlier__")


@query
def isolation_forest_properties(spark, d):
    """What holds of the flags whichever trees are drawn; the extremes are the rows furthest from the middle."""
    out = flag_outliers_isolation_forest(spark, d)
    flag, there = F.col("__is_outlier__"), F.col("amount").isNotNull()
    away = F.abs(F.col("amount") - out.agg(F.median("amount")).first()[0])
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("amount").alias("n_complete"),
        F.count_if(flag & ~there).alias("flagged_incomplete"), F.count_if(flag.isNull()).alias("unknown"),
        (F.count_if(flag) <= 0.02 * F.count("amount")).alias("at_most_the_share"),
        (F.count_if(flag) >= 0.01 * F.count("amount")).alias("not_far_below"),
        F.max_by(flag, F.when(there, away)).alias("furthest_flagged"),
    )


@query
def expand_and_stem(spark, d):
    stem = categories.expand_and_stem
    return customers(spark, d).select(
        "customer_id", stem(F.col("segment")).alias("segment"), stem(F.col("major")).alias("major"),
        stem(F.col("full_name")).alias("full_name"), stem(F.col("email")).alias("email"),
    )


@query
def pair_tests(spark, d):
    df = customers(spark, d).select(
        "customer_id", F.lower("account_status").alias("status"), F.lower(F.trim("segment")).alias("segment"),
        F.lower("major").alias("major"),
    )
    return df.select(
        "customer_id",
        categories.is_negation_pair(F.col("status"), F.lit("active")).alias("opposite"),
        categories.is_prefix_variant(F.col("segment"), F.lit("building")).alias("prefix"),
        categories.is_token_prefix_variant(F.col("major"), F.lit("comp science department")).alias("token_prefix_3"),
        categories.is_token_prefix_variant(F.col("major"), F.lit("comp science")).alias("token_prefix_2"),
    )


@query
def indel_ratio(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", F.lower("p_type").alias("p_type"))
    return rounded(df.select("p_partkey", categories.indel_ratio(F.col("p_name"), F.col("p_type")).alias("ratio")))


@query
def similar_pairs(spark, d):
    return rounded(sl.similar_pairs(table(spark, d, "part"), "p_name"))


@query
def fuzzy_standardize(spark, d):
    return sl.fuzzy_standardize(events(spark, d), "event_type").select("event_id", "event_type")


@query
def fuzzy_standardize_parts(spark, d):
    return sl.fuzzy_standardize(table(spark, d, "part"), "p_name").select("p_partkey", "p_name")


@query
def run_ml_cleaning(spark, d):
    df = events(spark, d).select("event_id", "event_type", "amount")
    return rounded(sl.run_ml_cleaning(df).drop("__is_outlier__"))


# Mapping layer

@query
def distinct_value_batches(spark, d):
    out = sl.distinct_value_batches(customers(spark, d), "full_name")
    return out.select("batch", F.array_join("values", "|").alias("members"))


@query
def apply_value_mapping(spark, d):
    raw = customers(spark, d)
    mapping = raw.select(F.col("segment").alias("raw")).distinct().withColumn(
        "clean", F.when(~F.col("raw").endswith("S"), F.upper(F.trim("raw")))
    )
    return sl.apply_value_mapping(raw, "segment", mapping).select("customer_id", "segment")


def lower_mapper(column: str, values: list[str]) -> dict[str, str]:
    if "BUILDING" in values:
        raise RuntimeError("service unavailable")
    return {v: v.strip().lower() for v in values}


@query
def standardize_with_mapper(spark, d):
    out, status = sl.standardize_with_mapper(customers(spark, d), "segment", lower_mapper, batch_size=2)
    return out.select("customer_id", "segment", F.lit(status.split(":")[0]).alias("status"))


def amount_suggester(column: str, row: dict) -> str:
    if row["event_type"].strip().lower().startswith("error"):
        raise ValueError("no idea")
    return str(row["user_id"] / 2)


@query
def suggest_missing(spark, d):
    out = sl.suggest_missing(
        events(spark, d), "amount", ["user_id", "event_type"], amount_suggester, "event_id"
    )
    return out.select("event_id", "amount")


@query
def run_mapping(spark, d):
    out, _ = sl.run_mapping(customers(spark, d), ["account_status", "major"], lower_mapper)
    return out.select("customer_id", "account_status", "major")


# Everything together

@query
def clean(spark, d):
    result = sl.clean(customers(spark, d))
    return rounded(result.df.drop("__is_outlier__"))


@query
def clean_report(spark, d):
    result = sl.clean(customers(spark, d))
    return result.report.where("section = 'summary'").select("metric", "value")


@query
def apply_cleaning_plan(spark, d):
    raw = orders(spark, d)
    config = sl.CleaningConfig(convert_currency=True, fuzzy_columns=())
    plan = sl.clean(raw, config).plan
    return rounded(plan.apply(raw).drop("__is_outlier__"), 3)


@query
def saved_cleaning_plan(spark, d):
    """A plan that was written, whose scratch tables are gone, on the table it comes from."""
    raw = orders(spark, d)
    result = sl.clean(raw, sl.CleaningConfig(convert_currency=True, fuzzy_columns=()))
    path = new_path(spark, "plan")
    sl.save_plan(result.plan, spark, path)
    result.release()
    return rounded(sl.load_plan(spark, path).apply(raw).drop("__is_outlier__"), 3)
