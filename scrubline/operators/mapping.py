"""Replacing values by what a pluggable mapper says about them.

A mapper is any picklable function; an external service can sit behind it. It sees batches of
distinct values, never rows, runs inside Spark tasks, and is called once: its answers are stored
before they are used. (A task that is retried after a failure asks again for its own batches.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.columns import col
from scrubline.storage import write_table

BATCH = 50
Mapper = Callable[[str, list[str]], dict[str, str]]
Suggester = Callable[[str, dict], str]


def distinct_value_batches(df: DataFrame, column: str, batch_size: int = BATCH) -> DataFrame:
    """(batch, values): the sorted distinct non-NULL values, cut into batches.

    Positions come from a range-partitioned sort: each partition numbers its own values and adds
    the sizes of the partitions before it, so no task sees the whole vocabulary.
    """
    numbered = numbered_values(df, column)
    return (
        numbered.groupBy(F.floor(F.col("position") / batch_size).alias("batch"))
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
    )


def numbered_values(df: DataFrame, column: str) -> DataFrame:
    """(value, position): distinct non-NULL values and their place in sorted order, from zero."""
    values = df.where(col(column).isNotNull()).select(col(column).cast("string").alias("value")).distinct()
    parts = write_table(
        values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values"
    )
    sizes = parts.groupBy("part").count().orderBy("part").collect()  # one row per partition
    offsets, total = {}, 0
    for r in sizes:
        offsets[r["part"]] = total
        total += r["count"]
    if not offsets:
        return parts.select("value", F.lit(0).cast("long").alias("position"))
    start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    place = F.row_number().over(W.partitionBy("part").orderBy("value"))
    return parts.select("value", (place - 1 + start[F.col("part")]).cast("long").alias("position"))


def apply_value_mapping(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace values by a (raw, clean) table with one row per raw value.

    Unmapped values, values mapped to NULL and NULLs keep the original. The join carries no hint:
    a mapping that proves small at run time is broadcast, a large one is joined by value with hot
    values split by adaptive execution.
    """
    pairs = mapping.select(F.col("raw").alias("__raw__"), F.col("clean").alias("__clean__"))
    text = col(column).cast("string")
    joined = df.join(pairs, text == F.col("__raw__"), "left")
    return joined.withColumn(column, F.coalesce("__clean__", text)).drop("__raw__", "__clean__")


def mapper_answers(df: DataFrame, column: str, mapper: Mapper, batch_size: int = BATCH) -> DataFrame:
    """(raw, clean, error): the stored answers; a failing batch gives one row with its error."""

    def ask(batches):
        for pdf in batches:
            rows = []
            for values in pdf["values"]:
                try:
                    answer = mapper(column, list(values))
                    rows += [
                        (str(k), None if v is None else str(v), None) for k, v in answer.items()
                    ]
                except Exception as e:  # any failure of the service keeps the originals
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["raw", "clean", "error"], dtype="object")

    batches = distinct_value_batches(df, column, batch_size)
    answers = batches.mapInPandas(ask, "raw string, clean string, error string")
    return write_table(answers, "mapper-answers")


def standardize_with_mapper(
    df: DataFrame, column: str, mapper: Mapper | None, batch_size: int = BATCH
) -> tuple[DataFrame, str]:
    """Apply a mapper to the distinct values of a column.

    The second result says how it went: ``skipped``, ``empty``, ``success``, ``partial`` or
    ``failed``, followed by the figures.
    """
    if mapper is None:
        return df, "skipped: no mapper given"
    if column not in df.columns:
        return df, f"skipped: no column {column!r}"
    answers = mapper_answers(df, column, mapper, batch_size)
    # A mapper may answer for a value it was not asked about; one answer per value is kept.
    mapping = answers.where("raw is not null").groupBy("raw").agg(F.min("clean").alias("clean"))
    seen = answers.agg(
        F.count_distinct("raw").alias("mapped"),
        F.count("error").alias("failed"),
        F.min("error").alias("error"),
    ).first()
    if seen["mapped"]:
        df = apply_value_mapping(df, column, mapping)
        if seen["failed"]:
            return df, (
                f"partial: {column!r}, {seen['mapped']} values mapped, "
                f"{seen['failed']} batches failed: {seen['error']}"
            )
        return df, f"success: {column!r}, {seen['mapped']} values mapped"
    if seen["failed"]:
        return df, f"failed: {column!r}: {seen['error']}"
    return df, f"empty: {column!r}, no values mapped"


def suggest_missing(
    df: DataFrame,
    column: str,
    context_cols: Iterable[str],
    suggester: Suggester | None,
    row_key: str,
    max_rows: int | None = None,
) -> DataFrame:
    """Ask for a value for every row that misses ``column``, in batches through the tasks.

    With a budget only the first ``max_rows`` of them, by ``row_key``, are asked for.
    Rows that share a ``row_key`` get one suggestion, the smallest of theirs; rows without a key and
    rows for which the suggester fails stay missing. There are as many rows as before.
    """
    if suggester is None:
        return df
    context = list(context_cols)
    first = (
        df.where(col(column).isNull())
        .select(col(row_key).alias("__row__"), *[col(c) for c in context])
    )
    if max_rows is not None:
        first = first.orderBy("__row__").limit(max_rows)
    key_type = df.schema[row_key].dataType.simpleString()

    def ask(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                key = r.pop("__row__")
                try:
                    rows.append((key, str(suggester(column, r)).strip()))
                except Exception:
                    pass
            yield pd.DataFrame(rows, columns=["__row__", "__suggested__"])

    found = write_table(
        first.mapInPandas(ask, f"__row__ {key_type}, __suggested__ string")
        .groupBy("__row__").agg(F.min("__suggested__").alias("__suggested__")), "suggestions"
    )
    filled = F.coalesce(col(column), F.col("__suggested__").try_cast(df.schema[column].dataType))
    return (
        df.join(found, col(row_key) == F.col("__row__"), "left")
        .withColumn(column, filled).drop("__row__", "__suggested__")
    )


def run_mapping(
    df: DataFrame, text_columns: Iterable[str] | None, mapper: Mapper | None, batch_size: int = BATCH
) -> tuple[DataFrame, list[str]]:
    """``standardize_with_mapper`` on each column, with the messages."""
    messages = []
    for c in text_columns or ():
        df, message = standardize_with_mapper(df, c, mapper, batch_size)
        messages.append(message)
    return df, messages
