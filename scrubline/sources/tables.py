"""Database tables and queries, unions of several sources, and writing the result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.columns import nan_to_null
from scrubline.sources.csv import FILE, read_csv


@dataclass(frozen=True)
class JdbcPartitioning:
    """Split the read of a table into ranges of a numeric or date column, one task each."""

    column: str
    lower: str | int
    upper: str | int
    partitions: int


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: JdbcPartitioning | None = None,
    **options,
) -> dict[str, str]:
    """Reader options; a query wins over a table, and one of them is needed."""
    chosen = {"url": url, **{k: str(v) for k, v in options.items()}}
    if not query and not table:
        raise ValueError("give either a table or a query")
    if partition is None:
        return {**chosen, **({"query": query} if query else {"dbtable": table})}
    # Spark takes partitioning only with dbtable, where a query can stand as a subquery.
    return {
        **chosen,
        "dbtable": f"({query}) AS source_query" if query else table,
        "partitionColumn": partition.column,
        "lowerBound": str(partition.lower),
        "upperBound": str(partition.upper),
        "numPartitions": str(partition.partitions),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: JdbcPartitioning | None = None,
    **options,
) -> DataFrame:
    """A whole table or the result of a query; filters and column choice reach the database."""
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, query, partition, **options)
    ).load()


def union_with_source(
    frames: dict[str, DataFrame], source_col: str = "__source_sheet__"
) -> DataFrame:
    """All frames one below the other, aligned by column name, with the name of their source."""
    if not frames:
        raise ValueError("no frames given")
    labelled = [df.withColumn(source_col, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def load_files(
    spark: SparkSession, source_type: str, paths: Iterable[str], source_col: str = "__source_file__", **kw
) -> DataFrame:
    """Folders or files of one kind below each other, aligned by column name, with each row's file.

    The file is what Spark's own metadata of the scan says, so files inside a folder are told apart.
    Each path has types of its own; where they differ, the union widens them.
    """
    frames = [load(spark, source_type, path=p, source_col=source_col, **kw) for p in paths]
    if not frames:
        raise ValueError("no paths given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load(spark: SparkSession, source_type: str, **kw) -> DataFrame:
    """``csv``, ``database`` or ``parquet`` (any case); NaN is read as missing.

    For files, ``source_col`` names a column to add with the file of each row.
    """
    kind = source_type.lower()
    if kind == "csv":
        return read_csv(spark, kw.pop("path"), **kw)
    if kind == "database":
        return nan_to_null(read_jdbc(spark, kw.pop("url"), **kw))
    if kind == "parquet":
        df = spark.read.parquet(kw["path"])
        name = kw.get("source_col")
        return nan_to_null(df.select("*", F.col(FILE).alias(name)) if name else df)
    raise ValueError(f"unsupported source type: {source_type}")


def write_clean(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write the cleaned table in the given format, one file per task and no index column."""
    writer = df.write.mode(mode)
    if fmt.lower() == "csv":
        writer.csv(path, header=True, quote='"', escape='"',
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt.lower() == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows, for looking at."""
    return df.limit(n)
