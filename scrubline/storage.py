"""Writing intermediate tables to the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a folder in the SQL warehouse serves, which driver and
    executors share as well. A machine-local temporary folder is never used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


_open_scratches: list[Scratch] = []


class Scratch:
    """Notes the paths made while it is open, so that they can be deleted once nothing reads them.

        with Scratch() as scratch:
            result = clean(raw)
        result.df.write.parquet(target)
        scratch.release(spark)
    """

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        _open_scratches.append(self)
        return self

    def __exit__(self, *error) -> None:
        _open_scratches.remove(self)

    def release(self, spark: SparkSession) -> None:
        """Delete what was stored; tables that still read it fail from then on."""
        while self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scratch in _open_scratches:
        scratch.paths.append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Compute once, store as parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, unlike a cache.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_and_observe(df: DataFrame, name: str, aggs: dict, columns: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Store ``columns`` of ``df`` and give back the aggregates ``aggs`` of ``df`` from the same pass.

    Each task folds its rows into one row of counters, as in an aggregation without keys.
    """
    seen = Observation()
    watched = df.observe(seen, *[agg.alias(f"a{i}") for i, agg in enumerate(aggs.values())])
    stored = write_table(watched.select(*[c.alias(n) for n, c in columns.items()]), name)
    found = seen.get
    return stored, {key: found[f"a{i}"] for i, key in enumerate(aggs)}


#: Tables of at most so many rows are dealt out to all cores before heavy work on every value.
SPREAD_ROWS = 1 << 20


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, over all cores if it is small: a small file is read by a single task.

    Larger tables have partitions enough and are left as they are, so no large table is moved.
    """
    if rows > SPREAD_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
