"""Helpers the operators share: word columns, running totals over hot groups, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.storage import write_table

#: The characters that end a word: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null becomes the empty text."""
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    blank_ends = (F.element_at(parts, 1) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return (F.size(parts) - blank_ends).cast("long")


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the rows whose crc32 of the id as text leaves no remainder; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def smallest(df: DataFrame, order: Column, ties: list[str], k: int, n: int) -> DataFrame:
    """The ``k`` rows of ``df`` with the smallest 64-bit hashes ``order``, of about ``n`` rows.

    Hashes far above the wanted ones are turned away by a bound first, so that what is put in order does
    not grow with the number of rows or tasks.
    """
    if n > 2 * k:
        df = df.where(order <= (1 << 65) * k // n - (1 << 63))
    return df.orderBy(order, *ties).limit(k)


def block_of(order: Column, blocks: int) -> Column:
    """The hash range, of ``blocks`` equal ones, that a 64-bit hash lies in."""
    return F.shiftrightunsigned(
        F.shiftrightunsigned(order, 33).cast("long") * F.lit(blocks).cast("long"), 31
    ).cast("int")


def with_running_total(
    df: DataFrame, group: str, order: str, ties: list[str], value: Column, name: str,
    rows_per_block: int = 1 << 12,
) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier rows of the same group.

    ``order`` is a 64-bit hash and ``ties`` are columns that decide between equal hashes. A group
    is summed in hash ranges of about ``rows_per_block`` rows, so that a group that holds most of
    the rows is dealt out over many tasks; only one sum a range meets in one place. ``df`` should
    be a stored table, as it is read twice.
    """
    blocks = max(1, -(-df.count() // rows_per_block))
    df = df.withColumns({"_block": block_of(F.col(order), blocks), "_value": value})
    sums = df.groupBy(group, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(group).alias("_group"), F.col("_block").alias("_start_block"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    inside = (
        Window.partitionBy(group, "_block").orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(
            starts,
            F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_start_block")),
        )
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_block", "_value", "_start", "_group", "_start_block")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), the root being the smallest node it reaches.

    Alternates large-star and small-star contraction, storing the edges of each round in the shared
    folder: the rounds are logarithmic in number, no round has more edges than the one before, and
    no group of nodes is ever gathered in one task.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first())

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    edges = write_table(ordered(edges.select("u", "v")), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"))
        large = ordered(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        low = lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_table(
            ordered(small.unionByName(low.select("u", F.col("m").alias("v")))), "edges"
        )
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
