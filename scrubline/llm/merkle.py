"""A Merkle manifest of a table: one digest for all rows, and a proof for each.

Rows are leaves, in order within groups; runs of ``arity`` nodes become their parent's digest, level by
level, up to one subroot a group, and the subroots likewise one root. At each level the nodes join
themselves at their siblings' computed places (XOR where runs are pairs, else slot offsets), so that
a node has what stands beside it in a proof, and the node in slot zero emits the parent. Every level
is stored. Proofs are then handed down, from the root to the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.storage import write_table

#: A row that stands many times in a table is numbered in pieces of so many.
COPIES_A_PIECE = 1 << 16


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes, a colon, itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


@dataclass
class Manifest:
    """What ``build`` stored.

    ``levels`` has for each level (group, place, nodes, digest, others): a node, the number of its
    group's nodes, and the other digests of its run in order. Level 0 also has the rows' own
    columns. ``single`` are the leaves that are alone in their group. ``subroots`` has (group,
    height, subroot, proof) where ``proof`` leads from the subroot to the root. ``root`` is None
    for an empty table.
    """

    arity: int
    levels: list[DataFrame]
    single: DataFrame
    subroots: DataFrame
    root: str | None
    columns: list[str]


def _numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``before``, the copies of earlier rows of the group, and ``nodes``, those of all.

    Also the largest number of nodes. Rows are dealt out by ranges of (group, order); each range
    counts for itself, and only one count a range and group meets in one place.
    """
    ranged = write_table(
        rows.repartitionByRange(group, *order).withColumn("range_", F.spark_partition_id()), "ranges"
    )
    counts = ranged.groupBy(group, "range_").agg(F.sum("copies").alias("sum_"))
    earlier = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group, "range_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("start_"),
        F.sum("sum_").over(Window.partitionBy(group)).alias("nodes"),
    )
    inside = (
        Window.partitionBy(group, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranged.join(starts, [group, "range_"]).withColumn(
        "before", F.col("start_") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    ).drop("range_", "start_")
    most = starts.agg(F.max("nodes")).first()[0]
    return placed, most or 0


def _one_by_one(rows: DataFrame, group: str) -> DataFrame:
    """A row for each copy, with its place; a row of very many copies is dealt out in pieces."""
    size = F.lit(COPIES_A_PIECE).cast("long")
    pieces = rows.withColumn("piece_", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / size).cast("long")))).withColumns({
            "from_": F.col("piece_") * size,
            "to_": F.least(F.col("copies"), (F.col("piece_") + 1) * size) - 1,
        })
    return pieces.repartition(group, "before", "piece_").withColumn(
        "place", F.explode(F.sequence(F.col("before") + F.col("from_"), F.col("before") + F.col("to_")))
    ).drop("before", "copies", "piece_", "from_", "to_")


def _with_siblings(nodes: DataFrame, group: str, arity: int) -> DataFrame:
    """``nodes`` with ``others``, joined with themselves at each sibling's place."""
    slots = range(1, arity)
    for shift in slots:
        beside = nodes.selectExpr(f"{group} as group_", "place as place_", f"digest as beside{shift}")
        there = "place ^ 1L" if arity == 2 else f"place - place % {arity} + (place + {shift}) % {arity}"
        nodes = nodes.join(beside, F.expr(f"{group} = group_ and {there} = place_"), "left").drop("group_", "place_")
    found = ", ".join(f"struct((place + {s}) % {arity} as slot, beside{s} as digest)" for s in slots)
    return nodes.withColumn("others", F.expr(
        f"transform(array_sort(filter(array({found}), s -> s.digest is not null)), s -> s.digest)"
    )).drop(*[f"beside{s}" for s in slots])


def _raise(nodes: DataFrame, most: int, group: str, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the trees over ``nodes``, and the subroots (group, digest, height) of each height."""
    levels, tops = [], [nodes.where("nodes = 1").select(group, "digest", F.lit(0).alias("height"))]
    while most > 1:
        level = write_table(
            _with_siblings(nodes.where("nodes > 1"), group, arity), f"merkle-level-{len(levels)}"
        )
        levels.append(level)
        nodes = level.where(f"place % {arity} = 0").selectExpr(
            group, f"(nodes + {arity - 1}) div {arity} as nodes", f"place div {arity} as place",
            "sha2(cast(concat(digest, array_join(others, '')) as binary), 256) as digest",
        )
        tops.append(nodes.where("nodes = 1").selectExpr(group, "digest", f"{len(levels)} as height"))
        most = -(-most // arity)
    return levels, tops


def build(
    df: DataFrame, leaf: Column, group: Column, order: list[str], also: dict[str, Column] | None = None,
    arity: int = 2,
) -> Manifest:
    """Raise the trees over ``df``.

    ``leaf`` is a row's digest, ``group`` its group as a string (null is a group, the first one) and
    ``order`` the columns by which rows ascend in it, nulls first; rows that are equal there ascend by
    their digest and by ``also``, further columns that are kept. Equal rows are leaves of their own
    with places in a row. Digests alone are moved, never the texts; a group or a repeated row that
    holds most of the table is dealt out over all tasks. An empty table has no root.
    """
    if arity < 2:
        raise ValueError("runs have two nodes or more")
    also = also or {}
    kept = [*order, *also]
    coded = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    leaves = df.select(coded.alias("group_key"), *order, leaf.alias("digest"), *[c.alias(n) for n, c in also.items()])
    leaves = leaves.groupBy(*leaves.columns).agg(F.count(F.lit(1)).alias("copies"))
    ranked, most = _numbered(leaves, "group_key", [*order, "digest", *also])
    nodes = write_table(_one_by_one(ranked, "group_key"), "leaves")
    levels, tops = _raise(nodes, most, "group_key", arity)
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    # The trees' tops are leaves of one more tree.
    subroots = subroots.withColumns({"all_": F.lit("all"), "copies": F.lit(1).cast("long")})
    ranked, most = _numbered(subroots, "all_", ["group_key"])
    placed = write_table(ranked.drop("copies").withColumnRenamed("before", "place"), "subroots")
    upper, last = _raise(placed, most, "all_", arity)
    top = last[-1].first()
    proofs = placed.where("nodes = 1").select(
        "group_key", "height", F.col("digest").alias("subroot"), F.expr(f"cast(array() as {STEPS})").alias("proof"))
    if upper:
        handed = _hand_down(upper, None, "all_", arity)
        proofs = handed.select("group_key", "height", F.col("digest").alias("subroot"), "proof")
    return Manifest(
        arity, levels, nodes.where("nodes = 1"), write_table(proofs, "subroot-proofs"),
        top["digest"] if top else None, kept,
    )


#: A proof: for each level the node's slot in its run and the run's other digests.
STEPS = "array<struct<slot:int,others:array<string>>>"


def _hand_down(levels: list[DataFrame], tops: DataFrame | None, group: str, arity: int) -> DataFrame:
    """The rows of the lowest level with ``proof``: the way to the top, and on from there.

    ``tops`` (group, height, subroot, proof) says how it goes on above each tree's top.
    """
    above = None
    for height in range(len(levels), 0, -1):
        level = levels[height - 1]
        up = [f"{group} as group_", "place as place_", "subroot", "proof as above_"]
        ends = above.selectExpr(*up) if above is not None else None
        if tops is not None:
            top = tops.where(f"height = {height}").selectExpr(up[0], "0L as place_", *up[2:])
            ends = top if ends is None else ends.unionByName(top)
        if ends is None:
            joined = level.selectExpr("*", "cast(null as string) as subroot", f"cast(array() as {STEPS}) as above_")
        else:
            joined = level.join(ends, F.expr(f"{group} = group_ and place div {arity} = place_")).drop("group_", "place_")
        step = f"concat(array(struct(cast(place % {arity} as int) as slot, others)), above_) as proof"
        kept = [c for c in level.columns if c != "others"] if height == 1 else [group, "place"]
        above = joined.selectExpr(*kept, "subroot", step)
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf: the kept columns, ``leaf``, ``place`` in its group, ``subroot``, ``root``, ``proof``.

    A proof lists, from the leaf to the root, the slot of the node in its run and the run's other
    digests in order.
    """
    columns = [*manifest.columns, F.col("digest").alias("leaf"), "group_key", "place", "subroot", "proof"]
    alone = manifest.single.join(manifest.subroots.where("height = 0").drop("height"), "group_key").select(*columns)
    if manifest.levels:
        alone = alone.unionByName(
            _hand_down(manifest.levels, manifest.subroots, "group_key", manifest.arity).select(*columns))
    return alone.withColumn("root", F.lit(manifest.root))


def siblings_digest(proof: Column) -> Column:
    """The digest of all of a proof's digests, from the leaf up."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to; it is the manifest's if neither was tampered with."""
    def up(node: Column, step: Column) -> Column:
        others, slot = step["others"], step["slot"]
        return digest(
            F.array_join(F.slice(others, F.lit(1), slot), ""), node,
            F.array_join(F.slice(others, slot + 1, F.greatest(F.size(others) - slot, F.lit(0))), ""),
        )

    return F.aggregate(proof, leaf, up)
