"""Resharding by minimum-cost flow: move the fewest bytes to reach new shard capacities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.storage import new_path

OLD_SHARDS = 12
NEW_SHARDS = 16
#: Blocks a shard is cut into, and parts a block is cut into that fits nowhere whole.
BLOCKS = 1024
SUB_BLOCKS = 256
#: How far a shard may go beyond its capacity before a block is cut, as a part of the capacity.
SLACK = 1 / 64
#: Rows that stand in a table more than so often in this many, by bytes, have their copies numbered.
COMMON_ROWS = 4096
#: Copies of such a row that are given out together.
COPIES_A_PIECE = 1 << 12


def text_bytes(text: Column) -> Column:
    """Size of a document: UTF-8 bytes of its text plus 1; null has no bytes."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow from supplies to demands of least cost(i, j) per unit, by successive shortest paths.

    A graph of shards, not of data: its size is the number of old times new shards.
    """
    source, sink, n = 0, len(supply) + len(demand) + 1, len(supply) + len(demand) + 2
    edges: list[list[int]] = []  # to, capacity, cost; the reverse edge is at the index xor 1
    out: list[list[int]] = [[] for _ in range(n)]

    def add(u: int, v: int, capacity: int, price: int) -> None:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            out[a].append(len(edges))
            edges.append([b, c, p])

    for i, s in enumerate(supply):
        add(source, 1 + i, s, 0)
    for j, d in enumerate(demand):
        add(1 + len(supply) + j, sink, d, 0)
    arcs = {}
    for i, s in enumerate(supply):
        for j in range(len(demand)):
            arcs[i, j] = len(edges)
            add(1 + i, 1 + len(supply) + j, s, cost(i, j))
    while True:
        far, via = [None] * n, [None] * n
        far[source] = 0
        queue = [source]
        for u in queue:  # grows while it is read
            for e in out[u]:
                v, capacity, price = edges[e]
                if capacity and (far[v] is None or far[u] + price < far[v]):
                    far[v], via[v] = far[u] + price, e
                    queue.append(v)
        if far[sink] is None:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {k: edges[e ^ 1][1] for k, e in arcs.items() if edges[e ^ 1][1]}


@dataclass
class Resharding:
    """Where each block goes: ``moves`` maps (old shard, block, part, bit) to the new shard.

    ``cut`` are the blocks that went in parts, ``cut_again`` the parts that went in bits.
    """

    moves: dict[tuple[int, int, int, int], int]
    cut: list[tuple[int, int]]
    cut_again: list[tuple[int, int, int]]
    flow: dict[tuple[int, int], int]
    shards: int

    @property
    def affected(self) -> set[int]:
        """Shards that give or take a block; the files of the others stay as they are."""
        return {s for (old, *_), new in self.moves.items() if old != new for s in (old, new)}


def plan_transfers(
    blocks: dict[tuple[int, int, int, int], int], old_shards: int, shards: int
) -> tuple[Resharding, list[tuple[int, int, int, int]]]:
    """Destinations of blocks {(old, block, part, bit): bytes}, and those that fit nowhere whole.

    The flow says how many bytes go from each old shard to each new one. A shard's blocks, largest
    first, fill the largest amount still open, its own before others; what a shard's blocks leave
    over or under goes into the flow of the shards after it.
    """
    total = sum(blocks.values())
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    slack = SLACK * total / shards
    by_old: dict[int, list] = {i: [] for i in range(old_shards)}
    for key, size in blocks.items():
        by_old[key[0]].append((size, key))
    sizes = [sum(s for s, _ in by_old[i]) for i in range(old_shards)]
    moved = lambda i, j: int(i != j)
    flow = min_cost_flow(sizes, room, moved)
    moves, too_large = {}, []
    for i in sorted(by_old, key=lambda i: (-sizes[i], i)):
        rest = sum(sizes[k] for k in by_old if k not in {m[0] for m in moves})
        # Rounding has changed the room: make it sum up to what is left, then solve again.
        open_room = [max(0, r) for r in room]
        j = 0
        while sum(open_room) < rest:
            open_room[j % shards] += -(-(rest - sum(open_room)) // shards)
            j += 1
        left = [k for k in by_old if k not in {m[0] for m in moves} and sizes[k]]
        part = min_cost_flow([sizes[k] for k in left], open_room, lambda a, b: moved(left[a], b))
        want = {j: part.get((left.index(i), j), 0) for j in range(shards)} if i in left else {}
        for size, key in sorted(by_old[i], key=lambda b: (-b[0], b[1])):
            j = max(want, key=lambda j: (want[j], j == i, -j))
            if size > want[j] + slack:
                too_large.append(key)
            want[j] -= size
            room[j] -= size
            moves[key] = j
    return Resharding(moves, [], [], flow, shards), sorted(too_large)


def plan_resharding(rows: DataFrame, old_shards: int = OLD_SHARDS, shards: int = NEW_SHARDS) -> Resharding:
    """Sum up the blocks of ``rows`` (size, old, block, hash) and plan their transfers.

    A block is a range of text hashes of an old shard, so equal texts move together. What the driver
    holds is bounded by the number of blocks, old_shards * BLOCKS, whatever the data. A block that
    fits nowhere is summed up again in SUB_BLOCKS parts by another hash of its texts, and a part that
    still fits nowhere, such as one text with a third of all rows, in bits by the hash of its rows; at
    most shards / SLACK blocks or parts are large enough for that.
    """
    def summed(some: DataFrame) -> dict:
        found = some.groupBy("old", "block", "part", "bit").agg(F.sum("size").alias("n")).collect()
        return {(r["old"], r["block"], r["part"], r["bit"]): r["n"] for r in found}

    pieces = summed(with_parts(rows, [], []))
    plan, large = plan_transfers(pieces, old_shards, shards)
    cut, again = [k[:2] for k in large], []
    if cut:
        parts = summed(with_parts(rows, cut, []).where("part > 0"))
        pieces = {k: n for k, n in pieces.items() if k[:2] not in set(cut)} | parts
        plan, large = plan_transfers(pieces, old_shards, shards)
        again = [k[:3] for k in large if k[2] > 0]
    if again:
        bits = summed(with_parts(rows, cut, again).where("bit > 0"))
        pieces = {k: n for k, n in pieces.items() if k[:3] not in set(again)} | bits
        plan, _ = plan_transfers(pieces, old_shards, shards)
    plan.cut, plan.cut_again = cut, again
    return plan


def with_parts(rows: DataFrame, cut: list[tuple[int, int]], again: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` with the part of their block and the bit of it, which are 0 but where those are cut."""
    def listed(names: list[str], keys: list[tuple]) -> Column:
        return F.struct(*names).isin([F.struct(*[F.lit(x) for x in k]) for k in keys]) if keys else F.lit(False)

    def share(of: str) -> Column:
        return 1 + F.pmod(F.shiftright(of, 20), F.lit(SUB_BLOCKS)).cast("int")

    rows = rows.withColumn("part", F.when(listed(["old", "block"], cut), share("text_hash")).otherwise(0))
    return rows.withColumn("bit", F.when(listed(["old", "block", "part"], again), share("hash")).otherwise(0))


def with_copies_apart(rows: DataFrame, total: int, piece_bytes: int) -> DataFrame:
    """``rows`` (row, size, ..., hash) with hashes of their own for the copies of very common rows.

    Rows with one hash that have more bytes than a few pieces are folded into one row each, which is given
    out again with numbered copies; there are fewer than COMMON_ROWS such hashes.
    """
    bound = max(4 * piece_bytes, total // COMMON_ROWS)
    common = [r["hash"] for r in rows.groupBy("hash").agg(F.sum("size").alias("n")).where(F.col("n") > bound).collect()]
    if not common:
        return rows
    is_common = F.col("hash").isin(common)
    copies = F.lit(COPIES_A_PIECE).cast("long")
    runs = rows.where(is_common).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_")).withColumn(
        "run_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / copies).cast("long")))
    ).repartition("hash", "run_")
    numbered = runs.withColumn("copy_", F.explode(F.sequence(
        F.col("run_") * copies, F.least(F.col("n_"), (F.col("run_") + 1) * copies) - 1)))
    numbered = numbered.withColumn("hash", F.xxhash64("hash", "copy_")).select(rows.columns)
    return rows.where(~is_common).unionByName(numbered)


def by_text(text: str, shards: int = OLD_SHARDS) -> Column:
    """An old layout: the shard a hash of the text gives."""
    return F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col(text), F.lit(""))), F.lit(shards))


def reshard(
    df: DataFrame, text: str = "text", old_shard: Column | None = None,
    old_shards: int = OLD_SHARDS, shards: int = NEW_SHARDS, piece_bytes: int = 4 << 20,
) -> DataFrame:
    """``df`` in new shards: its columns and ``shard``, ``old_shard``, ``slot``.

    ``old_shard`` gives each row's shard so far (default: by the hash of its text). All shards end up
    near the same number of bytes (text and 1). Files are written to the shared folder, one folder a
    shard, for the shards that give or take blocks; rows of the others are taken as they are.
    ``slot`` numbers the rows of a shard from 0 without gaps.

    Equal texts stay together unless they fit in no shard; a text too large for that, even if all its
    rows are equal, is dealt out by its rows. Null and empty texts count 1 byte; equal
    rows are rows of their own. An empty table gives no rows. Columns of ``df`` named shard, old_shard
    or slot are replaced. Rows are numbered in pieces of about ``piece_bytes``, so no shard is ever
    gathered in one task.
    """
    spark = df.sparkSession
    old_shard = by_text(text, old_shards) if old_shard is None else old_shard
    kept = [c for c in df.columns if c not in ("shard", "old_shard", "slot")]
    body = F.coalesce(F.col(text), F.lit(""))
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    text_hash = F.xxhash64(F.lit(3), body)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_bytes(F.col(text)).alias("size"),
        old_shard.cast("int").alias("old"),
        F.pmod(F.shiftright(text_hash, 8), F.lit(BLOCKS)).cast("int").alias("block"), text_hash.alias("text_hash"),
        F.xxhash64(*plain).alias("hash"),
    )
    if len(plain) == len(df.columns):  # rows with maps or variants can not be compared
        rows = with_copies_apart(rows, rows.agg(F.sum("size")).first()[0] or 0, piece_bytes)
    plan = plan_resharding(rows, old_shards, shards)
    moves = spark.createDataFrame(
        [(*k, j) for k, j in sorted(plan.moves.items())], "old int, block int, part int, bit int, shard int"
    )
    # One row a block: the number of blocks is fixed, so the map is small whatever the data.
    placed = with_parts(rows, plan.cut, plan.cut_again).join(F.broadcast(moves), ["old", "block", "part", "bit"])
    mean = sum(plan.flow.values()) / shards
    pieces = max(1, int(-(-mean // piece_bytes)))
    placed = placed.withColumn("piece", F.pmod("hash", F.lit(pieces)).cast("int"))
    inside = Window.partitionBy("shard", "piece").orderBy("block", "part", "bit", "hash")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).select("row", "old", "piece", "at", "shard")
    touched = sorted(plan.affected)
    path = new_path(spark, "shards")
    (numbered.where(F.col("shard").isin(touched)) if touched else numbered.limit(0)).write.partitionBy("shard").parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path).select(numbered.columns)
    if len(touched) < shards:
        stored = stored.unionByName(numbered.where(~F.col("shard").isin(touched)))
    counts = stored.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0)).alias("start"))
    return stored.join(starts, ["shard", "piece"]).select(
        "row.*", F.col("old").alias("old_shard"), "shard", (F.col("start") + F.col("at")).alias("slot")
    )
