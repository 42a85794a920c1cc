"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import with_running_total, word_count
from scrubline.storage import write_table

#: Weights of the sources in the order of their code points, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2.0
BLOCK_WORDS = 1024
GOLDEN = (math.sqrt(5) - 1) / 2


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """(source, source_size, target), one row per source of ``sizes`` (source, size).

    Targets split ``share`` of all words by weight; none is above ``max_repeats`` times its source,
    and what is cut off is shared again by weight until none is above. In the order of size per
    weight the sources that are cut off come first, so running sums give the level at which the
    rest are filled. Only one row per source meets in one task.
    """
    # Nulls come last: the flag is part of the order.
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per_source.withColumn(
        "_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ).withColumn("_weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int")
    )).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    leveled = numbered.withColumn(
        # What is left per unit of weight if exactly the sources before this one are cut off.
        "_level", (
            F.sum("source_size").over(whole) * F.lit(float(share))
            - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
        ) / F.sum("_weight").over(rest),
    )
    # The first source that is not cut off sets the level; later ones give lower values.
    level = F.max(
        F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    ).over(whole)
    return leveled.withColumn("_fill", level).select(
        "source", "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_fill") * F.col("_weight"), F.col("_cap"))).alias("target"),
    )


def slot_table(needs: DataFrame, spare: float = 1.1) -> DataFrame:
    """(source, rank, slot): the slots of the schedule, ranked per source.

    ``needs`` has (source, blocks). Slot t takes the point frac(t * golden ratio); the source whose
    interval of cumulative weights holds the point gets the slot. A few more slots are drawn than
    there are blocks, since the points meet each weight only to within the logarithm of their
    number.
    """
    spark = needs.sparkSession
    order = Window.orderBy(F.col("source").isNull(), "source")
    ends = F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("blocks").over(Window.partitionBy())
    intervals = write_table(needs.where("blocks > 0").select(
        F.col("source"), (F.row_number().over(order) - 1).alias("_no"),
        ((ends - F.col("blocks")) / total).alias("low"), (ends / total).alias("high"),
        total.alias("total"),
    ), "intervals")
    first, sources = intervals.agg(F.max("total"), F.count(F.lit(1))).first()
    if not first:
        return spark.createDataFrame([], needs.schema[0].simpleString().replace(":", " ") + ", rank long, slot long")
    slots = int(first * spare) + 64
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.expr(f"pmod((id + 1) * {GOLDEN!r}D, 1D)").alias("point")
    )
    # Each point lies in a grid cell; an interval is listed under the cells it touches.
    grid = max(256, 4 * sources)
    listed = intervals.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * grid).cast("int"), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)).cast("int")
    )))
    taken = points.withColumn("cell", F.floor(F.col("point") * grid).cast("int")).join(listed, "cell").where(
        "point >= low and point < high"
    ).select("source", "_no", "slot")
    # The k-th slot of a source: counted in ranges of slots, then within them.
    size = 1 << 16
    ranged = taken.withColumn("part", F.floor(F.col("slot") / size).cast("int"))
    counts = ranged.groupBy("_no", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("_no", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0)).alias("start"))
    inside = Window.partitionBy("_no", "part").orderBy("slot")
    return ranged.join(starts, ["_no", "part"]).select(
        "source", (F.col("start") + F.row_number().over(inside) - 1).alias("rank"), "slot"
    )


def mix_documents(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS,
    block_words: int = BLOCK_WORDS, seed: int = 42, number_rows: bool = False,
) -> DataFrame:
    """Pieces of the mix: (slot, doc_id, source, size, source_size, target, from_word, words, epoch).

    The documents of a source, in the order of a seeded hash, are one run of words, cut into blocks
    of ``block_words`` words. A source gives its blocks in turn, again from the start when all are
    used, until its target is reached; the last block is cut there. The k-th block goes to the
    source's k-th slot of the schedule, so any stretch of the mix holds the sources in proportion.
    A piece is the part of a document in one block: ``words`` words from word ``from_word``. Documents
    of which the mix takes nothing, empty ones among them, have one row without a slot and 0 words.

    A null source is a source of its own, the last; null texts have no words. Rows with equal id and
    text are ordered by a hash of both and count each for itself; with ``number_rows`` pieces
    also have ``row_no``, a number of their row in this run; reruns on the same rows agree.
    An empty table gives no rows; further columns are ignored. Documents are ordered in hash ranges,
    so that a source with most of the rows is dealt out over many tasks.
    """
    sizes = write_table(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("_order"),
        F.monotonically_increasing_id().alias("row_no"),
    ), "mix-sizes")
    targets = write_table(source_targets(sizes, weights, share, max_repeats), "mix-targets")
    needs = targets.select("source", F.ceil(F.col("target") / block_words).alias("blocks"))
    slots = slot_table(needs)
    placed = with_running_total(sizes, "source", "_order", ["doc_id", "size"], F.col("size"), "_at")
    placed = placed.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")

    # A source is laid end to end: epoch e covers the words from e * source_size on.
    goal = F.round("target").cast("long")
    epochs = F.sequence(F.lit(0), F.lit(math.ceil(max_repeats) - 1))
    runs = placed.withColumn("epoch", F.explode(epochs)).withColumns({
        "_from": F.col("epoch") * F.col("source_size") + F.col("_at"),
    }).withColumn("_to", F.least(F.col("_from") + F.col("size"), goal)).withColumn(
        "_words", F.greatest(F.col("_to") - F.col("_from"), F.lit(0))
    )
    pieces = runs.where("_words > 0").withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words)
    ))).withColumns({
        "_low": F.greatest(F.col("_from"), F.col("_block") * block_words),
        "_high": F.least(F.col("_to"), (F.col("_block") + 1) * block_words),
    })
    s = slots.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"), "slot")
    joined = pieces.join(s, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_rank")), "left")
    columns = [*(["row_no"] if number_rows else []), "doc_id", "source", "size", "source_size", "target"]
    used = joined.select(
        # Blocks beyond the drawn slots, if any, follow at the end in the order of their rank.
        F.coalesce("slot", F.lit(1 << 60) + F.col("_block")).alias("slot"), *columns,
        (F.col("_low") - F.col("_from")).alias("from_word"), (F.col("_high") - F.col("_low")).alias("words"),
        "epoch",
    )
    unused = runs.where("epoch = 0 and _words <= 0").select(
        F.lit(None).cast("long").alias("slot"), *columns, F.lit(0).cast("long").alias("from_word"),
        F.lit(0).cast("long").alias("words"), "epoch",
    )
    return used.unionByName(unused)


def words_between(text: Column, start: Column, count: Column) -> Column:
    """The words of ``text`` from word ``start`` on, joined by spaces: the text of a piece."""
    return F.array_join(F.slice(F.filter(
        F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), (start + 1).cast("int"), count.cast("int")), " ")


def whole_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in no particular order.

    The mix is made of whole documents here: one whose words are cut by the end of its source's
    target is taken whole. A document the mix does not reach is left out; one it reaches twice comes
    twice. Documents without any word take no room and stay. Rows that are equal in id and text
    share their number of copies, rounded up to at least the mix's for each.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    pieces = mix_documents(docs, **options)
    taken = pieces.groupBy("doc_id", "source", "size").agg(
        F.countDistinct(F.when(F.col("words") > 0, F.col("epoch"))).alias("_copies")
    )
    source = options.get("source", "source")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"),
        F.col(source).alias("from"), word_count(F.col(text)).alias("words"),
    )
    joined = rows.join(
        taken, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source"))
        & (F.col("words") == F.col("size")), "left",
    )
    copies = F.when(F.col("words") == 0, F.lit(1)).otherwise(F.coalesce("_copies", F.lit(0)).cast("int"))
    return joined.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
