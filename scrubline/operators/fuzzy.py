"""Merging spelling variants of category values.

All work is on distinct values and their stems, never on rows. Which stems are alike is found by
equi-joins on keys chosen so that no similar pair is lost and no block is paired with itself:

* similarity ratio: prefix filtering on letter pairs, rarest first (as in set-similarity joins);
* one value begins the other: every prefix of a stem is looked up among the stems;
* word by word prefixes: stems are matched by the first letters of all their words; where many share
  these, the trees of their words are walked in step, place by place;
* equal but for spaces: each stem is tied to one representative, not to its whole group.

Groups are the connected components, found by star contraction with one stored table per round. A
long vocabulary is linked in two steps, so that crowds of alike values, such as numbered names, are not
paired with each other: what cheap links connect is one group already, and by ratio only stems of
different groups are compared, in blocks that hold more than one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.columns import col, present
from scrubline.functions import vocab
from scrubline.functions.categories import (
    expand_and_stem, indel_ratio, is_negation_pair, is_token_prefix_variant, ratio_at_least,
)
from scrubline.storage import write_table

# Stems with the same first letters of all words that are compared with each other at once.
FEW_STEMS = 64
# Replacements up to this number are written into the projection; more go through a join.
MAX_LITERALS = 200
# Tables up to this many rows stand in one partition, where their joins and groupings need no exchange;
# at most half a million pairs can come of them.
SHORT_VOCABULARY = 1_000
# How many of the values before it in sorted order a stem is compared with first.
NEIGHBOURS = 2
STEM_LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"


def vocabulary(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(column, value, n, stem): every distinct value of the columns with its row count."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols
    ])
    return (
        df.select(F.inline(entries)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("stem", expand_and_stem(F.col("value")))
    )


def _stored_vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """The vocabulary as a stored table; a short one as a single partition, so that the joins on
    it need no shuffle.
    """
    words = write_table(vocabulary(df, cols), "vocabulary")
    return words.coalesce(1) if words.count() <= SHORT_VOCABULARY else words


def _stems(words: DataFrame) -> DataFrame:
    """Distinct comparable stems; text without any Latin letter or digit has none."""
    return words.where(F.col("stem") != "").select("column", "stem").distinct()


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    joined = left.join(right, keys)
    if condition is not None:
        joined = joined.where(condition)
    a, b = F.col("a"), F.col("b")
    return joined.where(a != b).select(
        "column", F.least(a, b).alias("stem_a"), F.greatest(a, b).alias("stem_b")
    )


def _letter_set(stem: str) -> Column:
    """One bit for each of the 37 characters a stem can have."""
    places = F.transform(F.split(stem, ""), lambda x: F.instr(F.lit(STEM_LETTERS), x))
    return F.aggregate(places, F.lit(0).cast("long"), lambda seen, i: seen.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i)
    ))


def _ratio_pairs(stems: DataFrame, threshold: float) -> DataFrame:
    """Pairs with ``indel_ratio >= threshold``; with a column ``root``, those of different roots.

    Deleting a letter of ``a`` breaks at most two of its letter pairs and inserting one breaks at
    most one. The threshold limits both, hence how many letter pairs of a stem the other may
    lack; ordered rarest first, two alike stems share one among the first (lacking + 1). Below 85
    short stems may share no letter pair, so single letters are used there.
    """
    t = threshold / 100.0
    size = 2 if threshold >= 85 else 1
    length = F.length("stem")
    # Only lengths that occur are paired, so a very long stem without any of like length costs nothing.
    lengths = stems.where(length >= (size + 1 if size > 1 else 1)).groupBy(
        "column", length.alias("len")).agg(F.count(F.lit(1)).alias("n"))
    reach = lengths.select("column", F.col("len").alias("len_b"), "n", F.explode(F.sequence(
        F.ceil(F.col("len") * t / (2.0 - t) - 1e-9).cast("int"), "len")).alias("other"))
    matched = write_table(reach.join(
        lengths.select("column", F.col("len").alias("other")), ["column", "other"]
    ).where("other < len_b or n > 1").select("column", "len_b", "other"), "lengths")
    compared = matched.select("column", F.col("len_b").alias("len")).unionByName(
        matched.select("column", F.col("other").alias("len"))).distinct()
    rooted = "root" in stems.columns
    parted = stems.withColumn("len", length).join(compared, ["column", "len"], "left_semi").select(
        "column", "stem", F.col("root") if rooted else F.lit("").alias("root"), "len",
        _letter_set("stem").alias("letters"), _numbered_parts(F.col("stem"), F.lit(size)).alias("of"),
    )
    tokens = parted.select(
        "column", "stem", "root", "len", "letters", F.col("of.marks").alias("marks"),
        F.explode("of.parts").alias("token"))
    frequency = tokens.groupBy("column", "token").agg(F.count(F.lit(1)).alias("seen"))
    lacking = (2.0 * size) * F.col("len") * (1.0 - t) / (2.0 - t)
    rank = F.row_number().over(W.partitionBy("column", "stem").orderBy("seen", "token"))
    first = (
        tokens.join(frequency, ["column", "token"])
        .withColumn("rank", rank)
        .where(F.col("rank") <= F.floor(lacking + 1e-9) + 1)
    )
    if rooted:  # blocks of one group have nothing left to link
        first = write_table(first, "blocks")
        mixed = first.groupBy("column", "token").agg(
            F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        first = first.join(mixed.select("column", "token"), ["column", "token"], "left_semi")
    shorter = first.select(
        "column", "token", F.col("len").alias("other"), F.col("stem").alias("a"),
        F.col("root").alias("root_a"), F.col("letters").alias("letters_a"), F.col("marks").alias("marks_a"),
    )
    # The longer stem names the lengths its partner may have: blocks are (token, length).
    longer = first.select(
        "column", "token", F.col("stem").alias("b"), F.col("root").alias("root_b"), F.col("len").alias("len_b"),
        "letters", "marks",
    ).join(matched, ["column", "len_b"])
    once = (F.col("other") < F.col("len_b")) | (F.col("a") < F.col("b"))
    # Each letter that only one side has costs an insertion or a deletion, and one of these changes at most
    # three letter pairs (one letter).
    edits = (F.col("other") + F.col("len_b")) * (1.0 - t) + 1e-9
    near = F.bit_count(F.col("letters").bitwiseXOR(F.col("letters_a"))) <= edits
    near &= F.bit_count(F.col("marks").bitwiseXOR(F.col("marks_a"))) <= (2 * size - 1) * edits
    if rooted:
        once &= F.col("root_a") != F.col("root_b")
    candidates = _pairs(shorter, longer, ["column", "token", "other"], once & near)
    # Checked where they are joined: only true pairs go on to the exchange that drops repeats.
    return candidates.where(ratio_at_least(F.col("stem_a"), F.col("stem_b"), threshold)).distinct()


@F.pandas_udf(T.StructType().add("parts", T.ArrayType(T.StringType())).add("marks", T.LongType()))
def _numbered_parts(stem: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Runs of ``size`` letters; the second "an" of "banana" is another token than the first.

    ``marks`` has a bit for the hash of each of them.
    """
    out = []
    for text, n in zip(stem, size):
        seen: dict[str, int] = {}
        parts = []
        marks = 0
        for i in range(len(text) - n + 1):
            part = text[i:i + n]
            seen[part] = times = seen.get(part, -1) + 1
            parts.append(f"{part}#{times}")
            marks |= 1 << zlib.crc32(parts[-1].encode()) % 63
        out.append((parts, marks))
    return pd.DataFrame(out, columns=["parts", "marks"])


def _beginnings(texts: DataFrame, keys: list[str], text: str, least: int) -> DataFrame:
    """(keys, text, form): beginnings of each text, of the lengths that other texts of its keys have."""
    lengths = texts.groupBy(*keys).agg(F.collect_set(F.length(text)).alias("lengths"))
    return texts.join(lengths, keys).select(*keys, text, F.explode(F.filter(
        "lengths", lambda n: (n >= least) & (n < F.length(text)))).alias("n")).select(
            *keys, text, F.left(F.col(text), F.col("n")).alias("form"))


def _prefix_pairs(stems: DataFrame) -> DataFrame:
    beginnings = _beginnings(stems.select("column", F.col("stem").alias("b")), ["column"], "b", vocab.MIN_PREFIX_LENGTH)
    return _pairs(
        stems.select("column", F.col("stem").alias("a")), beginnings.withColumnRenamed("form", "a"), ["column", "a"])


def _token_prefix_pairs(stems: DataFrame) -> DataFrame:
    """Pairs of equally many words (two or more), each word beginning its counterpart or the other way round.

    Such words have their first letters in common, so stems are brought together by the first letters
    of all their words. The few that share these are compared; where many do, the trees of their words
    are walked.
    """
    least = vocab.MIN_TOKEN_PREFIX_LENGTH
    words = F.split(F.col("stem"), " ")
    opened = stems.select("column", "stem", words.alias("words")).where(
        (F.size("words") >= 2) & F.forall("words", lambda w: F.length(w) >= least)
    ).select("column", "stem", "words", F.array_join(F.transform("words", lambda w: F.left(w, F.lit(least))), " ").alias("opening"))
    keys = ["column", "opening"]
    sizes = opened.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = write_table(opened.join(sizes, keys), "openings")
    few = shared.where(F.col("n") <= FEW_STEMS)
    found = _pairs(
        few.select(*keys, F.col("stem").alias("a")), few.select(*keys, F.col("stem").alias("b")), keys,
        (F.col("a") < F.col("b")) & is_token_prefix_variant(F.col("a"), F.col("b")))
    many = shared.where(F.col("n") > FEW_STEMS).select(*keys, "stem", "words")
    return found if many.isEmpty() else found.unionByName(_walked_pairs(many, keys))


def _walked_pairs(stems: DataFrame, keys: list[str]) -> DataFrame:
    """The word-by-word pairs among (keys, stem, words), found by walking the words of each group as a tree.

    A node is what a stem has at the first places; two nodes stay together as long as their words are
    related at every place. From a pair of nodes the next words are joined through the beginnings
    that exist among the words of the place, in either direction. Places at which a group has
    one word only are left out. One stored table a place; its rows are pairs of beginnings that are alike.
    """
    least = vocab.MIN_TOKEN_PREFIX_LENGTH
    placed = stems.select(*keys, "stem", F.posexplode("words").alias("place", "word"))
    places = placed.groupBy(*keys, "place").agg(F.min("word").alias("low"), F.max("word").alias("high")).where("low <> high")
    step = F.row_number().over(W.partitionBy(*keys).orderBy("place"))
    last = F.count(F.lit(1)).over(W.partitionBy(*keys))
    places = places.select(*keys, "place", step.alias("step"), last.alias("last"))
    lists = placed.join(places, [*keys, "place"]).groupBy(*keys, "stem", "last").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("step", "word"))), lambda s: s["word"]).alias("words"))
    nodes = F.aggregate("words", F.array(F.lit("")), lambda done, w: F.concat(
        done, F.array(F.md5(F.concat(F.element_at(done, -1), F.lit(" "), w)))))
    tree = write_table(lists.select(*keys, "stem", "last", "words", nodes.alias("nodes")).select(
        *keys, "last", F.col("stem"), F.element_at("nodes", -1).alias("leaf"), F.explode(F.arrays_zip(
            F.sequence(F.lit(1), F.col("last").cast("int")).alias("step"), F.slice("nodes", F.lit(1), F.col("last").cast("int")).alias("parent"),
            F.slice("nodes", F.lit(2), F.col("last").cast("int")).alias("node"), F.col("words").alias("word"))).alias("at"),
    ).select(*keys, "last", "stem", "leaf", "at.*"), "word-tree")
    known = tree.select(*keys, "step", "word").distinct()
    shorter = write_table(_beginnings(known, [*keys, "step"], "word", least).join(
        known.withColumnRenamed("word", "form"), [*keys, "step", "form"]), "beginnings")
    pairs = tree.select(*keys, "last", F.lit("").alias("a"), F.lit("").alias("b")).distinct()
    done = None
    for at in range(1, (tree.agg(F.max("last")).first()[0] or 0) + 1):
        branch = tree.where(F.col("step") == at).select(*keys, "parent", "node", "word").distinct()
        forms = shorter.where(F.col("step") == at).select(*keys, "word", "form")
        either = forms.unionByName(branch.select(*keys, "word", F.col("word").alias("form")).distinct())

        def extended(pairs: DataFrame, left: str, right: str, forms: DataFrame) -> DataFrame:
            """The left node goes on with a word and the right one with a form of it."""
            on = pairs.join(branch.withColumnsRenamed({"parent": left, "node": "x"}), [*keys, left]).join(forms, [*keys, "word"])
            on = on.select(*keys, "last", right, "x", "form")
            other = branch.withColumnsRenamed({"parent": right, "node": "y", "word": "form"})
            return on.join(other, [*keys, right, "form"]).select(
                *keys, "last", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

        pairs = write_table(extended(pairs, "a", "b", either).unionByName(
            extended(pairs.where("a <> b"), "b", "a", forms)).distinct(), "word-pairs")
        ended = pairs.where((F.col("last") == at) & (F.col("a") != F.col("b"))).select(*keys, "a", "b")
        done = ended if done is None else done.unionByName(ended)
        pairs = pairs.where(F.col("last") > at)
    leaves = tree.select(*keys, "leaf", "stem").distinct()
    named = done.join(leaves.withColumnsRenamed({"leaf": "a", "stem": "stem_x"}), [*keys, "a"]).join(
        leaves.withColumnsRenamed({"leaf": "b", "stem": "stem_y"}), [*keys, "b"])
    return named.select("column", F.least("stem_x", "stem_y").alias("stem_a"), F.greatest("stem_x", "stem_y").alias("stem_b"))


def _spacing_pairs(stems: DataFrame) -> DataFrame:
    """Each stem tied to the smallest stem that is equal but for spaces."""
    solid = stems.withColumn("solid", F.replace("stem", F.lit(" "), F.lit("")))
    first = solid.groupBy("column", "solid").agg(F.min("stem").alias("b"))
    return _pairs(solid.withColumnRenamed("stem", "a"), first, ["column", "solid"])


def stem_pairs(stems: DataFrame, threshold: float = 85) -> DataFrame:
    """(column, stem_a, stem_b) of all alike stems, opposites excepted.

    Stems that differ in spaces only are listed through their representative.
    """
    found = (
        _ratio_pairs(stems, threshold)
        .unionByName(_prefix_pairs(stems))
        .unionByName(_token_prefix_pairs(stems))
        .unionByName(_spacing_pairs(stems))
    )
    return found.where(~is_negation_pair(F.col("stem_a"), F.col("stem_b"))).distinct()


def _sorted_pairs(stems: DataFrame, threshold: float) -> DataFrame:
    """Alike pairs among stems that are close in sorted order, read forwards or backwards.

    Only some of the pairs, and as many as stems at most per order and distance. The order is that of
    ranges of values, each in a task of its own; the ends of two ranges are not compared.
    """
    found = None
    for order in (F.col("stem"), F.reverse("stem")):
        ranges = stems.select("column", "stem", order.alias("order")).repartitionByRange("column", "order")
        line = W.partitionBy("part").orderBy("column", "order")
        before = ranges.withColumn("part", F.spark_partition_id()).select(
            F.col("column"), F.col("stem").alias("b"), F.array(*[
                F.struct(F.lag("column", i).over(line).alias("of"), F.lag("stem", i).over(line).alias("a"))
                for i in range(1, NEIGHBOURS + 1)]).alias("last")
        ).select("column", "b", F.explode("last").alias("before"))
        pairs = before.where(F.col("before.of") == F.col("column")).select(
            "column", F.least("b", "before.a").alias("stem_a"), F.greatest("b", "before.a").alias("stem_b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.where(ratio_at_least(F.col("stem_a"), F.col("stem_b"), threshold))


def linked_groups(stems: DataFrame, threshold: float = 85) -> DataFrame:
    """(column, stem, root): the groups of ``stem_pairs`` without listing its pairs.

    Stems that begin one another, differ in spaces only or are neighbours in sorted order are linked
    first. Pairs by ratio are then sought between different groups alone, so numbered names cost what
    their number does, not its square. Stems of no pair may be missing.
    """
    stems = write_table(stems, "stems")
    opposite = is_negation_pair(F.col("stem_a"), F.col("stem_b"))
    linked = _prefix_pairs(stems).unionByName(_token_prefix_pairs(stems)).unionByName(
        _spacing_pairs(stems)).unionByName(_sorted_pairs(stems, threshold))
    groups = connected_groups(linked.where(~opposite).distinct())
    rooted = write_table(stems.join(groups, ["column", "stem"], "left").select(
        "column", "stem", F.coalesce("root", "stem").alias("root")), "linked")
    names = rooted.select("column", "stem", "root")
    across = _ratio_pairs(rooted, threshold).where(~opposite)
    across = across.join(names.withColumnsRenamed({"stem": "stem_a", "root": "root_a"}), ["column", "stem_a"]).join(
        names.withColumnsRenamed({"stem": "stem_b", "root": "root_b"}), ["column", "stem_b"]
    ).select("column", F.least("root_a", "root_b").alias("stem_a"), F.greatest("root_a", "root_b").alias("stem_b"))
    joined = connected_groups(across.distinct()).select("column", F.col("stem").alias("root"), F.col("root").alias("last"))
    return rooted.join(joined, ["column", "root"], "left").select(
        "column", "stem", F.coalesce("last", "root").alias("root"))


def similar_pairs(df: DataFrame, column: str, threshold: float = 85) -> DataFrame:
    """(stem_a, stem_b, ratio) of the alike values of a column.

    Values of one stem are alike by definition and stand as that one stem.
    """
    words = _stored_vocabulary(df, [column])
    return stem_pairs(_stems(words), threshold).select(
        "stem_a", "stem_b", indel_ratio(F.col("stem_a"), F.col("stem_b")).alias("ratio")
    )


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(column, stem, root) with the smallest member as root, for every stem in a pair.

    Alternating large-star and small-star contraction: a logarithmic number of rounds, each with
    at most as many edges as before, whatever the shape of the groups.
    """
    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The stored edges, with their number and a checksum."""
        e = write_table(e, "edges")
        check = F.sum(F.xxhash64("column", "u", "v").cast("decimal(38,0)"))
        state = tuple(e.agg(F.count(F.lit(1)), check).first())
        return (e.coalesce(1) if state[0] <= SHORT_VOCABULARY else e), state

    def star(both: DataFrame, keep_larger: bool) -> DataFrame:
        lowest = both.groupBy("column", "u").agg(F.min("v").alias("m"))
        lowest = lowest.withColumn("m", F.least("u", "m"))
        linked = both.join(lowest, ["column", "u"])
        moved = linked.select("column", F.col("v").alias("u"), F.col("m").alias("v"))
        if keep_larger:  # only larger neighbours go to the lowest one
            larger = linked.where(F.col("v") > F.col("u"))
            return larger.select("column", F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(lowest.select("column", "u", F.col("m").alias("v")))

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(
            "column", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    edges, before = stored(
        pairs.select("column", F.col("stem_b").alias("u"), F.col("stem_a").alias("v"))
    )
    while before[0]:
        mirrored = edges.unionByName(
            edges.select("column", F.col("v").alias("u"), F.col("u").alias("v"))
        )
        large = ordered(star(mirrored, True))
        edges, after = stored(ordered(star(large, False)))
        if after == before:
            break
        before = after
    roots = edges.select("column", F.col("u").alias("stem"), F.col("v").alias("root"))
    own = edges.select("column", F.col("v").alias("stem"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)


def fit_fuzzy(df: DataFrame, cols: Iterable[str], threshold: float = 85) -> DataFrame:
    """(column, value, canonical) for the values that change, all columns in one go.

    The canonical spelling is the most frequent of its group, ties going to the smallest text.
    """
    names = present(df, cols)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, canonical string")
    words = _stored_vocabulary(df, names)
    stems = _stems(words)
    if stems.count() <= SHORT_VOCABULARY:  # as few pairs as a task can list
        groups = connected_groups(stem_pairs(stems, threshold))
    else:
        groups = linked_groups(stems, threshold)
    rooted = words.join(groups, ["column", "stem"], "left").withColumn(
        "root",
        # A value without a stem is a group of its own; no stem contains the mark.
        F.when(F.col("stem") == "", F.concat(F.lit("="), F.col("value")))
        .otherwise(F.coalesce("root", "stem")),
    )
    best = rooted.groupBy("column", "root").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical")
    )
    changed = rooted.join(best, ["column", "root"]).where(F.col("value") != F.col("canonical"))
    return write_table(changed.select("column", "value", "canonical"), "spellings")


def apply_fuzzy(df: DataFrame, mapping: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace values by their canonical spelling; unmapped values and NULLs stay.

    A short list becomes part of the projection. A longer one is joined per column without a
    hint, so Spark broadcasts it only if it is small and splits hot values otherwise.
    """
    names = present(df, cols)
    sizes = {r["column"]: r["count"] for r in mapping.groupBy("column").count().collect()}
    short = [c for c in names if 0 < sizes.get(c, 0) <= MAX_LITERALS]
    pairs: dict[str, dict[str, str]] = {c: {} for c in short}
    for r in mapping.where(F.col("column").isin(short)).collect() if short else []:
        pairs[r["column"]][r["value"]] = r["canonical"]
    df = df.withColumns({c: replaced(col(c), p) for c, p in pairs.items()}) if pairs else df
    order = df.columns
    for c in names:
        if sizes.get(c, 0) > MAX_LITERALS:
            part = mapping.where(F.col("column") == c).select(
                F.col("value").alias("__value__"), F.col("canonical").alias("__canonical__")
            )
            df = df.join(part, col(c) == F.col("__value__"), "left").withColumn(
                c, F.coalesce("__canonical__", col(c))
            ).select(*[col(o) for o in order])
    return df


def replaced(c: Column, pairs: dict[str, str]) -> Column:
    """One membership test per canonical value."""
    variants: dict[str, list[str]] = {}
    for value, canonical in pairs.items():
        variants.setdefault(canonical, []).append(value)
    out = None
    for canonical, values in sorted(variants.items()):
        test = c.isin(*values)
        out = F.when(test, canonical) if out is None else out.when(test, canonical)
    return out.otherwise(c) if out is not None else c


def fuzzy_standardize(df: DataFrame, column: str, threshold: float = 85) -> DataFrame:
    """Give all spelling variants in a column the most frequent spelling of their group."""
    return apply_fuzzy(df, fit_fuzzy(df, [column], threshold), [column])
