"""N-gram Jaccard join by vertical partitioning, and the groups its links form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import WORD, components, fresh
from scrubline.llm.tokens import mix, shingle_sets
from scrubline.storage import write_table

#: Two sets link if 5 * intersection >= 4 * union.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles of a fragment of the order, of which one task holds one.
FRAGMENT_SHINGLES = 2 << 20
#: Parts in which the overlap of a pair is counted.
PARTS = 8
#: Rounds in which each list of documents is compared with one of them only.
PIVOT_ROUNDS = 3
#: A fragment's shingles are told apart by so many bytes, so all are by 40 bits and the fragment.
BYTES = 5
#: Words of 64 bits in the sign of a set.
WORDS = 4
_LOW = np.uint64((1 << 40) - 1)
_SALT = np.uint64(0xA0761D6478BD642F)


def needed(n):
    """The fewest common shingles of a set of ``n`` and any set it links to."""
    return -(-n * NUMERATOR // DENOMINATOR)


def packed(values: np.ndarray) -> bytes:
    """Five bytes a value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(body) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :BYTES] = raw
    return out.view("<u8").ravel()


def content_key(shingles: np.ndarray) -> int:
    """64 bits of a set's content: equal sets have equal keys."""
    parts = np.concatenate([mix(shingles ^ _SALT), np.array([len(shingles)], np.uint64) * _SALT])
    return int(mix(parts.sum(keepdims=True))[0].view(np.int64))


def _keys(docs: DataFrame) -> DataFrame:
    """(_row columns, n_shingles, key), with a null key for sets without shingles."""
    kept = [f for f in docs.schema if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for _, sets in shingle_sets(batch.column(batch.num_columns - 1)):
                n += [len(s) for s in sets]
                keys += [content_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(keys, pa.int64())],
                [*[f.name for f in kept], "n_shingles", "key"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.select(*[f"`{f.name}`" for f in kept], "_text").mapInArrow(
        run, ", ".join([*fields, "n_shingles long", "key long"])
    )


def _fragments(docs: DataFrame, fragments: int) -> DataFrame:
    """The shingles of every set by fragment: ranges of equal width of the hash order.

    A row holds what the documents of a run of texts have in one fragment. Copies within the run
    are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [min(-(-f * (1 << 32) // fragments) << 32, (1 << 64) - 1) for f in range(fragments + 1)]
        edges = np.array(edges, dtype=np.uint64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0)):
                unique = {content_key(s): s for s in sets if len(s)}
                if not unique:
                    continue
                keys = np.array(list(unique), dtype=np.int64)
                sizes = np.array([len(s) for s in unique.values()], dtype=np.int32)
                cuts = np.stack([np.searchsorted(s, edges) for s in unique.values()])
                cuts[:, -1] = sizes
                rows, every = [], list(unique.values())
                for f in range(fragments):
                    n = cuts[:, f + 1] - cuts[:, f]
                    some = np.flatnonzero(n)
                    if len(some):
                        body = np.concatenate([every[i][cuts[i, f]:cuts[i, f + 1]] for i in some]) & _LOW
                        rows.append((f, keys[some], sizes[some], n[some].astype(np.int32), packed(body)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    pa.array([r[3].tobytes() for r in rows], pa.binary()),
                    pa.array([r[4] for r in rows], pa.binary()),
                ], ["fragment", "keys", "sizes", "counts", "body"])

    return docs.select("_text").mapInArrow(
        run, "fragment int, keys binary, sizes binary, counts binary, body binary"
    )


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(column)])


def _shared(segments: DataFrame, buckets: int) -> DataFrame:
    """The shingles that two or more sets have, with their number of sets, by bucket of the set's key."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fragment = key[0].as_py()
        keys, sizes = _joined(table, "keys", np.int64), _joined(table, "sizes", np.int32)
        counts = _joined(table, "counts", np.int32)
        values = np.concatenate([unpacked(v.as_buffer()) for v in table.column("body")])
        owner = np.repeat(np.arange(len(keys)), counts)
        # Copies of a set in other runs count once.
        _, first = np.unique(keys, return_index=True)
        if len(first) < len(keys):
            once = np.zeros(len(keys), bool)
            once[first] = True
            chosen = once[owner]
            values, owner = values[chosen], owner[chosen]
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
        sets = np.diff(np.concatenate([starts, [len(values)]]))
        sets = np.repeat(sets, sets)
        common = sets > 1
        values, owner, sets = values[common], owner[common], sets[common]
        bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((values, owner, bucket[owner]))
        values, owner, sets = values[order], owner[order], sets[order]
        edges = np.searchsorted(bucket[owner], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            a, z = edges[b], edges[b + 1]
            if a < z:
                at = np.flatnonzero(np.concatenate([[True], owner[a + 1:z] != owner[a:z - 1]]))
                who = owner[a:z][at]
                rows.append((
                    b, keys[who].tobytes(), sizes[who].tobytes(),
                    np.diff(np.concatenate([at, [z - a]])).astype(np.int32).tobytes(),
                    packed(values[a:z]), np.minimum(sets[a:z], 2**31 - 1).astype(np.int32).tobytes(),
                ))
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.table({
            **{n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(
                ("bucket", "keys", "sizes", "counts", "body", "sets"))},
            "fragment": pa.array([fragment] * len(rows), pa.int32()),
        })

    return segments.groupBy("fragment").applyInArrow(
        run, "bucket int, keys binary, sizes binary, counts binary, body binary, sets binary, fragment int"
    )


def _survivors(shared: DataFrame, fragments: int) -> DataFrame:
    """(key, n, lone, part, tokens, prefix, bits): sets with enough shared shingles to link to others.

    ``lone`` is the number of shingles no other set has; ``tokens`` are the shared ones of a part; ``prefix`` is the start of their global order,
    rarest first, in which a set must meet each set it links to; ``bits`` says of each of WORDS * 64
    hash values whether the set has an odd number of shared shingles with it. Both stand in one row of
    a set.
    """
    def run(table: pa.Table) -> pa.Table:
        keys, sizes = _joined(table, "keys", np.int64), _joined(table, "sizes", np.int32).astype(np.int64)
        counts, sets = _joined(table, "counts", np.int32), _joined(table, "sets", np.int32)
        token = np.concatenate([
            unpacked(v.as_buffer()) | np.uint64(f.as_py() << 40) for v, f in zip(table.column("body"), table.column("fragment"))
        ])
        own, owner = np.unique(keys, return_inverse=True)
        n = np.zeros(len(own), np.int64)
        n[owner] = sizes
        owner = np.repeat(owner, counts)
        held = np.bincount(owner, minlength=len(own))
        # Shingles that no other set has come first in the order.
        length = held - needed(n) + 1
        kept = (length > 0)[owner]
        token, owner, sets = token[kept], owner[kept], sets[kept]
        part = (token >> np.uint64(40)).astype(np.int64) * PARTS // fragments
        order = np.lexsort((token, part, owner))
        by_place = owner[order] * PARTS + part[order]
        starts = np.flatnonzero(np.concatenate([[True], by_place[1:] != by_place[:-1]])) if len(token) else np.zeros(0, int)
        ends = np.concatenate([starts[1:], [len(token)]]).astype(int)
        rare = np.lexsort((token, sets, owner))
        first = np.searchsorted(owner[rare], np.arange(len(own)))
        place = (mix(token) >> np.uint64(58)).astype(np.int64) + 64 * (token % np.uint64(WORDS)).astype(np.int64)
        odd = np.bincount(owner * WORDS * 64 + place, minlength=len(own) * WORDS * 64) % 2
        bits = np.packbits(odd.astype(np.uint8)).view("<i8").reshape(len(own), WORDS)
        rows, last = [], -1
        for a, z in zip(starts, ends):
            d = owner[order[a]]
            prefix = token[rare[first[d]:first[d] + length[d]]].view(np.int64) if d != last else []
            sign = bits[d] if d != last else []
            last = d
            rows.append((own[d], n[d], n[d] - held[d], by_place[a] % PARTS, packed_long(token[order[a:z]]), prefix, sign))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 2]
        return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(
            ("key", "n", "lone", "part", "tokens", "prefix", "bits"))})

    return shared.groupBy("bucket").applyInArrow(
        run, "key long, n long, lone long, part int, tokens binary, prefix array<long>, bits array<long>"
    )


def packed_long(tokens: np.ndarray) -> bytes:
    """Tokens in five bytes: the low 40 bits, mixed with the fragment above them."""
    return packed(np.sort(mix(tokens) & _LOW))


def _overlaps(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b, overlap) of the pairs (a, b): counted part by part, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                len(np.intersect1d(unpacked(x.as_buffer()), unpacked(y.as_buffer()), assume_unique=True))
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(both, pa.int64())], ["a", "b", "overlap"]
            )

    # The sets compared with many others, in the place of a, are joined last: they are not copied.
    side = lambda k: tokens.select(F.col("key").alias(k), "part", F.col("tokens").alias(f"{k}_tokens"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), ["a", "part"])
    partial = joined.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long, overlap long")
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _links(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Of the pairs (a, b, n_a, n_b) those that link."""
    counts = _overlaps(pairs, tokens)
    return pairs.join(counts, ["a", "b"]).where(
        F.col("overlap") * (NUMERATOR + DENOMINATOR) >= (F.col("n_a") + F.col("n_b")) * NUMERATOR
    ).select("a", "b")


def linked_sets(tokens: DataFrame) -> DataFrame:
    """(node, root): the sets of ``tokens`` that link to others, and a root for each component.

    Sets with a common prefix shingle may link. First each shingle's sets are compared with one of
    them, the one with the fewest shingles of its own, which is the nearest to what the others are
    copies of. What links becomes one component, and shingles whose sets are all in one are done. After
    a few such rounds what is left in different components is compared in full. A group of copies,
    however large, is thus compared a few times its size, while no pair that could join two components
    is left out.
    """
    spark = tokens.sparkSession
    postings = write_table(tokens.where(F.size("prefix") > 0).select(
        F.explode("prefix").alias("token"), "key", "n", "lone"), "postings")
    # The overlap is at most what either set shares with any other.
    most = F.least(F.col("n_a") - F.col("lone_a"), F.col("n_b") - F.col("lone_b"))
    possible = most * (NUMERATOR + DENOMINATOR) >= (F.col("n_a") + F.col("n_b")) * NUMERATOR
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "lone", "root")]
    tested, links, roots = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        placed = postings.withColumn("root", F.col("key")) if roots is None else postings.join(
            roots, F.col("key") == F.col("node"), "left"
        ).select("token", "key", "n", "lone", F.coalesce("root", F.col("key")).alias("root"))
        # Later rounds try others of the sets with few shingles of their own.
        rank = F.col("lone") * (64 + turn * F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(64)))
        lists = placed.groupBy("token").agg(
            F.min(F.struct(rank.alias("r"), F.xxhash64("key").alias("s"), "key", "n", "lone", "root")).alias("p"),
            F.min("root").alias("low"), F.max("root").alias("high"),
        ).where("low <> high")
        right = placed.select("token", *side("b"))
        if turn < PIVOT_ROUNDS:
            left = lists.select("token", "p.*").select("token", *side("a"))
            pairs = left.join(right, "token").where(F.col("root_a") != F.col("root_b"))
        else:
            # Each bit in which two sets differ is a shingle that only one of them has.
            bits = tokens.where(F.size("bits") > 0).select("key", *[F.col("bits")[i].alias(f"bit{i}") for i in range(WORDS)])
            still = write_table(placed.join(lists.select("token"), "token", "left_semi").join(bits, "key"), "open")
            both = [still.select("token", *side(k), *[F.col(f"bit{i}").alias(f"bit{i}_{k}") for i in range(WORDS)]) for k in "ab"]
            differ = F.col("lone_a") + F.col("lone_b")
            for i in range(WORDS):
                differ = differ + F.bit_count(F.col(f"bit{i}_a").bitwiseXOR(F.col(f"bit{i}_b")))
            pairs = both[0].join(both[1], "token").where("key_a < key_b and root_a <> root_b").where(
                differ * (NUMERATOR + DENOMINATOR) <= (F.col("n_a") + F.col("n_b")) * (DENOMINATOR - NUMERATOR))
        pairs = pairs.where(possible).select(
            F.col("key_a").alias("a"), F.col("key_b").alias("b"), "n_a", "n_b").distinct()
        if tested is not None:
            known = tested.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"))
            pairs = pairs.join(
                known, (F.least("a", "b") == F.col("_x")) & (F.greatest("a", "b") == F.col("_y")), "left_anti")
        pairs = write_table(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        found = write_table(_links(pairs, tokens), "links")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        roots = write_table(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): every row of ``docs`` with the group its links put it in.

    A document's set are its distinct five-word shingles (A-Z as a-z); with fewer words the whole
    sequence is one. Two documents link if 5 times the intersection is at least 4 times the union of
    their sets. ``component_id`` is the smallest id that links reach, its own included. Null and
    empty texts, and texts without words, have no set and link with nothing; rows without an id have
    a null component if no row with an id is in their group. Equal rows are in one group. Rows that
    share an id but not a set are documents of their own. An empty table gives no rows; further
    columns are ignored.

    Equal sets are one set from the start. The order of all shingles is cut into fragments; in each
    the number of sets of every shingle is counted by itself, and only shingles of two or more sets
    go on. Sets with too few of them can not link. Sets are known by 64 bits of their content, and
    shingles by 40 bits and their fragment.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    keyed = write_table(_keys(rows), "sets")
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(1, -(-total // FRAGMENT_SHINGLES))
    shared = _shared(_fragments(rows, fragments), fragments)
    tokens = write_table(_survivors(shared, fragments), "shared-shingles")
    roots = linked_sets(tokens)
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    members = classes.join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "first", F.coalesce("root", F.col("key")).alias("root"))
    named = members.groupBy("root").agg(F.min("first").alias("component_id"))
    of_key = members.join(named, "root").select(F.col("key").alias("_key"), "component_id")
    return keyed.join(of_key, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their group: the smallest id, one row if it repeats.

    Rows without a set stay, and so do rows without an id whose group has no id.
    """
    groups = near_copies(docs, doc_id, text)
    name, nth = fresh(docs, "_loser"), fresh(docs, "_nth")
    losers = groups.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(losers, F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")
    repeated = groups.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.limit(1).count():
        return left
    has_words = F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    window = Window.partitionBy(doc_id, has_words).orderBy(F.xxhash64(text), F.col(text))
    return left.withColumn(nth, F.row_number().over(window)).where(
        (F.col(nth) == 1) | F.col(doc_id).isNull() | ~has_words
    ).drop(nth)
