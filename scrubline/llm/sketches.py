"""Threshold-scaled sketches of texts: every five-word shingle hash below a fixed fraction of all hashes.

As the threshold is the same for all texts, a sketch grows with its text: sketches of a paragraph and
of a book can be compared, sketches of parts merge into that of the whole, and the share of one text
that lies in another can be estimated however unequal the two are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from scrubline.llm import tokens
from scrubline.llm.common import fresh
from scrubline.storage import write_table

#: One shingle hash in so many is kept.
SCALE = 16
#: Texts are compared in runs of about so many characters, so temporaries stay small.
RUN_CHARS = 1 << 21
#: A row that stands many times in a table is given out in pieces of so many.
COPIES_A_PIECE = 1 << 16


def sketches_of(column, scale: int = SCALE) -> list[np.ndarray]:
    """The sketch of each text of an Arrow column: ascending 63-bit hashes, without repeats.

    Words are what ``tokens`` takes, A-Z as a-z; a text of fewer than five words is one shingle. A
    text without a hash below the threshold keeps its smallest one, so that only texts without words
    have empty sketches.
    """
    limit = np.int64((1 << 63) // scale - 1)
    found = []
    for _, _, data, offsets in tokens.text_chunks(column):
        hashes, at = tokens.shingle_hashes(*tokens.word_hashes(data, offsets))
        hashes = (hashes >> np.uint64(1)).astype(np.int64)
        kept = np.flatnonzero(hashes <= limit)
        low, values = np.searchsorted(kept, at), hashes[kept]
        for i in range(len(at) - 1):
            if low[i] < low[i + 1]:
                found.append(np.unique(values[low[i]:low[i + 1]]))
            else:
                found.append(hashes[at[i]:at[i + 1]].min(keepdims=True) if at[i] < at[i + 1] else hashes[:0])
    return found


def with_sketch(df: DataFrame, text: str = "text", name: str = "sketch", scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of each text as an ascending array; null texts are empty ones.

    The new column's name is lengthened if ``df`` has it. Nothing is shuffled.
    """
    name = fresh(df, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(sketches_of(batch.column(text), scale), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(LongType()))]))


def merged(sketches: Column, scale: int = SCALE) -> Column:
    """The sketch of several texts together from an array of theirs, each of them whole shingles.

    An aggregation gives the array with ``collect_list``; merging merged sketches gives the same.
    """
    every = F.array_sort(F.array_distinct(F.flatten(sketches)))
    below = F.filter(every, lambda h: h <= (1 << 63) // scale - 1)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(every, 1, 1))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of ``part``'s shingles that ``whole`` has; 1 if neither has words."""
    return F.when(F.size(part) == 0, (F.size(whole) == 0).cast("double")).otherwise(
        F.size(F.array_intersect(part, whole)) / F.size(part))


def likeness(a: Column, b: Column) -> Column:
    """How much of the smaller text the larger one has: the larger of both containments."""
    return F.greatest(containment(a, b), containment(b, a))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, ascending."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _like(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def edited(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) gives way to as much of the start of ``following``."""
    cut = len(text) // 2
    return text[:len(text) - cut] + following[:cut]


RESULT = "doc_id long, copies long, n_chars long, edited_sha256 string, sketch array<long>, edited_sketch array<long>, near_edited double, near_next double"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("copies", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("sketch", pa.list_(pa.int64())), ("edited_sketch", pa.list_(pa.int64())),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compared(pairs: list[tuple], scale: int) -> pa.RecordBatch:
    """Rows of RESULT for (doc_id, copies, text, sketch, next text, next sketch)."""
    changed = [edited(p[2], p[4]) for p in pairs]
    theirs = sketches_of(pa.array(changed, pa.large_string()), scale)
    ids, copies, texts, own, _, following = zip(*pairs)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(own, pa.list_(pa.int64())), pa.array(theirs, pa.list_(pa.int64())),
        pa.array([_like(a, b) for a, b in zip(own, theirs)]), pa.array([_like(a, b) for a, b in zip(own, following)]),
    ], schema=_ARROW)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(doc_id, text, copies) in runs of about RUN_CHARS; equal neighbours are one with all their copies."""
    run, chars, last = [], 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            for row in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), rows["copies"].to_pylist()):
                if last is not None and last[:2] == row[:2]:
                    last = (*row[:2], last[2] + row[2])
                    continue
                if last is not None:
                    run.append(last)
                    chars += len(last[1])
                    if chars > RUN_CHARS:
                        yield run
                        run, chars = [], 0
                last = row
    if last is not None:
        run.append(last)
    if run:
        yield run


def compare_with_next(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each document against its edited text and against the next document, as rows of RESULT.

    ``df`` has doc_id and text; other columns are left out. The next document is the one of the
    next smaller doc_id, rows without an id coming last and rows of one id following each other by
    text; after the last comes the first. Rows that are equal in both columns are one document, whose
    result stands in ``copies`` and which is given out that often. Null texts are empty ones.

    Texts are moved once, into ranges of ids that neighbouring documents share; only the documents
    at the ends of the ranges meet their neighbours in a join of their own. Copies are folded before.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = docs.select("doc_id").repartitionByRange(ranges, "doc_id").groupBy(
        F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("low"), F.count_if(F.isnull("doc_id")).alias("nulls")).collect()
    lows = np.array(sorted({r.low for r in starts if r.low is not None}), dtype=np.int64)
    nulls = any(r.nulls for r in starts)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(["doc_id", "text"]).aggregate([([], "count_all")])
            ids = rows["doc_id"].combine_chunks()
            place = np.searchsorted(lows, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right")
            place[pc.is_null(ids).to_numpy(zero_copy_only=False)] = 0
            yield from pa.table({
                "doc_id": rows["doc_id"], "text": rows["text"].cast(pa.string()), "copies": rows["count_all"].cast(pa.int64()),
                "block": pa.array(place.astype(np.int32)),
            }).to_batches()

    dealt = docs.mapInArrow(folded, "doc_id long, text string, copies long, block int").repartitionById(
        len(lows) + 1, F.col("block")).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document so far, whose next one is not known yet

        def end(kind: str, doc: tuple) -> pa.RecordBatch:
            block = int(np.searchsorted(lows, doc[0], side="right")) if doc[0] is not None else 0
            return pa.RecordBatch.from_pylist(
                [{"doc_id": doc[0], "copies": doc[1], "sketch": doc[3], "kind": kind, "block": block, "text": doc[2]}],
                pa.schema([*_ARROW, ("kind", pa.string()), ("block", pa.int32()), ("text", pa.string())]))

        def done(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            more = [pa.array(["done"] * n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], [*_ARROW.names, "kind", "block", "text"])

        for run in _runs(batches):
            own = sketches_of(pa.array([r[1] for r in run], pa.large_string()), scale)
            docs = [(i, n, t, s) for (i, t, n), s in zip(run, own)]
            if held is None:
                yield end("head", docs[0])
            else:
                docs.insert(0, held)
            held = docs[-1]
            if len(docs) > 1:
                yield done(_compared([(*a, b[2], b[3]) for a, b in zip(docs, docs[1:])], scale))
        if held is not None:
            yield end("open", held)

    parts = write_table(
        dealt.mapInArrow(compared, RESULT + ", kind string, block int, text string"), "compared")
    # The last document of a range goes on with the first of the next one; the ranges are numbered
    # upwards from 1, and 0 holds the rows without an id.
    top = F.lit(len(lows))
    after = F.when(F.col("block") > 1, F.col("block") - 1).when(
        (F.col("block") == 1) & F.lit(nulls), F.lit(0)).otherwise(top)
    heads = parts.where("kind = 'head'").select(
        F.col("block").alias("after"), F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    ends = parts.where("kind = 'open'").withColumn("after", after).join(heads, "after").select(
        "doc_id", "copies", "text", "sketch", "next_text", "next_sketch")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16)
                lists = [c.to_pylist() for c in rows.columns]
                lists[3], lists[5] = ([np.array(x, dtype=np.int64) for x in lists[i]] for i in (3, 5))
                yield _compared(list(zip(*lists)), scale)

    every = parts.where("kind = 'done'").select(*_ARROW.names).unionByName(ends.mapInArrow(finished, RESULT))
    return _given_out(every)


def _given_out(rows: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says; one of very many copies by many tasks."""
    size = F.lit(COPIES_A_PIECE).cast("long")
    few = rows.where(F.col("copies") <= size).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    many = rows.where(F.col("copies") > size).withColumn(
        "piece_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / size).cast("long")))
    ).repartition("doc_id", "edited_sha256", "piece_").withColumn("copy_", F.explode(
        F.sequence(F.lit(1).cast("long"), F.least(size, F.col("copies") - F.col("piece_") * size))))
    return few.drop("copy_").unionByName(many.drop("piece_", "copy_"))
