"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import fresh, word_count
from scrubline.llm.tokens import SHINGLE, shingle_sets, shingle_texts
from scrubline.storage import write_table

#: An item is found in a document that holds at least NUMERATOR / DENOMINATOR of its shingles.
NUMERATOR, DENOMINATOR = 4, 5
#: Bits of the hash that the filter on the documents' side looks at: at most 2**22 positions.
FILTER_BITS = 22


def needed(q: int) -> int:
    """The fewest shingles of an item of ``q`` that reach the threshold."""
    return -(-q * NUMERATOR // DENOMINATOR)


def item_sketches(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, n_item, part, sketch) for every item with words.

    The sketch is a bottom-k MinHash: the k = q - needed(q) + 1 smallest of the item's q hashes. A
    document that lacks all k can not hold ``needed(q)`` of them, so the search misses nothing.
    ``part`` is the size partition, the binary logarithm of q.
    """
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, parts, sketches = [], [], [], []
            for start, sets in shingle_sets(batch.column(1)):
                for i, s in enumerate(sets):
                    if len(s):
                        ids.append(batch.column(0)[start + i].as_py())
                        counts.append(len(s))
                        parts.append(len(s).bit_length() - 1)
                        sketches.append(s[:len(s) - needed(len(s)) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, batch.column(0).type), pa.array(counts, pa.int64()),
                pa.array(parts, pa.int32()), pa.array(sketches, pa.list_(pa.int64())),
            ], ["item_id", "n_item", "part", "sketch"])

    kind = dict(items.dtypes)[item_id]
    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(
        sketch, f"item_id {kind}, n_item long, part int, sketch array<long>"
    )


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents that hold at least 4/5 of an item's shingles.

    Shingles are five words; an item or document of fewer has its whole sequence as one. If there are
    items of fewer words, documents are searched for runs of so many as well. Items are
    partitioned by size. For each partition the driver knows one number, the largest value in its
    sketches: a document's sketch for the partition are its hashes up to that value, if the document
    is long enough to hold an item of the partition. Matching hashes give candidates, which are
    verified on the words themselves.

    Empty or null texts and items match nothing. Rows with equal document or item ids are searched
    each; a pair of ids is given once, with its largest overlap. Null ids are ids. Empty tables give
    no rows; further columns are ignored. Documents stay where they are in the search: only matching
    hashes and candidates are shuffled, and a passage found in a third of all documents gives one
    candidate a document.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text"))
    # At most four lengths, of items that are shorter than a shingle.
    n_words = word_count(F.col("item_text"))
    widths = sorted(r[0] for r in items.select(n_words.alias("n")).where(f"n > 0 and n < {SHINGLE}").distinct().collect())
    sketches = write_table(item_sketches(items, "item_id", "item_text"), "item-sketches")
    top = F.array_max(F.transform("sketch", lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))))
    # One row a partition, of which there are at most 63.
    parts = sketches.groupBy("part").agg(
        F.min("n_item").alias("least"), F.max(top).alias("top")
    ).collect()
    hashes = sketches.select("item_id", F.explode("sketch").alias("hash"))
    # At most 2**FILTER_BITS positions, however many items there are.
    places = hashes.select(
        F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("p")
    ).groupBy((F.col("p") / 4096).cast("int")).agg(F.collect_set("p").alias("p")).collect()
    filled = np.zeros(1 << FILTER_BITS, dtype=bool)
    for r in places:
        filled[r["p"]] = True
    filled = np.packbits(filled)
    bounds = sorted((needed(r["least"]), r["top"] + (1 << 63)) for r in parts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_filter = np.unpackbits(filled).astype(bool)
        for batch in batches:
            for start, sets in shingle_sets(batch.column(1), widths):
                rows, found = [], []
                for i, s in enumerate(sets):
                    tops = [top for least, top in bounds if least <= len(s)]
                    if not tops:
                        continue
                    s = s[:np.searchsorted(s, np.uint64(max(tops)), side="right")]
                    s = s[in_filter[s >> np.uint64(64 - FILTER_BITS)]]
                    if len(s):
                        rows += [start + i] * len(s)
                        found.append(s)
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(found).view(np.int64)),
                    ], ["doc_id", "hash"])

    id_type = dict(docs.dtypes)["doc_id"]
    hits = docs.mapInArrow(search, f"doc_id {id_type}, hash long")
    candidates = write_table(hits.join(hashes, "hash").select("doc_id", "item_id").distinct(), "candidates")
    pairs = candidates.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item"))
    texts = docs.join(pairs.select("_doc").distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    joined = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(
        items, F.col("item_id").eqNullSafe(F.col("_item"))
    ).select("doc_id", "text", "item_id", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep, counts, shared = [], [], []
            for i in range(batch.num_rows):
                body, item = batch.column(1)[i].as_py(), shingle_texts(batch.column(3)[i].as_py())
                if body != last:
                    last, held = body, shingle_texts(body, widths)
                both = len(item & held)
                if item and both >= needed(len(item)):
                    keep.append(i)
                    counts.append(len(item))
                    shared.append(both)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(2).take(at),
                pa.array(counts, pa.int64()), pa.array(shared, pa.int64()),
            ], ["doc_id", "item_id", "n_item", "n_shared"])

    item_type = dict(items.dtypes)["item_id"]
    verified = joined.mapInArrow(verify, f"doc_id {id_type}, item_id {item_type}, n_item long, n_shared long")
    best = F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("b")
    return verified.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.n_item", "b.n_shared"
    )


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is not found to hold an item."""
    name = fresh(docs, "_bad")
    bad = contaminated(docs, items, doc_id, text).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(write_table(bad, "contaminated"), F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")
