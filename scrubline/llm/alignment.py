"""Aligning two tokenizers' tokens on the same texts through sparse incidence matrices.

Both tokenizers cut the same bytes, so each gives a 0/1 matrix of tokens by bytes. Matrices are
compressed sparse rows built from token lengths, and links are row products A·Bᵀ in Gustavson's way:
for each entry of a row of A the row of Bᵀ at its column is added up. Tokens by their bytes give the
links between tokens that overlap, tokens by their last byte those between tokens that end together,
and tokens by the group they lie in those that share a group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scrubline.llm.common import fresh
from scrubline.storage import write_table

#: Texts are aligned in runs of about so many bytes, so temporaries stay small.
RUN_BYTES = 1 << 20
#: Neighbouring texts of about so many bytes look up the counts of their pairs together.
BLOCK_BYTES = 1 << 23
#: Longest run of bytes without a change between white space and the rest that the quick merger gets.
QUICK_BYTES = 1 << 11

#: Fixed value: the pattern by which byte-level BPE with these merges cuts a text before merging.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Csr:
    """A sparse matrix by rows: the columns (and values) of row i stand from ``starts[i]`` on."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    def transposed(self) -> Csr:
        """Rows become columns: a counting sort of the entries by column."""
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        values = None if self.values is None else self.values[order]
        return Csr(starts, rows[order], len(self.starts) - 1, values)

    def times(self, other: Csr) -> Csr:
        """The product, row by row; equal columns of a row are added up."""
        lengths = np.diff(other.starts)[self.columns]
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        at = np.arange(total) + np.repeat(other.starts[self.columns] - before, lengths)
        rows = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), lengths)
        columns = other.columns[at]
        values = np.ones(total, np.int64)
        if self.values is not None:
            values *= np.repeat(self.values, lengths)
        if other.values is not None:
            values *= other.values[at]
        key = rows * other.width + columns
        if total and not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(values, first) if total else values
        rows, columns = np.divmod(key[first], max(other.width, 1))
        starts = np.searchsorted(rows, np.arange(len(self.starts)))
        return Csr(starts, columns, other.width, sums)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), self.columns


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token has the bytes it covers."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def token_ends(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token has its last byte."""
    ends = np.cumsum(lengths)
    return Csr(np.arange(len(lengths) + 1), ends - 1, int(ends[-1]) if len(ends) else 0)


def token_groups(lengths: np.ndarray, cuts: np.ndarray) -> Csr:
    """Tokens by groups: each token has the group that it lies in; groups end at ``cuts``."""
    return Csr(np.arange(len(lengths) + 1), np.searchsorted(cuts, np.cumsum(lengths)), len(cuts))


def links(a: np.ndarray, b: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, weight) of all links between tokens of these lengths in bytes.

    ``kind``: ``overlap`` (the weight is the number of shared bytes), ``end`` (ranges end together)
    or ``group`` (both lie between two neighbouring places where an A and a B token end).
    """
    if kind == "group":
        cuts = np.intersect1d(np.cumsum(a), np.cumsum(b), assume_unique=True)
        rows, columns = token_groups(a, cuts), token_groups(b, cuts)
    else:
        make = {"overlap": token_bytes, "end": token_ends}[kind]
        rows, columns = make(a), make(b)
    product = rows.times(columns.transposed())
    return *product.entries(), product.values


def _byte_alphabet() -> dict[str, int]:
    """Byte-level entries write each byte as a letter: itself if it is visible, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Token ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"] for t in made.get("added_tokens", ()) if t.get("special")}
        letters = _byte_alphabet()
        ranks = {
            bytes(letters[c] for c in entry): i for entry, i in made["model"]["vocab"].items() if entry not in special
        }
        self.path, self.careful = path, None
        # Ids follow the order of the merges, so they serve as ranks.
        self.quick = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            table[i] = entry
        self.bytes = pa.array(table, pa.large_binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.quick.encode_to_numpy(t) if _quick(t) else self._encode_carefully(t) for t in texts]

    def _encode_carefully(self, text: str) -> np.ndarray:
        """By the other library, whose time grows less with the length of a word."""
        if self.careful is None:
            from tokenizers import Tokenizer

            self.careful = Tokenizer.from_file(self.path)
            self.careful.encode_special_tokens = True
        return np.array(self.careful.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _quick(text: str) -> bool:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(data) <= QUICK_BYTES:
        return True
    turns = np.flatnonzero(np.diff(data <= 32))
    return int(np.diff(turns, prepend=0, append=len(data)).max()) <= QUICK_BYTES


class Pieces:
    """Token ids and bytes of a sentence-piece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = pa.array([
            bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())
        ], pa.large_binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in self.model.encode(texts, num_threads=1)]


_loaded: dict = {}


def _tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _loaded[a_path, b_path]


def _data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of large binaries."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Side:
    """One tokenizer's tokens of a run of texts: ids, lengths in bytes, where each text starts."""

    ids: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray


def _side(tokenizer, texts: list[str], whole: list[bytes]) -> tuple[Side, np.ndarray]:
    """The tokens of each text, and which texts the tokens' bytes give back."""
    found = tokenizer.encode(texts)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    ids = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int64)
    data, offsets = _data(tokenizer.bytes.take(pa.array(ids)))
    at = offsets[starts]
    same = np.array([data[at[i]:at[i + 1]].tobytes() == w for i, w in enumerate(whole)], dtype=bool)
    return Side(ids, np.diff(offsets), starts), same


def _only(side: Side, keep: np.ndarray) -> Side:
    counts = np.diff(side.starts)
    tokens = np.repeat(keep, counts)
    return Side(side.ids[tokens], side.lengths[tokens], np.concatenate([[0], np.cumsum(counts * keep)]))


def align_texts(texts: list[str | None], a: ByteLevel, b: Pieces) -> tuple[Side, Side]:
    """Tokens of both sides; texts that are null, empty or not given back by both have none."""
    texts = [t or "" for t in texts]
    shown = [" " + t for t in texts]
    whole = [s.encode() for s in shown]
    left, same_a = _side(a, shown, whole)
    right, same_b = _side(b, texts, whole)
    keep = same_a & same_b & np.array([bool(t) for t in texts], dtype=bool)
    return _only(left, keep), _only(right, keep)


def _group_texts(a: Side, b: Side) -> tuple[list[str], np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of each text, and the number of its groups."""
    ends_a, ends_b = np.cumsum(a.lengths), np.cumsum(b.lengths)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    place = np.concatenate([2 * group_a, 2 * group_b + 1])[order]
    ids = np.concatenate([a.ids, b.ids])[order]
    turn = np.concatenate([np.diff(place) != 0, [True]]) if len(place) else np.zeros(0, bool)
    # After a token: a comma, or the sign that ends its part of the group.
    sign = np.where(turn, 1 + place % 2, 0)
    tokens_per_text = np.diff(a.starts) + np.diff(b.starts)
    last = np.cumsum(tokens_per_text)[tokens_per_text > 0] - 1
    sign[last] = 3
    data, offsets = _data(_numbers(int(ids.max(initial=0))).take(pa.array(ids * 4 + sign)))
    at = offsets[np.concatenate([[0], np.cumsum(tokens_per_text)])]
    body = memoryview(data.tobytes())
    shown = [bytes(body[s:e]) for s, e in zip(at[:-1], at[1:])]
    stops = np.concatenate([[0], ends_a])[a.starts]
    return shown, np.diff(np.searchsorted(cuts, stops, side="right"))


_signed: dict = {}


def _numbers(most: int) -> pa.Array:
    """Ids in decimal digits, each followed by nothing or one of the three signs."""
    if _signed.get("most", -1) < most:
        _signed.update(most=most, table=pa.array(
            [f"{i}{s}".encode() for i in range(most + 1) for s in (",", "|", ";", "")], pa.large_binary()))
    return _signed["table"]


def _aligned_batches(a_path: str, b_path: str, text: str, kind: str, names: list[str], kept: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(a_path, b_path)
        # Blocks only say which texts look up counts together; they are stored, so any number will do.
        block, in_block = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
            _, offsets = _data(column)
            start = 0
            while start < len(column):
                end = int(np.searchsorted(offsets, offsets[start] + RUN_BYTES, side="right")) - 1
                end = min(max(end, start + 1), len(column))
                texts = [t.decode(errors="replace") for t in column.slice(start, end - start).to_pylist()]
                if in_block > BLOCK_BYTES:
                    block, in_block = block + 1, 0
                in_block += int(offsets[end] - offsets[start])
                yield _aligned(batch.slice(start, end - start), texts, a, b, kind, block, names, kept)
                start = end

    return run


def _aligned(batch, texts, a, b, kind, block, names, kept) -> pa.RecordBatch:
    left, right = align_texts(texts, a, b)
    rows, columns, _ = links(left.lengths, right.lengths, kind)
    row_of = np.searchsorted(rows, left.starts)
    shown, groups = _group_texts(left, right)
    n_links = np.diff(row_of)
    # One number a pair of ids; equal pairs of a text are one with their number.
    pairs = (left.ids[rows] << 32) | right.ids[columns]
    lists, times = [], []
    for s, e in zip(row_of[:-1], row_of[1:]):
        found, n = np.unique(pairs[s:e], return_counts=True)
        lists.append(found)
        times.append(n.astype(np.int32))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate([*lists, np.zeros(0, np.int64)])
    made = [
        pa.array(np.diff(left.starts)), pa.array(np.diff(right.starts)), pa.array(groups.astype(np.int64)),
        pa.array(n_links.astype(np.int64)),
        pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in shown], pa.string()),
        pa.ListArray.from_arrays(ends, pa.array(flat >> 32).cast(pa.int32())),
        pa.ListArray.from_arrays(ends, pa.array(flat & 0xFFFFFFFF).cast(pa.int32())),
        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*times, np.zeros(0, np.int32)]))),
        pa.array(np.full(len(texts), block, np.int64)),
    ]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], names)


MADE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids array<int>, b_ids array<int>, times array<int>"


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", kind: str = "end") -> DataFrame:
    """``df`` without its texts, with both sides' numbers of tokens, groups and links, and the links.

    ``a_path`` is a byte-level BPE file, which gets the text behind a space, and ``b_path`` a
    sentence-piece model, which adds the space itself; both lie at the same path on all executors.
    ``a_ids``, ``b_ids`` and ``times`` list the pairs of ids that links join, and how often in the text;
    ``groups_sha256`` is the digest of the groups' ids. Texts that are null, empty or not given back
    byte by byte by both sides have no tokens. New columns whose names ``df`` has get longer ones.
    Nothing is shuffled. Links of kind ``group`` are as many as their definition says: a long text
    whose tokens never end together has all of its pairs.
    """
    return _align(df, a_path, b_path, text, kind)[0].drop("block_")


def _align(df: DataFrame, a_path: str, b_path: str, text: str, kind: str) -> tuple[DataFrame, dict[str, str]]:
    kept = [i for i, f in enumerate(df.schema.fields) if f.name != text]
    given = df.select(*[df.columns[i] for i in kept])
    made = [p.split(" ") for p in MADE.split(", ")]
    named = {n: fresh(given, n) for n, _ in made}
    schema = StructType([
        *given.schema.fields,
        *[StructField(f.name if n is None else named[n], f.dataType)
          for n, f in zip([*[n for n, _ in made], None], StructType.fromDDL(MADE + ", block_ long").fields)],
    ])
    return df.mapInArrow(_aligned_batches(a_path, b_path, text, kind, schema.names, kept), schema), named


def align_with_counts(
    df: DataFrame, a_path: str, b_path: str, text: str = "text", kind: str = "end"
) -> DataFrame:
    """What ``align`` gives, with ``n_best`` and ``count_sum`` in the light of all texts.

    A pair's count is the number of links of all texts that join it. ``count_sum`` adds the counts up
    over a text's links, ``n_best`` is how many of them have the highest count of their B id. Texts are
    encoded once and their pairs stored; neighbouring texts look their pairs up together, a pair once,
    so that common pairs do not stand in the shuffles as often as in the texts.
    """
    aligned, named = _align(df, a_path, b_path, text, kind)
    stored = write_table(aligned, "aligned")
    a, b, times = named["a_ids"], named["b_ids"], named["times"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block_").to_numpy()
            lengths = np.diff(batch.column(a).offsets.to_numpy())
            of = np.repeat(blocks, lengths)
            ids = (batch.column(a).flatten().to_numpy().astype(np.int64) << 32) | batch.column(b).flatten().to_numpy()
            n = batch.column(times).flatten().to_numpy()
            for block in np.unique(blocks):
                here = of == block
                pairs, at = np.unique(ids[here], return_inverse=True)
                sums = np.bincount(at, weights=n[here], minlength=len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(pairs), block)), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(sums),
                ], ["block_", "a", "b", "n"])

    found = write_table(stored.select("block_", a, b, times).mapInArrow(
        gathered, "block_ long, a long, b long, n long"), "pairs")
    counts = found.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # A B id has at most as many pairs as A has ids.
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))
    known = found.select("block_", "a", "b").distinct().join(counts, ["a", "b"])

    names = [c for c in stored.columns if c not in (a, b, times, "block_")]
    n_best, count_sum = fresh(stored, "n_best"), fresh(stored, "count_sum")
    schema = StructType([
        *stored.select(*names).schema.fields, StructField(n_best, LongType()), StructField(count_sum, LongType())])

    def looked_up(texts: pa.Table, there: pa.Table) -> pa.Table:
        key = (there["a"].to_numpy() << 32) | there["b"].to_numpy()
        order = np.argsort(key)
        key, count, best = key[order], there["count"].to_numpy()[order], there["best"].to_numpy()[order]
        texts = texts.combine_chunks()
        sums = {n: [] for n in (n_best, count_sum)}
        for chunk in texts.to_batches():
            lengths = np.diff(chunk.column(a).offsets.to_numpy())
            of = np.repeat(np.arange(len(lengths)), lengths)
            pairs = (chunk.column(a).flatten().to_numpy().astype(np.int64) << 32) | chunk.column(b).flatten().to_numpy()
            at, n = np.searchsorted(key, pairs), chunk.column(times).flatten().to_numpy().astype(np.int64)
            for name, value in ((n_best, n * best[at]), (count_sum, n * count[at])):
                total = np.zeros(len(lengths), np.int64)
                np.add.at(total, of, value)
                sums[name].append(pa.array(total))
        made = [pa.chunked_array(sums[n], pa.int64()) for n in (n_best, count_sum)]
        return pa.table([*[texts[c] for c in names], *made], names=[*names, n_best, count_sum])

    return stored.groupBy("block_").cogroup(known.groupBy("block_")).applyInArrow(looked_up, schema)
