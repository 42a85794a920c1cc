"""Words and word shingles of Arrow text columns as 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in runs of about so many bytes, so temporaries stay small.
CHUNK_BYTES = 1 << 20
SHINGLE = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(21)).integers(0, 2**64, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_BASE = int(0xD6E8FEB86659FD93)
_powers = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= _STEP
    h ^= h >> np.uint64(32)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if n > CHUNK_BYTES * 2:
        return _make_powers(n)
    if not _powers:
        _powers["t"] = _make_powers(CHUNK_BYTES * 2)
    up, down = _powers["t"]
    return up[:n], down[:n]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        t = np.full(n, base, dtype=np.uint64)
        t[0] = 1
        tables.append(np.cumprod(t, dtype=np.uint64))
    return tables[0], tables[1]


def text_chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; nulls are empty texts."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words do not reach over the ends of documents."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    last = solid
    last = last.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Hashes of all words, A-Z as a-z, and the position in them where each document starts.

    For each length of ``prefixes`` a further array holds the hash of the first so many bytes of
    every word; a shorter word has the hash of itself, marked as a prefix.
    """
    if not len(data):
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(offsets), np.int64), *[none for _ in prefixes]
    starts, ends = word_bounds(data, offsets)
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up, dtype=np.uint64, out=sums[1:])

    def hashed(stops: np.ndarray, salt: int) -> np.ndarray:
        h = (sums[stops] - sums[starts]) * down[starts]
        return mix(h + ((stops - starts).astype(np.uint64) + np.uint64(salt)) * _STEP)

    first = np.searchsorted(starts, offsets)
    return hashed(ends, 0), first, *[hashed(np.minimum(ends, starts + n), n << 32) for n in prefixes]


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and where each document starts in them.

    A document of fewer than five words has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    # The first word of every shingle.
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first[:-1], n)
    whole = np.repeat(counts, n)
    h = np.zeros(starts[-1], dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    for j in range(SHINGLE):
        term = mix(padded[at + j] + _PLACE[j])
        h += term if j == 0 else np.where(whole > j, term, np.uint64(0))
    return mix(h + np.minimum(whole, SHINGLE).astype(np.uint64) * _PLACE[SHINGLE]), starts


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, fewer than five, as of texts that are no longer."""
    counts = np.diff(first)
    n = np.maximum(counts - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first[:-1], n)
    h = np.zeros(starts[-1], dtype=np.uint64)
    for j in range(width):
        h += mix(words[at + j] + _PLACE[j])
    return mix(h + np.uint64(width) * _PLACE[SHINGLE]), starts


def shingle_sets(column, widths: Iterable[int] = ()) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows of a text column.

    Runs of so many words as ``widths`` has, fewer than five, count as well.
    """
    for start, _, data, offsets in text_chunks(column):
        words, first = word_hashes(data, offsets)
        shingles, at = shingle_hashes(words, first)
        sets = [shingles[a:b] for a, b in zip(at[:-1], at[1:])]
        for width in widths:
            more, at = window_hashes(words, first, width)
            sets = [np.concatenate([s, more[a:b]]) for s, a, b in zip(sets, at[:-1], at[1:])]
        yield start, [np.unique(s) for s in sets]


def shingle_texts(text: str | None, widths: Iterable[int] = ()) -> set[tuple[str, ...]]:
    """The shingles themselves: the plain form of what ``shingle_sets`` hashes."""
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        data = data.replace(c, " ")
    words = [w for w in data.split(" ") if w]
    if not words:
        return set()
    short = {tuple(words[i:i + w]) for w in widths for i in range(len(words) - w + 1)}
    if len(words) < SHINGLE:
        return {tuple(words)} | short
    return {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} | short
