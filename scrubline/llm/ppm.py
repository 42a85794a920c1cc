"""Language-model scoring: prediction by partial matching over bytes, and a unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.tokens import _LOWER, mix, text_chunks, word_hashes
from scrubline.storage import write_table

#: Length of the longest context in bytes.
ORDER = 5
#: Most strings of a length that are sent to all tasks; a larger trie stays where its counts are.
MAX_STRINGS = 1 << 21
#: Strings of a part of a distributed trie, and most strings looked up there in one task.
SEGMENT_STRINGS, LOOKED_UP = 2 << 20, 4 << 20
#: Lengths of context sent to all tasks in any case: up to 1 byte, at most 65,792 strings.
BASE_LEVELS = 2
#: Marks the end of a text and stands for what is before its start; no UTF-8 text holds it.
END = 255
#: A word is common if it makes up one in COMMON of all tokens, so there are no more than COMMON.
COMMON = 1 << 14
#: Rare words of a task of the second pass.
SEGMENT_WORDS = 1 << 20


def strings(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the last ``order`` bytes and it, packed.

    The symbol is in the low byte, the byte before it in the next one. The second array gives
    where each text starts.
    """
    n = np.diff(offsets)
    pad = order + 1
    starts = offsets[:-1] + np.arange(len(n)) * pad + order
    stream = np.full(len(data) + len(n) * pad, END, dtype=np.uint8)
    own = np.repeat(starts - offsets[:-1], n) + np.arange(len(data))
    stream[own] = _LOWER[data]
    symbols = np.ones(len(stream), dtype=bool)
    for j in range(order):
        symbols[starts - order + j] = False
    wide = stream.astype(np.uint64)
    packed = wide.copy()
    for j in range(1, order + 1):
        packed[j:] |= wide[:-j] << np.uint64(8 * j)
    return packed[symbols], offsets[:-1] + np.arange(len(n))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts (1 each if not given)."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[at], np.diff(np.concatenate([at, [len(keys)]]))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Places:
    """Positions of 64-bit keys by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = keys
        self.at = np.full(1 << bits, -1, dtype=np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = self.at[slot] < 0
            self.at[slot[free]] = rest[free]
            lost = self.at[slot] != rest
            slot, rest = (slot[lost] + 1) & self.mask, rest[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is not there."""
        slot = self._slot(keys)
        found = self.at[slot]
        rest = np.flatnonzero(found >= 0)
        rest = rest[self.keys[found[rest]] != keys[rest]]
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found[rest] = self.at[slot[rest]]
            rest = rest[found[rest] >= 0]
            rest = rest[self.keys[found[rest]] != keys[rest]]
        return found


def _index(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(len(keys) and keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


@dataclass
class Level:
    """The trie at one depth: strings with counts, and their contexts.

    Per context: ``total`` of the counts, number of symbols ``kinds``, and ``covered``: what those
    symbols count in the next shorter context, from where they are excluded. Every task holds all
    of this, so counts have the narrowest type and ``context`` is kept of the longest strings alone.
    """

    keys: np.ndarray
    counts: np.ndarray
    context: np.ndarray | None
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    covered: np.ndarray


class Trie:
    """A byte-context trie, for scoring with escape method D and symbol exclusion.

    Among the symbols not excluded, one seen c times of n has the probability (2 c - 1) / 2 n and
    the escape k / 2 n if there are k of them; so they sum to 1.
   """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """``tables``: for each length of context from 0 on, sorted strings and their counts.

        A string is only held if its shorter forms are.
        """
        self.levels: list[Level] = []
        for k, (keys, counts) in enumerate(tables):
            contexts, context, kinds = np.unique(keys >> np.uint64(8), return_inverse=True, return_counts=True)
            counts = narrow(counts)
            total = np.bincount(context, counts, len(contexts))
            covered = np.zeros(len(contexts))
            if k:
                below = self.levels[k - 1]
                shorter = below.counts[_index(below.keys, keys & _low(k))]
                covered = np.bincount(context, shorter, len(contexts))
            if k:
                self.levels[-1].context = None
            self.levels.append(Level(keys, counts, narrow(context), contexts, total, narrow(kinds), covered))

    def prepare(self) -> None:
        """Build what scoring needs; done in the task, not sent to it."""
        top = self.levels[-1]
        self.places = Places(top.keys)
        self.direct = np.log10((top.counts - 0.5) / top.total[top.context]) if len(top.keys) else np.zeros(0)

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        out = np.zeros(len(packed))
        found = self.places.find(packed)
        hit = found >= 0
        out[hit] = self.direct[found[hit]]
        rest = np.flatnonzero(~hit)
        covered, kinds = np.zeros(len(rest)), np.zeros(len(rest))  # of the longer context
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            text = packed[rest] & _low(k + 1)
            context = _index(level.contexts, text >> np.uint64(8))
            there = context >= 0
            total = np.where(there, level.total[context] - covered, 0) if len(level.total) else np.zeros(len(rest))
            options = np.where(there, level.kinds[context] - kinds, 0) if len(level.total) else np.zeros(len(rest))
            at = _index(level.keys, text)
            seen = at >= 0
            out[rest[seen]] += np.log10((level.counts[at[seen]] - 0.5) / total[seen])
            escaped = there & ~seen & (options > 0)
            out[rest[escaped]] += np.log10(options[escaped] / (2 * total[escaped]))
            covered = np.where(there, level.covered[context], covered) if len(level.total) else covered
            kinds = np.where(there, level.kinds[context].astype(np.float64), kinds) if len(level.total) else kinds
            left = ~seen
            rest, covered, kinds = rest[left], covered[left], kinds[left]
        out[rest] -= np.log10(np.maximum(256 - kinds, 1))
        return out


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them all."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _low(n: int) -> np.uint64:
    """Mask of the low ``n`` bytes."""
    return np.uint64((1 << (8 * n)) - 1)


def count_strings_and_words(docs: DataFrame, train: str, text: str, order: int) -> DataFrame:
    """(kind, key, n): counts of the strings ('s') and words ('w') of the training texts.

    Each task adds up its own counts before they are shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"s": [], "w": []}

        def merged(kind: str) -> None:
            parts = held[kind]
            if len(parts) > 1:
                held[kind] = [counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in held:
                merged(kind)
                for keys, n in held[kind]:
                    for i in range(0, len(keys), 1 << 16):
                        part = keys[i:i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([kind] * len(part)), pa.array(part.view(np.int64)),
                            pa.array(n[i:i + (1 << 16)].astype(np.int64)),
                        ], ["kind", "key", "n"])
                held[kind] = []

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                held["s"].append(counted(strings(data, offsets, order)[0]))
                held["w"].append(counted(word_hashes(data, offsets)[0]))
                for kind, parts in held.items():
                    if len(parts) >= 8:
                        merged(kind)
                if sum(len(p[0]) for parts in held.values() for p in parts) > 6 << 20:
                    yield from flush()
        yield from flush()

    rows = docs.where(F.col(train)).select(text).mapInArrow(count, "kind string, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def count_levels(counts: DataFrame, order: int) -> DataFrame:
    """(key, n, k): the counted strings of every length of context, the shorter being sums of the longest."""
    grams = counts.where("kind = 's'").select("key", "n")
    lengths = []
    for k in range(order + 1):
        key = F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        lengths.append(grams.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).withColumn("k", F.lit(k)))
    every = lengths[0]
    for more in lengths[1:]:
        every = every.unionByName(more)
    return write_table(every, "strings")


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    by = np.argsort(keys)
    return keys[by], n[by]


def fit_trie(every: DataFrame, levels: int) -> Trie:
    """A trie of the lengths of context below ``levels``."""
    return Trie([_sorted(every.where(F.col("k") == k).select("key", "n").toArrow()) for k in range(levels)])


@dataclass
class Frequent:
    """The strings seen most in the longest context, with the log10 of their probability there."""

    keys: np.ndarray
    direct: np.ndarray

    def prepare(self) -> None:
        self.places = Places(self.keys)


def fit_frequent(every: DataFrame, order: int, max_strings: int) -> Frequent:
    """Strings seen from the smallest power of two on with which there are at most ``max_strings``."""
    top = every.where(F.col("k") == order).select("key", "n")
    sizes = [0] * 64
    for r in top.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect():
        sizes[r["b"]] = r["c"]
    least = next((b for b in range(63) if sum(sizes[b:]) <= max_strings), 63)
    context = F.shiftright("key", 8)
    totals = top.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    found = top.where(F.log2(F.col("n").cast("double")) >= least).withColumn("context", context).join(
        totals, "context").select("key", "n", "total").toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    return Frequent(keys, np.log10((n - 0.5) / found.column("total").to_numpy()))


def trie_part(packed: np.ndarray, parts: int) -> np.ndarray:
    """The part of a distributed trie that has all of a string's contexts of two bytes and more."""
    context = (packed >> np.uint64(8)).astype(np.int64) & 0xFFFF
    return ((context * 40503 & 0xFFFF) * parts >> 16).astype(np.int32)


def score_texts(
    docs: DataFrame, train: Column, text: str = "text", order: int = ORDER, max_strings: int = MAX_STRINGS,
) -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score.

    Rows for which ``train`` is true teach the model; all rows are scored. ``score`` is the log10
    probability of the text's bytes (A-Z as a-z) and its end: each byte is predicted in the longest
    context of up to ``order`` bytes that the trie has; a symbol it has not followed by escapes to the
    next shorter one, whose already rejected symbols are excluded, down to all 256 being equally
    likely. ``base_score`` is the sum over words and the end of log10((c + 0.1) / (N + 0.1 (V + 1))).

    A null text is an empty one and scores its end. Rows that repeat count and are scored each. An
    empty table gives no rows; without training rows all counts are 0. Columns with the names of
    results are replaced. Word counts stay distributed: only words that make up one in COMMON of all
    tokens, hence at most COMMON, are sent to all tasks; the others are looked up where the counts
    are, by ranges of their hash. So are strings, with the same scores, if the trie has more than
    ``max_strings`` of a length: only the most frequent and the shortest are sent out then, the others are
    looked up in parts of the trie that hold all strings with the same last bytes of context.
    """
    spark = docs.sparkSession
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (*results, text)]
    source = docs.select(
        F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
    )
    counts = write_table(count_strings_and_words(source, "train", "text", order), "counts")
    words = counts.where("kind = 'w'").select("key", "n")
    in_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts, others = source.agg(
        F.coalesce(F.sum(F.col("train").cast("int")), F.lit(0)), F.count(F.lit(1))
    ).first()
    total, kinds = in_words + texts, distinct + (1 if texts else 0)
    norm = total + 0.1 * (kinds + 1)
    common = words.where(F.col("n") * COMMON >= in_words).toArrow() if in_words else None
    hot = common.column(0).to_numpy().view(np.uint64) if common else np.zeros(0, np.uint64)
    by = np.argsort(hot)
    hot, hot_counts = hot[by], (common.column(1).to_numpy()[by] if common else np.zeros(0))
    every = count_levels(counts, order)
    sizes = {r["k"]: r["c"] for r in every.groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect()}
    whole = max(sizes.values(), default=0) <= max_strings
    parts = max(1, -(-sum(c for k, c in sizes.items() if k >= BASE_LEVELS) // SEGMENT_STRINGS))
    # At most max_strings strings of each length, and COMMON words.
    model = fit_trie(every, order + 1) if whole else fit_frequent(every, order, max_strings)
    shared = spark.sparkContext.broadcast((model, hot, hot_counts))
    base_levels = None if whole else spark.sparkContext.broadcast(fit_trie(every, min(order + 1, BASE_LEVELS)))
    rare_share = 1 - (hot_counts.sum() / in_words if in_words else 0)
    segments = max(1, -(-int(in_words * rare_share * max(1, others) / max(1, texts)) // SEGMENT_WORDS))

    def logs(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / norm)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot, hot_counts = shared.value
        model.prepare()

        def requests(chunk, segment, owner, keys, row_type) -> Iterator[pa.RecordBatch]:
            """The keys to look up in each segment, with the texts that hold them."""
            by = np.lexsort((owner, segment))
            keys, owner, segment = keys[by], owner[by], segment[by]
            names_of, starts = np.unique(segment, return_index=True)
            rows = []
            for s, a, b in zip(names_of, starts, [*starts[1:], len(keys)]):
                who, n = np.unique(owner[a:b], return_counts=True)
                rows.append((s, who.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), keys[a:b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(rows), pa.int64()), *[pa.nulls(len(rows), t) for t in types[1:5]],
                    *[pa.array([r[i] for r in rows], types[5 + i]) for i in range(4)],
                    pa.nulls(len(rows), row_type),
                ], names)

        names = ["chunk", "tokens", "known", "base", "score", "segment", "docs", "counts", "words", "row"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 3]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, end, data, offsets in text_chunks(batch.column(1)):
                packed, at = strings(data, offsets, order)
                if whole:
                    score = np.add.reduceat(model.log10(packed), at)
                else:
                    place = model.places.find(packed)
                    here = place >= 0
                    value = np.zeros(len(packed))
                    value[here] = model.direct[place[here]]
                    score = np.add.reduceat(value, at)
                    holder = np.repeat(np.arange(end - start), np.diff(np.append(at, len(packed))))[~here]
                    asked = packed[~here]
                    # Segments of the trie are below 0, those of the words are not.
                    yield from requests(ids[start], -1 - trie_part(asked, parts), holder, asked, batch.column(2).type)
                h, first = word_hashes(data, offsets)
                owner = np.repeat(np.arange(end - start), np.diff(first))
                where = _index(hot, h)
                known = where >= 0
                n_known = np.bincount(owner[known], minlength=end - start)
                base = np.bincount(owner[known], logs(hot_counts[where[known]]), end - start)
                base = base + logs(np.float64(texts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(end - start, ids[start])), pa.array(np.diff(first) + 1),
                    pa.array((n_known + (texts > 0)).astype(np.int64)), pa.array(base), pa.array(score),
                    pa.array(np.arange(end - start, dtype=np.int32)), *[pa.nulls(end - start, t) for t in types[6:]],
                    batch.column(2).slice(start, end - start),
                ], names)
                h, owner = h[~known], owner[~known]
                segment = ((h >> np.uint64(40)) * np.uint64(segments) >> np.uint64(24)).astype(np.int32)
                yield from requests(ids[start], segment, owner, h, batch.column(2).type)

    # A chunk is a run of texts, named by a number of its first; the table is stored, so the names
    # hold although a task may be repeated.
    keyed = source.select(F.monotonically_increasing_id().alias("key"), "text", "row")
    stored = write_table(keyed.mapInArrow(
        read, "chunk long, tokens long, known long, base double, score double, segment int, docs binary, "
        f"counts binary, words binary, row {dict(keyed.dtypes)['row']}"), "scores")
    shared.destroy()  # what follows reads the stored scores, so no task needs room for the model any more
    vocabulary = words.where(F.col("n") * COMMON < in_words).select(
        F.shiftright(
            F.shiftrightunsigned("key", 40).cast("long") * F.lit(segments).cast("long"), 24
        ).cast("int").alias("segment"), F.col("key").alias("word"), "n",
    )

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("word").to_numpy().view(np.uint64)
        by = np.argsort(h)
        h, n = h[by], right.column("n").to_numpy()[by]
        sums, known = [], []
        for counts, body in zip(left.column("counts"), left.column("words")):
            at = _index(h, np.frombuffer(body.as_buffer(), np.uint64))
            c = np.where(at >= 0, n[at], 0) if len(n) else np.zeros(len(at))
            starts = np.concatenate([[0], np.cumsum(np.frombuffer(counts.as_buffer(), np.int32))[:-1]])
            sums.append(np.add.reduceat(logs(c), starts).tobytes())
            known.append(np.add.reduceat((c > 0).astype(np.int32), starts).astype(np.int32).tobytes())
        return pa.table({
            "chunk": left.column("chunk"), "docs": left.column("docs"),
            "base": pa.array(sums, pa.binary()), "known": pa.array(known, pa.binary()),
            "score": pa.nulls(len(sums), pa.binary()),
        })

    def look_up_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [(level.keys, level.counts) for level in base_levels.value.levels]
        k = right.column("k").to_numpy()
        for length in range(BASE_LEVELS, order + 1):
            tables.append(_sorted(right.filter(pa.array(k == length))))
        trie = Trie(tables)
        trie.prepare()
        sums = []
        for counts, body in zip(left.column("counts"), left.column("words")):
            starts = np.concatenate([[0], np.cumsum(np.frombuffer(counts.as_buffer(), np.int32))[:-1]])
            sums.append(np.add.reduceat(trie.log10(np.frombuffer(body.as_buffer(), np.uint64)), starts).tobytes())
        return pa.table({
            "chunk": left.column("chunk"), "docs": left.column("docs"),
            "base": pa.nulls(len(sums), pa.binary()), "known": pa.nulls(len(sums), pa.binary()),
            "score": pa.array(sums, pa.binary()),
        })

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a chunk with what its rare words and strings add, from all segments."""
        base = left.column("base").to_numpy().copy()
        known = left.column("known").to_numpy().copy()
        score = left.column("score").to_numpy().copy()
        at = left.column("segment").to_numpy()  # the place in the chunk
        back = np.empty(len(at), np.int64)
        back[at] = np.arange(len(at))
        for docs, sums, n, more in zip(*(right.column(c) for c in ("docs", "base", "known", "score"))):
            who = back[np.frombuffer(docs.as_buffer(), np.int32)]
            if more.is_valid:
                score[who] += np.frombuffer(more.as_buffer(), np.float64)
                continue
            base[who] += np.frombuffer(sums.as_buffer(), np.float64)
            known[who] += np.frombuffer(n.as_buffer(), np.int32)
        return pa.table({
            "tokens": left.column("tokens"), "known": pa.array(known), "base": pa.array(base),
            "score": pa.array(score), "row": left.column("row"),
        })

    rare = stored.where("words is not null").select("segment", "chunk", "docs", "counts", "words")
    answer = "chunk long, docs binary, base binary, known binary, score binary"
    looked_up = rare.where("segment >= 0").groupBy("segment").cogroup(vocabulary.groupBy("segment")).applyInArrow(look_up, answer)
    if not whole:
        asked = rare.where("segment < 0")
        # Parts of the trie that many ask are copied, so that no task looks up too much.
        copies = asked.groupBy("segment").agg(
            F.ceil(F.sum(F.length("words")) / (8 * LOOKED_UP)).cast("int").alias("copies"))
        asked = asked.join(copies, "segment").withColumn("copy", F.pmod(F.xxhash64("chunk"), "copies").cast("int")).drop("copies")
        context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
        part = F.shiftright((context * 40503).bitwiseAND(F.lit(0xFFFF)) * parts, 16)
        trie = every.where(F.col("k") >= BASE_LEVELS).withColumn("segment", (-1 - part).cast("int")).join(
            copies, "segment").select("segment", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "k", "key", "n")
        looked_up = looked_up.unionByName(asked.groupBy("segment", "copy").cogroup(
            trie.groupBy("segment", "copy")).applyInArrow(look_up_strings, answer))
    texts_of = stored.where("words is null").select("chunk", "segment", "tokens", "known", "base", "score", "row")
    scores = texts_of.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(
        add_up, f"tokens long, known long, base double, score double, row {dict(keyed.dtypes)['row']}")
    return scores.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
