"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import fresh, smallest
from scrubline.llm.tokens import text_chunks, word_hashes

#: Terms are hashed into 2**TERM_BITS places.
TERM_BITS = 18
#: Terms are words and their beginnings of so many bytes, which inflected forms share.
PREFIXES = (4, 6)
#: Terms of the sample that are tested in pairs, and documents that a pair must be in.
PAIR_TERMS = 1024
MIN_PAIRED = 8


@dataclass(frozen=True)
class Machine:
    """A trained machine: bias, weight and factors of the terms it knows.

    logit(x) = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, with x_i = 1 if the text has the
    term i. The pairwise part is (|sum_i v_i|^2 - sum_i |v_i|^2) / 2.
    """

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def lookup(self) -> np.ndarray:
        """Row of each hashed place in the arrays, -1 for the terms not known."""
        at = np.full(1 << TERM_BITS, -1, dtype=np.int32)
        at[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return at

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of documents whose term rows are ``rows``, document d from starts[d] on."""
        n = len(starts) - 1
        line, square = np.zeros(n), np.zeros((n, self.factors.shape[1]))
        own, full = np.zeros(n), np.diff(starts) > 0
        if len(rows):
            v = self.factors[rows]
            first = starts[:-1][full]
            line[full] = np.add.reduceat(self.weights[rows], first)
            square[full] = np.add.reduceat(v, first, axis=0)
            own[full] = np.add.reduceat((v * v).sum(1), first)
        return self.bias + line + 0.5 * ((square * square).sum(1) - own)


def document_terms(column, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct terms, starts) for runs of rows; ``at`` maps terms, dropping negatives."""
    for start, _, data, offsets in text_chunks(column):
        words, first, *beginnings = word_hashes(data, offsets, PREFIXES)
        terms = (np.concatenate([words, *beginnings]) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
        owner = np.tile(np.repeat(np.arange(len(first) - 1), np.diff(first)), 1 + len(PREFIXES))
        if at is not None:
            terms = at[terms].astype(np.int64)
            known = terms >= 0
            terms, owner = terms[known], owner[known]
        both = np.unique((owner << TERM_BITS) | terms)
        starts = np.searchsorted(both, np.arange(len(first)) << TERM_BITS)
        yield start, both & ((1 << TERM_BITS) - 1), starts


def paired_terms(
    terms: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, marked: np.ndarray, min_documents: int,
) -> np.ndarray:
    """Terms that say something about the label together with another, though perhaps nothing alone.

    A pair counts if documents with both differ in label from those with either beyond the chance of the
    most extreme of all pairs tested. Tested are the PAIR_TERMS most common terms of the sample that are
    not in most of its documents; each of its words stands there once, by itself.
    """
    usual = (counts >= max(min_documents, MIN_PAIRED)) & (2 * counts <= len(labels))
    chosen = np.argsort(np.where(usual, -counts, 1), kind="stable")[:min(PAIR_TERMS, int(usual.sum()))]
    if len(chosen) < 2:
        return np.zeros(0, np.int64)
    at = np.full(1 << TERM_BITS, -1, dtype=np.int64)
    at[chosen] = np.arange(len(chosen))
    both, bad = np.zeros((2, len(chosen), len(chosen)))
    for start in range(0, len(terms), 1024):
        rows = [r[r >= 0] for r in (at[t] for t in terms[start:start + 1024])]
        seen = np.zeros((len(rows), len(chosen)), np.float32)
        seen[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)] = 1
        both += seen.T @ seen
        bad += seen.T @ (seen * labels[start:start + 1024, None].astype(np.float32))
    # Smoothed shares of label 1 among the documents with a term.
    rate = (marked[chosen] + labels.mean()) / (counts[chosen] + 1.0)
    high, low = np.maximum(rate[:, None], rate), np.minimum(rate[:, None], rate)
    more, less = bad - both * high, both * low - bad
    chi = np.maximum(
        np.where(more > 0, more ** 2 / (both * high * (1 - high) + 1e-9), 0),
        np.where(less > 0, less ** 2 / (both * low * (1 - low) + 1e-9), 0))
    # Terms that go together always are one, such as a word and its beginning.
    apart = both < 0.9 * np.minimum(counts[chosen][:, None], counts[chosen])
    found = (both >= MIN_PAIRED) & apart & (chi > 4 * np.log(len(chosen)) + 8)
    return chosen[found.any(1)]


def fit_machine(
    terms: list[np.ndarray], labels: np.ndarray, factors: int = 8, epochs: int = 12, rate: float = 0.05,
    decay: float = 2e-4, min_documents: int = 2, seed: int = 7,
) -> Machine:
    """Logistic loss, minimized by AdaGrad in shuffled batches.

    Of the terms in at least ``min_documents`` documents those are used that depend on the label by the
    chi-square test, alone or as one of a pair, so that chance words do not drown the others. Without
    documents of both labels the machine is its bias alone.
    """
    flat = np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64)
    counts = np.bincount(flat, minlength=1 << TERM_BITS)
    marked = np.bincount(flat, np.repeat(labels, [len(t) for t in terms]), minlength=1 << TERM_BITS)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    spread = counts * share * (1 - share) * (1 - counts / (len(labels) + 1.0)) + 1e-9
    chi = np.where(counts >= min_documents, (marked - counts * share) ** 2 / spread, 0.0)
    bias = float(np.log(share / (1 - share)))
    known = np.zeros(0, np.int64)
    if labels.min(initial=1) < labels.max(initial=0):
        alone = np.flatnonzero(chi > 7.88)  # the 0.5 % point of the test
        known = np.union1d(alone, paired_terms(terms, labels, counts, marked, min_documents))
    if not len(known):
        return Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    rng = np.random.Generator(np.random.PCG64(seed))
    batch = int(np.clip(len(labels) // 64, 4, 256))  # small samples take as many steps
    w, v = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors))
    gw, gv, gb = np.full(len(known), 1e-3), np.full(v.shape, 1e-3), 1e-3
    at = np.full(1 << TERM_BITS, -1, dtype=np.int64)
    at[known] = np.arange(len(known))
    docs = [r[r >= 0] for r in (at[t] for t in terms)]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            rows = np.concatenate([docs[d] for d in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(docs[d]) for d in chosen])
            starts = np.searchsorted(owner, np.arange(len(chosen) + 1))
            logit = Machine(bias, known, w, v).logits(rows, starts)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) / len(chosen)
            used, inverse = np.unique(rows, return_inverse=True)
            vr, e = v[rows], error[owner]
            sums = np.zeros((len(chosen), v.shape[1]))
            full = np.diff(starts) > 0
            if len(rows):
                sums[full] = np.add.reduceat(vr, starts[:-1][full], axis=0)
            dw = np.bincount(inverse, e, len(used)) + decay * w[used]
            pull = e[:, None] * (sums[owner] - vr)
            dv = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(v.shape[1])], 1)
            dv = dv + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            db = error.sum()
            gb += db * db
            bias -= float(rate * db / np.sqrt(gb))
    return Machine(bias, known, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, max_documents: int) -> Machine:
    """A machine from at most ``max_documents`` rows of ``labels``, the first by a hash of the id."""
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label)).cast("double").alias("_label")
    )
    ids = smallest(ids, F.xxhash64("_id"), ["_id"], max_documents, ids.count())
    # At most max_documents ids.
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, terms, starts in document_terms(batch.column(1)):
                n = len(starts) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, n), batch.column(2).slice(start, n),
                    pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(terms.astype(np.int32))),
                ], ["_id", "_label", "_terms"])

    id_type = dict(docs.dtypes)[doc_id]
    features = chosen.select("_id", "_text", "_label").mapInArrow(
        featurize, f"_id {id_type}, _label double, _terms array<int>"
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, marks = [], []
        for batch in batches:
            marks.append(batch.column(1).to_numpy())
            column = batch.column(2)
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
            ends = ends - ends[0]
            terms += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        machine = fit_machine(terms, np.concatenate([*marks, np.zeros(0)]))
        yield pa.RecordBatch.from_arrays([
            pa.array([machine.bias]), *[pa.array([a.tobytes()]) for a in (
                machine.terms.astype(np.int64), machine.weights, machine.factors.astype(np.float64))],
        ], ["bias", "terms", "weights", "factors"])

    # The sample is bounded, so one task may hold it; its order does not depend on the partitions.
    row = features.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", F.size("_terms"), "_label").mapInArrow(
        fit, "bias double, terms binary, weights binary, factors binary"
    ).collect()
    if not row:
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 8)))
    row = row[0]
    known = np.frombuffer(row["terms"], np.int64)
    factors = np.frombuffer(row["factors"])
    return Machine(
        row["bias"], known, np.frombuffer(row["weights"]), factors.reshape(len(known), len(factors) // max(1, len(known)))
    )


def score(docs: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``to``, from whole texts; null is empty."""
    kept = [c for c in docs.columns if c != to]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept if c != text]).alias("row")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most 2**TERM_BITS terms

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = m.lookup()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start, rows, starts in document_terms(batch.column(0), at):
                logit = m.logits(rows, starts)
                scores[start:start + len(logit)] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], ["text", "row", "score"])

    rows = docs.select(F.col(f"`{text}`").alias("text"), rest)
    scored = rows.mapInArrow(apply, f"text string, row {dict(rows.dtypes)['row']}, score double")
    return scored.select(
        *[F.col("text" if c == text else f"row.`{c}`").alias(c) for c in kept], F.col("score").alias(to)
    )


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    max_documents: int = 20_000, to: str = "score",
) -> DataFrame:
    """``docs`` with ``to``, the probability that ``label`` is 1, learned from ``labels``.

    Terms are the distinct words (A-Z as a-z) of a text and their beginnings, hashed. The factors let two terms say
    together what neither says alone. Training takes at most ``max_documents`` labelled documents,
    chosen by a hash of their ids. Rows without a label or id teach nothing; without labels of both
    kinds every document gets the share of label 1 (0.5 without any). Null and empty texts are
    scored by the bias alone. Repeated rows get equal scores, other columns stay (one named as
    ``to`` is replaced), an empty table stays empty. Scoring shuffles nothing.
    """
    return score(docs, train(docs, labels, label, doc_id, text, max_documents), text, to)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    to = fresh(docs, "_toxicity")
    scored = score_toxicity(docs, labels, to=to, **options)
    return scored.where(F.col(to) < threshold).drop(to)
