"""Inputs that once failed: one label, pairs of words, equal rows, mixed dimensions, short items, repeated ids."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import decontaminate, mixing, multi_index, sharding, tokens, toxicity


@pytest.mark.parametrize("marks, score", [([0, 0], 0.5 / 3), ([1, 1], 2.5 / 3), ([0, 1], 0.5)])
def test_toxicity_without_a_telling_term(spark, marks, score):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(len(marks))], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    got = [r.score for r in toxicity.score_toxicity(docs, labels).collect()]
    assert got == pytest.approx([score] * len(marks))


def test_toxicity_of_a_pair_of_harmless_words(spark):
    """Each word stands as often in toxic texts as in others; both or neither make a text toxic."""
    r = random.Random(4)
    rows = []
    for i in range(1200):
        a, b = r.random() < .4, r.random() < .4
        toxic = (a == b) if a or b else r.random() < .3
        words = [f"w{r.randrange(3000)}" for _ in range(60)] + ["zorble"] * a + ["quindle"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic), a or b))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, telling boolean").repartition(3)
    scored = toxicity.score_toxicity(df.select("doc_id", "text", "telling"), df.where("doc_id < 900").select("doc_id", "toxic"))
    test = {i: t for i, _, t, telling in rows if i >= 900 and telling}
    hits = [(x.score >= .5) == (test[x.doc_id] == 1) for x in scored.collect() if x.doc_id in test]
    assert np.mean(hits) > .85


def test_shards_of_equal_rows(spark):
    """A third of all rows are one row: shards stay near equal, and slots gapless."""
    same = [(1, "the same text in every one of these rows", "x")] * 2000
    also = [(10_000 + i, "one text under many ids " * 3, "x") for i in range(1000)]
    rows = same + also + [(2 + i, f"text number {i} " * (1 + i % 5), "x") for i in range(3000)]
    done = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5), piece_bytes=2000).collect()
    assert Counter((r.doc_id, r.text) for r in done) == Counter(r[:2] for r in rows)
    size, slots = Counter(), {}
    for r in done:
        size[r.shard] += len(r.text) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(size.values()) < 1.15 * mean and min(size.values()) > .85 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_vectors_of_several_dimensions(spark):
    r = np.random.default_rng(1)
    base = r.normal(0, 1, 8)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8)]) for i in range(50)]
    rows += [(50 + i, [float(x) for x in base + r.normal(0, .01, 8)]) for i in range(4)]
    rows += [(60, [1.0, 2.0, 3.0]), (61, [2.0, 4.0, 6.0]), (62, [3.0, -1.0, 0.0]), (63, [5.0]), (64, [2.0]), (65, [-1.0]), (66, [1.0, 2.0, 3.0, 0.0])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in multi_index.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(60, 67)] == [(1, 60), (1, 60), (0, 62), (1, 63), (1, 63), (0, 65), (0, 66)]
    assert [got[i] for i in range(50, 54)] == [(3, 50)] * 4


def test_short_items_inside_long_documents(spark):
    docs = [(1, "one two THREE four five\nsix seven eight nine ten"), (2, "three four five six"), (3, "three four five"),
            (4, None), (5, "needle"), (6, "a hay stack with a Needle in it, twice: needle"), (7, "six five four three two one")]
    items = [(1, "three four five six"), (2, "needle"), (3, "two one"), (4, ""), (5, "one two three four five six"), (6, None)]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in found.collect()}
    widths = (1, 2, 4)
    want = {}
    for d, text in docs:
        held = tokens.shingle_texts(text, widths)
        for i, item in items:
            sought = tokens.shingle_texts(item)
            if sought and 5 * len(sought & held) >= 4 * len(sought):
                want[d, i] = (len(sought), len(sought & held))
    assert got == want and {(1, 1), (2, 1), (5, 2), (6, 2), (7, 3), (1, 5)} == set(want)


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(1, "a", "one two three"), (1, "a", "one two three"), (1, "a", "four five"), (None, "a", "six"), (None, "b", "seven eight"), (2, "b", None)]
    pieces = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), number_rows=True)
    each = pieces.groupBy("row_no").agg(F.first("doc_id").alias("d"), F.first("size").alias("s"), F.sum("words").alias("t")).collect()
    key = lambda t: (t[0] or 0, t[1])
    assert sorted(((r.d, r.s) for r in each), key=key) == sorted([(1, 3), (1, 3), (1, 2), (None, 1), (None, 2), (2, 0)], key=key)
    assert all(r.t <= 2 * r.s for r in each)
