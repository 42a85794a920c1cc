"""Merkle manifests, scaled sketches and token alignment against brute force, and odd rows."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubline.llm import alignment, merkle, sketches, tokens
from scrubline.llm.queries import QUERIES, TOKENIZERS
from tests.conftest import SF_SMALL

DOC = "doc_id long, source string, lang string, n_chars long, text string"
A_PATH, B_PATH = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def odd_rows():
    r = random.Random(3)
    rows = []
    for i in range(20):
        text = " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(200)))
        rows.append((i, f"s{i % 3}", r.choice(["en", "en", "fr", None, ""]), len(text), text))
    rows += [(100, None, "en", None, None), (101, "", "en", 0, ""), (102, "s", "only", 5, "é ß\n\t"), (None, "s", "en", 1, "x"),
             (None, None, None, None, None), (7, "s1", "en", 3, "another row of seven"),
             (103, "s", "en", 60_000, " ".join(f"v{i}" for i in range(60_000)))]
    rows += [(15, "hot", "en", 9, "a row that stands here very often")] * 12
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(5).cache()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, arity):
    """All levels, and the siblings of each leaf on the way up."""
    ways, levels = [[] for _ in leaves], [list(leaves)]
    while len(levels[-1]) > 1:
        now, depth = levels[-1], len(levels) - 1
        for i, way in enumerate(ways):
            at = i // arity ** depth
            run = range(at - at % arity, min(at - at % arity + arity, len(now)))
            way.append((at % arity, [now[j] for j in run if j != at]))
        levels.append([sha(*now[i:i + arity]) for i in range(0, len(now), arity)])
    return levels[-1][0], ways


def null_first(v):
    return (v is not None, v if v is not None else 0)


def manifest_of(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done, tops = {}, []
    for g in order:
        at = sorted(((null_first(r[0]), leaf_of((r[0], r[1], r[2], r[3], r[4]))) for r in groups[g]))
        done[g] = at, tree([leaf for _, leaf in at], arity)
        tops.append(done[g][1][0])
    root, above = tree(tops, arity)
    found = []
    for g, up in zip(order, above):
        at, (top, ways) = done[g]
        found += [(key[1] if key[0] else None, leaf, top, root, way + up) for (key, leaf), way in zip(at, ways)]
    return found


def built(df, arity):
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return merkle.proofs(merkle.build(df, merkle.leaf_digest(*columns), F.col("lang"), ["doc_id"], arity=arity))


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_is_brute_forces_and_finds_tampering(docs, arity):
    found = built(docs, arity).withColumns({
        "good": merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root"),
        "bad": merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")}).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.slot, list(s.others)) for s in r.proof]) for r in found]
    key = lambda t: (str(t[0]), t[1], str(t[4]))
    assert sorted(got, key=key) == sorted(manifest_of(odd_rows(), arity), key=key)
    assert {(r.good, r.bad) for r in found} == {(True, False)}


def test_manifest_of_little(spark):
    none = spark.createDataFrame([], DOC)
    assert built(none, 2).collect() == []
    one = built(spark.createDataFrame([(1, "s", "en", 1, "x")], DOC), 2).first()
    assert one.leaf == one.subroot == one.root == leaf_of((1, "s", "en", 1, "x")) and one.proof == []


# Sketches


def sketch_by_hand(text):
    """From the shingles' texts: only their hashing is the library's."""
    hashes = set()
    for shingle in tokens.shingle_texts(text):
        _, (h,) = next(iter(tokens.shingle_sets(pa.array([" ".join(shingle)]))))
        hashes |= {int(x) >> 1 for x in h}
    below = sorted(h for h in hashes if h < (1 << 63) // sketches.SCALE)
    return below or sorted(hashes)[:1]


def like_by_hand(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def compared_by_hand(rows):
    counts = Counter((r[0], r[4] or "") for r in rows)
    order = sorted(counts, key=lambda d: (d[0] is None, -(d[0] or 0), d[1].encode()))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 2
        changed = text[:len(text) - cut] + after[:cut]
        own, theirs, following = sketch_by_hand(text), sketch_by_hand(changed), sketch_by_hand(after)
        out += [(i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, theirs,
                 like_by_hand(own, theirs), like_by_hand(own, following))] * counts[i, text]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[2]))


def compared(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, list(r.sketch), list(r.edited_sketch), r.near_edited, r.near_next)
            for r in sketches.compare_with_next(df).collect()]


def test_comparison_is_brute_forces(docs):
    assert in_order(compared(docs)) == in_order(compared_by_hand(odd_rows()))


def test_copies_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(sketches, "COPIES_A_PIECE", 7)
    assert len(compared(docs)) == len(odd_rows())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_comparison_of_few(spark, n):
    rows = [(i, "s", "en", 1, f"one two three {i}") for i in range(n)]
    assert in_order(compared(spark.createDataFrame(rows, DOC))) == in_order(compared_by_hand(rows))


def test_rows_without_ids_only(spark):
    rows = [(None, "s", "en", 1, t) for t in ("b b b", None, "a a")]
    assert in_order(compared(spark.createDataFrame(rows, DOC))) == in_order(compared_by_hand(rows))


def test_fingerprint_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {r[0]: r for r in compared_by_hand([(d.doc_id, None, None, None, d.text) for d in docs])}
    got = QUERIES["op13_fingerprints"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        _, n, digest, own, theirs, near, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, digest, near, following)
        assert r.fingerprint == "".join(f"{h:016x}" for h in own) and r.edited_fingerprint == "".join(f"{h:016x}" for h in theirs)


def test_sketches_merge_and_contain(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    rows = [("a", " ".join(words[:20_000])), ("b", " ".join(words[20_000:])), ("whole", " ".join(words)), ("short", "just three words"), ("none", None)]
    df = sketches.with_sketch(spark.createDataFrame(rows, "sketch string, text string"))
    assert df.columns == ["sketch", "text", "sketch_"]
    found = {x.sketch: x.sketch_ for x in df.collect()}
    union = df.where("sketch in ('a', 'b', 'short', 'none')").agg(sketches.merged(F.collect_list("sketch_")).alias("m")).first().m
    whole = set(found["whole"])
    # Four shingles reach over the cut, one is the short text's and only counts if it is below.
    assert set(found["a"]) | set(found["b"]) <= set(union) and len(set(union) ^ whole) <= 6
    assert found["none"] == [] and len(found["short"]) == 1
    pair = spark.createDataFrame([(found["a"], found["whole"])], "a array<long>, w array<long>").select(
        sketches.containment(F.col("a"), F.col("w")).alias("c"), sketches.likeness(F.col("w"), F.col("a")).alias("l"),
        sketches.containment(F.col("w"), F.col("a")).alias("back")).first()
    assert pair.c > .99 and pair.l == pair.c and abs(pair.back - .5) < .05


# Alignment


def align_by_hand(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_PATH)
    letters, found, count = alignment._byte_alphabet(), [], Counter()
    for text in texts:
        text = text or ""
        left, right = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        sides = [[bytes(letters[c] for c in t) for t in left.tokens], [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[] for _ in cuts], [[] for _ in cuts]]
        for side, ids in enumerate((left.ids, right)):
            for e, i in zip(ends[side], ids):
                groups[side][bisect.bisect_left(cuts, e)].append(i)
        pairs = [(x[-1], y[-1]) for x, y in zip(*groups)]
        count.update(pairs)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*groups))
        found.append((len(ends[0]), len(ends[1]), len(cuts), pairs, hashlib.sha256(shown.encode()).hexdigest()))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        *f[:3], len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for f in found]


ODD_TEXTS = [
    None, "", " ", "\n\n \t x", "a ▁ b", "<|endoftext|> </s> <s> <unk> <0x41>", "naïve Größe 中文 🙂🙂 ẍ", "x" * 5000, " " * 5000,
    "ab" * 3000 + " " + "\n" * 3000, "nul \x00 byte", "  two  spaces  ", "don't I'll we've 12345 ½ ⅷ ²",
    " line par nbsp　wide \x85\x1c", "one more plain text", "one more plain text", "ﬁ é",
]


def test_alignment_is_brute_forces(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_A string").repartition(3)
    got = {r[0]: tuple(r) for r in alignment.align_with_counts(df, A_PATH, B_PATH).select(
        "doc_id", "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "N_A").collect()}
    want = align_by_hand(ODD_TEXTS)
    assert got == {i: (i, *w, "x") for i, w in enumerate(want)}


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_with_counts(none, A_PATH, B_PATH).collect() == []
    assert alignment.align(none, A_PATH, B_PATH, kind="group").collect() == []


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, align_by_hand([d.text for d in docs]))}
    got = QUERIES["op11_align_tokens"](spark, SF_SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_both_mergers_agree(text):
    side = alignment._tokenizers(A_PATH, B_PATH)[0]
    assert side.quick.encode_to_numpy(" " + text).tolist() == side._encode_carefully(" " + text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_links_are_brute_forces(a, b):
    a.append(max(0, sum(b) - sum(a)) + 1)
    b.append(sum(a) - sum(b))
    ends = [np.cumsum(a), np.cumsum(b)]
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    spans = [[(int(e) - n, int(e)) for e, n in zip(ends[s], side)] for s, side in enumerate((a, b))]
    group = lambda e: bisect.bisect_left(cuts, e)
    every = [(i, j, x, y) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1])]
    want = {
        "overlap": [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, j, x, y in every if min(x[1], y[1]) > max(x[0], y[0])],
        "end": [(i, j, 1) for i, j, x, y in every if x[1] == y[1]],
        "group": [(i, j, 1) for i, j, x, y in every if group(x[1]) == group(y[1])],
    }
    for kind, expected in want.items():
        got = alignment.links(np.array(a), np.array(b), kind)
        assert list(zip(*[g.tolist() for g in got])) == expected
