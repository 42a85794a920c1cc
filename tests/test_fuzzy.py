"""Spelling merge against the all-pairs definition."""

import itertools
import random

import pytest

import scrubline as sl
from scrubline.functions import vocab
from scrubline.functions.categories import longest_common
from scrubline.operators import fuzzy
from tests.test_expressions import lcs


def opposite(a, b):
    return any(a == p + b or b == p + a for p in vocab.NEGATION_PREFIXES)


def alike(a, b, threshold):
    if opposite(a, b):
        return False
    if 200 * lcs(a, b) / (len(a) + len(b)) >= threshold:
        return True
    short, long = sorted([a, b], key=len)
    if len(short) >= 4 and long.startswith(short):
        return True
    words = list(zip(a.split(" "), b.split(" ")))
    if len(a.split(" ")) != len(b.split(" ")) or len(words) < 2:
        return False
    return all(min(len(x), len(y)) >= 2 and (x.startswith(y) or y.startswith(x)) for x, y in words)


def stems(seed):
    rnd = random.Random(seed)
    base = ["active", "inactive", "legal", "dropped out", "business administration", "bus administration",
            "business admin", "customer support 12", "cust support 1", "st ro", "street road", "internet banking"]

    def spoilt(word):
        letters = list(word)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(letters))
            kind = rnd.randint(0, 2)
            if kind == 0 and len(letters) > 1:
                letters.pop(i)
            elif kind == 1:
                letters.insert(i, rnd.choice("abcdest "))
            else:
                letters[i] = rnd.choice("abcdest ")
        return " ".join("".join(letters).split())

    made = {spoilt(rnd.choice(base)) for _ in range(160)}
    made |= {" ".join("".join(rnd.choices("ab ", k=rnd.randint(1, 9))).split()) for _ in range(50)}
    return sorted(made - {""})


@pytest.mark.parametrize("threshold, short", [(85, 5000), (70, 5000), (85, 0), (70, 0)])
def test_pairs_and_groups_match_all_pairs(spark, monkeypatch, threshold, short):
    monkeypatch.setattr(fuzzy, "SHORT_VOCABULARY", short)
    values = sorted(stems(threshold + short) + [f"long numbered name {i}" for i in range(40)])
    df = spark.createDataFrame([("c", v) for v in values], "column string, stem string").coalesce(2)
    found = fuzzy.stem_pairs(df, threshold)
    got = {(r.stem_a, r.stem_b) for r in found.collect()}
    first = {}
    for v in values:
        first.setdefault(v.replace(" ", ""), v)
    want = {(a, b) for a, b in itertools.combinations(values, 2) if alike(a, b, threshold)}
    want |= {(first[v.replace(" ", "")], v) for v in values
             if first[v.replace(" ", "")] != v and not opposite(first[v.replace(" ", "")], v)}
    assert got == want

    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in want:
        low, high = sorted([root(a), root(b)])
        parent[high] = low
    groups = {r.stem: r.root for r in fuzzy.connected_groups(found).collect()}
    assert {v: groups.get(v, v) for v in values} == {v: root(v) for v in values}
    if not short:  # the way of long vocabularies, which lists no pairs inside a group
        linked = {r.stem: r.root for r in fuzzy.linked_groups(df, threshold).collect()}
        assert {v: linked.get(v, v) for v in values} == {v: root(v) for v in values}


@pytest.mark.parametrize("size", [10, 11, 62, 63, 64, 100])
def test_stems_of_many_words_match_word_by_word(spark, size):
    words = [f"w{i:03d}" for i in range(size)]

    def stem(**changed):
        return " ".join(changed.get(f"at{i}", w) for i, w in enumerate(words))

    last = f"at{size - 1}"
    values = [stem(at0="w000" + "x" * 900), stem(**{last: words[-1] + "y" * 900}), stem(at3="w0"),
              stem(**{last: words[-1] + "z" * 900}), stem(at3="w0z")]
    want = {tuple(sorted(p)) for p in itertools.combinations(values, 2) if all(
        x.startswith(y) or y.startswith(x) for x, y in zip(p[0].split(" "), p[1].split(" ")))}
    df = spark.createDataFrame([("c", v) for v in values], "column string, stem string").coalesce(1)
    got = {(r.stem_a, r.stem_b) for r in fuzzy._token_prefix_pairs(df).collect()}
    assert 0 < len(want) < 10 and got == want


@pytest.mark.parametrize("size", [12, 18, 64, 100])
def test_stems_whose_words_are_all_shortened(spark, size):
    values = [" ".join(f"word{i}xyz"[:n] for i in range(size)) for n in (5, 6, 8, 20)]
    values += [" ".join(f"word{i}xyz"[:5 + (i + k) % 3] for i in range(size)) for k in range(3)]
    values += [" ".join(["other"] * (size - 1) + [f"end{k}"]) for k in range(3)]
    df = spark.createDataFrame([("c", v) for v in values], "column string, stem string").coalesce(1)
    got = {(r.stem_a, r.stem_b) for r in fuzzy._token_prefix_pairs(df).collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(values, 2) if all(
        x.startswith(y) or y.startswith(x) for x, y in zip(p[0].split(" "), p[1].split(" ")))}
    assert got == want and len(want) >= 6


def test_walk_matches_all_pairs(spark, monkeypatch):
    """Groups that are walked place by place instead of compared, several columns and lengths at once."""
    monkeypatch.setattr(fuzzy, "FEW_STEMS", 2)
    rnd = random.Random(8)
    values = {" ".join("ab" + "".join(rnd.choices("xy", k=rnd.randint(0, 3))) for _ in range(n)) for n in (2, 3, 4) for _ in range(60)}
    values |= {"ab same " + "".join(["cd", *rnd.choices("xy", k=rnd.randint(0, 4))]) for _ in range(30)}
    df = spark.createDataFrame([(c, v) for v in values for c in ("c", "d")], "column string, stem string").coalesce(2)
    rows = [tuple(r) for r in fuzzy._token_prefix_pairs(df).collect()]
    want = {tuple(sorted(p)) for p in itertools.combinations(values, 2) if len(p[0].split(" ")) == len(p[1].split(" ")) and all(
        x.startswith(y) or y.startswith(x) for x, y in zip(p[0].split(" "), p[1].split(" ")))}
    assert {r[1:] for r in rows if r[0] == "c"} == want == {r[1:] for r in rows if r[0] == "d"}
    assert len(rows) == len(set(rows)) > 100


def test_a_very_long_value_among_short_ones(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choices("abcdefgh ", k=100_000))
    values = [f"value {i} {chr(97 + i % 26) * 3}" for i in range(200)] + [long, long[:20] + "," + long[20:]]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v for r in sl.fuzzy_standardize(df.where("length(v) < 1000 or v not like '%,%'"), "v").collect()}
    assert long in got
    assert sl.similar_pairs(df, "v").where("length(stem_a) > 1000").count() <= 1


def test_longest_common_stops_early_only_below():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 150))) for _ in range(2))
        want = lcs(a, b)
        assert longest_common(a, b) == want
        least = rnd.randint(0, 150)
        got = longest_common(a, b, least)
        assert got == want if want >= least else got < least


def test_long_chain_is_one_group(spark):
    links = [("c", f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)]
    pairs = spark.createDataFrame(links, "column string, stem_a string, stem_b string").coalesce(2)
    assert {r.root for r in fuzzy.connected_groups(pairs).collect()} == {"n000"}


def test_merge_is_transitive_and_spares_opposites(spark):
    values = ["Dropped Out", "DroppedOut", "Drop-Out"] * 3 + ["Active", "Inactive", "活动", "北京", None]
    df = spark.createDataFrame([(v,) for v in values], "status string").coalesce(1)
    got = sorted((r["status"] or "") for r in sl.fuzzy_standardize(df, "status").collect())
    assert got == sorted(["Drop-Out"] * 9 + ["Active", "Inactive", "活动", "北京", ""])


def test_most_frequent_spelling_wins_through_the_join_too(spark, monkeypatch):
    df = spark.createDataFrame([("cats",), ("cat",), ("cats",), ("dog",), (None,)], "v string").coalesce(1)
    want = ["", "cats", "cats", "cats", "dog"]
    assert sorted(r["v"] or "" for r in sl.fuzzy_standardize(df, "v").collect()) == want
    monkeypatch.setattr(fuzzy, "MAX_LITERALS", 0)
    assert sorted(r["v"] or "" for r in sl.fuzzy_standardize(df, "v").collect()) == want
    assert sl.fuzzy_standardize(df, "absent").count() == 5


def test_numbered_names_are_one_group_without_their_pairs(spark, monkeypatch):
    """Every name is alike to hundreds of others; the list of pairs by ratio stays short."""
    df = spark.createDataFrame(
        [("c", f"numbered customer name {i:05d}") for i in range(3000)]
        + [("d", f"numbered customer name {i:05d}") for i in range(0, 3000, 2)], "column string, stem string")
    listed = []
    find = fuzzy._ratio_pairs

    def counted(stems, threshold):
        pairs = find(stems, threshold)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(fuzzy, "_ratio_pairs", counted)
    groups = fuzzy.linked_groups(df).collect()
    assert {(r["column"], r["root"]) for r in groups} == {(c, "numbered customer name 00000") for c in "cd"}
    assert len(groups) == 4500 and sum(listed) < 50_000
