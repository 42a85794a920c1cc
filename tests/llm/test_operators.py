"""The ten operators against brute force, round trips and defined results for odd rows."""

import base64
import hashlib
import math
import os
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubline.llm import (
    chat, decontaminate, mixing, multi_index, ngram_join, pii, ppm, sharding, tokens, toxicity, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, key string, row int, score string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x{seed if r.random() < .5 else 0}" for _ in range(n)]


def sample_docs():
    """Copies, near copies, a hot source, odd spaces, nulls, empty and long texts, repeated rows."""
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(30 + i, i))))
    base = words(120, 1000)
    for i in range(40, 60):  # near copies with one or two words changed
        copy = list(base)
        for j in range(i % 3):
            copy[(i * 37 + j * 50) % 120] = f"new{i}{j}"
        rows.append((i, " ".join(copy)))
    rows += [(60 + i, " ".join(base).upper() if i % 2 else "\t".join(base) + "\n") for i in range(6)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "only four words here"), (74, "ONLY four\nwords here"),
             (75, "é" * 50 + " ß " + "word " * 3), (76, " ".join(words(20_000, 7, 10**6))),
             (None, "a text without any id at all"), (3, " ".join(words(33, 3))), (3, "another text of document three here")]
    return [(i, t, None if n % 17 == 0 else ("hot" if n % 3 else f"s{n % 5}"), "k", n, "x") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_docs(), DOC)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def shingles(text):
    return tokens.shingle_texts(text)


def test_hashed_shingles_are_the_plain_ones(docs):
    import pyarrow as pa

    texts = [r[1] for r in sample_docs()]
    found = {}
    for start, sets in tokens.shingle_sets(pa.array(texts).slice(0)):
        found.update({start + i: len(s) for i, s in enumerate(sets)})
    assert [found[i] for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    plain = WORD.findall(lower(texts[0]))
    assert shingles(texts[0]) == {tuple(plain[i:i + 5]) for i in range(len(plain) - 4)}


def test_containment(spark, docs, no_docs):
    rows = sample_docs()
    items = [(0, " ".join(rows[5][1].split()[3:20])), (1, " ".join(words(30, 999))), (2, None), (3, ""),
             (4, "only four words here"), (5, rows[76 - 10][1] if rows[76 - 10][1] else "x"),
             (0, " ".join(rows[9][1].split()[:12])), (None, " ".join(rows[11][1].split()[:9]))]
    broken = rows[20][1].split()[:30]
    broken[15] = "changed"
    items.append((6, " ".join(broken)))
    table = spark.createDataFrame([(a, b, "c") for a, b in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contaminated(docs, table).collect()}
    want = {}
    for doc, text, *_ in rows:
        for item, body in items:
            q = shingles(body)
            both = len(q & shingles(text))
            if q and 5 * both >= 4 * len(q):
                want[doc, item] = max(want.get((doc, item), (0, 1)), (both, len(q)), key=lambda v: (v[0] / v[1], v[0]))
    assert got == want and len(want) > 4
    kept = decontaminate.without_items(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(no_docs, table).count() == 0
    assert decontaminate.contaminated(docs, table.limit(0)).count() == 0


def groups_by_hand(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        least[find(i)] = min((v for v in (least.get(find(i)), doc) if v is not None), default=None)
    return sorted(((d[0], len(sets[i]), least[find(i)]) for i, d in enumerate(rows)), key=str)


@pytest.mark.parametrize("turns", [0, 3])
def test_near_copies(spark, docs, no_docs, monkeypatch, turns):
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", turns)
    monkeypatch.setattr(ngram_join, "FRAGMENT_SHINGLES", 1000)
    got = ngram_join.near_copies(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_hand(sample_docs())
    assert ngram_join.near_copies(no_docs).count() == 0


def test_chains_of_near_copies(spark):
    """Texts that drift away from each other: a long chain of links is one group."""
    text, rows = words(60, 5), []
    for i in range(40):
        text = text[:(i * 7) % 60] + [f"step{i}"] + text[(i * 7) % 60 + 1:]
        rows.append((100 - i, " ".join(text)))
    rows += [(200 + i, " ".join(words(60, 300 + i))) for i in range(5)]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_hand(rows)


def test_one_of_each_group_stays(docs, no_docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    leaders = {c for _, n, c in groups_by_hand(sample_docs()) if n}
    assert set(ids) >= leaders - {None} and ids.count(3) == 1 and {70, 71, 72} <= set(ids)
    assert len([i for i in ids if i is not None and 40 <= i < 66]) == 1
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_toxicity_learns_pairs(spark, no_docs):
    """An insult with a group word is toxic, either alone is not: no sum of weights tells."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        insult, group = r.random() < .5, r.random() < .5
        text = words(20, i, 50) + ["vermin"] * insult + ["folk"] * group
        r.shuffle(text)
        rows.append((i, " ".join(text), "s", "k", i, "x"))
        if i < 1100:
            labels.append((i, int(insult and group)))
    labels += [(5, None), (None, 1)]
    table = spark.createDataFrame(rows + [(None, None, None, None, None, None), (2000, "", "s", "k", 1, "x")], DOC)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    done = toxicity.score_toxicity(table, marks)
    assert done.columns == [c for c in table.columns if c != "score"] + ["score"]
    got = {x.doc_id: x.score for x in done.collect()}
    right = [(got[i] >= .5) == ({"vermin", "folk"} <= set(t.split())) for i, t, *_ in rows[1100:]]
    assert np.mean(right) > .97
    assert all(0 <= s <= 1 for s in got.values()) and got[None] == got[2000]
    assert toxicity.without_toxic(table, marks).columns == table.columns
    assert toxicity.score_toxicity(no_docs, marks).count() == 0
    assert {x.score for x in toxicity.score_toxicity(table, marks.limit(0)).collect()} == {0.5}


def test_machine_equals_its_formula():
    rng = np.random.Generator(np.random.PCG64(1))
    m = toxicity.Machine(.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = np.array([0, 2, 5, 1, 1 + 2])
    want = [m.bias + sum(m.weights[d]) + sum(m.factors[a] @ m.factors[b] for x, a in enumerate(d) for b in d[:x])
            for d in ([0, 2, 5], [], [1, 3])]
    assert np.allclose(m.logits(rows, np.array([0, 3, 3, 5])), want)


PAGES = [(1, "http://a/?x=1%0A", "same"), (2, "http://b", "same"), (3, None, "other é\r\n\r\nend"), (4, "u\r\nv", None), (5, "e", ""),
         (6, "long", "<p>" + "x" * 300_000), (7, "z", "same"), (None, "n", "same"), (7, "z2", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, record_id int").repartition(2)
    folder, files = warc.write_archives(pages, min_revisit_bytes=least)
    assert files.agg(F.sum("records")).first()[0] == len(PAGES) and files.count() > 1
    got = warc.read_archives(spark, folder, files).collect()
    assert sorted((str(r.record_id), str(r.url), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), str(u), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, u, h in PAGES)
    bodies = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert bodies[3] == "other é\r\n\r\nend".encode() and len(bodies[6]) == 300_003
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in got)
    if least:
        assert not [k for k in kinds if k[1] == "revisit"]
    else:
        assert {k for k in kinds if k[1] == "revisit"} == {(1, "revisit", 7), (2, "revisit", 7), (4, "revisit", 5), (7, "revisit", 7)}
        assert kinds[7, "response", None] == 1 and kinds[None, "response", None] == 1
    none, files = warc.write_archives(pages.limit(0))
    assert files.count() == 0


def test_broken_archives_are_named():
    import zstandard

    dictionary = zstandard.train_dictionary(1024, [b"WARC/1.1 %d record of a page" % (i * 7919) for i in range(300)])
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    record = warc.record_bytes(1, "http://a", b"payload")
    archive = warc.archive_header(dictionary.as_bytes()) + packer.compress(record) + packer.compress(record)
    assert [c for _, c in warc.frames(archive)] == [record, record]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(archive[:-3]))
    plain = zstandard.ZstdCompressor().compress(record)
    assert [c for _, c in warc.frames(plain)] == [record]
    with pytest.raises(ValueError, match="cut off"):
        warc.load_dictionary(archive[:20])
    for bad in (record.replace(b"payload", b"payl0ad"), record[:-5] + b"\r\n\r\n", record.replace(b"WARC-Date", b"Other"),
                record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def foreign(kind: str, block: bytes, *headers: str) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:8f1c>", "WARC-Date: 2020-02-02T00:00:00Z",
             *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    import zstandard

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\ncontent-length:4\r\nServer\r\n\r\nbody"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n"
    message = "Content-Type: application/http; msgtype=response"
    records = [
        (foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), b"software: x\r\n"),
        (foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request"), b""),
        (foreign("metadata", b"", "WARC-Concurrent-To: <urn:uuid:1>"), b""),
        (foreign("resource", b"\x00\xff", "WARC-Target-URI: http://a/%25"), b"\x00\xff"),
        (foreign("response", http, message, f"WARC-Payload-Digest: {sha(b'body')}"), b"body"),
        (foreign("response", chunked, message, f"WARC-Payload-Digest: {sha(b'body')}"), chunked.partition(b"\r\n\r\n")[2]),
        (foreign("response", b"20200202\na. 60 IN A 1.2.3.4\n", "Content-Type: text/dns"), b"20200202\na. 60 IN A 1.2.3.4\n"),
        (foreign("revisit", b"", "WARC-Refers-To-Target-URI: http://a", "WARC-Payload-Digest: md5:12"), None),
        (foreign("conversion", b"text", "WARC-Payload-Digest: sha256:00"), b"text"),
    ]
    folder = tmp_path / "archives"
    folder.mkdir()
    packer = zstandard.ZstdCompressor()
    own = warc.record_bytes(0, "http://a/%25", b"zero")
    (folder / "a.warc.zst").write_bytes(b"".join(packer.compress(r) for r, _ in [*records, (own, b"")]))
    got = warc.read_archives(spark, str(folder)).collect()
    assert [None if r.payload is None else bytes(r.payload) for r in got[:-1]] == [payload for _, payload in records]
    assert [r.record_type for r in got[:4]] == ["warcinfo", "request", "metadata", "resource"]
    assert {(r.record_id, r.refers_to, r.record_uri) for r in got[:-1]} == {(None, None, "<urn:uuid:8f1c>")}
    assert got[3].url == "http://a/%25" and got[7].payload_digest == "md5:12" and got[2].payload_digest == sha(b"")[5:]
    assert (got[-1].record_id, got[-1].url, got[-1].payload_bytes) == (0, "http://a/%25", 4)
    for bad in (foreign("letter", b""), foreign("revisit", b""), foreign("response", http[:-1], message),
                foreign("resource", b"x", f"WARC-Block-Digest: {sha(b'y')}"), foreign("response", b"HTTP/1.1 200 OK\r\n", message)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 16)
    rng = np.random.Generator(np.random.PCG64(2))
    center = rng.normal(size=16)
    rows = [rng.normal(size=16).tolist() for _ in range(150)] + [(center + rng.normal(size=16) * .08).tolist() for _ in range(80)]
    rows += [(center * 3).tolist()] * 40 + [(center * 1.5).tolist()]
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 15]
    x = np.array([np.array(r, dtype=np.float32).astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= .95
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(linked, label, len(rows)).min(1))
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, r, "k", 1) for i, r in enumerate(rows + odd)], "vec_id long, embedding array<float>, key string, unit int")
    got = sorted(multi_index.near_vectors(df).collect())
    assert [r.component_id for r in got] == [*label, *range(len(rows), len(rows) + len(odd))]
    assert [r.n_links for r in got] == [*linked.sum(1), *[0] * len(odd)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert multi_index.near_vectors(df.limit(0)).count() == 0
    assert multi_index.near_vectors(df.where("vec_id >= 271")).count() == len(odd)


def links_by_hand(x, threshold=.95):
    """Number of links of each row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(x[i:i + 1000] @ x.T >= threshold).sum(1) - 1 for i in range(0, len(x), 1000)])


def test_near_vectors_finds_the_links_of_many_distinct_near_copies(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    center = rng.normal(size=64)
    center /= np.linalg.norm(center)
    copies = center + rng.normal(size=(6667, 64)) * .2 / 8  # cosine to the centre about 0.98
    pairs = rng.normal(size=(1000, 64))
    x = np.concatenate([copies, pairs, pairs + rng.normal(size=(1000, 64)) * .15, rng.normal(size=(11333, 64))])
    want = links_by_hand(x)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(x.tolist())}))
    got = np.array([r.n_links for r in multi_index.near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all()
    assert got[:6667].sum() >= .99 * want[:6667].sum()
    assert got[6667:].sum() >= .98 * want[6667:].sum() > 0


def test_a_grid_that_needs_too_many_visits_becomes_coarser(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "MOST_VISITS", 1)
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 64)
    rng = np.random.Generator(np.random.PCG64(6))
    x = np.repeat(rng.normal(size=(100, 8)), 4, axis=0) + rng.normal(size=(400, 8)) * .15
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = [r.n_links for r in multi_index.near_vectors(df, target=1.0).orderBy("vec_id").collect()]
    assert got == links_by_hand(x).tolist()


def test_traversal_visits_nearest_cells_first():
    rng = np.random.Generator(np.random.PCG64(3))
    books = multi_index.Codebooks(rng.normal(size=(7, 2)), rng.normal(size=(5, 2)))
    x = rng.normal(size=(20, 4))
    a, b = books.distances(x)
    every = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    assert (books.traverse(x, 9) == np.argsort(every, 1)[:, :9]).all()


def test_mix(docs, no_docs):
    rows = sample_docs()
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    per = Counter()
    for r, n in zip(rows, size):
        per[r[2]] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, set(order), 1.5 * sum(size)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * per[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * per[s]
            rest -= target[s]
            left.remove(s)
    pieces = mixing.mix_documents(docs, block_words=64).collect()
    taken, by_source = Counter(), Counter()
    for p in pieces:
        assert p.target == pytest.approx(target[p.source]) and p.source_size == per[p.source]
        taken[p.doc_id, p.size] += p.words
        by_source[p.source] += p.words
    assert all(abs(by_source[s] - target[s]) <= 1 for s in target)
    sizes = Counter()
    for r, n in zip(rows, size):
        sizes[r[0], n] += n
    assert all(taken[k] <= 2 * sizes[k] for k in sizes) and {k for k, *_ in taken} == {r[0] for r in rows}
    slots = [p.slot for p in pieces if p.slot is not None]
    # No slot holds two sources, and a long stretch of the schedule holds each in proportion.
    assert len({(p.slot, p.source) for p in pieces if p.slot is not None}) == len(set(slots))
    again = mixing.mix_documents(docs.repartition(5), block_words=64).collect()
    assert Counter(map(str, again)) == Counter(map(str, pieces))
    whole = mixing.whole_documents(docs)
    assert whole.columns == docs.columns
    copies = Counter(r.row for r in whole.collect())
    assert set(copies.values()) <= {1, 2} and all(copies[r[4]] for r, n in zip(rows, size) if n == 0)
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.whole_documents(no_docs).count() == 0


def test_schedule_has_low_discrepancy(spark):
    needs = spark.createDataFrame([("a", 500), ("b", 300), (None, 200)], "source string, blocks long")
    slots = sorted((r.slot, r.source, r["rank"]) for r in mixing.slot_table(needs).collect())
    assert [s for s, *_ in slots] == list(range(len(slots)))
    seen = Counter()
    for slot, source, rank in slots:
        assert rank == seen[source]
        seen[source] += 1
        for s, share in (("a", .5), ("b", .3), (None, .2)):
            assert abs(seen[s] - share * (slot + 1)) < 4


CHATS = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "### User: #### ?x:\\ <\\/turn></turn>\n"), (1, 2, "user", ""),
         (2, 1, "assistant", "too early"), (2, 0, None, None), (3, 0, "to:ol\\", "### ?tool: x"), (3, None, "user", "first"),
         (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "system", "x\ny"), (5, 0, "user", "é" * 5000), (5, 1, "assistant", "</turn>" * 500)]


def test_chats_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in CHATS], "conv_id long, turn int, role string, text string, turns int")
    done = chat.format_chats(df).withColumn("formatted", chat.formatted_text(F.col("segments")))
    got = {r.conv_id: r for r in done.withColumns({"back": chat.read_turns(F.col("formatted")), "learned": chat.loss_text(F.col("segments"))}).collect()}
    by = {}
    for c, t, role, text in CHATS:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        assert [tuple(t) for t in got[c].back] == [t[1:] for t in sorted(turns)]
        assert got[c].learned == "".join(t[2] for t in sorted(turns) if t[1] == "assistant")
        assert got[c].formatted.count("</turn>\n") == len(turns)
    assert {c: r.valid_order for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: False}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language_model(spark, docs, no_docs):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    done = ppm.score_texts(docs, train)
    assert set(done.columns) == (set(docs.columns) - {"text"}) | {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    got = {r.row: r for r in done.collect()}
    rows = sample_docs()
    counts = Counter()
    for i, t, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3:
            counts.update([*WORD.findall(lower(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        own = [*WORD.findall(lower(r[1])), None]
        g = got[r[4]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + .1) / (total + .1 * (kinds + 1))) for w in own))
        assert g.score < 0 and math.isfinite(g.score)
    assert ppm.score_texts(no_docs, F.lit(True)).count() == 0
    untaught = {r.row: r.score for r in ppm.score_texts(docs, F.lit(False)).collect()}
    assert untaught[next(r[4] for r in rows if r[0] == 71)] == pytest.approx(-math.log10(256))


@pytest.mark.parametrize("order, most", [(5, 200), (5, 0), (1, 20)])
def test_scores_do_not_depend_on_what_is_sent_to_all_tasks(docs, monkeypatch, order, most):
    monkeypatch.setattr(ppm, "SEGMENT_STRINGS", 5000)
    monkeypatch.setattr(ppm, "LOOKED_UP", 1000)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    want = {r.row: r for r in ppm.score_texts(docs, train, order=order).collect()}
    got = {r.row: r for r in ppm.score_texts(docs, train, order=order, max_strings=most).collect()}
    assert got.keys() == want.keys()
    for row, r in want.items():
        assert got[row].score == pytest.approx(r.score, rel=1e-9)
        assert got[row].base_score == pytest.approx(r.base_score) and got[row].n_known == r.n_known


def test_the_model_is_small_and_not_kept(spark, docs, monkeypatch):
    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(send(sc, value)) or sent[-1])
    scored = ppm.score_texts(docs, F.lit(True))
    assert len(sent) == 1 and not os.path.exists(sent[0]._path)  # destroyed once the scores are stored
    assert scored.count() == docs.count()
    data = np.random.default_rng(3).choice(np.frombuffer(b"the lazy dogs ", np.uint8), 100_000)
    packed, _ = ppm.strings(data, np.array([0, len(data)]))
    tables = [ppm.counted(packed & ppm._low(k + 1)) for k in range(ppm.ORDER + 1)]
    assert len(pickle.dumps(ppm.Trie(tables))) < 30 * sum(len(keys) for keys, _ in tables)
    assert ppm.narrow(np.array([70_000, 1])).dtype == np.uint32


def test_ppm_equals_a_plain_trie():
    texts = ["abracadabra", "abra abra", "", "cadabra!"]
    order, tables = 3, []
    for k in range(order + 1):
        seen = Counter()
        for t in texts:
            s = [255] * order + list(t.encode()) + [255]
            for i in range(order, len(s)):
                seen[tuple(s[i - k:i + 1])] += 1
        tables.append(seen)

    def plain(context, symbol):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            here = {g[-1]: n for g, n in tables[k].items() if g[:-1] == tuple(context[order - k:])}
            here = {s: n for s, n in here.items() if s not in excluded}
            if not here:
                continue
            n = sum(here.values())
            if symbol in here:
                return p * (2 * here[symbol] - 1) / (2 * n)
            p *= len(here) / (2 * n)
            excluded |= set(here)
        return p / (256 - len(excluded))

    def pack(g):
        return sum(b << (8 * (len(g) - 1 - j)) for j, b in enumerate(g))

    sorted_tables = []
    for t in tables:
        keys = np.array(sorted(pack(g) for g in t), dtype=np.uint64)
        by = {pack(g): n for g, n in t.items()}
        sorted_tables.append((keys, np.array([by[int(k)] for k in keys])))
    trie = ppm.Trie(sorted_tables)
    trie.prepare()
    for text in ("abracadabra", "zzz", "cab", "", "abrx abra"):
        data = np.frombuffer(text.encode(), np.uint8)
        packed, _ = ppm.strings(data, np.array([0, len(data)]), order)
        s = [255] * order + list(text.encode()) + [255]
        want = [math.log10(plain(s[i - order:i], s[i])) for i in range(order, len(s))]
        assert np.allclose(trie.log10(packed), want)


def test_spans_equal_plain_patterns(spark):
    r = random.Random(4)
    alphabet = ["a", "b.c", "@", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "é", "%", "_", "4111111111111111", "x@y.zz", "1.2.3.4", "+1 (555) 010-9999", "\n"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    texts += [None, "", "a" * 200_000, "1" * 100_000, "a.b@" * 3000, "1.2.3.4 " * 300, "𝄞 x@y.zz 4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433"]

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    digits = lambda s: sum(c in "0123456789" for c in s)
    plain = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= digits(s) <= 15),
    )
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, kind int")
    got = {x.id: x for x in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        if t and len(set(t)) == 1:  # quadratic for the plain patterns
            assert not any(got[i][f"pii_{k}"] for k in pii.BASE)
            continue
        for kind, pattern, good in plain:
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t or "") if good(m[0])]
            assert [(s.start, s.end) for s in got[i][f"pii_{kind}"]] == want, (kind, t)
    assert len(got[len(texts) - 2].pii_iban) == 1 and not got[len(texts) - 1].pii_iban
    assert pii.find_pii(df.limit(0)).count() == 0
    near = spark.createDataFrame([(1, "mail me: x@y.zz"), (2, "qqq x@y.zz")], "id int, text string")
    a, b = (x.pii_email[0].score for x in pii.find_pii(near).orderBy("id").collect())
    assert a > b


def test_account_numbers_end_where_their_country_says(spark):
    cases = {
        "DE89370400440532013000 The sum": "DE89370400440532013000",
        "IBAN DE89370400440532013000 BIC COBADEFFXXX": "DE89370400440532013000",
        "DE89 3704 0044 0532 0130 00 12 May": "DE89 3704 0044 0532 0130 00",
        "GB82 WEST 1234 5698 7654 32 Barclays": "GB82 WEST 1234 5698 7654 32",
        "𝄞 pay NO93 8601 1117 947 NOW, thanks": "NO93 8601 1117 947",
        "AB12 CODE GB82 WEST 1234 5698 7654 32 7": "GB82 WEST 1234 5698 7654 32",
        "DE89370400440532013001 The sum": None, "DE893704004405320130009 The": None, "xDE89370400440532013000 The": None,
    }
    two = "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 Barclays"
    df = spark.createDataFrame([(t,) for t in [*cases, two, "AA00 " * 20_000]], "text string")
    got = {r.text: [r.text[s.start:s.end] for s in r.pii_iban] for r in pii.find_pii(df).collect()}
    assert {t: got[t] for t in cases} == {t: [m] if m else [] for t, m in cases.items()}
    assert got[two] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]


def test_reshard(spark, docs, no_docs):
    done = sharding.reshard(docs, piece_bytes=1 << 12).collect()
    rows = sample_docs()
    assert sorted(r.row for r in done) == [r[4] for r in rows]
    by = {}
    for r in done:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    text_shards = {}
    for r in done:
        text_shards.setdefault(r.text or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in text_shards.values())
    assert sharding.reshard(no_docs).count() == 0


def test_shards_are_near_equal_and_few_bytes_move(spark):
    r = random.Random(6)
    rows = [(i, "x" * r.randrange(10, 2000) if i % 3 else "the same text " * 40, "a") for i in range(4000)]  # a third of all rows
    done = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string, slot string")).toPandas()
    size = done.text.str.len() + 1
    per = size.groupby(done["shard"]).sum()
    mean = size.sum() / 16
    assert len(per) == 16 and per.max() < 1.05 * mean and per.min() > .95 * mean
    old = size.groupby(done.old_shard).sum()
    least = sum(max(0, n - mean) for n in old)  # what can not stay
    assert size[done["shard"] != done.old_shard].sum() < 1.1 * least + mean / 4


def test_flow_is_of_least_cost():
    rng = random.Random(8)
    for _ in range(20):
        supply = [rng.randrange(0, 20) for _ in range(3)]
        demand = [sum(supply) // 3 + 7] * 3
        price = [[rng.randrange(0, 5) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j: price[i][j])
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(3)] == supply
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= demand[k] for k in range(3))
        # No cycle of the residual graph has a negative cost: no better flow exists.
        arcs = [(i, 3 + j, price[i][j]) for i in range(3) for j in range(3)]
        arcs += [(3 + j, i, -price[i][j]) for (i, j), n in flow.items() if n]
        used = [sum(n for (_, j), n in flow.items() if j == k) for k in range(3)]
        arcs += [(3 + j, 6, 0) for j in range(3) if used[j] < demand[j]] + [(6, 3 + j, 0) for j in range(3) if used[j]]
        far = [0] * 7
        for _ in range(8):
            for a, b, c in arcs:
                far[b] = min(far[b], far[a] + c)
        assert all(far[b] <= far[a] + c for a, b, c in arcs)
