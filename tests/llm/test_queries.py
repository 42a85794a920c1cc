"""Registered queries against their SQL or brute force on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from scrubline.llm import tokens
from scrubline.llm.queries import QUERIES, SQL
from tests.conftest import SF_SMALL
from verification.compare import duck, rows_of


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    cursor = duck(SF_SMALL).execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def test_toxicity_holds_out_a_fifth(spark, texts):
    got = QUERIES["op3_toxicity"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= .5) for r in got)


def test_mix_takes_words_of_all_documents(spark, texts):
    got = QUERIES["op6_mix_sources"](spark, SF_SMALL).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert all(r.taken <= 2 * r.size for r in got)


def test_shards(spark, texts):
    got = QUERIES["op10_reshard"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    mean = sum(by.values()) / 16
    assert set(by) == set(range(16)) and max(by.values()) < 1.2 * mean and min(by.values()) > .8 * mean


def test_pipeline_stage_by_stage(spark, texts):
    """Each stage keeps what brute force says it should, and runs alike as one query."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, ids = docs.columns, list(texts)
    results = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF_SMALL)
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{name}-{id(docs)}"
        kept.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "reshard":
            assert docs.columns == columns
        sets = {i: tokens.shingle_texts(texts[i]) for i in set(ids)}
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 1").collect()}
            clean = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 0").collect()}
            assert clean <= set(now) and len(toxic & set(now)) < len(toxic)  # a dozen examples teach little
        elif name == "ngram_join":
            reach = {i: {i} for i in ids}
            for a in ids:
                for b in ids:
                    both = len(sets[a] & sets[b])
                    if a < b and sets[a] and 5 * both >= 4 * len(sets[a] | sets[b]) and reach[a] is not reach[b]:
                        joined = reach[a] | reach[b]
                        for x in joined:
                            reach[x] = joined
            assert sorted(now) == sorted({min(g) for g in reach.values()})
        elif name == "decontaminate":
            items = [tokens.shingle_texts(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
            bad = {i for i in ids if any(q and 5 * len(q & sets[i]) >= 4 * len(q) for q in items)}
            assert sorted(now) == sorted(set(ids) - bad)
        elif name == "mix_sources":
            assert set(now) <= set(ids) and max(Counter(now).values()) <= 2
        else:
            assert sorted(now) == sorted(ids)
        ids = now
        results.append(len(now))
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert [r.doc_id for r in whole.orderBy("doc_id").collect()] == sorted(ids)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """The contracted kinds by plain regular expressions: all matches, then those that pass."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data_of_all_documents(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    seen = Counter()
    for i, text in texts.items():
        want = base_spans(text)
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        counts = Counter(k for k, _, _ in want)
        seen += counts
        row = got[i]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("iban:")] == listed
    assert sum(seen.values()) > 0


def test_base_scores_of_all_documents(spark, texts):
    lower = {c: c + 32 for c in range(65, 91)}
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in words[i])
    total = sum(counts.values())
    got = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    for i, tokens_of in words.items():
        row = got[i]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[i], len(tokens_of), total)
        assert row.n_known == sum(counts[w] > 0 for w in tokens_of)
        want = sum(math.log10((counts[w] + .1) / (total + .1 * (len(counts) + 1))) for w in tokens_of)
        assert math.isclose(row.base_score, want, rel_tol=1e-9) and row.score < 0
