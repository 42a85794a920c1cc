"""One query per operator, over the whole of its table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import (
    alignment, chat, decontaminate, merkle, mixing, multi_index, ngram_join, pii, ppm, sharding, sketches, toxicity,
    warc,
)
from scrubline.llm.common import held_out

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, pair by pair."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


#: Words in lower case (A-Z only) as a list, and their distinct five-word shingles.
SHINGLES = r"""
  SELECT {id}, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN range(1, len(w) - 3)]) END AS s
  FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM {table})
"""

SQL["op1_decontaminate"] = f"""
WITH d AS ({SHINGLES.format(id="doc_id", table="documents")}), i AS ({SHINGLES.format(id="item_id", table="benchmark")}),
short AS (SELECT coalesce(list(DISTINCT len(w)) FILTER (len(w) BETWEEN 1 AND 4), []) AS widths FROM i),
held AS (SELECT DISTINCT doc_id, unnest(list_concat(s, flatten([
  [list_aggregate(w[k:k + n - 1], 'string_agg', ' ') FOR k IN range(1, len(w) - n + 2)] FOR n IN short.widths]))) AS h FROM d, short), sought AS (SELECT item_id, len(s) AS n_item, unnest(s) AS h FROM i),
both_of AS (SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM held JOIN sought USING (h) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM both_of WHERE n_shared * 5 >= n_item * 4
"""


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: the group of each."""
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


SQL["op2_ngram_join"] = f"""
WITH RECURSIVE d AS ({SHINGLES.format(id="doc_id", table="documents")}),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM d),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b USING (h) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT p.a, r.c FROM reach r JOIN pairs p ON p.b = r.doc_id)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(c) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM d
"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labelled rows outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5))
    return toxicity.score_toxicity(docs, labels).select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written to archives and read back."""
    folder, files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder, files, payloads=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL["op4_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top,
  list_aggregate([lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0') FOR i IN range(1, 41)], 'string_agg', '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    list_sum([(bits[5 * j + k] = '1')::INT * (1 << (5 - k)) FOR k IN range(1, 6)])::INT + 1
  ] FOR j IN range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""


@query
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings, whatever their labels."""
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op5_near_vectors"] = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT p.a, r.c FROM reach r JOIN pairs p ON p.b = r.vec_id),
named AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named
"""


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs, number_rows=True).groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("words").alias("taken"),
        F.count("slot").alias("pieces"), F.min("slot").alias("first_slot"),
    ).drop("row_no")


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, formatted and read back."""
    tricky = r"\### Assistant: </turn> ok"
    made = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat.format_chats(rows.unionByName(made))
    done = done.withColumn("formatted", chat.formatted_text(F.col("segments")))
    done = done.withColumns({
        "turns": chat.read_turns(F.col("formatted")), "learned": chat.loss_text(F.col("segments")),
    })
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid_order",
    )


SQL["op7_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter,
    CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END
    + length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '### System: ', ''))) // 12
    + (length(text) - length(replace(text, '### User: ', ''))) // 10
    + (length(text) - length(replace(text, '### Assistant: ', ''))) // 15
    + (length(text) - length(replace(text, '### ?', ''))) // 5
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 8 AS chars
  FROM given
), grouped AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
    string_agg(letter, '' ORDER BY turn, role, text) AS letters
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  regexp_full_match(letters, 's?(ua)*ua?') AS valid_order
FROM grouped
"""


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the rows outside fold 0 of 10."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "text"
    )
    return ppm.score_texts(docs, ~F.col("held_out"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [F.col(f"pii_{k}") for k in pii.BASE]
    every = F.concat(*[F.col(f"pii_{k.name}") for k in pii.KINDS])
    return found.select(
        "doc_id", *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in pii.KINDS],
        F.sha2(pii.span_list(*base).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(every).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"),
    )


@query
def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes, from twelve by the hash of the text."""
    done = sharding.reshard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return done.select(
        "doc_id", sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("old_shard").cast("int").alias("old_shard"),
    )


#: Where the public tokenizers' files lie on driver and executors.
TOKENIZERS = "/opt/tokenizers"


@query
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and a sentence-piece vocabulary, aligned on all documents."""
    return alignment.align_with_counts(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model",
    ).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents; every seventh leaf or so is tampered with, and found out."""
    docs = table(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + 1

    def leaf(n_chars: Column) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = merkle.build(
        docs, leaf(F.col("n_chars")), F.col("lang"), ["doc_id"], {"tampered": F.when(touched, leaf(more))}
    )
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return merkle.proofs(manifest).select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: A field of a leaf.
FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

SQL["op12_merkle"] = f"""
WITH RECURSIVE bits AS (SELECT i AS byte, list_reduce(range(0, 8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS crc FROM range(0, 256) t(i)),
crcs AS (SELECT list(crc::BIGINT ORDER BY byte) AS t FROM bits),
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {LEAF.format(n="n_chars")} AS leaf,
    {LEAF.format(n="(n_chars + 1)")} AS other,
    xor(list_reduce([ascii(c) FOR c IN string_split(doc_id::VARCHAR, '')], lambda s, c:
      xor(s >> 8, crcs.t[(xor(s, c) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 7 = 0 AS touched
  FROM documents, crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY g) AS n FROM leaves),
lower_nodes(g, lvl, n, place, h) AS (SELECT g, 0, n, place, leaf FROM placed
  UNION ALL SELECT g, lvl + 1, (n + 1) // 2, place // 2, sha256(string_agg(h, '' ORDER BY place)) FROM lower_nodes
  WHERE n > 1 GROUP BY g, lvl, n, place // 2),
tops AS (SELECT g, h, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM lower_nodes WHERE n = 1),
upper_nodes(lvl, n, place, h) AS (SELECT 0, n, place, h FROM tops
  UNION ALL SELECT lvl + 1, (n + 1) // 2, place // 2, sha256(string_agg(h, '' ORDER BY place)) FROM upper_nodes
  WHERE n > 1 GROUP BY lvl, n, place // 2),
steps AS (
  SELECT p.g, p.place AS leaf_place, a.lvl, a.place % 2 AS slot, b.h FROM placed p
    JOIN lower_nodes a ON a.g = p.g AND a.n > 1 AND a.place = p.place >> a.lvl
    LEFT JOIN lower_nodes b ON b.g = a.g AND b.lvl = a.lvl AND b.place = xor(a.place, 1)
  UNION ALL
  SELECT p.g, p.place, 1000 + a.lvl, a.place % 2, b.h FROM placed p JOIN tops t ON t.g = p.g
    JOIN upper_nodes a ON a.n > 1 AND a.place = t.place >> a.lvl
    LEFT JOIN upper_nodes b ON b.lvl = a.lvl AND b.place = xor(a.place, 1)
),
ways AS (SELECT g, leaf_place, string_agg(h, '' ORDER BY lvl) AS beside,
  list({{'slot': slot, 'h': coalesce(h, ''), 'at': ''}} ORDER BY lvl) AS way FROM steps GROUP BY ALL),
folded AS (SELECT p.*, t.h AS subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root,
  sha256(coalesce(w.beside, '')) AS proof_sha256,
  list_reduce(list_prepend({{'slot': 0::BIGINT, 'h': '', 'at': CASE WHEN touched THEN other ELSE leaf END}}, coalesce(w.way, [])),
    lambda x, s: {{'slot': 0::BIGINT, 'h': '', 'at': sha256(CASE WHEN s.slot = 0 THEN x.at || s.h ELSE s.h || x.at END)}}).at AS folded_root
  FROM placed p JOIN tops t USING (g) LEFT JOIN ways w ON w.g = p.g AND w.leaf_place = p.place)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled fingerprints of all documents, against an edited text and the next document."""
    done = sketches.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", sketches.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketches.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
