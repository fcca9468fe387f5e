"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, chat_repair, decontamination, language_id, line_dedup, mixing, ngram_join, quality, secret_scan, substring_dedup, suffix_dedup,
    token_store, vector_codes,
)

#: Vocabulary file of the token store; a parameter of the operator, never part of the repository.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(VOCABULARY))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, decontamination.SLOP)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_long_repeats(table(spark, sf_dir, "documents"), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(*chat_format.calls_of_turns(table(spark, sf_dir, "conversations")))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.read_store(spark, folder, tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), 5, 0.8)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256")
    return vector_codes.with_label_errors(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest)


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_language_id, op3_substring_dedup, op4_suffix_dedup, op5_chat_format, op6_token_store, op7_mixing, op8_quality,
        op9_secret_scan, op10_ngram_join, op11_vector_codes, op12_chat_repair, op13_line_dedup, pipeline,
    )
}

ORACLE = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, pos.n, i, item_id FROM pos JOIN win USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
exact AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)),
vocab AS (SELECT DISTINCT unnest(g) AS t FROM win),
tok AS (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d) SEMI JOIN vocab USING (t)),
freq AS (SELECT t, count(*) AS often FROM tok GROUP BY 1),
wins AS (SELECT g, row_number() OVER () AS win FROM (SELECT DISTINCT g FROM win)),
wt AS (SELECT win, len(g) AS n, unnest(g) AS t, unnest(range(len(g))) AS o FROM wins),
ranked AS (SELECT wt.*, coalesce(often, 0) AS often, row_number() OVER (PARTITION BY win ORDER BY coalesce(often, 0), o) AS rk FROM wt LEFT JOIN freq USING (t)),
start AS (SELECT win, n, doc_id, p - o AS s FROM ranked JOIN tok USING (t) WHERE rk = 1),
placed AS (SELECT DISTINCT s.win, s.n, s.doc_id, s.s, r.o FROM start s JOIN ranked r ON s.win = r.win JOIN tok k ON k.doc_id = s.doc_id AND k.t = r.t AND k.p BETWEEN s.s + r.o - 3 AND s.s + r.o + 3),
near AS (SELECT DISTINCT doc_id, item_id FROM (SELECT win, doc_id, s, n FROM placed GROUP BY ALL HAVING count(*) = n) JOIN wins USING (win) JOIN win USING (g)),
nears AS (SELECT doc_id, count(*) AS n_near_items FROM near GROUP BY 1)
SELECT exact.*, coalesce(n_near_items, 0) AS n_near_items FROM exact LEFT JOIN nears USING (doc_id)""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE first < doc_id),
w AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(w.w[w.p], ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p WHERE gone.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
q AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
level AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT step + 1, (SELECT (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM q) - coalesce(sum(cap) FILTER (NOT cap > weight * level.level), 0)) / sum(weight) FILTER (cap > weight * level.level) FROM q) FROM level WHERE step < 40),
t AS (SELECT source, source_size, n, least(cap, coalesce(weight * (SELECT max(level) FROM level), cap)) AS target FROM q),
e AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.target / nullif(t.source_size, 0) AS rate, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CAST(ceil(n / 10000.0) AS BIGINT) AS buckets FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % buckets AS bucket FROM e),
w AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY source, bucket) AS whole FROM o)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN size > 0 AND upto - size / 2 <= (rate - floor(rate)) * whole THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM w""",
    "op11_vector_codes": """
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
p AS (SELECT r, part, v[part * w + 1:part * w + w] AS v FROM (SELECT r, v, len(v) // 16 AS w, unnest(range(16)) AS part FROM k)),
c0 AS (SELECT part, r - 1 AS entry, v FROM p WHERE r <= 64),
a0 AS (SELECT r, part, CAST(min(d) AS BIGINT) AS d, arg_min(entry, d * 64 + entry) AS entry FROM
  (SELECT p.r, part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c0 c USING (part)) GROUP BY r, part),
c1 AS (SELECT part, entry, coalesce(m, c.v) AS v FROM c0 c LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS m FROM (
    SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM a0 JOIN p USING (r, part)) GROUP BY ALL)) GROUP BY ALL) USING (part, entry)),
a1 AS (SELECT r, part, CAST(min(d) AS BIGINT) AS d, arg_min(entry, d * 64 + entry) AS entry FROM
  (SELECT p.r, part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c1 c USING (part)) GROUP BY r, part),
c2 AS (SELECT part, entry, coalesce(m, c.v) AS v FROM c1 c LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS m FROM (
    SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM a1 JOIN p USING (r, part)) GROUP BY ALL)) GROUP BY ALL) USING (part, entry)),
a2 AS (SELECT r, part, CAST(min(d) AS BIGINT) AS d, arg_min(entry, d * 64 + entry) AS entry FROM
  (SELECT p.r, part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c2 c USING (part)) GROUP BY r, part),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 JOIN k USING (r) GROUP BY r, vec_id, label),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM c2))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN sums ON coded.label IS NOT DISTINCT FROM sums.label, books""",
    "op12_chat_repair": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
f AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice, right(bare, 1) NOT IN ('.', '!', '?') AS open FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice AND NOT blank) AS duplicate,
  count(*) FILTER (open AND NOT twice AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
-- the best way from each of four states (nothing, system, user, assistant) to the end, from the last row to the first
best AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': ''} AS s0, {'c': 4, 'a': 'II'} AS s1, {'c': 2, 'a': 'I'} AS s2, {'c': 0, 'a': ''} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, t0, t1, t2, t3 FROM (
    SELECT *, list_min([x0, {'c': t2.c + 2, 'a': 'I' || t2.a}]) AS t0, list_min([x1, {'c': t2.c + 2, 'a': 'I' || t2.a}]) AS t1 FROM (
    SELECT *, list_min([x2, {'c': x3.c + 2, 'a': 'I' || x3.a}]) AS t2, list_min([x3, {'c': x2.c + 2, 'a': 'I' || x2.a}]) AS t3 FROM (
    SELECT b.conv_id, f.i,
      list_min([{'c': s0.c + 3, 'a': 'D' || s0.a}, {'c': s2.c + stay + CASE WHEN r = 'u' THEN 0 ELSE 2 END, 'a': CASE WHEN r = 'u' THEN 'K' ELSE 'R' END || s2.a},
        {'c': s1.c + stay + CASE WHEN r = 's' THEN 0 ELSE 99999 END, 'a': 'K' || s1.a}]) AS x0,
      list_min([{'c': s1.c + 3, 'a': 'D' || s1.a}, {'c': s2.c + stay + CASE WHEN r = 'u' THEN 0 ELSE 2 END, 'a': CASE WHEN r = 'u' THEN 'K' ELSE 'R' END || s2.a}]) AS x1,
      list_min([{'c': s2.c + 3, 'a': 'D' || s2.a}, {'c': s3.c + stay + CASE WHEN r = 'a' THEN 0 ELSE 2 END, 'a': CASE WHEN r = 'a' THEN 'K' ELSE 'R' END || s3.a}]) AS x2,
      list_min([{'c': s3.c + 3, 'a': 'D' || s3.a}, {'c': s2.c + stay + CASE WHEN r = 'u' THEN 0 ELSE 2 END, 'a': CASE WHEN r = 'u' THEN 'K' ELSE 'R' END || s2.a}]) AS x3
    FROM best b JOIN (SELECT *, left(role, 1) AS r, CASE WHEN blank OR twice THEN 99999 WHEN open THEN 1 ELSE 0 END AS stay FROM f) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))),
audits AS (SELECT conv_id, CAST(s0.c AS BIGINT) AS cost, s0.a AS audit FROM best WHERE i = 1),
edits AS (SELECT conv_id, j, audit[j] AS e, len(replace(audit[1:j], 'I', '')) AS i, len(replace(audit[1:j], 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM audits)),
shown AS (SELECT e.conv_id, j, e.e, f.role, f.text, place, count(*) FILTER (f.role[1] = 's' AND e.e = 'K') OVER (PARTITION BY e.conv_id) AS s
  FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.e <> 'I' WHERE e.e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM shown GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM q.conv_id""",
    "op13_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
common AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM l ANTI JOIN common USING (key) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
}
