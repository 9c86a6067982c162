"""Registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastebud.llm import (chat, decontam, fingerprint, licenses, linededup, neardup, packing, quality, secretscan,
                          spelling, trie, warc, wordpiece)
from tastebud.llm.common import materialise, shared_path, table

# Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TASTEBUD_TOKENIZERS", "/opt/tokenizers")
RESAMPLED_SHARE = 0.5  # of the accepted documents, drawn by op7
SEED = 7
DELETE_EVERY = 199  # op11: of the runs, one in so many loses a letter


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    with open(os.path.join(TOKENIZERS, name), encoding="utf-8") as f:
        return f.read()


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("matches")
    names = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"])))
    return licenses.with_licenses(docs).select(
        "doc_id", F.size(m).cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform(m, lambda x: x["dice"])), F.lit(0.0)), 6).alias("best_dice"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    out = (fingerprint.with_next(docs).withColumn("edited", edited)
           .withColumn("edited_fp", fingerprint.fingerprint(F.col("edited"))))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint.as_hex(F.col("fp")).alias("fingerprint"),
        fingerprint.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = secretscan.with_spans(docs, secretscan.fit(docs))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secretscan.joined(F.col("base")), 256).alias("base_sha256"),
        secretscan.joined(F.col("spans")).alias("spans"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = wordpiece.sentencepiece_vocabulary(os.path.join(TOKENIZERS, "piece_bpe_32k.model"))
    return wordpiece.with_token_counts(docs, vocabulary).select("doc_id", "counts.*")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(rows.withColumn("parts", chat.text_parts(F.col("text")))))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = F.col("hits")
    return (decontam.with_hits(docs, table(spark, sf_dir, "benchmark"))
            .select("doc_id", hits["n_words"].alias("n_words"), decontam.n_hit(hits).alias("n_hit"),
                    F.size(hits["items"]).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort(hits["items"]), ","), 256).alias("items_sha256"),
                    (F.size(hits["spans"]) > 0).alias("contaminated")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    s = F.col("s")
    scored = docs.select("doc_id", F.xxhash64("text").alias("h"), model.scored(F.col("text")).alias("s")).select(
        "doc_id", "s.n_grams", "s.log_weight", quality.mean_weight(s).alias("score"), model.accepts(s).alias("kept"),
        quality.gumbel_key(s["log_weight"], SEED, F.col("doc_id"), F.col("h")).alias("gumbel_key"))
    scored = materialise(spark, scored, "scored")
    accepted = scored.where("kept").count()
    return quality.resample(scored, int(accepted * RESAMPLED_SHARE))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, size=2, numerator=80, denominator=100)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_json())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_resolved(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs, delete_every=DELETE_EVERY)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_fingerprint, op3_secret_scan, op4_token_count, op5_chat_format, op6_decontaminate,
    op7_quality, op8_near_dedup, op9_pack, op10_warc, op11_spelling_variants, op12_line_dedup, op13_prefix_trie)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    rows = ", ".join(f"({k}, {_q(name)}, {_q(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = ("regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    # Units by place: the text, paragraphs between blank lines, lines; equal places count once.
    return f"""
WITH templates(k, license, body) AS (VALUES {rows}),
template_pairs AS (SELECT k, license, unnest(p) AS pair, len(p) AS size
  FROM (SELECT k, license, {pairs} AS p FROM (SELECT k, license, {words.format('body')} AS w FROM templates))),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pars AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*') AS p FROM docs),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM docs),
units AS (
  SELECT doc_id, 'text' AS unit, 0 AS n, text AS body FROM docs WHERE text <> ''
  UNION ALL SELECT doc_id, 'paragraph', i, p[i] FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pars WHERE len(p) > 1)
  UNION ALL SELECT doc_id, 'line', i, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines WHERE len(l) > 1)
),
unit_words AS (SELECT doc_id, unit, n, {words.format('body')} AS w FROM units),
unit_pairs AS (SELECT doc_id, unit, n, unnest(p) AS pair, len(p) AS size
  FROM (SELECT doc_id, unit, n, {pairs} AS p FROM unit_words WHERE len(w) >= 2)),
dice AS (SELECT doc_id, unit, n, k, license, 2.0 * count(*) / (any_value(u.size) + any_value(t.size)) AS dice
  FROM unit_pairs u JOIN template_pairs t USING (pair) GROUP BY doc_id, unit, n, k, license),
best AS (SELECT doc_id, unit, n, license, dice FROM dice WHERE dice >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit, n ORDER BY dice DESC, k) = 1)
SELECT d.doc_id, count(b.license) AS n_matches,
  coalesce(string_agg(DISTINCT b.license, ',' ORDER BY b.license), '') AS licenses,
  round(coalesce(max(b.dice), 0.0), 6)::DOUBLE AS best_dice
FROM docs d LEFT JOIN best b ON d.doc_id = b.doc_id GROUP BY d.doc_id"""


def _chat_sql() -> str:
    escaped = "replace({0}, '\\', '\\\\')"
    for c in chat.CONTROL:
        escaped = f"replace({escaped}, {_q(c)}, {_q(c[0] + chr(92) + c[1:])})"
    frame = len(chat.OPEN) + 1 + len(chat.CLOSE)
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(replace({escaped.format('role')}, chr(10), '\\' || chr(10))) + length({escaped.format('text')}) + {frame} AS chars FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM f GROUP BY conv_id"""


_DECONTAM_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, WORDS(text) AS w FROM documents),
b AS (SELECT item_id, WORDS(text) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, item_id FROM places p JOIN windows USING (win)),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS j FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  WHEN len(w) = 1 THEN w ELSE [] END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(y) AS component_id, s.doc_id = min(y) AS kept
FROM s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, s"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM q"""

_WORDS = "coalesce(regexp_extract_all(" + _LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

# crc32 of a list of bytes, its table made by the polynomial's rule.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t)"""
_CRC = ("xor(list_reduce({0}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)")

_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id,
  unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
bytes AS (SELECT run, k, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: ord(c)::BIGINT) AS o FROM runs),
hashed AS (SELECT run, k, {_CRC.format("flatten(list_transform(o, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END))")} AS h
  FROM bytes, crc_table),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
  FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one_way AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON c.rest = w.word),
links AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way UNION
  SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n
  FROM links JOIN words w ON w.word = b GROUP BY a),
formed AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form,
  CASE WHEN best_n >= 5 * n THEN best_n END::BIGINT AS form_n FROM words LEFT JOIN near ON near.word = words.word),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, form, c.root, n, n_near, form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL"""

_LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id,
  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT r, id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
shared AS (SELECT key, max(id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3),
marked AS (SELECT r, i, line, keeper IS NOT NULL AND id <> keeper AS gone FROM lines LEFT JOIN shared USING (key)),
put AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, kept_sha256 FROM d JOIN put USING (r)"""

_TRIE_SQL = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(role)::VARCHAR || ':' || role || text)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
hashed AS (SELECT conv_id, {_CRC.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_table),
built AS (SELECT h.conv_id, t.pos, 0 AS part, role, text FROM hashed h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.pos < h.h
  UNION ALL SELECT h.conv_id, t.pos, 1, role, text FROM hashed h JOIN t ON t.conv_id = h.conv_id AND t.pos >= h.h),
seqs AS (SELECT conv_id, coalesce(list({{'k': md5(length(role)::VARCHAR || ':' || role || text),
    'w': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))}} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS s
  FROM (SELECT conv_id FROM hashed) LEFT JOIN built USING (conv_id) GROUP BY conv_id),
paths AS (SELECT conv_id, s, len(s) AS len, unnest(range(len(s) + 1)) AS depth FROM seqs),
keyed AS (SELECT conv_id, depth, len, array_to_string(list_transform(s[1:depth], lambda x: x.k), '') AS key,
  CASE WHEN depth = 0 THEN 0 ELSE s[depth].w END AS w FROM paths),
nodes AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(w) AS w,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256 FROM keyed GROUP BY key),
linked AS (SELECT *, CASE WHEN depth > 0 THEN substr(key, 1, 32 * (depth - 1)) END AS parent FROM nodes),
kids AS (SELECT parent AS key, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT substr(l.key, 1, 32 * a) AS key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM linked) l LEFT JOIN kids k ON k.key = l.key GROUP BY 1)
SELECT l.conv_id::BIGINT AS conv_id, l.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, l.n_convs::BIGINT AS n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.key = l.key LEFT JOIN kids k ON k.key = l.key LEFT JOIN nodes p ON p.key = l.parent"""

ORACLE = {
    "op1_license_scan": _license_sql(),
    "op5_chat_format": _chat_sql(),
    "op6_decontaminate": _DECONTAM_SQL.replace("WORDS(text)", _WORDS),
    "op8_near_dedup": _NEAR_SQL,
    "op10_warc": _WARC_SQL,
    "op11_spelling_variants": _SPELLING_SQL,
    "op12_line_dedup": _LINES_SQL,
    "op13_prefix_trie": _TRIE_SQL,
}
