"""Registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import align, decontaminate, html, jaccard, langid, lines, lm, pieces, quality, tokenbin, trie, urls, warc
from cohortry.llm.common import fold, partitions, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: Rules of the contract: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

ORACLE_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id LEFT JOIN degree ON degree.a = w.doc_id
"""

ORACLE_URLS = (
    r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(h, p, verdict) AS (VALUES """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    + r"""),
fits AS (
  SELECT u.*, r.h || r.p AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY len(r.h || r.p) DESC NULLS LAST, len(r.h) DESC) AS place
  FROM u LEFT JOIN r ON (host = r.h OR suffix(host, '.' || r.h)) AND starts_with(path, r.p)),
w AS (
  SELECT *, list_filter(regexp_extract_all(host, '[a-z0-9]+'), lambda x: list_contains(["""
    + ", ".join(f"'{w}'" for w in urls.HOST_WORDS)
    + r"""], x))[1] AS listed FROM fits WHERE place = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN listed END AS word FROM w
"""
)

ORACLE_TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: xor(v >> 1, (v & 1) * 3988292384))) AS crc),
h AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda v, x: xor(v >> 8, crc[xor(v, x) % 256 + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), c),
r AS (
  SELECT h.conv_id, t.pos, role, text, words FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos, role, text, words FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
s AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS turns, list(words ORDER BY pos) AS words FROM r GROUP BY conv_id),
a AS (SELECT h.conv_id, coalesce(turns, []) AS turns, coalesce(words, []) AS words FROM h LEFT JOIN s USING (conv_id)),
m AS (
  SELECT conv_id, d, array_to_string(turns[:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(turns[:d - 1], '') END AS above, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM a)),
n AS (
  SELECT node, any_value(above) AS above, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM m GROUP BY node),
k AS (SELECT above AS node, count(*) AS kids FROM n WHERE above IS NOT NULL GROUP BY above),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (node)),
b AS (SELECT substr(f.node, 1, 32 * x) AS node, count(*) FILTER (WHERE kids = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM f) f GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN b USING (node) LEFT JOIN n p ON p.node = f.above
"""


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


@register("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality.judge(docs, model)


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = WORD_BPE
    manifest = tokenbin.write_token_files(docs, lambda: tokenbin.word_encoder(path), tokenbin.vocabulary_size(path), end_id=2)
    return tokenbin.read_token_files(manifest, partitions(spark), with_ids=False).drop("ids")


@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    model = langid.learn(docs.where(~held_out))
    return langid.predict(docs, model, more={"held_out": held_out})


@register("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return lm.score(docs, train=fold("doc_id", 7) != 2, weigh=fold("doc_id", 7) == 5)


@register("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), html.fit_tree())


@register("op9_warc_derivatives")
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derived record: which page and response it comes from, its digests, and what it holds."""
    tasks = partitions(spark)
    responses = warc.write_responses(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    records = warc.read_files(warc.build_derivatives(responses, tasks), tasks)
    about = F.when(F.col("type") == "metadata", F.col("block").cast("string"))
    return records.select(
        F.col("key").cast("long").alias("page_id"),
        F.col("target").alias("url"),
        F.col("type").alias("record_type"),
        F.col("id").alias("record_id"),
        "refers_to",
        "concurrent_to",
        F.col("fields")["X-Source-Payload-Digest"].alias("source_payload_digest"),
        F.col("fields")["WARC-Block-Digest"].alias("block_digest"),
        "digest_ok",
        F.get_json_object(about, "$.Payload-Digest-Verified").cast("boolean").alias("source_digest_ok"),
        F.get_json_object(about, "$.Title").alias("title"),
        F.length("block").cast("long").alias("block_bytes"),
        F.when(F.col("type") == "conversion", F.sha1("block")).alias("text_sha1"),
    )


@register("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.find(read_table(spark, sf_dir, "documents", "doc_id", "text"), benchmark)


@register("op7_sentence_pieces")
def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = int(spark.conf.get("spark.task.cpus", "1"))
    return pieces.encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), PIECES, threads=threads, with_ids=False).drop("ids")


@register("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, those that went, and the length and md5 of what is left."""
    left = lines.dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("op6_jaccard_join", ORACLE_JACCARD)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classes(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "class_id", "n_links")


@register("op11_url_filters", ORACLE_URLS)
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages", "page_id", "url"), urls.build(urls.entries(spark, URL_RULES)))


@register("op12_conversation_trie", ORACLE_TRIE)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


@register("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read_table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE, PIECES)
