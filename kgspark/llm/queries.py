"""Registered queries of this package, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontaminate, fim, hard_negatives, hilbert, jaccard, language_model, licenses, mixing, quality, simhash, substrings, tokens, warc
from kgspark.llm.batches import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules", """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 8) AS r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS fails_base, 10 * n_symbols > n_words AS fails_symbols,
    100 * n_dup_lines > 30 * n_lines AS fails_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS fails_length FROM m
), c AS (
  SELECT source, rule, count(*) AS n, count_if(fails) AS f FROM (
    SELECT source, unnest(['base', 'symbols', 'lines', 'length']) AS rule, unnest([fails_base, fails_symbols, fails_lines, fails_length]) AS fails FROM f) GROUP BY source, rule
), p AS (
  SELECT rule, sum(f) / sum(n) AS m, sum(n) AS n_all, count(*) AS hosts, sum(f::DOUBLE * f / n) / sum(n) AS second FROM c GROUP BY rule
), b AS (
  SELECT rule, m, greatest(second - m * m - m * (1 - m) * hosts / n_all, m * (1 - m) / 1e6) AS between_hosts FROM p
), k AS (
  SELECT rule, m, CASE WHEN between_hosts > 0 THEN greatest(m * (1 - m) / between_hosts - 1, 1.0) ELSE 1.0 END AS strength FROM b
), rates AS (
  SELECT source, rule, (f + m * strength) / (n + strength) AS rate FROM c JOIN k USING (rule)
), v AS (
  SELECT source, bool_or(rule = 'base' AND rate >= 0.5) AS host_rejected, bool_or(rule = 'symbols' AND rate >= 0.25) AS strict_symbols,
    bool_or(rule = 'lines' AND rate >= 0.25) AS strict_lines, bool_or(rule = 'length' AND rate >= 0.25) AS strict_length FROM rates GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_base AS base_failed, host_rejected,
  NOT fails_base AND NOT host_rejected AND NOT (strict_symbols AND fails_symbols) AND NOT (strict_lines AND fails_lines)
  AND NOT (strict_length AND fails_length) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir, "doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op4_substring_dedup", """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 50) AS r(k)
), kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS n_removed, count(*) AS n_words
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(documents(spark, sf_dir, "doc_id", "text"))


@query("op5_decontaminate", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), p AS (
  SELECT DISTINCT item_id, len(words[i:i+12]) AS n, array_to_string(words[i:i+12], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, least(len(words), 1)) + 1)) AS i FROM b)
), n AS (SELECT DISTINCT n FROM p), grams AS (
  SELECT doc_id, i, n, array_to_string(words[i:i+n-1], ' ') AS phrase FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, n)
), hits AS (
  SELECT doc_id, i, g.n, item_id FROM grams g JOIN p ON g.n = p.n AND g.phrase = p.phrase
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(decontaminate.find(documents(spark, sf_dir, "doc_id", "text"), benchmark))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir, "doc_id", "text"))


@query("op7_hilbert_shards")
def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    docs = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1, "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    placed = hilbert.shard(docs, ["source", "lang", "size"], ["text_crc32", "doc_id"])
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_source_mixing")
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.rates(documents(spark, sf_dir, "doc_id", "text"), labels)
    return rates.select("doc_id", "tokens", *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in mixing.DOMAINS], F.round("rate", 6).alias("rate"), "copies")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_back(tokens.write_tokens(documents(spark, sf_dir, "doc_id", "text")))


@query("op10_warc_index", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
""")
def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_fill_in_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('7:' || doc_id) AS code FROM documents
), h AS (
  SELECT *, len(lines) AS n, ('0x' || code[1:8])::BIGINT AS h1, ('0x' || code[9:16])::BIGINT AS h2, ('0x' || code[17:24])::BIGINT AS h3, ('0x' || code[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a+1:b], '') AS m, array_to_string(lines[b+1:n], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = fim.restore(fim.transform(documents(spark, sf_dir, "doc_id", "text")))
    return restored.select(
        "doc_id", F.col("fim_lines").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("fim_restored", 256).alias("restored_sha256"))


@query("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vector
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.vector, r.vector)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_simhash_bk_trees")
def op13_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir, "doc_id", "text"))
