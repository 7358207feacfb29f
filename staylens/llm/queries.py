"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import bpe, embedding_dedup, fill_middle, filter_audit, language_model, packing, pieces, sharding, simhash, substring_dedup, token_counts, topk_search, toxicity
from staylens.llm.common import documents, prepared


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    # different texts under one id, or without one, are dealt by their hash; equal rows may change places unseen
    dealt = sharding.uniform_shards(docs, ["doc_id", "text_key"], shards=24)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; looked up when a query runs, since only some queries need one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=2_048)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_token_counts(token_counts.sample_edits(documents(spark, sf_dir)), tokenizer_path("byte_bpe_50k.json"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk_search.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(documents(spark, sf_dir), seed=42, percent=50, suffix_first=80)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN told ON d.doc_id = told.doc_id
), cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT letter AS filter_order FROM letters
  UNION ALL
  SELECT filter_order || letter FROM orders, letters WHERE NOT contains(filter_order, letter)
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier
  FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5
), seen AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails, contains(fails, filter) AS hit,
    length(translate(fails, earlier, '')) < length(fails) AS gone
  FROM cells, steps
), sums AS (
  SELECT part, filter_order, step, filter, CAST(COALESCE(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(COALESCE(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed, CAST(COALESCE(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
    CAST(COALESCE(sum(n) FILTER (fails = filter), 0) AS BIGINT) AS unique_fails, CAST(COALESCE(sum(n) FILTER (hit AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
    CAST(COALESCE(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM sums
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    sha256('42:' || doc_id) AS h
  FROM documents
), k AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') AS p, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(tokens[greatest(a, b) + 1:], '') AS s
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""

OP10_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT comp.vec_id, COALESCE(n.n, 0) AS n_links, component_id, comp.vec_id = component_id AS kept
FROM comp LEFT JOIN n ON n.vec_id = comp.vec_id
"""


def located(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the workers' settings made first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {"op1_suffix_dedup": op1_suffix_dedup, "op2_sharding": op2_sharding, "op3_packing": op3_packing, "op4_simhash": op4_simhash, "op5_bpe": op5_bpe, "op6_embedding_dedup": op6_embedding_dedup, "op7_toxicity": op7_toxicity, "op8_language_model": op8_language_model, "op9_token_counts": op9_token_counts, "op10_topk_search": op10_topk_search,
        "op11_filter_audit": op11_filter_audit, "op12_fill_middle": op12_fill_middle, "op13_pieces": op13_pieces,
        "pipeline": pipeline}
    return {name: located(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_dedup": OP6_SQL, "op10_topk_search": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_fill_middle": OP12_SQL}
