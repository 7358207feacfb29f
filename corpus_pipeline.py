"""The corpus pipeline: toxicity, near-dedup, repeated passages, packing. Counted as part of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import packing, similar_documents, simhash, substring_dedup, toxicity
from staylens.llm.common import checkpointed, fresh, prepared, scratch, small_batches
from staylens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_settings(stage: Callable) -> Callable:
    """The stage, with the settings of Python workers that registered queries have, also where it is called on its own.

    All its Python tasks run in here, on small batches: a stage that would leave one for its reader writes that one's rows first.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepared(spark)
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; all columns are kept."""
    return checkpointed(toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies.

    Fingerprints at most two bits apart connect documents (op4, by multi-index hashing); then those that they leave apart are
    compared exactly, and similarity 0.8 of their sets of five words connects them as well.
    """
    return similar_documents.one_of_each_group(docs, words=5, similarity=0.8, known=simhash.components)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that an earlier document holds; a document may become empty.

    A letter of which some bytes are cut goes as a whole; n_chars follows the text. Every row stays with its own
    text, repeated rows and different texts under one doc_id included; rows without doc_id stay as they are.
    """
    name, key, kept = (fresh(docs.columns, x) for x in ("cut_doc_id", "cut_text_key", "cut_kept"))
    with scratch(spark) as lasting:
        changed = substring_dedup.remove_repeats(docs, length=100).filter("doc_id IS NOT NULL AND n_removed > 0")
        cut = lasting(changed.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias(name), F.col("text_key").alias(key), F.col("kept").alias(kept)))
    cut = cut.withColumn(kept, F.col(kept).cast("string"))
    own = F.coalesce(docs["text"].cast("string"), F.lit(""))
    joined = docs.join(cut, (docs["doc_id"].cast("long") == F.col(name)) & (F.xxhash64(own) == F.col(key)), "left")
    text = F.coalesce(F.try_validate_utf8(kept), F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", ""))
    changed = F.col(name).isNotNull()
    return joined.withColumn("n_chars", F.when(changed, F.length(text)).otherwise(docs["n_chars"]).cast(dict(docs.dtypes)["n_chars"])).withColumn(
        "text", F.when(changed, text).otherwise(docs["text"])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, placed in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2_048, with_ids=True)


STAGES = [(name, with_settings(stage)) for name, stage in (("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("packing", pack_sequences))]

#: No stage can be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written before the next one reads it, that of the first by itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if 0 < k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
