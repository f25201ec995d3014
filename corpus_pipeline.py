"""A corpus pipeline over documents: language ID, near-duplicates, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.llm import common, langid, neardup, packing, pii
from groundshift.session import ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; a null lang becomes the one that the network names.

    Where no row can be learned from there is no network: texts with a letter stay, and a null lang becomes `und`.
    """
    ship_package(spark)
    network = langid.fit(docs)
    named = docs.withColumn("_groundshift_lang", langid.language_column(docs, network))
    rest = named.filter(F.col("_groundshift_lang.lang_pred") != langid.UNDETERMINED if network else F.col("text").rlike(r"\p{L}"))
    return rest.withColumn("lang", F.coalesce("lang", "_groundshift_lang.lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id.

    Classes are those of similarity 0.8 or more. Rows of one doc_id are one document, which stays or goes as a whole; rows
    without an id, and texts without words, stay.
    """
    ship_package(spark)
    gone = neardup.near_duplicates(docs, percent=80).filter("not kept").select(F.col("doc_id").alias("_groundshift_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_groundshift_gone"], "left_anti")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows the text."""
    ship_package(spark)
    return pii.redact_column(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, common.tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", known_language), ("near-duplicates", drop_near_duplicates), ("pii", redact_pii), ("packing", pack)]

#: Byte networks, MinHash and best-fit packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again as the next one's input, then dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"stage{k}")
        common.drop(before)
    return docs
