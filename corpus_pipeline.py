"""A corpus pipeline of five stages; each reads what the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bpe, jaccard, language, mixing, queries, secrets
from keystrata.llm.shared import stored

#: Columns of documents; every stage but the last returns them and no others.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: word n-grams and the least similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: The mix: the targets share 150% of all words, no document is taken more than twice.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.5, 2.0, 20240229


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null texts, no letter); lang becomes the language found, or stays if nothing could be learned."""
    network = language.train(docs, ~queries.held_out(F.col("doc_id")))
    if network is None:
        return docs.select(*COLUMNS).filter(language.has_letter(F.col("text")))
    found = language.identify(docs, network, keep=["text", "source", "n_chars"])
    found = found.filter(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(F.col("key").alias("doc_id"), "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of links: that of the smallest id."""
    return jaccard.one_of_each(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text; all documents stay."""
    forest = secrets.training(secrets.generated_findings(spark))
    text = secrets.redacted(F.col("text"), secrets.scan(F.col("text"), F.col("source"), forest))
    out = docs.select("doc_id", text.alias("text"), "lang", "source", F.col("n_chars").alias("was"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("was").isNotNull(), F.length("text").cast("long")).alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: twice, once or not at all."""
    docs = docs.select(*COLUMNS)
    return mixing.mixed(docs, queries.source_weights(docs), MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    return bpe.code(docs, queries.tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("key", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("bpe_coding", bpe_coding),
]

#: Trained networks, a random forest and seeded draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
