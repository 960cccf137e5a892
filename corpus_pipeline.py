"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, jaccard, langid, lines, pieces
from cohortry.llm.common import new_folder
from cohortry.session import spread_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior probability of the likeliest language.
SURE_FROM = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table names.

    The model learns from the documents with a language. A document goes if it has no letter, or if no language is likelier
    than not. Its columns stay as they are, a null ``lang`` too.
    """
    model = langid.learn(docs)
    found = langid.predict(spread_out(docs), model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE_FROM)).select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that came before; ``n_chars`` follows the text. One of which nothing but white space is left goes."""
    left = lines.dedup_lines(docs)
    kept = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.where(kept).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the lowest doc_id."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove(docs, benchmark).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left: doc_id, n_tokens, n_bytes, n_unknown, ids_crc32, restored, ids."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), threads=int(spark.conf.get("spark.task.cpus", "1")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Naive Bayes, edit distance of characters and the tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``; a lost executor repeats a part of one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
