"""From raw documents to token ids: language, near copies, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined results: extra columns stay as they are, whatever their names; rows equal in id and text count as
one document and leave the second stage once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import language_id, mixing, near_dedup, piece_codec, secret_scan
from bitloom.llm.common import Scratch, apart, documents, dropped_after, together

#: Tokens wanted from the mixture, over those that come in: enough that clean documents stay, and make up for what low and toxic ones lose.
BUDGET = 1.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language learnt from the labelled ones, go."""
    return language_id.keep_known(docs, language_id.learn(docs.select("text", "lang")), language_id.LEAST)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, Jaccard 0.8 or more) the document of the smallest id stays."""
    plain = apart(docs, "doc_id", "text")
    kept = near_dedup.near_duplicates(plain).where("kept").select(F.col("doc_id").alias("id")).distinct()
    stay = plain.join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc_id", "text"])
    return together(stay, docs, "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def to_target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, towards the target weights of clean, low and toxic text.

    The weights are mixing.TARGETS, whatever the natural shares are; no document comes more than mixing.MOST
    times, so a corpus with too little of a domain falls short of its weight and doesn't repeat what it has."""
    domains = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = mixing.learn(docs, domains, mixing.LABEL_DOMAINS)
    return mixing.resampled(docs, model, mixing.TARGETS, BUDGET, mixing.MOST)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of the whole text, and that they decode to it."""
    return piece_codec.encoded_documents(docs, piece_codec.Pieces.load())


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("source_mixing", to_target_mixture),
    ("piece_encoding", encoded),
]

#: Near-duplicate search, the classifier and the encoding aren't SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of the stages before, and the operators' own, are dropped once they are read."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        with dropped_after():
            docs = scratch.keep(stage(spark, docs, sf_dir))
        if n:
            scratch.drop(n - 1)
    return docs
