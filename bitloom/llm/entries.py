"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import oracles
from bitloom.llm.common import Scratch, bucket_of, documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.toxicity import learn, score

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    machine = learn(docs, labels)
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), machine).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.language_id import identify, learn

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = learn(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.mixing import LABEL_DOMAINS, MOST, TARGETS, label_domains, learn, mixed

    docs = documents(spark, sf_dir)
    domains = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = learn(docs, domains, LABEL_DOMAINS)
    out, plan = mixed(docs.select("doc_id", "source", "text"), model, TARGETS, most=MOST)
    own = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(LABEL_DOMAINS)]
    # What the whole mixture was to have of each domain, and has, over the tokens that came in.
    whole = [F.lit(float(x)).alias(f"{name}_{d}") for name, xs in (("wanted", plan.wanted), ("reached", plan.reached)) for d, x in zip(LABEL_DOMAINS, xs, strict=True)]
    return out.select("doc_id", "source", "n_tokens", *own, "rate", "copies", *whole)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.secret_scan import digest, find_secrets

    return digest(find_secrets(documents(spark, sf_dir)))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.piece_codec import Pieces, encoded_documents

    return encoded_documents(documents(spark, sf_dir), Pieces.load())


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.token_rollup import VOCABULARY, ranks, replayed_corpus

    # The rollup's folder goes with the work tables, when its totals are written.
    return replayed_corpus(documents(spark, sf_dir), Scratch(spark).folder("rollup"), ranks(VOCABULARY), "byte_bpe_50k")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.quality_cascade import quality

    return quality(documents(spark, sf_dir))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.spotsigs import digest, edited_pairs

    return digest(edited_pairs(documents(spark, sf_dir)))


def document_fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op9's comparisons of neighbours: the search over all documents by length partitions."""
    from bitloom.llm.spotsigs import classes

    return classes(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.unit_dedup import repeats

    return repeats(documents(spark, sf_dir)).select("doc_id", "start", "end", "n_units", "n_words", "kept_doc_id")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.ngram_join import similar_documents

    return similar_documents(documents(spark, sf_dir), shingle=4, percent=85)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.impact_index import search

    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", k=50)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.prefix_trie import seeded_trie

    return seeded_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return own | {"document_fingerprint_classes": document_fingerprint_classes, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
