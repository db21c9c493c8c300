"""Pair tables made of the generic test tables, and stand-ins for systems' output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.columns import settled, spread
from bitloom.functions.text import INK


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of a document, the first with the second, the third with the fourth and so on.

    Documents in French lack the fragment id, those in German have the section id instead, so that every
    fallback of group ids occurs.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    full = settled(docs, lines=F.filter(lines, lambda x: F.regexp_like(x["line"], F.lit(INK))))
    pair = lambda i: F.struct(F.get("lines", 2 * i).alias("a"), F.get("lines", 2 * i + 1).alias("b"))
    rows = full.where(F.size("lines") > 1).select("doc_id", "lang", "source", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("lines") / 2).cast("int") - 1), pair)).alias("p"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("source").alias("source_doc"),
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("p.a.at").cast("string")).alias("line_id"),
        F.when(~F.col("lang").isin("fr", "de"), F.col("doc_id").cast("string")).alias("fragment_id"),
        F.when(F.col("lang") == "de", F.col("lang")).alias("section_id"),
        none.alias("chapter_id"),
        F.col("p.a.line").alias("src"),
        F.col("p.b.line").alias("tgt"),
        (F.col("doc_id") * 1_000_000 + F.col("p.a.at")).alias("ord"),
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the assistant's answer right after it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    led = turns.withColumn("tgt", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    none = F.lit(None).cast("string")
    return led.where("role = 'user' AND next = 'assistant'").select(
        F.col("conv_id").cast("string").alias("source_doc"),
        F.col("turn").cast("string").alias("line_id"),
        none.alias("fragment_id"),
        none.alias("section_id"),
        none.alias("chapter_id"),
        F.col("text").alias("src"),
        "tgt",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )


SYSTEMS = ("sys_copy", "sys_empty", "sys_lower", "sys_novowel", "sys_reverse", "sys_src")


def hypotheses(rows: DataFrame) -> DataFrame:
    """(source_doc, seg_id, system, src, hyp, ref): six stand-ins for translations of rows(line_id, src, tgt)."""
    made = {"sys_copy": F.col("tgt"), "sys_empty": F.lit(""), "sys_lower": F.lower("tgt"), "sys_novowel": F.regexp_replace("tgt", "[aeiou]", ""), "sys_reverse": F.reverse("tgt"), "sys_src": F.col("src")}
    all_ = F.explode(F.array(*(F.struct(F.lit(k).alias("system"), v.alias("hyp")) for k, v in made.items())))
    return rows.select("source_doc", F.col("line_id").alias("seg_id"), "src", F.col("tgt").alias("ref"), all_.alias("x")).select("source_doc", "seg_id", "x.system", "src", "x.hyp", "ref")
