"""Corpus statistics and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(pairs: DataFrame) -> DataFrame:
    """Per document, and TOTAL over all rows: segments, and sum, mean and sample deviation of token counts."""
    per_side = [
        x
        for s in ("src", "tgt")
        for x in (
            F.sum(f"{s}_tokens").cast("long").alias(f"{s}_tokens"),
            F.round(F.avg(f"{s}_tokens"), 2).alias(f"{s}_avg_len"),
            F.round(F.stddev_samp(f"{s}_tokens"), 2).alias(f"{s}_std_len"),
        )
    ]
    by = pairs.rollup("source_doc").agg(F.grouping("source_doc").alias("g"), F.count(F.lit(1)).alias("segments"), *per_side)
    return by.withColumn("corpus", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source_doc"))).drop("g", "source_doc")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def split_stats(pairs: DataFrame) -> DataFrame:
    """Rows and mean characters per split."""
    means = [F.round(F.avg(F.length(s)), 1).alias(f"{s}_chars_mean") for s in ("src", "tgt")]
    return pairs.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *means)
