"""Proportional samples for human rating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def allocate(rows: DataFrame, total: int, stratum: str = "source_doc") -> DataFrame:
    """(stratum, count, n): `total` shared out by count, half to even; what is over or short by one each goes
    off the strata that rounding favoured, or to those that it cut most."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("count"))
    everything = Window.partitionBy(F.lit(0))  # one row for each stratum
    exact = F.col("count") / F.sum("count").over(everything) * F.lit(total)
    shared = counts.withColumn("exact", exact).withColumn("n", F.rint("exact").cast("long"))
    shared = shared.withColumn("short", F.lit(total) - F.sum("n").over(everything)).withColumn("rest", F.round(F.col("exact") - F.col("n"), 9))
    up = F.row_number().over(everything.orderBy(F.desc("rest"), stratum))
    down = F.row_number().over(everything.orderBy("rest", stratum))
    n = F.col("n") + F.when(F.col("up") <= F.col("short"), 1).when(F.col("down") <= -F.col("short"), -1).otherwise(0)
    return shared.withColumn("up", up).withColumn("down", down).select(stratum, "count", F.greatest(n, F.lit(0)).alias("n"))


def stratified_sample(rows: DataFrame, total: int, stratum: str = "source_doc", key: str = "seg_id", seed: int = SEED) -> DataFrame:
    """min(n, size) rows of each stratum, the first by md5 of seed and key."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    at = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    sizes = allocate(rows, total, stratum).select(F.col(stratum).alias("__s"), F.col("n").alias("__want"))
    return rows.withColumn("__h", h).withColumn("__at", at).where(F.col("__at") <= total).join(sizes, F.col(stratum) == F.col("__s")).where("__at <= __want").drop("__h", "__at", "__s", "__want")


def rating_sheet(wide: DataFrame, systems: list[str], source: str, target: str) -> DataFrame:
    """Columns for the rater: document, source, reference, one translation and one blank mark for each system."""
    out = wide.withColumnsRenamed({"src": f"source_{source}", "ref": f"reference_{target}", **{s: f"translation_{target}_{s}" for s in systems}})
    out = out.withColumns({f"eval_{s}": F.lit("") for s in systems})
    return out.select("source_doc", "seg_id", f"source_{source}", f"reference_{target}", *(f"translation_{target}_{s}" for s in systems), *(f"eval_{s}" for s in systems))
