"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import Scratch

#: Up to so many links (16 bytes each) one task joins them at once, where a pass over all partitions would take longer.
FEW = 200_000


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find with the smaller root on top."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], ["id", "root"])


def components(links: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """links(u, v) to (id, root) of every linked id, root the smallest id that it reaches.

    Large star: each node hands its larger neighbours its least neighbour; small star: its smaller
    ones. Every step is a minimum per key, aggregated before it is shuffled, and a join on that key;
    no neighbourhood is gathered. It ends when a pass changes nothing: all links then point at roots.
    A table that is counted to have at most `few` links is left to one task; 0: none is.
    """
    edges = scratch.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    if few and mark[0] <= few:
        return edges.coalesce(1).mapInArrow(_at_once, "id long, root long")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots.select("id", F.col("id").alias("root")))
