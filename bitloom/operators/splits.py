"""Group-wise train/dev/test splits and their leakage reports.

Groups are shuffled by the md5 of seed and group id. Ranks are taken within hash ranges and offset by
the counts of the ranges before, so that neither one document with most groups nor the global shuffle
puts all groups into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
#: Hexadecimal digits of a hash that name its range: groups are ranked within 4,096 ranges of each value of `by`.
RANGE_DIGITS = 3
#: Shares of the groups.
TRAIN_SHARE, DEV_SHARE = 0.8, 0.1
SPLITS = ("train", "dev", "test")
LEVELS = (("fragment_id", "frag"), ("section_id", "sec"), ("chapter_id", "cap"))


def group_id(fallback: str = "line") -> Column:
    """The finest known id: fragment, section, chapter, else the line or the whole document."""
    named = [F.when(F.col(c).isNotNull(), F.concat_ws("__", "source_doc", F.lit(tag), c)) for c, tag in LEVELS]
    last = {"line": F.concat_ws("__", "source_doc", F.lit("line"), "line_id"), "document": F.col("source_doc")}[fallback]
    return F.coalesce(*named, last)


def hash_rank(groups: DataFrame, key: str, by: list[str], seed: int = SEED) -> DataFrame:
    """groups with `rank` (from 1, in md5 order) and `n`, the number of groups, within each value of `by`."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)).cast("binary"))
    hashed = groups.withColumn("__h", h).withColumn("__part", F.substring("__h", 1, RANGE_DIGITS))
    counts = hashed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__k"))  # at most 16 ** RANGE_DIGITS rows for each value
    w = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("__k").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__k").over(w).alias("n"))
    within = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__h", key))
    return hashed.withColumn("__at", within).join(counts, [*by, "__part"]).withColumn("rank", (F.col("__at") + F.col("__before")).cast("long")).drop("__h", "__part", "__at", "__before")


def is_holdout(words: tuple[str, ...]) -> Column:
    """The document's name holds one of the words."""
    name = F.lower("source_doc")
    return F.coalesce(reduce(lambda a, b: a | b, (name.contains(w) for w in words), F.lit(False)), F.lit(False))


def _cut(rank: Column, n: Column) -> Column:
    share = lambda x: F.greatest(F.lit(1), F.floor(n * F.lit(x)).cast("long"))
    train = share(TRAIN_SHARE)
    return F.when(rank <= train, "train").when(rank <= train + share(DEV_SHARE), "dev").otherwise("test")


def _split(pairs: DataFrame, by: list[str], holdout: tuple[str, ...], seed: int) -> DataFrame:
    groups = pairs.where(~is_holdout(holdout)).select("source_doc", "group_id").distinct()
    chosen = hash_rank(groups if by else groups.select("group_id").distinct(), "group_id", by, seed).select(*by, "group_id", _cut(F.col("rank"), F.col("n")).alias("split"))
    return pairs.join(chosen, [*by, "group_id"], "left").withColumn("split", F.when(is_holdout(holdout), "test").otherwise(F.col("split")))


def stratified_split(pairs: DataFrame, holdout: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """pairs with `split`: the groups of each document are cut 80/10/10; held-out documents are test."""
    return _split(pairs, ["source_doc"], holdout, seed)


def global_split(pairs: DataFrame, holdout: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """The same over all groups at once."""
    return _split(pairs, [], holdout, seed)


def group_shuffle_split(pairs: DataFrame, held: float = 0.2, seed: int = SEED) -> DataFrame:
    """pairs with `split`: the share `held` of the groups, rounded up, and of these half, rounded up, for test, the rest for dev."""
    ranked = hash_rank(pairs.select("group_id").distinct(), "group_id", [], seed)
    out = F.ceil(F.col("n") * F.lit(held))
    test = F.ceil(out * F.lit(0.5))
    split = F.when(F.col("rank") <= test, "test").when(F.col("rank") <= out, "dev").otherwise("train")
    return pairs.join(ranked.select("group_id", split.alias("split")), "group_id")


def leaks(pairs: DataFrame, key: list[str]) -> DataFrame:
    """For each pair of splits, how many keys are in both; one pass over the keys."""
    seen = [F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    keys = pairs.groupBy(*key).agg(*seen)
    checks = [("train", "dev"), ("train", "test"), ("dev", "test")]
    counts = keys.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}/{b}") for a, b in checks))
    names = [f"{a}/{b}" for a, b in checks]
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("shared")) for n in names))).alias("x")).select("x.*")


def assert_no_leaks(pairs: DataFrame, key: list[str]) -> None:
    found = [r for r in leaks(pairs, key).collect() if r["shared"]]
    if found:
        raise ValueError("; ".join(f"{r['check']}: {r['shared']} shared" for r in found))


def contamination(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose pair is in the training rows."""
    return test.join(train.select("src", "tgt").distinct(), ["src", "tgt"], "left_semi")
