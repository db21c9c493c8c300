"""Quality control of segment pairs: features, policies, order-stable deduplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from bitloom.functions.columns import settled
from bitloom.functions.text import n_tokens, present, strip


@dataclass(frozen=True)
class QcPolicy:
    """Bounds of a pair, and the key on which pairs are duplicates of each other."""

    dedup_key: tuple[str, ...]
    least_ratio: float
    most_ratio: float
    inclusive: bool
    chars_below: int | None = None
    least_tokens: int = 0

    def accepts(self) -> Column:
        ratio = F.col("len_ratio")
        ok = ratio.between(self.least_ratio, self.most_ratio) if self.inclusive else (ratio > self.least_ratio) & (ratio < self.most_ratio)
        if self.chars_below is not None:
            ok &= (F.col("src_chars") < self.chars_below) & (F.col("tgt_chars") < self.chars_below)
        if self.least_tokens:
            ok &= (F.col("src_tokens") >= self.least_tokens) & (F.col("tgt_tokens") >= self.least_tokens)
        return ok


#: The two regimes' bounds.
TRAIN = QcPolicy(("src", "tgt", "source_doc"), 0.15, 6.0, inclusive=False, chars_below=800)
EVAL = QcPolicy(("src", "tgt"), 0.2, 5.0, inclusive=True, least_tokens=2)


def clean(pairs: DataFrame) -> DataFrame:
    """Both sides as stripped text; pairs that lack one go."""
    sides = settled(pairs, **{s: strip(F.col(s).cast("string")) for s in ("src", "tgt")})
    return sides.where(present(F.col("src")) & present(F.col("tgt"))).select(*pairs.columns)


def _sizes(pairs: DataFrame) -> DataFrame:
    return settled(pairs, **{f"{s}_chars": F.length(s) for s in ("src", "tgt")})


def _tokens(pairs: DataFrame) -> DataFrame:
    counted = settled(pairs, **{f"{s}_tokens": n_tokens(F.col(s)) for s in ("src", "tgt")})
    return counted.withColumn("len_ratio", (F.col("tgt_tokens") + 1) / (F.col("src_tokens") + 1))


def add_features(pairs: DataFrame) -> DataFrame:
    return _tokens(_sizes(pairs))


def accepted(pairs: DataFrame, policy: QcPolicy) -> DataFrame:
    """Pairs within the bounds, with their features; tokens are counted where the sizes don't rule a pair out."""
    sized = _sizes(pairs)
    if policy.chars_below is not None:
        sized = sized.where((F.col("src_chars") < policy.chars_below) & (F.col("tgt_chars") < policy.chars_below))
    return _tokens(sized).where(policy.accepts())


def dedup_first(pairs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of the rows of a key the one of least ord."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ord", "line_id"))
    return pairs.withColumn("__n", first).where("__n = 1").drop("__n")


def apply_qc(pairs: DataFrame, policy: QcPolicy) -> DataFrame:
    """Accepted pairs, deduplicated. The bounds read only what is in the key, so they come first."""
    return dedup_first(accepted(pairs, policy), policy.dedup_key)


#: Names of the counts of what quality control removes.
REMOVED = ("rows_in", "duplicates", "out_of_bounds", "rows_out")


class Counts:
    """The counts of a run of counted_qc, once its rows have been written or read."""

    def __init__(self, before: Observation, after: Observation):
        self.before, self.after = before, after

    @property
    def get(self) -> dict[str, int]:
        rows, keys, bad = self.before.get["rows"] or 0, self.after.get["keys"] or 0, self.after.get["bad"] or 0
        return dict(zip(REMOVED, (rows, rows - keys, bad, keys - bad), strict=True))


def counted_qc(pairs: DataFrame, policy: QcPolicy) -> tuple[DataFrame, Counts]:
    """What apply_qc gives, and its counts, which the job that runs the rows collects as it goes: no second pass.

    Copies go before bounds here, so that both are counted of all rows; bounds read only what is in the key."""
    before, after = Observation(), Observation()
    seen = pairs.observe(before, F.count(F.lit(1)).alias("rows"))
    first = dedup_first(add_features(seen), policy.dedup_key).withColumn("ok", policy.accepts())
    rows = first.observe(after, F.count(F.lit(1)).alias("keys"), F.sum((~F.col("ok")).cast("int")).alias("bad")).where("ok").drop("ok")
    return rows, Counts(before, after)


def removed_counts(pairs: DataFrame, policy: QcPolicy) -> DataFrame:
    """One row: rows before, duplicates, rows that break a bound, rows after; in one pass over distinct keys."""
    keys = add_features(pairs).withColumn("ok", policy.accepts()).groupBy(*policy.dedup_key).agg(F.count(F.lit(1)).alias("n"), F.first("ok").alias("ok"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(n("n").alias("rows_in"), n(F.col("n") - 1).alias("duplicates"), n((~F.col("ok")).cast("int")).alias("out_of_bounds"), n(F.col("ok").cast("int")).alias("rows_out"))
