"""SpotSigs document fingerprints in DataFrame functions only.

Common words of the corpus' languages, and the start of each line, are anchors. An anchor with the
next CHAIN content words after it is one signature; the set of a text's signatures is its
fingerprint. Sets are compared by Jaccard. `classes` finds duplicates: sets are partitioned by length so
that only the same and the next partition can hold partners, an inverted index over each set's rarest
signatures proposes them, and a pair whose set lengths alone keep it under the threshold isn't compared.

Defined results: null text counts as empty; a text without content words has one signature, of the
whole of its words, and an empty text has none; two texts of which one has no signature have
likeness 1 if their sets are both empty, else 0; rows are kept one to one; documents of equal id
are ordered by text; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import SPACE_RUN, SPACES, let

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "à au aux avec ce ces dans de des du elle en est et il ils la le les leur ne nous ou par pas plus pour qu que qui se son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so über um und von vor war wie wir zu zum zur "
    "al como con del el ella ellos es esta este fue ha han hay las lo los más me mi muy no nos o para pero por sin sobre su sus te tiene todo y ya"
).split()
CHAIN = 2
LINE = "\x01"
PUNCTUATION = ".,;:!?\"'()[]{}|*#$%&<>"


def _hash(c: Column) -> Column:
    return (F.conv(F.left(F.md5(c.cast("binary")), F.lit(8)), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")


def signatures(text: Column, anchors: tuple[str, ...] | list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, array<int>: each the first 32 bits of an md5, less 2**31."""
    plain = F.lower(F.regexp_replace(text, f"[{re.sub('(.)', r'\\\1', PUNCTUATION)}]+", ""))
    marked = F.concat(F.lit(f"{LINE} "), F.replace(plain, F.lit("\n"), F.lit(f" {LINE} ")))
    # The first mark is a word, so there is one, and the text is worked out once.
    found = F.split(F.btrim(marked, F.lit(SPACES)), SPACE_RUN)
    stops = sorted({*anchors, LINE})

    def chained(w: Column) -> Column:
        content = F.filter(w, lambda x: ~x.isin(stops))
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(stops), i)), lambda i: i.isNotNull())

        def hashed(c: Column) -> Column:
            # The k-th anchor stands at word i, so i - k content words stand before it.
            sigs = F.transform(at, lambda i, k: F.when(i - k < F.size(c), _hash(F.concat_ws(" ", F.get(w, i), *(F.get(c, i - k + n) for n in range(chain))))))
            whole = F.when(F.size(w) > F.size(F.filter(w, lambda x: x == LINE)), F.array(_hash(F.array_join(w, " ")))).otherwise(F.array().cast("array<int>"))
            return F.when(F.size(c) > 0, F.filter(sigs, lambda x: x.isNotNull())).otherwise(whole)

        return let(content, hashed)

    return F.sort_array(F.array_distinct(let(found, chained)))


def fingerprint(sigs: Column) -> Column:
    """Each signature as eight hexadecimal digits, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; of two empty ones 1."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(both)


def length_partition(n: Column, threshold: float) -> Column:
    """Sets of Jaccard >= threshold lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.lit(math.log(1 / threshold))).cast("int")


def _ranges(docs: DataFrame, rows_each: int, most: int = 16_384) -> tuple[list[int], dict[int, int]]:
    """Upper bounds of ranges of doc_id with about rows_each rows, and the largest id in each range."""
    n = docs.count()
    k = max(1, min(most, n // rows_each))
    if k == 1:
        bounds = []
    else:
        cuts = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k).alias("q")).first()["q"]
        bounds = sorted(set(cuts or []))
    tops = docs.groupBy(_range_of(F.col("doc_id"), bounds).alias("r")).agg(F.max("doc_id").alias("top"))
    return bounds, {r["r"]: r["top"] for r in tops.collect()}


def _range_of(doc_id: Column, bounds: list[int], step: int = 128) -> Column:
    """How many bounds are below the id, by one pass over every step-th bound and one over a step."""
    if not bounds:
        return F.lit(0)
    lits = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.coalesce(doc_id, F.lit(-(1 << 63)).cast("long"))))
    coarse = below(lits(bounds[step - 1 :: step])) * step
    return let(coarse, lambda c: c + below(F.slice(lits(bounds), c + 1, F.lit(step)))) if len(bounds) > step else below(lits(bounds))


def with_next(docs: DataFrame, rows_each: int = 500, more: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs and `more`, and `next`: a struct of the same columns of the document that follows
    in descending doc_id (after the last: the first). What `more` says is worked out after the shuffle.

    Ids are cut into ranges of about equal counts, each ordered by itself; the first document of a
    range also goes, marked, to the end of the range before it. So one shuffle carries the texts,
    and only the ranges' bounds (at most 16,384) come to the driver.
    """
    more = more or {}
    names = [*docs.columns, *more]
    bounds, tops = _ranges(docs.select("doc_id"), rows_each)
    if not tops:
        full = docs.withColumns(more)
        return full.withColumn("next", F.struct(*names))
    used = sorted(tops, reverse=True)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # of the first range: the last
    size = max(used) + 1
    prior = F.array(*(F.lit(before.get(r, -1)) for r in range(size)))
    top = F.array(*(F.lit(tops.get(r)).cast("long") for r in range(size)))
    spots = F.array(F.struct(F.col("__r").alias("r"), F.lit(False).alias("extra")))
    again = F.array(F.struct(F.get(prior, F.col("__r")).alias("r"), F.lit(True).alias("extra")))
    first = F.col("doc_id").eqNullSafe(F.get(top, F.col("__r")))
    dealt = docs.withColumn("__r", _range_of(F.col("doc_id"), bounds)).withColumn("__at", F.explode(F.when(first, F.concat(spots, again)).otherwise(spots)))
    dealt = dealt.withColumn("__k", F.col("__at.r")).repartition("__k").withColumns(more)
    w = Window.partitionBy("__k").orderBy(F.col("__at.extra"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    led = dealt.withColumn("next", F.lead(F.struct(*names)).over(w))
    return led.where(~F.col("__at.extra")).drop("__r", "__at", "__k")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Of each document: its signatures, its edited text and that text's, and the next document's."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(own, more={"sigs": signatures(F.col("text"))})
    n = F.length("text")
    cut = (n - n % 3) / 3
    edited = F.concat(F.substr("text", F.lit(1), n - cut.cast("int")), F.substr("next.text", F.lit(1), cut.cast("int")))
    return led.select("doc_id", n.cast("long").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited")).withColumn("edited_sigs", signatures(F.col("edited")))


def digest(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def classes(docs: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """doc_id, n_signatures and class_id, the smallest id among documents joined by likeness >= the threshold.
    A document without signatures is in a class of its own."""
    from bitloom.llm.near_dedup import join_classes

    sets = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("items"))

    def propose(reps: DataFrame) -> DataFrame:
        """Each set under its rarest signatures, in its own length partition and the next.

        A signature of one set alone proposes nothing, but takes one of the first places: such ones are counted, not ranked.
        """
        seen = reps.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
        often = reps.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        ranks = Window.partitionBy("id").orderBy("df", "item")
        known = F.count(F.lit(1)).over(ranks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        # Few are in more than one set, so their table is the one to hash, and the signatures of all sets needn't be sorted.
        rank = seen.join(often.hint("shuffle_hash"), "item").withColumn("at", F.col("n") - known + F.row_number().over(ranks))
        rare = rank.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold_percent / 100) + 1)
        part = length_partition(F.col("n"), threshold_percent / 100)
        return rare.select("id", F.col("n"), F.explode(F.array(part, part + 1)).alias("p"), "item").select("id", "n", F.xxhash64("p", "item").alias("bucket"))

    joined = join_classes(sets, propose, threshold_percent)
    return joined.select("doc_id", F.col("n").cast("long").alias("n_signatures"), "class_id")
