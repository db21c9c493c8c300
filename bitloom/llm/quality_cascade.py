"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and selectivity is estimated on a bounded random sample; rules are then tried in
falling order of rejections per cost, and a document that one rule rejects is not shown to the next.
The order changes the work, never the verdict. What only one rule reads of a text is worked out
inside its branch of the CASE, so a document rejected before is spared it; the counts that every
row returns are worked out once, for all.

A rule's cost is what it reads of a row besides the counts that all rows have, in characters of text, each as often as
the rule goes over it; comparing counts costs as much as one character. Shares of rejections and mean costs of all
rules come from one aggregation over the sample, so the order is the same in every run. Gains are compared by
powers of two; equal ones keep the order in which rules were given. An order found once can be given to `quality`
as `order`; then a plan is built without a job.

Defined results: null text counts as empty (no words, base_failed); rows are kept one to one, so
repeated ids give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import SPACES, let, words

SYMBOLS = "#*$%&|<>"
#: Of the sample: rows wanted (its size varies a little around it), and the longest text.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000


@dataclass(frozen=True)
class Rule:
    """reject: a boolean column over the columns of `metrics`; passes: how often it goes over the whole text."""

    name: str
    reject: Column
    passes: int = 0

    def cost(self) -> Column:
        return F.lit(1) + self.passes * F.length("txt")


def default_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        Rule("symbols", c("n_symbols") * 5 > c("n_words")),
        Rule("dup_lines", c("n_dup_lines") * 10 > c("n_lines") * 3),
        Rule("shouting", F.length(F.regexp_replace("txt", r"\P{Lu}", "")) * 2 > c("word_chars"), 1),
        Rule("few_letters", F.length(F.regexp_replace("txt", r"\P{L}", "")) * 2 < c("word_chars"), 1),
        Rule("exclaiming", (F.length("txt") - F.length(F.translate("txt", "!", ""))) * 2 > c("n_words"), 1),
    ]


def _repeat_words(w: Column) -> Column:
    """Words lying in a 3-word window that the text has twice or more.

    Windows are sorted by hash, so that equal ones are neighbours; the marked starts, sorted again,
    give the union of their 3-word spans in one linear fold.
    """
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def spans(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            found = F.transform(s, lambda x, j: F.when(same(j - 1, j) | same(j, j + 1), x["i"]))
            return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

        def union(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        some = let(let(ranked, marked), union)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(w) >= 4, let(hashes, spans)).otherwise(F.lit(0).cast("long"))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, txt and the counts on which rules decide."""
    lines = F.filter(F.split("txt", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    counts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("txt")).select(
        "doc_id",
        "txt",
        let(words(F.col("txt")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("rep"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.length(F.translate("txt", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("txt") - F.length(F.translate("txt", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return counts.select(
        "doc_id", "txt", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines")
    )


def gains(docs: DataFrame, rules: list[Rule]) -> list[tuple[float, float]]:
    """For each rule its share of rejections and its mean cost, on a sample of rows drawn from all partitions
    alike, without texts of over SAMPLE_CHARS characters."""
    n = docs.count()
    some = docs.select("doc_id", "text")
    if n > SAMPLE_ROWS:
        some = some.sample(False, SAMPLE_ROWS / n, 11)
    sample = metrics(some.where(F.length("text") <= SAMPLE_CHARS))
    each = [x for i, r in enumerate(rules) for x in (F.avg(r.reject.cast("int")).alias(f"s{i}"), F.avg(r.cost()).alias(f"c{i}"))]
    found = sample.agg(F.count(F.lit(1)).alias("n"), *each).first()
    return [(float(found[f"s{i}"] or 0), float(found[f"c{i}"] or 1)) for i in range(len(rules))]


def order_rules(docs: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by falling rejections per second."""
    level = [round(math.log2(share / cost)) if share else -math.inf for share, cost in gains(docs, rules)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-level[i], i))]


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects; CASE stops at the first that does."""
    kept = F.lit(True)
    for r in reversed(rules):
        kept = F.when(r.reject, F.lit(False)).otherwise(kept)
    return kept


def quality(docs: DataFrame, rules: list[Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, and kept. order: the rules' names as found before, instead of a sample of docs."""
    rules = rules if rules is not None else default_rules()
    ordered = order_rules(docs, rules) if order is None else sorted(rules, key=lambda r: order.index(r.name))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        metrics(docs)
        .withColumn("base_failed", base)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(ordered)).alias("kept")
        )
    )
