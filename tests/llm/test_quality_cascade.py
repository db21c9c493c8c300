import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from bitloom.llm import quality_cascade as Q

SCHEMA = "doc_id long, text string, n_words int, kept string, txt string, w int, l int"
SPACE = r"[\x20\x09-\x0D]+"


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    t = text or ""
    ws = [w for w in re.split(SPACE, t) if w]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = {}
    for g in grams:
        n[g] = n.get(g, 0) + 1
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.sub(SPACE, "", x)]
    chars = sum(map(len, ws))
    symbols = sum(c in "#*$%&|<>" for c in t)
    dup = len(lines) - len(set(lines))
    failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    letters = sum(unicodedata.category(c)[0] == "L" for c in t)
    bad = [chars < 2 * len(ws), chars > 15 * len(ws), symbols * 5 > len(ws), dup * 10 > len(lines) * 3, upper * 2 > chars, letters * 2 < chars, t.count("!") * 2 > len(ws)]
    return len(ws), chars, symbols, dup, len(repeated), failed, not failed and not any(bad)


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij\u00e9\u00df") for _ in range(rng.randint(1, 9)))
    good = " ".join(word() for _ in range(80))
    edge = " ".join(f"w{i}x" for i in range(50))
    out = [None, "", "  \n\t ", "one", "a b c", "a b c a b c", good, good, good.upper(), edge, " ".join(edge.split()[:49]), "\u00a0".join(["x"] * 60), "\U0001f600 " * 60]
    # Exactly at the bounds: half of the words repeat; 3 of 10 lines repeat; one symbol to five words.
    out += ["p q r p q r " + " ".join(f"u{i}v" for i in range(44)), "\n".join(f"line {i} has these five words" for i in [0, 1, 2, 3, 4, 5, 6, 0, 1, 2]), "# " * 10 + edge, "#" * 10 + " " + edge]
    for _ in range(250):
        some = [word() for _ in range(rng.randint(1, 25))]
        parts = [rng.choice([*some, *some, "!", "#x", "123", "QQ", "\u00a0", "so on"]) for _ in range(rng.randint(1, 160))]
        out.append("".join(p + rng.choice([" ", " ", " ", "\n", "\t ", "\n\n"]) for p in parts))
    return out


def test_against_a_plain_scan(spark):
    all_ = texts()
    # Nulls, repeated ids, and extra columns with the operator's own names.
    df = spark.createDataFrame([(None if i == 5 else i // 2, t, 9, "x", "y", 1, 2) for i, t in enumerate(all_)], SCHEMA).repartition(3)
    got = sorted(map(str, (tuple(r) for r in Q.quality(df).collect())))
    assert got == sorted(str((None if i == 5 else i // 2, *plain(t))) for i, t in enumerate(all_))


def test_the_order_of_rules_changes_no_verdict(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rules = Q.default_rules()
    verdicts = [{(r.doc_id, r.v) for r in Q.metrics(df).select("doc_id", Q.verdict(x).alias("v")).collect()} for x in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]


def test_rules_go_by_rejections_per_cost(spark, monkeypatch):
    rules = [Q.Rule(n, F.lit(False)) for n in "abcd"]
    monkeypatch.setattr(Q, "gains", lambda docs, rules: [(0.1, 1.0), (0.1, 0.05), (0.0, 0.05), (0.9, 1.0)])
    assert [r.name for r in Q.order_rules(None, rules)] == ["b", "d", "a", "c"]


def test_a_rule_that_is_seldom_met_and_dear_comes_last_every_time(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)) + (" !" * 300 if i % 2 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dear = Q.Rule("dear", F.length(F.regexp_replace(F.regexp_replace("txt", r"(\p{Lu}|x)+", ""), r"\P{L}", "")) < 0, 2)
    rules = [dear, Q.Rule("cheap", F.col("n_words") > 500)]
    for _ in range(3):
        assert [r.name for r in Q.order_rules(df, rules)] == ["cheap", "dear"]
    (seldom, cost), (often, least) = Q.gains(df, rules)
    assert seldom == 0 and often == pytest.approx(0.5, abs=0.15) and cost > 1000 > least
    assert Q.gains(df, rules) == [(seldom, cost), (often, least)]
    assert len(Q.gains(df.limit(0), rules)) == 2


def test_a_stored_order_needs_no_job(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    names = [r.name for r in Q.order_rules(df, Q.default_rules())]
    spark.sparkContext.setJobGroup("stored order", "plan only")
    try:
        plan = Q.quality(df, order=names)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("stored order")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in Q.quality(df).collect()}


def test_a_rejected_document_is_spared_the_rules_after(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    fails = Q.Rule("fails", F.when(F.col("txt") == "x", F.raise_error(F.lit("shown")).cast("boolean")).otherwise(F.lit(False)))
    first = Q.Rule("first", F.col("txt") == "x")
    got = {r.doc_id: r.v for r in Q.metrics(df).select("doc_id", Q.verdict([first, fails]).alias("v")).collect()}
    assert got == {1: False, 2: True}


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(3)
    text = "\n".join(" ".join(str(rng.randint(0, 400)) + "abc" for _ in range(12)) for _ in range(25_000))
    row = Q.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row)[1:] == plain(text)
    assert Q.quality(spark.createDataFrame([], SCHEMA)).count() == 0
