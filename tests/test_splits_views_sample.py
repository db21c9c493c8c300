import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bitloom.operators import sample, splits, views

SCHEMA = "source_doc string, line_id string, fragment_id string, section_id string, chapter_id string, src string, tgt string, ord long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def corpus(rng, docs):
    rows = []
    for d, groups in docs.items():
        for g in range(groups):
            for _ in range(rng.randint(1, 3)):
                i = len(rows)
                rows.append((d, f"l{i}", f"g{g}", None, None, f"src {i}", f"tgt {i}", i))
    return rows


def md5(g):
    return hashlib.md5(f"42|{g}".encode()).hexdigest()


def plain_cut(groups):
    order = sorted(groups, key=lambda g: (md5(g), g))
    a = max(1, int(len(order) * 0.8))
    b = a + max(1, int(len(order) * 0.1))
    return {g: "train" if i < a else "dev" if i < b else "test" for i, g in enumerate(order)}


def test_group_ids(spark):
    rows = [("D", "7", "f", "s", "c", "", "", 0), ("D", "7", None, "s", "c", "", "", 1), ("D", "7", None, None, "c", "", "", 2), ("D", "7", None, None, None, "", "", 3)]
    got = table(spark, rows).select(splits.group_id("line").alias("a"), splits.group_id("document").alias("b")).collect()
    assert [r.a for r in got] == ["D__frag__f", "D__sec__s", "D__cap__c", "D__line__7"] and got[3].b == "D"


def test_splits_against_plain_versions(spark):
    rows = corpus(random.Random(1), {"one": 1, "two": 2, "three": 3, "ten": 10, "many": 700, "held X": 4})
    df = table(spark, rows).withColumn("group_id", splits.group_id())
    by = defaultdict(set)
    for r in df.collect():
        by[r.source_doc].add(r.group_id)
    want = {g: s for d, gs in by.items() if d != "held X" for g, s in plain_cut(gs).items()} | dict.fromkeys(by["held X"], "test")
    got = splits.stratified_split(df.repartition(5), ("held",))
    assert {r.group_id: r.split for r in got.collect()} == want and got.count() == len(rows)
    everywhere = plain_cut({g for d, gs in by.items() if d != "held X" for g in gs}) | dict.fromkeys(by["held X"], "test")
    assert {r.group_id: r.split for r in splits.global_split(df, ("held",)).collect()} == everywhere
    order = sorted((g for gs in by.values() for g in gs), key=lambda g: (md5(g), g))
    out = math.ceil(len(order) * 0.2)
    shuffled = {g: "test" if i < math.ceil(out / 2) else "dev" if i < out else "train" for i, g in enumerate(order)}
    assert {r.group_id: r.split for r in splits.group_shuffle_split(df).collect()} == shuffled
    assert Counter(want[g] for g in by["two"]) == Counter({"train": 1, "dev": 1}) and {want[g] for g in by["one"]} == {"train"}
    splits.assert_no_leaks(got, ["group_id"])


def test_leaks_and_contamination(spark):
    df = spark.createDataFrame([("g1", "a", "b", "train"), ("g2", "a", "b", "test"), ("g2", "c", "d", "dev")], "group_id string, src string, tgt string, split string")
    assert {r.check: r.shared for r in splits.leaks(df, ["group_id"]).collect()} == {"train/dev": 0, "train/test": 0, "dev/test": 1}
    with pytest.raises(ValueError, match="train/test: 1"):
        splits.assert_no_leaks(df, ["src", "tgt"])
    assert [r.group_id for r in splits.contamination(df.where("split='test'"), df.where("split='train'")).collect()] == ["g2"]


def plain_sentences(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[-1]):
        groups[(r[0], ("f", r[2]) if r[2] else ("s", r[3]) if r[3] else "d")].append(r)
    out = []
    for lines in groups.values():
        buf = []
        for r in lines:
            buf.append(r)
            text = " ".join(x[5] for x in buf)
            if len(text) >= 20 and (text.rstrip()[-1] in ".!?" or len(text) >= 260):
                out.append(buf)
                buf = []
        if buf:
            out.append(buf)
    return sorted((b[0][0], b[0][1], len(b), " ".join(x[5] for x in b), " ".join(x[6] for x in b)) for b in out)


def test_sentence_packing_against_a_plain_pass(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        size = rng.choice([1, 5, 18, 19, 20, 21, 120, 258, 259, 260, 300])
        rows.append((rng.choice("AB"), f"l{i}", rng.choice([None, "f1", "f2"]), rng.choice([None, "s1"]), "c", "x" * (size - 1) + rng.choice([".", "x", "?", "x", "x"]), f"t{i}", i))
    got = views.sentence_view(table(spark, rows).repartition(7))
    assert sorted((r.source_doc, r.line_id, r.n_lines, r.src, r.tgt) for r in got.collect()) == plain_sentences(rows)


@pytest.mark.parametrize("kind", ["never closes", "closes now and then", "other documents between"])
def test_one_long_document_over_many_partitions(spark, kind):
    """Tasks share a document; what hangs on the partitions before is told by tables of states."""
    rng = random.Random(len(kind))
    rows = []
    for i in range(3000):
        long = kind == "closes now and then" and rng.random() < 0.002
        text = "y" * 270 if long else "x" * rng.choice([1, 2, 7, 30, 90]) + ("." if kind == "other documents between" and i % 40 == 0 else "")
        doc = rng.choice("AB") if kind == "other documents between" and 900 < i < 1500 else "A"
        rows.append((doc, f"l{i}", None, None, None, text, f"t{i}", i))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = views.sentence_view(table(spark, rows).repartition(7)).collect()
        scratch = [r.part for r in views._segments(_laid(spark, rows)).where("last").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.source_doc, r.line_id, r.n_lines, r.src, r.tgt) for r in got) == plain_sentences(rows)
    assert len(scratch) >= 12


def _laid(spark, rows):
    lines = table(spark, rows).selectExpr("source_doc AS doc", "'d' AS key", "ord", "line_id", "src", "tgt", "length(src) AS chars", "src LIKE '%.' AS ends")
    return lines.repartitionByRange("doc", "ord").sortWithinPartitions("doc", "ord").withColumn("part", F.spark_partition_id())


def test_sentence_view_of_no_lines_and_null_documents(spark):
    assert views.sentence_view(table(spark, [("A", "1", None, None, None, "x", "p", 1)]).limit(0)).count() == 0
    got = views.sentence_view(table(spark, [(None, "1", None, None, None, "x", "p", 1), (None, "2", None, None, None, "y" * 30 + ".", "q", 2)])).collect()
    assert [(r.source_doc, r.line_id, r.n_lines, r.tgt) for r in got] == [(None, "1", 2, "p q")]


def test_fragment_level_and_text(spark):
    rows = [("A", "1", None, "s", None, "x", "p", 2), ("A", "0", None, "s", None, "y", "q", 1), ("A", "2", None, None, "c", "z", "r", 3)]
    got = views.fragment_view(table(spark, rows)).collect()
    assert [(r.unit_id, r.line_id, r.src, r.tgt) for r in got] == [("s", "0", "y x", "q p")]
    assert views.fragment_view(table(spark, [("A", "1", None, None, None, "x", "p", 2)])).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1, "d": 97}, {"a": 5}, {f"d{i}": i + 1 for i in range(20)}, {"a": 3, "b": 1}])
def test_allocation_and_sample(spark, sizes):
    rows = [(d, f"{d}{i}") for d, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source_doc string, seg_id string")
    total = sum(sizes.values())
    got = {r.source_doc: r.n for r in sample.allocate(df, 28).collect()}
    assert sum(got.values()) == 28
    assert all(abs(got[d] - n / total * 28) <= 1 + 1e-9 for d, n in sizes.items())
    picked = sample.stratified_sample(df.repartition(3), 28)
    assert Counter(r.source_doc for r in picked.collect()) == Counter({d: min(got[d], n) for d, n in sizes.items() if got[d]})
    for d in sizes:
        want = sorted((s for x, s in rows if x == d), key=lambda s: (md5(s), s))[: got[d]]
        assert {r.seg_id for r in picked.where(F.col("source_doc") == d).collect()} == set(want)
