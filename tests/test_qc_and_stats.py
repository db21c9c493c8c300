import pytest
from pyspark.sql import functions as F

from bitloom.functions.text import ends_segment, n_tokens, strip
from bitloom.operators import qc, stats

EDGES = {"niño²": 1, "niño": 3, "a b": 2, "x_y": 1, "½": 1, "a\u001cb": 2, "\U0001f44d\U0001f3fd": 2, "hola, ¿qué tal?": 6, "": 0, "  ": 0}


def test_tokens_of_edge_strings(spark):
    df = spark.createDataFrame([(t,) for t in EDGES], "t string")
    assert {r.t: r.n for r in df.select("t", n_tokens(F.col("t")).alias("n")).collect()} == EDGES


def test_strip_and_boundaries(spark):
    df = spark.createDataFrame([("  a b \t",), ("x.",), ("x. \n",), ("x",), ("",)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "x.", "x.", "x", ""]
    assert [r[0] for r in df.select(ends_segment(F.col("t"))).collect()] == [False, True, True, False, False]


def pairs(spark, rows):
    full = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "source_doc string, line_id string, src string, tgt string, ord long")


def test_clean_drops_missing_sides(spark):
    rows = [("d", "1", " a ", "b"), ("d", "2", None, "b"), ("d", "3", "nan", "b"), ("d", "4", "a", "  "), ("d", "5", "N/A", "b")]
    assert [(r.line_id, r.src) for r in qc.clean(pairs(spark, rows)).collect()] == [("1", "a"), ("5", "N/A")]


@pytest.mark.parametrize("policy,src,tgt,ok", [
    (qc.TRAIN, "w " * 19, "w " * 2, False), (qc.TRAIN, "w " * 19, "w " * 3, True),  # 3/20 = 0.15, 4/20
    (qc.TRAIN, "w", "w " * 11, False), (qc.TRAIN, "w", "w " * 10, True),  # 12/2 = 6, 11/2
    (qc.TRAIN, "x" * 799, "y", True), (qc.TRAIN, "x" * 800, "y", False), (qc.TRAIN, "y", "x" * 800, False),
    (qc.EVAL, "w " * 14, "w " * 2, True), (qc.EVAL, "w " * 15, "w " * 2, False),  # 3/15 = 0.2, 3/16
    (qc.EVAL, "w w", "w " * 14, True), (qc.EVAL, "w w", "w " * 15, False),  # 15/3 = 5, 16/3
    (qc.EVAL, "w", "w w", False), (qc.EVAL, "w w", "x" * 900 + " w", True),
])
def test_bounds(spark, policy, src, tgt, ok):
    df = qc.add_features(qc.clean(pairs(spark, [("d", "1", src, tgt)])))
    assert (df.where(policy.accepts()).count() == 1) is ok


def test_dedup_keeps_the_first_whatever_the_partitions(spark):
    rows = [("d2", "9", "a a", "b b"), ("d1", "1", "a a", "b b"), ("d1", "2", "a a", "b b"), ("d1", "3", "a c", "b b")]
    df = pairs(spark, rows)
    for n in (1, 3, 7):
        assert sorted(r.line_id for r in qc.apply_qc(df.repartition(n), qc.TRAIN).collect()) == ["1", "3", "9"]
        assert sorted(r.line_id for r in qc.apply_qc(df.repartition(n), qc.EVAL).collect()) == ["3", "9"]
    assert tuple(qc.removed_counts(df, qc.TRAIN).first()) == (4, 1, 0, 3)
    assert tuple(qc.removed_counts(df.limit(0), qc.TRAIN).first()) == (0, 0, 0, 0)


def test_total_is_of_rows_and_single_rows_have_no_deviation(spark):
    rows = [("a", "1", "w", "w w"), ("b", "2", "w w w", "w"), ("b", "3", "w w", "w")]
    got = {r.corpus: r for r in stats.corpus_stats(qc.add_features(pairs(spark, rows))).collect()}
    assert got["TOTAL"].segments == 3 and got["TOTAL"].src_avg_len == 2.0 and got["TOTAL"].src_std_len == 1.0
    assert got["a"].src_std_len is None and got["b"].src_tokens == 5
    counts = stats.value_counts(pairs(spark, rows), "source_doc").collect()
    assert [(r.source_doc, r.n) for r in counts] == [("b", 2), ("a", 1)]
