import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.operators import qc
from bitloom.sources import files, workbook_format
from bitloom.sources.ooxml import write_workbook


def book(path, sheets):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(write_workbook(sheets))


def table(spark, n, docs=3):
    rows = [(f"Doc {i % docs}", ["one", "two"][i // docs % 2], f"l{i}", None if i % 4 else f"f{i}", f"src {i} <&>", f'tgt "{i}"', i) for i in range(n)]
    return spark.createDataFrame(rows, "source_doc string, sheet_name string, line_id string, fragment_id string, src string, tgt string, n int")


def test_many_workbooks_there_and_back(spark, tmp_path):
    workbook_format.register(spark)
    df = table(spark, 200).repartition(3, "source_doc").sortWithinPartitions("source_doc", "sheet_name", "n").drop("n")
    path = str(tmp_path / "out")
    df.write.format("workbook").mode("append").option("rowsPerFile", 30).save(path)
    assert sum(f.endswith(".xlsx") for _, _, fs in os.walk(path) for f in fs) >= 7 and not [f for f in os.listdir(path) if f.startswith("_")]
    back = spark.read.format("workbook").load(path)
    assert back.where("corrupt IS NOT NULL").count() == 0
    assert Counter(map(tuple, back.select(df.columns).collect())) == Counter(map(tuple, df.collect()))
    assert back.select("ord").distinct().count() == 200
    df.limit(10).write.format("workbook").mode("overwrite").save(path)
    assert spark.read.format("workbook").load(path).count() == 10


def test_broken_sheets_and_books_come_in_the_same_read(spark, tmp_path):
    import zipfile

    workbook_format.register(spark)
    book(tmp_path / "in" / "a.xlsx", {"lines": [["line_src", "line_tgt"], ["x", "y"], ["nan", "z"]], "names": [["name_t_src", "name_t_tgt"], ["T", "U"], ["n/a", "V"]]})
    (tmp_path / "in" / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "in" / "c.xlsx").write_bytes(b"")
    book(tmp_path / "in" / "sub" / "d.xlsx", {"good": [["line_src", "line_tgt"], ["p", "q"]], "bad": [["h"]]})
    with zipfile.ZipFile(tmp_path / "in" / "sub" / "d.xlsx") as z:
        parts = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(tmp_path / "in" / "sub" / "d.xlsx", "w") as z:
        for n, data in parts.items():
            z.writestr(n, b"<broken" if n.endswith("sheet2.xml") else data)
    rows = spark.read.format("workbook").load(str(tmp_path / "in")).collect()
    assert {(r.source_doc, r.sheet_name) for r in rows if r.corrupt} == {("b", None), ("c", None), ("d", "bad")}
    good = [r for r in rows if not r.corrupt]
    assert [(r.source_doc, r.src) for r in sorted(good, key=lambda r: r.ord)] == [("a", "x"), ("d", "p"), ("a", "T")]
    plain = files.workbook_pairs(spark, str(tmp_path / "in" / "sub")).first()
    assert (plain.source_doc, plain.src) == ("d", "p")
    assert spark.read.format("workbook").option("recursive", "false").load(str(tmp_path / "in")).where("corrupt IS NULL").count() == 2
    with pytest.raises(Exception, match="no workbook"):
        spark.read.format("workbook").load(str(tmp_path / "in" / "none")).count()


def test_a_large_workbook_is_read_sheet_by_sheet(tmp_path):
    sheets = {f"s{i}": [["line_src", "line_tgt"], *([f"{i} {j}", "t"] for j in range(40))] for i in range(9)}
    book(tmp_path / "in" / "big.xlsx", sheets)
    book(tmp_path / "in" / "small.xlsx", {"s": [["line_src", "line_tgt"], ["a", "b"]]})
    reader = workbook_format.Reader({"path": str(tmp_path / "in"), "groupBytes": 2000})
    parts = reader.partitions()
    assert len(parts) > 3
    rows = [r for p in parts for r in reader.read(p)]
    assert len(rows) == 361 and len({r[9] for r in rows}) == 361
    assert [r[5] for r in sorted(rows, key=lambda r: r[9])][:41:40] == ["0 0", "1 0"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    workbook_format.register(spark)
    path = str(tmp_path / "out")
    fails = F.when(F.col("n") == 57, F.raise_error(F.lit("stop"))).otherwise(F.col("src"))
    with pytest.raises(Exception, match="stop"):
        table(spark, 60).repartition(3, "source_doc").withColumn("src", fails).write.format("workbook").mode("append").save(path)
    assert not os.path.isdir(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="source_doc"):
        table(spark, 3).select("src").write.format("workbook").mode("append").save(path)


def test_numbers_without_gaps_over_many_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 5003, i) for i in range(5003)] + [(3, -1)] * 40, "k long, i long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = files.numbered(df, ["k"], "at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["at"] for r in got) == list(range(1, 5044))
    assert [r["k"] for r in sorted(got, key=lambda r: r["at"])] == sorted(r["k"] for r in got)
    parts = spark.createDataFrame([(i * 3, 2) for i in range(2500)], "part long, n long")
    assert [r["before"] for r in files._before(parts, "part", "n").orderBy("part").collect()] == [2 * i for i in range(2500)]
    assert files.numbered(df.limit(0), ["k"], "at").count() == 0


def test_large_csv_files_are_shared_and_keep_their_lineage(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.csv", 3000), ("b.csv", 5)):
        (tmp_path / "in" / name).write_text("src,tgt\n" + "".join(f"{name} {i} {'x' * 30},{'NA' if i % 10 == 3 else 't'}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.csv_pairs(spark, str(tmp_path / "in"), "src", "tgt", "D", multi_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = sorted(got, key=lambda r: r.ord)
    assert [r.line_id for r in rows] == [f"d_{i + 1}" for i in range(len(rows))]
    assert [r.src.split(" x")[0] for r in rows] == [f"a.csv {i}" for i in range(3000) if i % 10 != 3] + [f"b.csv {i}" for i in range(5) if i != 3]
    assert {r.source_path.rsplit("/", 1)[-1] for r in rows if r.src.startswith("b")} == {"b.csv"}


def test_csv_files_in_order(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_csv(df, str(tmp_path / "out"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(f for f in os.listdir(tmp_path / "out") if f.endswith(".csv"))
    assert len(names) > 1
    assert [int(x.split(",")[0]) for f in names for x in (tmp_path / "out" / f).read_text().split("\n")[1:] if x] == list(range(1000))


def test_counts_on_the_way_need_no_job_of_their_own(spark):
    rows = [("d", "a b", "c d", i) for i in range(3)] + [("d", "x", "y " * 50, 9), ("e", "a b", "c d", 10)]
    df = spark.createDataFrame(rows, "source_doc string, src string, tgt string, ord long").withColumn("line_id", F.col("ord").cast("string"))
    got, counts = qc.counted_qc(df, qc.TRAIN)
    assert got.count() == 2
    assert counts.get == qc.removed_counts(df, qc.TRAIN).first().asDict() == {"rows_in": 5, "duplicates": 2, "out_of_bounds": 1, "rows_out": 2}
    assert {r.ord for r in got.collect()} == {r.ord for r in qc.apply_qc(df, qc.TRAIN).collect()}
