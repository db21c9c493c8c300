import pytest

from bitloom.sources import files
from bitloom.sources.ooxml import read_workbook, write_workbook


def book(path, sheets):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(write_workbook(sheets))


def test_workbook_round_trip():
    sheets = {"A & <b>": [["h1", None, "h3"], ["é \"q\"", "x\ny", None], [" lead", "", "1"]], "empty": []}
    got = read_workbook(write_workbook(sheets))
    assert got["A & <b>"] == [["h1", None, "h3"], ['é "q"', "x\ny", None], [" lead", "", "1"]] and got["empty"] == []


def test_line_and_name_sheets(spark, tmp_path):
    lines = [[" line_src ", "line_tgt", "id_line", "id_section"], ["a", "b", "1", "s"], ["nan", "x", "2", "s"], [None, "x", "3", None], [" c ", "d", None, None], ["e", "f", "5", "t"]]
    names = [["name_title_src", "name_title_tgt", "name_x_src"], ["T", "U", "z"], ["n/a", "U", None], ["V", "W", None]]
    book(tmp_path / "in" / "Doc One.xlsx", {"lines": lines, "names": names, "other": [["q"], ["1"]]})
    book(tmp_path / "in" / "sub" / "two.xlsx", {"lines": [["line_src", "line_tgt"], ["g", "h"]]})
    got = files.fill_line_ids(files.workbook_pairs(spark, str(tmp_path / "in"))).collect()
    by = {(r.source_doc, r.src): r for r in got}
    assert set(by) == {("Doc One", "a"), ("Doc One", "c"), ("Doc One", "e"), ("Doc One", "T"), ("Doc One", "V"), ("two", "g")}
    # Ids stay with their rows though rows before them were dropped.
    assert by["Doc One", "e"].line_id == "5" and by["Doc One", "e"].section_id == "t"
    assert by["Doc One", "c"].line_id == "doc_one_2" and by["Doc One", "c"].section_id is None
    assert by["Doc One", "T"].line_id == "Doc One_meta_names_name_title_src_0" and by["two", "g"].fragment_id is None
    # Lines of all workbooks by path, then name pairs; a missing id holds the place in the whole table.
    assert [r.src for r in sorted(got, key=lambda r: r.ord)] == ["a", "c", "e", "g", "T", "V"] and by["two", "g"].line_id == "two_4"
    flat = files.workbook_pairs(spark, str(tmp_path / "in"), recursive=False, names=False)
    assert {r.src for r in flat.collect()} == {"a", "c", "e"}
    raw = files.workbook_pairs(spark, str(tmp_path / "in" / "sub"), clean=False)
    assert raw.first().src == "g"


def test_shared_strings_numbers_and_broken_sheets(spark, tmp_path):
    import zipfile

    path = tmp_path / "x.xlsx"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/><sheet name="bad" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>3.0</v></c><c r="B2"><v>2.5</v></c><c r="AA2" t="str"><v>f</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", "<broken")
    got = read_workbook(path.read_bytes())
    assert got["bad"] is None
    (tmp_path / "y").mkdir()
    path.rename(tmp_path / "y" / "x.xlsx")
    assert [r.sheet for r in files.broken_sheets(spark, str(tmp_path / "y")).collect()] == ["bad"]
    assert got["s"][0][:3] == ["plain", None, "rich"] and got["s"][1][:2] == ["3", "2.5"] and got["s"][1][26] == "f"


def test_csv_pairs(spark, tmp_path):
    (tmp_path / "p.csv").write_text(' src , other,tgt\n"a, ""q""",1,"two\nlines"\nnan,2,x\n,3,y\nN/A,3,y\nnull,3,y\n nan ,3,y\n b ,4, c \n', encoding="utf-8")
    got = files.csv_pairs(spark, str(tmp_path / "p.csv"), "src", "tgt", "My Book").collect()
    assert [(r.source_doc, r.line_id, r.src, r.tgt) for r in got] == [("My Book", "my_book_1", 'a, "q"', "two\nlines"), ("My Book", "my_book_2", "b", "c")]


def test_csv_ids_have_no_gaps_over_several_files(spark, tmp_path):
    for name, rows in (("b.csv", ["p,q", "NA,x", "r,s"]), ("a.csv", ["t,u", ",v", "w,x"])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(["src,tgt", *rows]) + "\n")
    got = sorted(files.csv_pairs(spark, str(tmp_path / "in"), "src", "tgt", "D").collect(), key=lambda r: r.ord)
    assert [(r.line_id, r.src) for r in got] == [("d_1", "t"), ("d_2", "w"), ("d_3", "p"), ("d_4", "r")]


def test_no_workbook(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError, match="no workbook"):
        files.workbook_pairs(spark, str(tmp_path / "none"))


def test_optional_union_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "src string, n int")
    assert files.optional(spark, str(tmp_path / "none.csv"), lambda: a) is None and files.optional(spark, str(tmp_path), lambda: a) is a
    assert files.union([None, a, a.drop("n")]).count() == 2
    with pytest.raises(FileNotFoundError):
        files.union([None])
    files.write_csv(a.selectExpr("'q\"u, x' AS src", "n"), str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first().src == 'q"u, x'
    files.write_xlsx({"S": a}, str(tmp_path / "o.xlsx"))
    assert read_workbook((tmp_path / "o.xlsx").read_bytes()) == {"S": [["src", "n"], ["x", "1"]]}
    with pytest.raises(ValueError, match="over 0 rows"):
        files.write_xlsx({"S": a}, str(tmp_path / "p.xlsx"), most=0)
