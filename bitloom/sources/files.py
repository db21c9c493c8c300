"""Pair tables from workbooks and CSV files, and files from result tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.columns import quoted
from bitloom.functions.schema import PAIR_SCHEMA
from bitloom.functions.scratch import Scratch
from bitloom.functions.text import NA_MARKERS, NA_TOKENS, present, strip
from bitloom.sources.ooxml import read_workbook, write_workbook


@dataclass(frozen=True)
class Columns:
    """How a workbook names its columns; metadata columns are `prefix`level + a side's suffix."""

    src: str = "line_src"
    tgt: str = "line_tgt"
    line: str = "id_line"
    fragment: str = "id_fragment"
    section: str = "id_section"
    chapter: str = "id_chapter"
    prefix: str = "name_"
    src_suffix: str = "_src"
    tgt_suffix: str = "_tgt"


_EDGE = re.compile(r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$")


#: Of `ord`: a file's lines follow those of the files before it in path order, name pairs all lines, and CSV rows both.
EACH_FILE, NAMES_FROM, CSV_FROM = 1 << 32, 1 << 61, 1 << 62


def _clean(v: str | None, drop: tuple[str, ...]) -> str | None:
    v = None if v is None or v in NA_MARKERS else _EDGE.sub("", str(v))
    return None if not v or v in NA_TOKENS or v.lower() in drop else v


def _lines(doc: str, path: str, sheet: str, rows: list, c: Columns, clean: bool) -> Iterator[tuple]:
    head = [(h or "").strip() for h in rows[0]]
    if c.src not in head or c.tgt not in head:
        return
    get = lambda row, name: row[head.index(name)] if name in head else None
    for i, row in enumerate(rows[1:]):
        src, tgt = (_clean(get(row, n), ()) for n in (c.src, c.tgt)) if clean else (get(row, n) for n in (c.src, c.tgt))
        if clean and (src is None or tgt is None):
            continue
        # Ids belong to the row that they stand in, whatever rows before it were dropped.
        ids = [None if v in NA_MARKERS else v for v in (get(row, n) for n in (c.line, c.fragment, c.section, c.chapter))]
        yield doc, *ids, src, tgt, path, sheet


def _names(doc: str, path: str, sheet: str, rows: list, c: Columns) -> Iterator[tuple]:
    head = [(h or "").strip() for h in rows[0]]
    if c.src in head:
        return
    for at, h in enumerate(head):
        if not (h.startswith(c.prefix) and h.endswith(c.src_suffix)):
            continue
        twin = h[: -len(c.src_suffix)] + c.tgt_suffix
        if twin not in head:
            continue
        for i, row in enumerate(rows[1:]):
            src, tgt = _clean(row[at], ("n/a",)), _clean(row[head.index(twin)], ("n/a",))
            if src is not None and tgt is not None:
                yield doc, f"{doc}_meta_{sheet}_{h}_{i}", None, None, None, src, tgt, path, sheet


def _workbooks(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """path and content of the workbooks under a folder, and `file`, the path's place in the order of all."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    # Names only: contents aren't read for their order. Folders are compared part by part.
    order = files.select("path").withColumn("file", F.row_number().over(Window.orderBy(F.split("path", "/"))).cast("long"))
    if order.isEmpty():
        raise FileNotFoundError(f"no workbook under {path}")
    return files.join(order, "path")


def workbook_pairs(spark: SparkSession, path: str, columns: Columns = Columns(), recursive: bool = True, lines: bool = True, names: bool = True, clean: bool = True) -> DataFrame:
    """The pairs of all workbooks under a folder: line sheets, and name columns of the other sheets.

    A workbook is read and parsed by one task; a sheet that can't be parsed is left out (`broken_sheets`
    lists those). `ord` goes by file in path order, then sheet and row, name pairs after all lines; a
    line without an id has none (`fill_line_ids` gives it one).
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content, file in zip(batch["path"], batch["content"], batch["file"], strict=True):
                doc, out = re.sub(r"\.xlsx$", "", where.rsplit("/", 1)[-1]), []
                sheets = [(sheet, rows) for sheet, rows in read_workbook(bytes(content)).items() if rows]
                for on, read, base in ((lines, lambda *a: _lines(*a, clean), 0), (names, _names, NAMES_FROM)):
                    found = [r for sheet, rows in sheets for r in read(doc, where, sheet, rows, columns)] if on else []
                    out += [(*r, base + file * EACH_FILE + n) for n, r in enumerate(found)]
                yield pd.DataFrame(out, columns=PAIR_SCHEMA.names, dtype=object)

    return _workbooks(spark, path, recursive).mapInPandas(parse, PAIR_SCHEMA)


def broken_sheets(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path and sheet of the sheets that can't be parsed."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(where, name) for name, rows in read_workbook(bytes(content)).items() if rows is None], columns=["path", "sheet"], dtype=object)

    return _workbooks(spark, path, recursive).mapInPandas(parse, "path string, sheet string")


def _before(counts: DataFrame, part: str, n: str) -> DataFrame:
    """counts(part, n, ...) with `before`, the sum of n over lesser parts (whole numbers from 0): within spans of 1,024 parts, and over the spans'
    sums, so that no window sees more than 1,024 parts or a span's row for each."""
    up_to = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spanned = counts.withColumn("__span", F.shiftright(F.col(part).cast("long"), 10))
    sums = spanned.groupBy("__span").agg(F.sum(n).alias(n)).withColumn("__over", F.shiftright("__span", 30))
    spans = sums.select("__span", up_to(Window.partitionBy("__over").orderBy("__span")).alias("__lead"))
    inner = up_to(Window.partitionBy("__span").orderBy(part)).alias("__inner")
    return spanned.select("*", inner).join(spans, "__span").withColumn("before", F.col("__inner") + F.col("__lead")).drop("__span", "__inner", "__lead")


def numbered(df: DataFrame, by: list[str], name: str, scratch: Scratch | None = None) -> DataFrame:
    """df with the rows' 1-based place in the order of `by`; rows equal in it are in any order.

    Rows are laid in order over ranges, written once, and counted by range: no task sees all rows, whatever the keys are."""
    scratch = scratch or Scratch(df.sparkSession)
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    # The range's number is in the upper bits, the row's place in the lower.
    kept = scratch.keep(laid).withColumn("__part", F.shiftright("__at", 33))
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = _before(counts, "__part", "__n").select("__part", "before")
    place = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # A row for each range: as many as the session has shuffle partitions, whatever the table's size.
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, place.cast("long")).drop("__at", "__part", "before")


def csv_pairs(spark: SparkSession, path: str, src: str, tgt: str, document: str, multi_line: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """The pairs of two columns of a CSV file (or a folder of them) with a header.

    Line ids number the rows kept, without gaps, by file in path order and then as they stand. multi_line: fields may hold line
    ends, so that a file is read by one task; without it a large file is shared by many. source_path is the row's file.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    raw = raw.withColumns({"__path": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")})
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    cell = lambda c: F.when(~quoted(c).isin(*NA_MARKERS), strip(quoted(c)))
    sides = raw.select(cell(src).alias("src"), cell(tgt).alias("tgt"), "__path", "__block", F.monotonically_increasing_id().alias("__row"))
    sides = sides.where(present(F.col("src")) & present(F.col("tgt"))).withColumn("__file", F.split("__path", "/"))
    # Folders are compared part by part; a block of a file is read by one task, whose rows are numbered as they come.
    placed = numbered(sides, ["__file", "__block", "__row"], "__n", scratch)
    name = document.lower().replace(" ", "_")
    lits = {"source_doc": F.lit(document), "line_id": F.concat(F.lit(f"{name}_"), F.col("__n").cast("string")), "source_path": F.col("__path"), "sheet_name": F.lit("csv"), "ord": F.lit(CSV_FROM) + F.col("__n")}
    none = {c: F.lit(None).cast("string") for c in ("fragment_id", "section_id", "chapter_id")}
    return placed.withColumns(lits | none).select(*PAIR_SCHEMA.names)


def fill_line_ids(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pairs without a line id get the document's name and the row's 1-based place in the whole table by ord."""
    name = F.lower(F.replace("source_doc", F.lit(" "), F.lit("_")))
    placed = numbered(pairs, ["ord"], "__place", scratch)
    return placed.withColumn("line_id", F.coalesce("line_id", F.concat_ws("_", name, F.col("__place").cast("string")))).select(*pairs.columns)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reaches it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, read) -> DataFrame | None:
    """read() if the path is there."""
    return read() if exists(spark, path) else None


def union(parts: list[DataFrame | None]) -> DataFrame:
    """All tables that are there, columns by name."""
    there = [p for p in parts if p is not None]
    if not there:
        raise FileNotFoundError("no source has any file")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there)


def unpivot_names(df: DataFrame, key: list[str], columns: Columns = Columns()) -> DataFrame:
    """key, level, src, tgt of every pair of name columns; missing and n/a values go."""
    own = [c for c in df.columns if c.startswith(columns.prefix) and c.endswith(columns.src_suffix)]
    levels = [c[len(columns.prefix) : -len(columns.src_suffix)] for c in own]
    twins = [(x, f"{columns.prefix}{x}{columns.src_suffix}", f"{columns.prefix}{x}{columns.tgt_suffix}") for x in levels]
    rows = F.array(*(F.struct(F.lit(x).alias("level"), strip(F.col(a).cast("string")).alias("src"), strip(F.col(b).cast("string")).alias("tgt")) for x, a, b in twins if b in df.columns))
    said = lambda c: present(F.col(c)) & (F.lower(c) != "n/a")
    return df.select(*key, F.explode(rows).alias("x")).select(*key, "x.*").where(said("src") & said("tgt"))


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, one_file: bool = False) -> None:
    """A folder of files with a header each, whose names and rows are in the order of `by`; no task writes more than its range.

    one_file: a result table of bounded size as one file."""
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    (laid.coalesce(1) if one_file else laid).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_xlsx(sheets: dict[str, DataFrame], path: str, most: int = 10_000, spark: SparkSession | None = None) -> None:
    """One sheet per table; a table of over `most` rows is refused. With a session the path may be in any store that Spark reaches."""
    out = {}
    for name, df in sheets.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows")
        out[name] = [df.columns, *([None if v is None else v for v in r] for r in rows)]
    data = write_workbook(out)
    if spark is None:
        with open(path, "wb") as f:
            f.write(data)
        return
    write_bytes(spark, path, data)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, in whatever store Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
