"""Workbooks as a Spark data source: `spark.read.format("workbook")` and `df.write.format("workbook")`.

Reading: each partition takes files of about `groupBytes` bytes together; a workbook of more than that is read by several, which
take its sheets in turn. A sheet or workbook that can't be parsed is one row with the reason in `corrupt`, found by the read
that parses the others; all other rows have null there. Rows are those of `files.workbook_pairs`; `ord` has a file's place in path
order, the sheet's place in the file and the row's in the sheet, name pairs after all lines.

Writing: each task makes workbooks of its own in a folder set aside, of at most `rowsPerFile` rows of one document, and the driver
moves them to their place when all tasks are done; if one fails, the folder set aside goes and nothing is left. A task
holds one workbook's rows. Rows should come ordered by source_doc and sheet_name, or many small workbooks are made.

Paths are those that pyarrow reaches (local and shared folders, and stores with a URI); `files.workbook_pairs` reads workbooks
from any store that Spark itself reaches.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from bitloom.functions.schema import PAIR_SCHEMA
from bitloom.sources import files
from bitloom.sources.ooxml import read_workbook, sheet_names, write_workbook

GROUP_BYTES, ROWS_PER_FILE = 32 << 20, 50_000
#: Of `ord` within a file: rows of a sheet.
EACH_SHEET = 1 << 20
SCHEMA = T.StructType([*PAIR_SCHEMA.fields, T.StructField("corrupt", T.StringType())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _columns(options) -> files.Columns:
    given = {f: options.get(f) for f in files.Columns.__dataclass_fields__}
    return files.Columns(**{k: v for k, v in given.items() if v is not None})


@dataclass
class Group(InputPartition):
    """(path, its place among the files, which sheets: every `of`-th from `first`)."""

    books: list[tuple[str, int, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.columns = options["path"], _columns(options)
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.bytes = int(options.get("groupBytes", GROUP_BYTES))

    def partitions(self) -> list[Group]:
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=self.recursive, allow_not_found=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
        books = sorted((x for x in found if x.is_file and x.path.endswith(".xlsx") and not hidden(x.path)), key=lambda x: x.path.split("/"))
        if not books:
            raise FileNotFoundError(f"no workbook under {self.path}")
        out, group, held = [], [], 0
        for i, x in enumerate(books):
            size = x.size or 0
            if size > self.bytes:
                of = -(-size // self.bytes)
                out += [Group([(x.path, i, first, of)]) for first in range(of)]
                continue
            if group and held + size > self.bytes:
                out.append(Group(group))
                group, held = [], 0
            group.append((x.path, i, 0, 1))
            held += size
        return [*out, Group(group)] if group else out

    def read(self, partition: Group) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, place, first, of in partition.books:
            doc = path.rsplit("/", 1)[-1].removesuffix(".xlsx")
            base = place * files.EACH_FILE
            bad = lambda sheet, why: (doc, None, None, None, None, None, None, path, sheet, base, why)  # noqa: B023, E731
            try:
                with store.open_input_file(path) as f:
                    names = sheet_names(f)
                    sheets = read_workbook(f, set(names[first::of]))
            except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError, ValueError) as e:
                if first == 0:
                    yield bad(None, f"workbook: {e}")
                continue
            for at, sheet in enumerate(names):
                if sheet not in sheets:
                    continue
                rows = sheets[sheet]
                if rows is None:
                    yield bad(sheet, "sheet can't be parsed")
                elif rows:
                    for n, r in enumerate(files._lines(doc, path, sheet, rows, self.columns, True)):
                        yield *r, base + at * EACH_SHEET + n, None
                    for n, r in enumerate(files._names(doc, path, sheet, rows, self.columns)):
                        yield *r, files.NAMES_FROM + base + at * EACH_SHEET + n, None


@dataclass
class Made(WriterCommitMessage):
    """Workbooks set aside, with the places that they go to."""

    moves: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.rows = int(options.get("rowsPerFile", ROWS_PER_FILE))
        c = _columns(options)
        heads = {"src": c.src, "tgt": c.tgt, "line_id": c.line, "fragment_id": c.fragment, "section_id": c.section, "chapter_id": c.chapter}
        own = [f.name for f in schema.fields if f.name in heads]
        if "source_doc" not in schema.names or not {"src", "tgt"} <= set(own):
            raise ValueError("a table of workbooks needs source_doc, src and tgt")
        self.own, self.heads, self.sheeted = own, [heads[n] for n in own], "sheet_name" in schema.names

    def _aside(self, root: str) -> str:
        return f"{root.rstrip('/')}/_pending-{self.run}"

    def write(self, iterator: Iterator) -> Made:
        store, root = _store(self.path)
        moves: list[tuple[str, str]] = []
        doc, sheets, held = None, {}, 0

        def finish() -> None:
            # A folder of its own for each workbook: a document's name stays the file's, whoever else writes the same.
            name = f"{uuid.uuid4().hex}/{doc}.xlsx"
            aside = f"{self._aside(root)}/{name}"
            store.create_dir(aside.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(aside) as out:
                out.write(write_workbook({s: [self.heads, *rows] for s, rows in sheets.items()}))
            moves.append((aside, f"{root.rstrip('/')}/part-{name}"))

        for row in iterator:
            new = row["source_doc"] or "unnamed"
            if held and (new != doc or held == self.rows):
                finish()
                sheets, held = {}, 0
            doc = new
            sheets.setdefault((row["sheet_name"] if self.sheeted else None) or "lines", []).append([row[n] for n in self.own])
            held += 1
        if held:
            finish()
        return Made(moves)

    def commit(self, messages: list[Made | None]) -> None:
        store, root = _store(self.path)
        old = store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if self.overwrite else []
        for x in old:
            if x.base_name.startswith("part-"):
                store.delete_dir(x.path)
        for made in messages:
            for aside, place in made.moves if made else []:
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                store.move(aside, place)
        self._clear(store, root)

    def abort(self, messages: list[Made | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._aside(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._aside(root))


class Workbooks(DataSource):
    """Options: path, recursive, groupBytes, rowsPerFile, and the names of files.Columns."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(Workbooks)
