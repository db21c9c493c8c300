"""Line, sentence-like and fragment views of a pair table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bitloom.functions.scratch import Scratch
from bitloom.functions.text import ends_segment

LEAST_CHARS, MOST_CHARS = 20, 260
LEVELS = ("fragment_id", "section_id", "chapter_id")


def line_view(pairs: DataFrame) -> DataFrame:
    return pairs.select("source_doc", "line_id", *LEVELS, "src", "tgt")


def _fold(size: int, first: int | None, chars: int, ends: bool, at: int) -> tuple[int, int, int]:
    """A line's segment, named by its first line's ord, and the state behind the line: the characters that wait, and for which segment."""
    first = first if size else at
    grown = (size + 1 if size else 0) + chars
    if grown >= LEAST_CHARS and (ends or grown >= MOST_CHARS):
        return first, 0, 0
    return first, grown, first


class _AnyState:
    """What every state that a partition may be entered with has become: for each count of waiting characters, the count now, and the
    segment that waits (0: the one from before), with whether it is that one."""

    def __init__(self):
        self.size, self.first, self.carried = np.arange(MOST_CHARS), np.zeros(MOST_CHARS, np.int64), np.arange(MOST_CHARS) > 0

    def step(self, chars: int, ends: bool, at: int) -> bool:
        """True if all states are one from here on: the line closes a segment whatever came before."""
        new = self.size == 0
        grown = np.where(new, 0, self.size + 1) + chars
        flush = (grown >= LEAST_CHARS) & (ends | (grown >= MOST_CHARS))
        self.first, self.carried = np.where(new, at, self.first), self.carried & ~new
        self.size = np.where(flush, 0, grown)
        self.carried &= ~flush
        return bool(flush.all())


_MARK = "last boolean, opens string, closes string, size int, first long, sizes array<int>, firsts array<long>, carried array<boolean>"


def _segments(laid: DataFrame) -> DataFrame:
    """laid(part, doc, key, ord, chars, ends, ...), sorted, with `segment`: the ord of its first line, null where that hangs on the
    partitions before. Behind a partition's lines stands one row (last) with its first and last group and the state that it is left
    in: size and first, or, if no line made all states one, what each state that it may be entered with has become."""
    own = laid.columns
    lines = [T.StructField(f.name, f.dataType) for f in laid.schema.fields]
    schema = T.StructType([*lines, T.StructField("segment", T.LongType()), *T.StructType.fromDDL(_MARK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        group = opens = None
        part, size, first, unknown = -1, 0, 0, None
        for batch in batches:
            found = []
            col = lambda c: batch.column(own.index(c)).to_pylist()  # noqa: B023, E731
            for part, doc, key, at, chars, ends in zip(*map(col, ("part", "doc", "key", "ord", "chars", "ends")), strict=True):
                if (doc, key) != group:
                    group, size, first = (doc, key), 0, 0
                    unknown = _AnyState() if opens is None else None
                    opens = opens or group
                if unknown:
                    found.append(None)
                    if unknown.step(chars, ends, at):
                        unknown = None
                else:
                    segment, size, first = _fold(size, first, chars, ends, at)
                    found.append(segment)
            more = [pa.nulls(len(found), kinds.field(i).type) for i in range(len(own) + 1, len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64()), *more], schema=kinds)
        if opens is None:
            return
        state = [None, None, *(x.tolist() for x in (unknown.size, unknown.first, unknown.carried))] if unknown else [size, first, None, None, None]
        row = {"part": part, "last": True, "opens": repr(opens), "closes": repr(group)} | dict(zip(("size", "first", "sizes", "firsts", "carried"), state, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in kinds], schema=kinds)

    return laid.mapInArrow(run, schema)


def _entries(marks: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each partition the state that it is entered with; the partitions' maps are composed one after another."""
    out, closes, size, first = {}, None, 0, 0
    for r in marks.orderBy("part").toLocalIterator():  # a row for each partition
        size, first = (size, first) if r["opens"] == closes else (0, 0)
        out[r["part"]] = (size, first)
        if r["sizes"] is None:
            size, first = r["size"], r["first"]
        else:
            size, first = r["sizes"][size], first if r["carried"][size] else r["firsts"][size]
        closes = r["closes"]
    return out


def _resolved(heads: DataFrame, entries: dict[int, tuple[int, int]]) -> DataFrame:
    """The lines at the partitions' beginnings, folded from the states that the partitions are entered with."""
    own = heads.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size, first = None, 0, 0
        for batch in batches:
            found = []
            col = lambda c: batch.column(own.index(c)).to_pylist()  # noqa: B023, E731
            for part, at, chars, ends in zip(*map(col, ("part", "ord", "chars", "ends")), strict=True):
                if part != last:
                    last, (size, first) = part, entries[part]
                segment, size, first = _fold(size, first, chars, ends, at)
                found.append(segment)
            at = own.index("segment")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()) if i == at else c for i, c in enumerate(batch.columns)], own)

    return heads.repartition("part").sortWithinPartitions("part", "ord", "line_id").mapInArrow(run, heads.schema)


def sentence_view(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Neighbouring lines of a fragment, else section, else document, packed until they hold at least
    20 characters and end a sentence, or hold 260.

    Lines are laid in order over the partitions of the whole table, so a document of any length is shared by tasks.
    A task packs its lines in one run. Only those before its first line that closes a segment by itself hang on
    the partition before: what a partition does to each of the 260 states that it may be entered with is a table, the
    tables are composed in order, and those lines are packed from the state found.

    ord must be unique within a document's group, or ties go by line_id; equal rows of both are in any order.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    key = F.coalesce(F.concat(F.lit("f|"), "fragment_id"), F.concat(F.lit("s|"), "section_id"), F.lit("d"))
    lines = pairs.select(F.col("source_doc").alias("doc"), key.alias("key"), "ord", "line_id", "src", "tgt", F.length("src").alias("chars"), ends_segment(F.col("src")).alias("ends"))
    by = ["doc", "key", "ord", "line_id"]
    laid = lines.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    done = scratch.keep(_segments(laid))
    kept = [*by, "src", "tgt", "segment"]
    heads = done.where("last IS NULL AND segment IS NULL").select("part", "chars", "ends", *kept)
    found = _resolved(heads, _entries(done.where("last"))).select(*kept).union(done.where("last IS NULL AND segment IS NOT NULL").select(*kept))
    return _joined(found, ["doc", "key", "segment"]).withColumnRenamed("doc", "source_doc").drop("key", "segment")


def _joined(lines: DataFrame, by: list[str]) -> DataFrame:
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", s))), lambda x: x[s]), " ")
    return lines.groupBy(*by).agg(F.min_by("line_id", "ord").alias("line_id"), F.min("ord").alias("ord"), F.count(F.lit(1)).cast("long").alias("n_lines"), text("src").alias("src"), text("tgt").alias("tgt"))


def fragment_level(pairs: DataFrame) -> str | None:
    """The first of fragment, section, chapter that any row has."""
    return levels(pairs).first()["level"]


def levels(pairs: DataFrame) -> DataFrame:
    """One row: level, the first of fragment, section, chapter that any row has."""
    has = pairs.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in LEVELS))
    return has.select(F.coalesce(*(F.when(F.col(c), F.lit(c)) for c in LEVELS)).alias("level"))


def fragment_view(pairs: DataFrame, level: str | None = None) -> DataFrame:
    """Lines joined per document and id of the level; rows without the id go. Without a level given the pairs
    are run through once more to find it; where there is none the view is empty."""
    level = level or fragment_level(pairs)
    if level is None:
        return _joined(pairs.limit(0), ["source_doc", "fragment_id"]).withColumnRenamed("fragment_id", "unit_id")
    return _joined(pairs.where(F.col(level).isNotNull()), ["source_doc", level]).withColumnRenamed(level, "unit_id")
