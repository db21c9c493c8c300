"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions.columns import apart, let, quoted, spread, together  # noqa: F401
from bitloom.functions.scratch import Scratch, dropped_after, shared_folder  # noqa: F401

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null or blank text has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def mapped(docs: DataFrame, made: dict[str, T.DataType], start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """docs with the columns `made`, which take the place of columns by those names; all others stay, whatever their names.

    start() is called once a task and gives what turns a batch, its columns in docs' order without those replaced, into the arrays
    of the new columns."""
    rest = [c for c in docs.columns if c not in made]
    plain = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(rest)))
    new = [f"m{i}" for i in range(len(made))]
    schema = T.StructType([*plain.schema.fields, *(T.StructField(n, kind) for n, kind in zip(new, made.values(), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *each(batch)], schema.names)

    out = plain.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), *(F.col(m).alias(n) for m, n in zip(new, made, strict=True)))


def place(docs: DataFrame, of: str, made: tuple[str, ...]) -> int:
    """Where `of` stands among the columns that `mapped` leaves."""
    return [c for c in docs.columns if c not in made].index(of)
