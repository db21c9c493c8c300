"""Columns that are worked out once, and tables that all cores share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table, as its files have them, up to which it is dealt out anew.
SMALL = 64 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once even if body names it often."""
    return F.transform(F.array(value), body)[0]


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each evaluated once per row: later filters and projections read their values, and
    aren't pushed below with the expressions in their place."""
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("settled")
    return df.select(*(f"`{c}`" for c in df.columns if c not in columns), row).select(*(f"`{c}`" for c in df.columns if c not in columns), "settled.*")


def quoted(name: str) -> Column:
    """The column of that name, whatever is in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def apart(df: DataFrame, *own: str) -> DataFrame:
    """df with columns other than `own` named c0, c1 and so on by place, so that no name clashes with an operator's, and none needs quotes."""
    return df.select(*(quoted(c).alias(c if c in own else f"c{i}") for i, c in enumerate(df.columns)))


def together(df: DataFrame, like: DataFrame, *own: str) -> DataFrame:
    """The columns of `like` out of a table made from apart(like, *own), with their names."""
    return df.select(*(F.col(c if c in own else f"c{i}").alias(c) for i, c in enumerate(like.columns)))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is small: a file of one row group would be read and worked on by one task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL else df


def dealt(df: DataFrame) -> DataFrame:
    """df in pieces of about SMALL bytes, at least two for each core, for work that takes long per row: small shuffles are joined to few partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, min(size // SMALL, 100 * cores)))
