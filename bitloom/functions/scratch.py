"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors both reach, under spark.checkpoint.dir.

    Only where driver and executors are one process, as in tests, a local folder stands in for an unset one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/bitloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Scratch:
    """Tables written once and read again, so that lineage is cut and work isn't repeated.

    They lie in the shared folder, hence outlive any executor. What a result still reads can't be dropped
    by the operator that returns it: `dropped_after` does so once the caller has written the result.
    """

    #: The lists of the `dropped_after` blocks that this thread is in: blocks of other threads drop nothing of its own.
    _open: ContextVar[tuple[list[Scratch], ...]] = ContextVar("open", default=())

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_folder(spark), 0
        self._tables: dict[int, DataFrame] = {}
        for made in Scratch._open.get():
            made.append(self)

    def folder(self, name: str) -> str:
        """A path of the caller's own beside the tables, dropped with them."""
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        out = self._tables[self.n - 1] = self.spark.read.schema(df.schema).parquet(path)
        return out

    def forget(self, *tables: DataFrame) -> None:
        """Drops tables that nothing reads any more, and lets Spark free the shuffle files of the jobs before: it does so for plans
        that the driver's JVM has collected, which may be long after a round of an iteration, and the disks are full by then."""
        for n in [n for n, t in self._tables.items() if any(t is x for x in tables)]:
            del self._tables[n]
            self.drop(n)
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, n: int | None = None) -> None:
        """The n-th table, or all."""
        if n is None:
            self._tables.clear()
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base if n is None else f"{self.base}/{n}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropped_after() -> Iterator[None]:
    """Drops, at its end, the work tables of all operators called inside by this thread; their results must be written by then."""
    made: list[Scratch] = []
    token = Scratch._open.set((*Scratch._open.get(), made))
    try:
        yield
    finally:
        Scratch._open.reset(token)
        for scratch in made:
            scratch.drop()
