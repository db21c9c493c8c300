"""Training runs that can be taken up again: a ledger of epochs, checkpoints, and the best model kept.

An epoch's model is written as a table in a folder of its own, then its record is put in place by a rename that never replaces
one: of several runs of one name only one commits an epoch, and an epoch with a record has its whole table. A run begins
behind the last record. When an epoch is committed, the checkpoints of all but the last and the best are deleted. Checkpoints are
exact, so a run that was stopped gives what one in a piece gives; the best model is saved in half precision at the end.

The rename is one step in a file system; in an object store without one, keep runs of a name apart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from bitloom.functions.columns import dealt
from bitloom.functions.scratch import Scratch
from bitloom.operators.lexical import SIZE, Model, encoded, epochs, likelihood_of

#: An epoch must better the best by so much of it to count as better.
LEAST_GAIN = 0.0


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """A small file, whole or not at all; False if it is there already."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place, fs = _fs(spark, path)
    aside = hadoop.Path(f"{path}.{uuid.uuid4().hex}.pending")
    fs.mkdirs(place.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(data))
    out.close()
    place, aside = fs.makeQualified(place), fs.makeQualified(aside)
    try:
        never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        hadoop.FileContext.getFileContext(place.toUri(), conf).rename(aside, place, never)
    except Py4JJavaError:
        fs.delete(aside, False)
        if fs.exists(place):
            return False
        raise
    return True


def save(spark: SparkSession, model: Model, path: str, kind: type = np.float64) -> None:
    """A model as a table: its words, and the rows of its tables in numbers of `kind`."""
    rows = [("src", i, w, None) for i, w in enumerate(model.src)] + [("tgt", i, w, None) for i, w in enumerate(model.tgt)]
    rows += [(name, i, None, np.asarray(v, kind).tobytes()) for name in ("table", "after") for i, v in enumerate(getattr(model, name))]
    rows.append(("facts", 0, json.dumps({"ratio": model.ratio, "loglik": model.loglik, "kind": np.dtype(kind).name}), None))
    columns = zip(*rows, strict=True)
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "i", "word", "v"), columns, (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows: dict[str, list] = {}
    for r in spark.read.parquet(path).collect():  # as many rows as the vocabularies have words, twice
        rows.setdefault(r["part"], []).append((r["i"], r["word"], r["v"]))
    facts = json.loads(rows["facts"][0][1])
    words = lambda part: [w for _, w, _ in sorted(rows.get(part, []))]
    numbers = lambda part: np.stack([np.frombuffer(v, facts["kind"]) for _, _, v in sorted(rows[part], key=lambda x: x[0])])
    return Model(words("src"), words("tgt"), numbers("table"), numbers("after"), facts["ratio"], facts["loglik"])


@dataclass(frozen=True)
class Run:
    """A run of one system and direction under a folder that driver and executors share."""

    spark: SparkSession
    path: str
    system: str
    direction: str

    @property
    def base(self) -> str:
        return f"{self.path}/{self.system}/{self.direction}"

    def ledger(self) -> list[dict]:
        """The records of the committed epochs, in order."""
        folder, fs = _fs(self.spark, f"{self.base}/ledger")
        if not fs.exists(folder):
            return []
        # One small file for each epoch; those set aside end otherwise.
        rows = self.spark.read.schema("epoch int, part string, loglik double, dev double").option("pathGlobFilter", "*.json").json(f"{self.base}/ledger").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["epoch"])

    def checkpoint(self, record: dict) -> str:
        return f"{self.base}/checkpoints/{record['part']}"

    def best(self) -> dict | None:
        """The record of the epoch that made the held-out pairs likeliest; of equal ones the first."""
        out = None
        for r in self.ledger():
            if out is None or r["dev"] > out["dev"] + LEAST_GAIN * abs(out["dev"]):
                out = r
        return out

    def _prune(self) -> None:
        records = self.ledger()
        kept = {records[-1]["part"], self.best()["part"]} if records else set()
        folder, fs = _fs(self.spark, f"{self.base}/checkpoints")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)

    def train(self, train: DataFrame, dev: DataFrame, n: int, size: int = SIZE, after: Callable[[dict], None] | None = None) -> Model | None:
        """The best model of n epochs, of which those in the ledger aren't run again; None without a pair. after: called with each new record."""
        scratch, done = Scratch(self.spark), self.ledger()
        last = load(self.spark, self.checkpoint(done[-1])) if done else None
        left = n - len(done)
        if left > 0:
            train, ids = scratch.keep(train.select("src", "tgt")), None
            for model, epoch in zip(epochs(train, size, scratch, last), range(len(done) + 1, n + 1), strict=False):
                part = uuid.uuid4().hex
                save(self.spark, model, f"{self.base}/checkpoints/{part}")
                if ids is None:  # all epochs have the same words
                    ids = scratch.keep(encoded(dealt(dev.select("src", "tgt")), model.src, model.tgt))
                loglik, pairs = likelihood_of(ids, model)
                record = {"epoch": epoch, "part": part, "loglik": model.loglik[-1], "dev": loglik / pairs if pairs else 0.0}
                if not write_once(self.spark, f"{self.base}/ledger/{epoch:06d}.json", json.dumps(record).encode()):
                    raise RuntimeError(f"another run of {self.system} {self.direction} has committed epoch {epoch}")
                self._prune()
                if after:
                    after(record)
        best = self.best()
        if best is None:
            return None
        model = load(self.spark, self.checkpoint(best))
        save(self.spark, model, f"{self.base}/best", np.float16)
        return model

    def saved(self) -> Model:
        """The best model as it was saved, in half precision."""
        return load(self.spark, f"{self.base}/best")
