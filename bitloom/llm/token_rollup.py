"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A feed has events: insert (a document with its count), delete (takes it back) and revise (an old and
a new count). A batch of them is summed to one signed row per key, written under its batch id, and
committed by a record that names it; totals are sums over committed batches. A batch id commits
once: replays find the record and change nothing, and a batch that died before its record is
written again from scratch. Old batches may be compacted into one.

Everything lies under one path that driver and executors share, and is written by Spark.

A record is written aside and renamed to its place, where a rename never replaces a file: so it appears
whole or not at all, and of two writers of one batch id one commits. That holds where renaming is one
step, as in HDFS; an object store needs a conditional put in its place.

Defined results: null source, language or version is a key of its own; a null count is 0; events of
unknown kind fail the batch; an empty batch commits; keys whose documents all went keep a row of
zeros; repeated events in a batch count each time (an exactly-once feed is the caller's); a null text has no
tokens and is no copy of another; texts of equal SHA-256 are copies; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import Scratch, mapped, place

#: The tokenizer version that has a token for each byte.
BYTES = "utf8_bytes"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Read on the driver; workers get the ranks with the task."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs with n_tokens, the byte-pair tokens of the whole text (null: 0); a column by that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # about a megabyte
    at = place(docs, "text", ("n_tokens",))

    def start():
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        return lambda batch: [pa.array([len(coder.encode_ordinary(t.as_py() or "")) for t in batch.column(at)], pa.int64())]

    return mapped(docs, {"n_tokens": T.LongType()}, start)


def deltas(events: DataFrame) -> DataFrame:
    """One signed row per key of events(kind, source, lang, version, n_tokens, old_tokens)."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -old).otherwise(new - old)
    return events.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens.cast("long")).alias("n_tokens"))


@dataclass
class Rollup:
    spark: SparkSession
    path: str

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _record(self, batch: str) -> str:
        return f"{self.path}/commits/{batch}.json"

    def committed(self, batch: str) -> bool:
        return self._exists(self._record(batch))

    def _commit(self, batch: str, replaces: list[str], part: str) -> bool:
        """The batch's record: which part holds its deltas, and which batches it replaces."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs
        record, aside = hadoop.Path(self._record(batch)), hadoop.Path(f"{self.path}/pending/{uuid.uuid4().hex}.json")
        fs = record.getFileSystem(conf)
        fs.mkdirs(record.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"batch": batch, "part": part, "replaces": replaces}).encode()))
        out.close()
        record, aside = fs.makeQualified(record), fs.makeQualified(aside)
        try:
            never = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(record.toUri(), conf).rename(aside, record, never)
        except Py4JJavaError:
            if self.committed(batch):
                return False
            raise
        return True

    def _written(self, rows: DataFrame) -> str:
        """A part of its own for each attempt, so that attempts never mix."""
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/deltas/{part}")
        return part

    def apply(self, batch: str, events: DataFrame) -> bool:
        """Commits the batch; False if it is committed already."""
        return not self.committed(batch) and self._commit(batch, [], self._written(deltas(events)))

    def _live(self) -> dict[str, str]:
        """Batch to part, of committed batches that no compacted one replaces."""
        if not self._exists(f"{self.path}/commits"):
            return {}
        rows = self.spark.read.schema("batch string, part string, replaces array<string>").json(f"{self.path}/commits").collect()  # one row a batch
        gone = {b for r in rows for b in r["replaces"]}
        return {r["batch"]: r["part"] for r in rows if r["batch"] not in gone}

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], DELTA)
        all_ = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/deltas/{part}" for part in sorted(live.values())))
        return all_.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, name: str) -> None:
        """One batch in place of all live ones."""
        live = self._live()
        if live and not self.committed(name):
            self._commit(name, sorted(live), self._written(self.totals()))


def replayed_corpus(docs: DataFrame, path: str, vocabulary: dict[bytes, int], version: str) -> DataFrame:
    """Totals of the documents, by two tokenizer versions (the vocabulary's, and one token a byte of UTF-8), after
    three batches: all are inserted; those of several lines are revised to the count of the text put on
    one line; copies of a text are deleted but for the smallest id. The second batch comes twice."""
    spark, work = docs.sparkSession, Scratch(docs.sparkSession)
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    plain = docs.select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("copy"), "text", (F.instr("text", "\n") > 0).alias("several"))
    counted = count_tokens(plain, vocabulary).withColumn("text", line).withColumnRenamed("n_tokens", "old_tokens")
    # The two characters that change places are of one byte each.
    counted = count_tokens(counted, vocabulary).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text")
    counted = work.keep(counted)
    ways = F.array(F.struct(F.lit(version).alias("version"), "n_tokens", "old_tokens"), F.struct(F.lit(BYTES).alias("version"), F.col("n_bytes").alias("n_tokens"), F.col("n_bytes").alias("old_tokens")))
    rollup = Rollup(spark, path)
    none = F.lit(None).cast("long")

    def event(df: DataFrame, kind: str, new: Column, old: Column) -> DataFrame:
        each = df.select("source", "lang", "several", F.explode(ways).alias("w")).select("source", "lang", "several", "w.*")
        return each.select(F.lit(kind).alias("kind"), *KEYS, new.alias("n_tokens"), old.alias("old_tokens"))

    rollup.apply("insert", event(counted, "insert", F.col("old_tokens"), none))
    revised = event(counted.where("several"), "revise", F.col("n_tokens"), F.col("old_tokens"))
    for _ in range(2):
        rollup.apply("revise", revised)
    copies = counted.where("copy IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = counted.join(work.keep(copies), "copy").where(F.col("doc_id") > F.col("first"))
    now = F.when(F.col("several"), F.col("n_tokens")).otherwise(F.col("old_tokens"))
    rollup.apply("delete", event(gone, "delete", none, now))
    work.drop()
    return rollup.totals()
