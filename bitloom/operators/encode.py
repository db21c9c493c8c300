"""Token ids of sentence pairs for a trainer, and batches of examples of about one length.

Ids come from a public vocabulary (a path), behind them one place for each language's tag. An example is the text's
ids between its language's tag and the end, cut to `limit` ids in all, with a mask over the source and the target's
ids as labels. Batches are filled to a budget of places: lengths are cut into buckets at quantiles of all lengths, a
batch takes examples of one bucket, and every list of a batch is padded to the same multiple of EIGHT.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions.columns import apart
from bitloom.operators.splits import hash_rank

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 128
#: Lists are padded to a multiple of it.
EIGHT = 8
#: A label that a loss leaves out.
IGNORED = -100
BUCKETS, BUDGET = 16, 4096
#: Examples whose texts are encoded at once.
ROWS = 2000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def tag_ids(languages: tuple[str, ...], vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Each language's tag: the places behind the vocabulary, in the order given."""
    first = _tokenizer(vocabulary).get_vocab_size()
    return {name: first + i for i, name in enumerate(languages)}


def encode_pairs(rows: DataFrame, languages: tuple[str, ...], vocabulary: str = VOCABULARY, end: str = "<|endoftext|>", limit: int = LIMIT) -> DataFrame:
    """rows(direction, src, ref, ...) with input_ids, attention_mask and labels, arrays of int.

    direction is the two languages with a hyphen between; a null text has its tag and the end alone; other
    columns stay, whatever their names, but for those of the three results; the vocabulary's file must be on every worker."""
    own, made = ("direction", "src", "ref"), ("input_ids", "attention_mask", "labels")
    rows = rows.drop(*made)
    plain = apart(rows, *own)
    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in made]
    at = {c: i for i, c in enumerate(plain.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tags = _tokenizer(vocabulary), tag_ids(languages, vocabulary)
        stop = tokenizer.token_to_id(end)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ways = [d.split("-") for d in batch.column(at["direction"]).to_pylist()]
            texts = [[x or "" for x in batch.column(at[c]).to_pylist()] for c in ("src", "ref")]
            # Either direction has the other's texts: each is encoded once.
            own = list(dict.fromkeys([*texts[0], *texts[1]]))
            found = tokenizer.encode_batch(own, add_special_tokens=False)
            known = {t: np.array(f.ids[: limit - 2], np.int32) for t, f in zip(own, found, strict=True)}

            def ids(side: int) -> pa.Array:
                parts = [known[t] for t in texts[side]]  # noqa: B023
                ends = np.cumsum([len(p) + 2 for p in parts])
                flat = np.empty(ends[-1], np.int32)
                starts = np.r_[0, ends[:-1]]
                inner = np.ones(len(flat), bool)
                inner[starts] = inner[ends - 1] = False
                flat[inner] = np.concatenate(parts)
                flat[starts], flat[ends - 1] = [tags[w[side]] for w in ways], stop  # noqa: B023
                return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat))

            src, ref = ids(0), ids(1)
            mask = pa.ListArray.from_arrays(src.offsets, pa.array(np.ones(len(src.values), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, src, mask, ref], [*at, *made])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *fields]))
    names = [F.col(c if c in own else f"c{i}").alias(c) for i, c in enumerate(rows.columns)]
    return out.select(*names, *made)


def up_to_eight(n):
    return F.ceil(n / EIGHT) * EIGHT


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(length, bucket, places) of lengths(length): cut where a share of 1 / buckets of all examples is full; places is the
    padded length of a bucket's longest. At most as many rows as there are lengths."""
    counts = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # Lengths are bounded by the limit, so this is a small table and one window may see all of it.
    up_to = F.sum("n").over(Window.orderBy("length"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    cut = counts.select("length", F.floor((up_to - F.col("n")) * buckets / whole).cast("int").alias("bucket"))
    return cut.withColumn("places", up_to_eight(F.max("length").over(Window.partitionBy("bucket"))).cast("long"))


def batches(examples: DataFrame, key: str, length: str, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 42) -> DataFrame:
    """examples with bucket, places (the padded length), batch (its number within the bucket, from 0): a batch has
    budget / places examples, at least one, in the order of a hash of the key; an example is in one batch."""
    known = examples.withColumn("__length", F.greatest(F.col(length), F.lit(1)).cast("long"))
    cut = length_buckets(known.select(F.col("__length").alias("length")), buckets).withColumnRenamed("length", "__length")
    ranked = hash_rank(known.join(cut, "__length"), key, ["bucket"], seed)
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("places")).cast("long"))
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long")).drop("__length", "rank", "n")


def padded(batched: DataFrame, ids: str = "input_ids", mask: str = "attention_mask", labels: str = "labels", pad: int = 0) -> DataFrame:
    """The arrays of batched examples filled up: ids and mask to the bucket's places, labels to those of the batch's longest."""
    most = up_to_eight(F.max(F.size(labels)).over(Window.partitionBy("bucket", "batch"))).cast("int")
    fill = lambda c, value, n: F.concat(F.col(c), F.array_repeat(F.lit(value), n - F.size(c)))
    wide = F.col("places").cast("int")
    longer = batched.withColumn("__most", most)
    return longer.withColumns({ids: fill(ids, pad, wide), mask: fill(mask, 0, wide), labels: fill(labels, IGNORED, F.col("__most"))}).drop("__most")


def padding_share(batched: DataFrame, length: str) -> DataFrame:
    """One row for each bucket: examples, batches, places taken, and the share of them that is padding."""
    sums = batched.groupBy("bucket").agg(F.count(F.lit(1)).alias("examples"), (F.max("batch") + 1).alias("batches"), F.sum("places").alias("places"), F.sum(F.greatest(F.col(length), F.lit(1))).alias("used"))
    return sums.select("bucket", "examples", "batches", "places", F.round(1 - F.col("used") / F.col("places"), 6).alias("padding"))
