"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Two permutations give the whole signature: the first scatters a shingle over WIDTH positions, the
second, shifted circularly by k, ranks positions for coordinate k. Bands of coordinates propose
documents; every link is confirmed on the full shingle sets.

Sets that are equal are one node, so copies never meet in pairs. In a band bucket one member after
another is a centre that the others are held against, only while the bucket still spans several
components, and only across components; sizes and parity maps of the sets rule most pairs out before
they are made. So groups of near copies are joined by few pairs, and yet no pair that a bucket
proposes and that could join two components is left out.

Defined results: a null or blank text has an empty set, is linked with nothing and kept; a text of
fewer words than a shingle is one shingle of them all; rows of equal id count as one document;
a null id is in the class of the documents with an id that have its very shingles, and is never a class
id there; without such a document it is linked with nothing and kept, also beside near copies;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import Scratch
from bitloom.llm.components import FEW, components

WIDTH_BITS = 20
BANDS, ROWS = 32, 6
#: Words of 64 bits in a set's parity map.
MAP = 16
#: Distinct words whose hashes a worker remembers.
MEMORY = 120_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles (A-Z lower-cased, split at ASCII space)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(n, len(found))
    acc = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        acc = mixed(acc * ODD[0] + h[k : k + len(acc)] * ODD[1])
    return np.unique(acc)


@lru_cache(maxsize=2)
def _ranks(coords: int) -> np.ndarray:
    """Row p holds the second permutation's ranks of p under shifts 0 to coords - 1 (a view)."""
    width = 1 << WIDTH_BITS
    rank = np.random.Generator(np.random.PCG64(20240229)).permutation(width).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[:coords]]), coords)


def signature(shingles: np.ndarray, coords: int, chunk: int = 2048) -> np.ndarray:
    """The least shifted rank of any shingle, for each coordinate."""
    at = (mixed(shingles * ODD[1]) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)
    table = _ranks(coords)
    out = np.full(coords, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), chunk):
        np.minimum(out, table[at[i : i + chunk]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=np.uint64) * ODD[0]
    for column in sig.reshape(bands, rows).T:
        acc = mixed(acc ^ column.astype(np.uint64))
    return acc.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at once, so that a worker holds the sets of few texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), digest (of the set), bands (bucket keys; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _sliced(batches):
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), shingle, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(keys)], ["doc_id", "n", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id and items, the shingle hashes, of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _sliced(batches):
            sets = [shingle_set(t.as_py(), shingle, hashes).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, items array<long>")


def parity_map(items: np.ndarray) -> np.ndarray:
    at = mixed(items.view(np.uint64) * ODD[0]) >> np.uint64(64 - 6 - (MAP.bit_length() - 1))
    odd = np.bincount(at.astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_maps(sets: DataFrame) -> DataFrame:
    """(id, map): each item flips one of 64 * MAP bits, so two maps differ in at most as many bits as their sets in items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [parity_map(np.asarray(items.values)) for items in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(maps)], ["id", "map"])

    return sets.select("id", "items").mapInArrow(run, "id long, map array<long>")


def native_maps(sets: DataFrame) -> DataFrame:
    """The like of `parity_maps`, by DataFrame functions alone: a set's items are summed by word where they are read."""
    h = F.xxhash64("item")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 4).bitwiseAND(F.lit(63)).cast("int"))
    bits = sets.select("id", F.explode("items").alias("item")).select("id", h.bitwiseAND(F.lit(MAP - 1)).alias("word"), bit.alias("bit"))
    odd = (F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("long")) for i in range(MAP))
    return bits.groupBy("id").agg(F.array(*odd).alias("map"))


def _may_link(a: str, b: str, percent: int) -> Column:
    """By sizes and maps: the sets of two rows, in columns named after them, can't be ruled out. Jaccard >= p%
    means that at most (100 - p) / (100 + p) of the summed sizes differ."""
    n, m = (lambda x: F.col(f"{x}_n")), (lambda x, i: F.get(F.col(f"{x}_map"), F.lit(i)))
    sizes = F.least(n(a), n(b)) * 100 >= F.greatest(n(a), n(b)) * percent
    bits = sum((F.bit_count(m(a, i).bitwiseXOR(m(b, i))) for i in range(MAP)), F.lit(0))
    return sizes & (bits * (100 + percent) <= (n(a) + n(b)) * (100 - percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("u"), F.col("items").alias("x"))
    b = sets.select(F.col("id").alias("v"), F.col("items").alias("y"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * percent).select("u", "v")


def linked(
    buckets: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    scratch: Scratch,
    native: bool = False,
    narrow: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    maps: DataFrame | None = None,
    growth: int = 8,
) -> DataFrame:
    """(id, root) of the ids that a confirmed link joins to another.

    buckets: (id, n, bucket), n the set's size; sets_of: ids to (id, items) and what else narrow reads; native: by
    DataFrame functions alone; narrow: takes from the pairs (u, v), given the sets, those that
    a filter of the caller's own rules out; maps: (id, map), where they are known without the sets, which are then
    asked for pair by pair, in each round, and not for all that share a bucket; growth: how many times more centres each round has.
    """
    few, names = 0 if native else FEW, ("id", "n", "root", "map")
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    shared = scratch.keep(shared)
    near = scratch.keep(buckets.join(shared, "bucket").distinct())
    sets = None
    if maps is None:
        sets = scratch.keep(sets_of(near.select("id").distinct()))
        maps = scratch.keep(native_maps(sets) if native else parity_maps(sets))
    live = scratch.keep(near.join(maps, "id").withColumn("root", F.col("id")))
    scratch.forget(shared, near, maps)
    root = None
    centres = 1
    while True:
        # One centre for each of `centres` shares of a bucket's members, the smallest id.
        share = F.pmod(F.xxhash64("id", "bucket"), F.lit(centres))
        least = live.groupBy("bucket", share.alias("share")).agg(F.min(F.struct(*names)).alias("c"))
        chosen = scratch.keep(least.select("bucket", *(F.col(f"c.{x}").alias(f"c_{x}") for x in names)))
        held = live.select("bucket", *(F.col(x).alias(f"o_{x}") for x in names)).join(chosen, "bucket")
        held = held.where((F.col("c_root") != F.col("o_root")) & _may_link("c", "o", percent))
        pairs = held.select(F.least("o_id", "c_id").alias("u"), F.greatest("o_id", "c_id").alias("v")).distinct()
        own, asked = sets, pairs
        if sets is None:
            found = asked = scratch.keep(pairs)
        if sets is not None or not asked.isEmpty():
            own = sets if sets is not None else scratch.keep(sets_of(asked.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
            found = scratch.keep(_verified(narrow(asked, own) if narrow else asked, own, percent))
        if root is None:
            root = scratch.keep(components(found, scratch, few))
        else:
            # Links between components join their roots.
            ends = found.join(root.select(F.col("id").alias("u"), F.col("root").alias("ru")), "u", "left").join(root.select(F.col("id").alias("v"), F.col("root").alias("rv")), "v", "left")
            over = components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")), scratch, few)
            over = scratch.keep(over.select(F.col("id").alias("root"), F.col("root").alias("top")))
            moved = root.join(over, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            added = over.select(F.col("root").alias("id"), F.col("top").alias("root")).join(root.select("id"), "id", "left_anti")
            root = scratch.keep(moved.union(added))
        # A centre has met all that its bucket can offer; a bucket of one component has nothing more to join.
        left = live.drop("root").join(chosen.select("bucket", F.col("c_id").alias("id")), ["bucket", "id"], "left_anti")
        left = scratch.keep(left.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")))
        open_ = scratch.keep(left.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket"))
        before, live = live, scratch.keep(left.join(open_, "bucket").select("bucket", "id", "n", "map", "root"))
        scratch.forget(before, chosen, left, open_, found, *([asked, own] if sets is None else []))
        if live.isEmpty():
            return root
        centres *= growth


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept (doc_id is it)."""
    scratch, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    sig = work.keep(signatures(docs, shingle, bands, rows))
    copies = work.keep(sig.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    rep = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id"))
    members = sig.join(copies, "digest", "left").withColumn("rep", rep)
    members = scratch.keep(members.select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    buckets = members.where("bands IS NOT NULL").select(F.col("rep").alias("id"), "n", F.explode("bands").alias("bucket"))
    plain = docs.select("doc_id", "text")
    root = scratch.keep(linked(buckets, lambda ids: full_sets(plain.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), shingle), percent, work))
    work.drop()
    out = members.select("doc_id", "n", "rep").join(root.select(F.col("id").alias("rep"), "root"), "rep", "left")
    top = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), top.alias("component_id"), F.col("doc_id").eqNullSafe(top).alias("kept"))


def join_classes(sets: DataFrame, propose: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """doc_id, n (its items) and class_id for sets(doc_id, items) under buckets(id, n, bucket) that
    propose(reps) gives, by DataFrame functions alone."""
    scratch, work = Scratch(sets.sparkSession), Scratch(sets.sparkSession)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    own = work.keep(sets.select("doc_id", "items", F.size("items").alias("n"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")))
    first = work.keep(own.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    members = scratch.keep(own.join(first, "digest", "left").select("doc_id", "n", "rep", "row"))
    # Rows are chosen without their sets, which go through one shuffle; of several rows of an id one is.
    chosen = members.where(F.col("doc_id") == F.col("rep")).groupBy("doc_id").agg(F.min("row").alias("row"))
    reps = work.keep(own.join(chosen.select("row"), "row", "left_semi").select(F.col("doc_id").alias("id"), "items"))
    root = scratch.keep(linked(work.keep(propose(reps)), lambda ids: reps.join(ids, "id", "left_semi"), percent, work, native=True, growth=32))
    work.drop()
    out = members.join(root.select(F.col("id").alias("rep"), "root"), "rep", "left")
    return out.select("doc_id", "n", F.coalesce("root", "rep", "doc_id").alias("class_id"))
