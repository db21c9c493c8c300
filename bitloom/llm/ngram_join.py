"""Jaccard join of documents on their n-gram sets, by prefix filters under several token orders.

If two sets of at least n items have a Jaccard of p %, each holds at least p % of n items of the other, so
the first n - ceil(p n / 100) + 1 items of each, its prefix, share an item: under any order of all tokens that
both go by. Under a first order, prefixes are the keys of an inverted index; a pair that meets there must
also share a prefix token under each of the other orders, and only pairs that pass all of them are held
against each other on the full sets.

The first order is by exact counts: the tokens of all sets go, with their documents' ids, in packed lists to parts
of the tokens' range, where each part's are sorted and counted, and those found more than once come back by
document. Tokens found once come first and are never shared, so most documents have no key at all. Tokens that are
very frequent by the hashed counts stand last and aren't gathered. The other orders go by the power of two of a
hashed count, and shuffle tokens of one class by a hash of their own; these counts are of all documents, in two
rows of counters of fixed size, read as the lesser of the two: never below the true count. An order is one whatever
the counts are, so they bear on the work and not on the result.

Sets that are equal are one node. In a bucket one member after another is a centre that the others are held
against, only while the bucket still spans several components (near_dedup.linked), so groups of near copies
are joined by few pairs and no pair that could join two components is left out. Sizes and parity maps go before
the other orders, so that pairs which can't reach the Jaccard are dropped before their prefixes are compared.
Texts are never shuffled: bitmaps of fixed size tell tasks which documents may be wanted, a join settles it. Full
sets are made of the documents alone that share a key.

Defined results: a null or blank text has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle of them all; rows of equal id count as one document; a null id is in the class of the
documents with an id that have its very shingles, else in none; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import Scratch
from bitloom.llm.near_dedup import ODD, WordHashes, _lists, _sliced, linked, mixed, parity_map, shingle_set

#: Orders in all; the first makes candidates, the others take from them.
ORDERS = 3
#: Counters of a row (two rows), as a power of two: 4 MB in all, whatever the table's size.
COUNTER_BITS = 18
#: Bits of a membership bitmap, as a power of two: 1 MB, whatever the table's size.
MAP_BITS = 23
#: A token with a hashed count of so many, and of 8 times the counters' mean, is frequent, and its occurrences aren't gathered.
LEAST_COMMON = 20_000
#: Tokens that a task sends at once; tokens of a part of all occurrences, which one task sorts.
TOKENS_AT_ONCE, TOKENS_IN_A_PART = 2_000_000, 2_000_000
#: Packed rows: a part, what they hold, and up to three lists of numbers as bytes.
PACKED = ["part", "kind", "a", "b", "c"]
PACKED_SCHEMA = "part int, kind int, a binary, b binary, c binary"
TOKENS, SIZES, REPEATED, COMMON = range(4)


def _slots(items: np.ndarray) -> np.ndarray:
    """Each item's counter in either row."""
    shift = np.uint64(64 - COUNTER_BITS)
    return np.stack([(mixed(items ^ odd) >> shift).astype(np.int64) + (row << COUNTER_BITS) for row, odd in enumerate(ODD)])


def sizes_and_counts(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (set size), digest (of the set) of each document; behind a task's documents its counters as rows (slot, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(2 << COUNTER_BITS, np.int64)
        none = lambda n, kind: pa.nulls(n, kind)
        names = ["doc_id", "n", "digest", "slot", "k"]
        for batch in _sliced(batches):
            sets = [shingle_set(t.as_py(), shingle, hashes) for t in batch.column(1)]
            if sets:
                counts += np.bincount(_slots(np.concatenate(sets)).ravel(), minlength=len(counts))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            own = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, none(len(sets), pa.int32()), none(len(sets), pa.int64())], names)
        used = np.flatnonzero(counts)
        empty = [none(len(used), kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array(counts[used])], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, slot int, k long")


def _counters(facts: DataFrame) -> np.ndarray:
    """The summed counters; at most 2 << COUNTER_BITS rows come to the driver."""
    table = facts.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(2 << COUNTER_BITS, np.int64)
    out[table["slot"].to_numpy()] = table["k"].to_numpy()
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefixes(items: np.ndarray, counts: np.ndarray, percent: int, orders: int) -> list[np.ndarray]:
    """Under each order the first of the items, enough that a set of Jaccard `percent` shares one."""
    if not len(items):
        return [items.view(np.int64)] * orders
    first = prefix_length(len(items), percent)
    return [in_order(items, counts, j)[:first].view(np.int64) for j in range(orders)]


def in_order(items: np.ndarray, counts: np.ndarray, j: int) -> np.ndarray:
    """Sorted items under the j-th order of hashed counts."""
    # The class is the bits of the count; below it, a hash of the order's own. Items come sorted, so equal keys go by the item.
    rank = np.frexp(counts[_slots(items)].min(axis=0).astype(np.float64))[1].astype(np.uint64) << np.uint64(58)
    return items[np.argsort(rank | mixed(items * ODD[1] + np.uint64(2 * j + 1)) >> np.uint64(6), kind="stable")]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64) * ODD[1]) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def membership(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of each of keys(k) set: what isn't in it is no key, what is may be one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(bits), pa.int32())], ["slot"])

    slots = keys.mapInArrow(run, "slot int").distinct().toArrow()["slot"].to_numpy()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little")


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _slot(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sets_and_prefixes(docs: DataFrame, wanted, shingle: int, percent: int, orders: int, counts) -> DataFrame:
    """id, items and the prefixes under the other orders, o1 and so on, of docs(doc_id, text) whose id is in the bitmap `wanted`."""
    names = ["id", "items", *(f"o{j}" for j in range(1, orders))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, bits = WordHashes(), counts.value, wanted.value
        for batch in _sliced(batches):
            ids = batch.column(0)
            asked = _may_hold(bits, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(asked))
            sets = [shingle_set(t.as_py(), shingle, hashes) for t in some.column(1)]
            found = [prefixes(s, known, percent, orders) for s in sets]
            lists = [_lists([s.view(np.int64) for s in sets]), *(_lists([f[j] for f in found]) for j in range(1, orders))]
            yield pa.RecordBatch.from_arrays([some.column(0), *lists], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["id long", *(f"{c} array<long>" for c in names[1:])]))


def _dealt(part: np.ndarray, *columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each column with its values' parts, in the order of the parts."""
    order = np.argsort(part, kind="stable")
    return [(part[order], c[order]) for c in columns]


def _packed(kind: int, *columns: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """One row for each part: the bytes of the columns' values there. A column is the parts, in order, and the values; all have the same parts."""
    used, blobs = np.empty(0, np.int32), []
    for part, values in columns:
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        used, ends = part[starts], (np.r_[starts, len(part)] * values.itemsize).astype(np.int32)
        blobs.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]))
    blobs += [pa.nulls(len(used), pa.binary())] * (3 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), kind, np.int32)), *blobs], PACKED)


def _unpacked(rows: list[pa.RecordBatch], kind: int, *types: type) -> list[np.ndarray]:
    """The columns of all packed rows of a kind."""
    some = [r.filter(pc.equal(r.column(1), kind)) for r in rows]
    read = lambda k, t: [np.frombuffer(x.as_buffer(), t) for r in some for x in r.column(2 + k)]
    return [np.concatenate([np.empty(0, t), *read(k, t)]) for k, t in enumerate(types)]


def _doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64) * ODD[1]) % np.uint64(parts)).astype(np.int32)


def occurrences(docs: DataFrame, shingle: int, percent: int, counts, most: int, parts: int, copies) -> DataFrame:
    """Packed rows of docs(doc_id, text), but for null ids and what the bitmaps `copies` leave out: the tokens that aren't frequent by
    part of all tokens, and by part of all ids the sizes, and of a document short of rare tokens the frequent ones in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, (again, kept) = WordHashes(), counts.value, copies.value
        ids, sizes, rare, tokens, own, common = [], [], [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            all_ = np.array(ids, np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *tokens])
            part = ((flat >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
            (part, flat), (_, of) = _dealt(part, flat, np.repeat(np.arange(len(all_), dtype=np.int32), rare))
            # A document's tokens in a part stand together, so its id is sent once.
            starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (part[1:] != part[:-1])]) if len(of) else np.empty(0, np.int64)
            lengths = np.diff(np.r_[starts, len(of)]).astype(np.int32)
            yield _packed(TOKENS, (part[starts], all_[of[starts]]), (part[starts], lengths), (part, flat))
            yield _packed(SIZES, *_dealt(_doc_part(all_, parts), all_, np.array(sizes, np.int64), np.array(rare, np.int64)))
            firsts = np.concatenate([np.empty(0, np.int64), *common])
            whose = np.concatenate([np.empty(0, np.int64), *own])
            yield _packed(COMMON, *_dealt(_doc_part(whose, parts), whose, firsts))
            for x in (ids, sizes, rare, tokens, own, common):
                x.clear()

        for batch in _sliced(batches):
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            numbers = batch.column(0).fill_null(0).to_numpy()
            for i in np.flatnonzero(named & ~(_may_hold(again, numbers) & ~_may_hold(kept, numbers))):
                items = shingle_set(batch.column(1)[int(i)].as_py(), shingle, hashes)
                if not len(items):
                    continue
                often = known[_slots(items)].min(axis=0) >= most
                few = items[~often]
                ids.append(int(numbers[i]))
                sizes.append(len(items))
                rare.append(len(few))
                tokens.append(few)
                short = prefix_length(len(items), percent) - len(few)
                if short > 0:
                    first = in_order(items[often], known, 0)[:short]
                    common.append(first.view(np.int64))
                    own.append(np.full(len(first), numbers[i], np.int64))
            if sum(rare) >= TOKENS_AT_ONCE:
                yield from flush()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED_SCHEMA)


def repeated(packed: DataFrame, parts: int) -> DataFrame:
    """Of occurrences(), by part of all ids: the tokens found more than once with their exact counts; the other rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ours = pc.equal(batch.column(1), TOKENS)
            rows.append(batch.filter(ours))
            yield batch.filter(pc.invert(ours))
        owners, lengths, tokens = _unpacked(rows, TOKENS, np.int64, np.int32, np.uint64)
        ids = np.repeat(owners, lengths)
        order = np.argsort(tokens)
        tokens, ids = tokens[order], ids[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
        k = np.diff(np.r_[starts, len(tokens)])
        count = np.repeat(k, k).astype(np.int32)
        some = count > 1
        yield _packed(REPEATED, *_dealt(_doc_part(ids[some], parts), ids[some], count[some], tokens[some]))

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, PACKED_SCHEMA)


def exact_prefixes(found: DataFrame, percent: int, parts: int) -> DataFrame:
    """(id, n, bucket) of the tokens in the prefix of each document of repeated(), under the order by exact counts, without those found
    once, which come first and no other document has. A document of several rows has all its repeated tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        ids, sizes, rare = _unpacked(rows, SIZES, np.int64, np.int64, np.int64)
        ids, first, times = np.unique(ids, return_index=True, return_counts=True)
        sizes, rare = sizes[first], rare[first]
        whose, count, tokens = _unpacked(rows, REPEATED, np.int64, np.int32, np.uint64)
        order = np.lexsort((tokens, count, whose))
        at, tokens = np.searchsorted(ids, whose[order]), tokens[order]
        k = np.bincount(at, minlength=len(ids))
        prefix = np.minimum(sizes - (percent * sizes + 99) // 100 + 1, rare)
        take = np.where(times > 1, k, prefix - (rare - k))
        keep = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k) < take[at]
        owner, common = _unpacked(rows, COMMON, np.int64, np.int64)
        at = np.r_[at[keep], np.searchsorted(ids, owner)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sizes[at]), pa.array(np.r_[tokens[keep].view(np.int64), common])], ["id", "n", "bucket"])

    return found.repartitionById(parts, F.col("part")).mapInArrow(run, "id long, n long, bucket long")


def shared_prefixes(docs: DataFrame, members: DataFrame, shingle: int, percent: int, counts) -> DataFrame:
    """(id, n, bucket) of exact_prefixes(), of documents that may be alone in their set or stand for their copies."""
    spark = docs.sparkSession
    known, total = counts.value, members.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(1 << 15, max(-(-total // TOKENS_IN_A_PART), spark.sparkContext.defaultParallelism)))
    most = max(LEAST_COMMON, 8 * int(known.sum()) // len(known))
    # A row that stands for its copies is never left out: those which the copies' bitmap may hold are in a bitmap of their own.
    again = membership(members.where("rep IS NOT NULL AND NOT doc_id <=> rep AND doc_id IS NOT NULL").select("doc_id"))
    bits = spark.sparkContext.broadcast(again)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_hold(bits.value, batch.column(0).to_numpy())))

    kept = membership(members.where("doc_id = rep").select("doc_id").mapInArrow(held, "doc_id long"))
    copies = spark.sparkContext.broadcast((again, kept))
    packed = occurrences(docs, shingle, percent, counts, most, parts, copies)
    return exact_prefixes(repeated(packed, parts), percent, parts)


def sharing_prefixes(pairs: DataFrame, sets: DataFrame, orders: int) -> DataFrame:
    """The pairs (u, v) that share a prefix token under every order but the first, of sets(id, o1, ...)."""
    if orders < 2:
        return pairs
    side = lambda end, tag: sets.select(F.col("id").alias(end), *(F.col(f"o{j}").alias(f"{tag}{j}") for j in range(1, orders)))
    met = reduce(lambda a, b: a & b, (F.arrays_overlap(f"a{j}", f"b{j}") for j in range(1, orders)))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(met).select("u", "v").distinct()


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    scratch, work = Scratch(spark), Scratch(spark)
    plain = docs.select("doc_id", "text")
    facts = work.keep(sizes_and_counts(plain, shingle))
    counts = spark.sparkContext.broadcast(_counters(facts))
    own = facts.where("slot IS NULL")
    copies = work.keep(own.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    members = own.join(copies, "digest", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    members = scratch.keep(members)
    work.forget(facts, copies)
    firsts = members.where("doc_id = rep").select(F.col("doc_id").alias("id")).distinct()
    buckets = work.keep(shared_prefixes(plain, members, shingle, percent, counts).join(firsts, "id", "left_semi"))
    work.forget()

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(membership(ids.select("id")))
        return sets_and_prefixes(plain, wanted, shingle, percent, orders, counts).join(ids, "id", "left_semi")

    root = linked(buckets, sets_of, percent, work, narrow=lambda pairs, sets: sharing_prefixes(pairs, sets, orders))
    root = scratch.keep(root)
    work.drop()
    out = members.join(root.select(F.col("id").alias("rep"), "root"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))
