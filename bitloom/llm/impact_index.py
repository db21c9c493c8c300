"""Ranked search over a bit-sliced index of term impacts.

Documents are indexed in blocks of SPAN, in order of id. Of a term that a block holds, slice b is a bitmap over
the block's documents: bit b of the term's impact in each. Scores of all documents of a block at once are
the sum of the terms' slices, added bit by bit with a carry, as numbers are added by hand; the best k are
found from the most significant slice down: those with the bit go before those without it, for as long as
they are fewer than k, and ties go by id, the bitmap's own order. Nothing is estimated and no document skipped.

A task keeps its best k of each query over its blocks, so that what is shuffled is k rows for a query and task. `search`
searches each block as it is made; `index` gives the blocks as a table to be written, which `found_in` searches.
Queries come in batches of about QUERY_TERMS terms, counted first; a batch's terms and their weights are all that
every task is handed, and the index of a batch has just its terms.

Defined results: a null text has no terms, as has one without letter or digit, and isn't found; rows are documents
each on its own, also of equal ids (null ids go last among equal scores); queries of equal id are one query of
all their terms; a query without a term that any document holds has no row; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a block.
SPAN = 512
#: Rows (query, term) of a batch, about.
QUERY_TERMS = 16_384
#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(w: int, tf: int, n_terms: int, n_docs: int, all_terms: int) -> int:
    """A term's share in a document's score; whole numbers, divisions round down."""
    m = 100 - 50 + 50 * n_terms * n_docs // all_terms
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in set(terms(x.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["query", "term"])

    return queries.select(F.col(f"`{key}`").cast("long").alias("query"), F.col(f"`{text}`").cast("binary")).mapInArrow(run, "query long, term binary").distinct()


def statistics(docs: DataFrame, wanted: set[bytes]) -> tuple[dict[bytes, int], int, int]:
    """Over all documents: how many hold each wanted term, how many hold any term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_terms = Counter(), 0, 0
        for batch in batches:
            for x in batch.column(0):
                found = terms(x.as_py())
                n_docs, n_terms = n_docs + bool(found), n_terms + len(found)
                held.update(wanted.intersection(found))
        # The totals stand behind the terms, under kinds of their own.
        rows = [*((0, t, n) for t, n in held.items()), (1, b"", n_docs), (2, b"", n_terms)]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["kind", "term", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind int, term binary, n long")
    summed = counts.groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()  # a row for each wanted term at most
    total = {r["kind"]: r["n"] for r in summed if r["kind"]}
    return {bytes(r["term"]): r["n"] for r in summed if not r["kind"]}, total.get(1, 0), total.get(2, 0)


def _block(found: list[tuple[int | None, int, dict[bytes, int]]], weights: dict[bytes, int], n_docs: int, all_terms: int) -> tuple:
    """ids, terms, and for each term its slices, least significant first, one after another, of documents (id, length, counts)."""
    found.sort(key=lambda d: (d[0] is None, d[0] or 0))
    at: dict[bytes, int] = {}
    spots = [(at.setdefault(t, len(at)), p, impact(weights[t], tf, n, n_docs, all_terms)) for p, (_, n, counts) in enumerate(found) for t, tf in counts.items()]
    width = -(-len(found) // 8)
    if not spots:
        return [d[0] for d in found], [], []
    term, spot, value = np.array(spots, np.int64).T
    byte, bit = term * width + (spot >> 3), (1 << (spot & 7)).astype(np.float64)
    planes = []
    for b in range(int(value.max()).bit_length()):
        has = (value >> b) & 1 == 1
        planes.append(np.bincount(byte[has], bit[has], minlength=len(at) * width).astype(np.uint8).reshape(len(at), width))
    slices = np.stack(planes, axis=1) if planes else np.zeros((len(at), 0, width), np.uint8)
    return [d[0] for d in found], list(at), [s.tobytes() for s in slices]


Block = tuple[list[int | None], list[bytes], list[bytes]]


def _blocks(batches: Iterator[pa.RecordBatch], weights: dict[bytes, int], n_docs: int, all_terms: int, span: int) -> Iterator[Block]:
    """The blocks of a task's documents (id, text)."""
    waiting: list[tuple[int | None, int, dict[bytes, int]]] = []
    for batch in batches:
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            all_ = terms(x.as_py())
            counts = {t: n for t, n in Counter(all_).items() if t in weights}
            if counts:
                waiting.append((doc, len(all_), counts))
            if len(waiting) == span:
                yield _block(waiting, weights, n_docs, all_terms)
                waiting = []
    if waiting:
        yield _block(waiting, weights, n_docs, all_terms)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def index(docs: DataFrame, held: dict[bytes, int], n_docs: int, all_terms: int, span: int = SPAN) -> DataFrame:
    """The index as a table, a row for each block: ids, terms, slices. held: the documents that hold each term to be indexed."""
    weights = {t: weight(n_docs, df) for t, df in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()))
        for block in _blocks(batches, weights, n_docs, all_terms, span):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block, kinds, strict=True)], ["ids", "terms", "slices"])

    return _plain(docs).mapInArrow(run, "ids array<long>, terms array<binary>, slices array<binary>")


def added(a: list[int], b: list[int]) -> list[int]:
    """The slices of the sums of two numbers a document, from those of either."""
    out, carry = [], 0
    for x, y in zip_longest(a, b, fillvalue=0):
        half = x ^ y
        out.append(half ^ carry)
        carry = x & y | carry & half
    return [*out, carry] if carry else out


def best(slices: list[int], k: int) -> int:
    """The bitmap of the k documents of greatest number above 0 (all, if fewer), of equal ones the first."""
    chosen, tied = 0, 0
    for s in slices:
        tied |= s
    for s in reversed(slices):
        ones = tied & s
        n = (chosen | ones).bit_count()
        if n > k:
            tied = ones
        else:
            chosen, tied = chosen | ones, tied ^ ones
            if n == k:
                return chosen
    for _ in range(min(k - chosen.bit_count(), tied.bit_count())):
        low = tied & -tied
        chosen, tied = chosen | low, tied ^ low
    return chosen


def _ranked(slices: list[int], k: int, ids: list[int | None]) -> list[tuple[int, int | None]]:
    """(score, id) of the best k."""
    left, out = best(slices, k), []
    while left:
        low = left & -left
        p = low.bit_length() - 1
        out.append((sum((s >> p & 1) << b for b, s in enumerate(slices)), ids[p]))
        left ^= low
    return out


FOUND = "query long, doc_id long, score long"


def _best_of(blocks: Iterable[Block], queries: dict[int | None, list[bytes]], k: int) -> pa.RecordBatch:
    """Of each query the best k of all the blocks."""
    top: dict[int | None, list[tuple[int, int | None]]] = {}
    for ids, names, slices in blocks:
        width = -(-len(ids) // 8)
        cut = lambda x: [int.from_bytes(x[i : i + width], "little") for i in range(0, len(x), width)]  # noqa: B023, E731
        held = {t: cut(s) for t, s in zip(names, slices, strict=True)}
        for q, wanted in queries.items():
            total: list[int] = []
            for t in wanted:
                if t in held:
                    total = added(total, held[t])
            if new := _ranked(total, k, ids):
                top[q] = sorted([*top.get(q, ()), *new], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    rows = [(q, doc, score) for q, docs in top.items() for score, doc in docs]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query", "doc_id", "score"])


def found_in(blocks: DataFrame, queries: dict[int | None, list[bytes]], k: int) -> DataFrame:
    """(query, doc_id, score): of each query the best k of a task's share of an index, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c.as_py() for c in row) for batch in batches for row in zip(*batch.columns, strict=True))
        yield _best_of(rows, queries, k)

    return blocks.mapInArrow(run, FOUND)


def found_at_once(docs: DataFrame, held: dict[bytes, int], n_docs: int, all_terms: int, queries: dict[int | None, list[bytes]], k: int, span: int = SPAN) -> DataFrame:
    """The same, where a task searches each block as it indexes it, and none is kept."""
    weights = {t: weight(n_docs, df) for t, df in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _best_of(_blocks(batches, weights, n_docs, all_terms, span), queries, k)

    return _plain(docs).mapInArrow(run, FOUND)


def search(docs: DataFrame, queries: DataFrame, key: str, text: str = "text", k: int = 50, batch: int = QUERY_TERMS, span: int = SPAN) -> DataFrame:
    """Of each query its best k documents: `key`, rank (int, from 1), doc_id, score."""
    asked = query_terms(queries, key, text)
    batches = max(1, -(-asked.count() // batch))
    parts = []
    for i in range(batches):
        own: dict[int | None, list[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == i).collect():  # about `batch` rows
            own.setdefault(r["query"], []).append(bytes(r["term"]))
        held, n_docs, all_terms = statistics(docs, {t for ts in own.values() for t in ts})
        parts.append(found_at_once(docs, held, n_docs, all_terms, {q: sorted(ts) for q, ts in own.items()}, k, span))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(key), "rank", "doc_id", "score")
