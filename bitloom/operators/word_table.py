"""The whole word-translation table: every token of every sentence pair, every word of either side.

The passes are those of operators/lexical.py, without its bounds. A table of all words by all words fits no task, but for one
target word all that a pass needs are the sentence pairs that hold it and one number for each source word: the sum of its
counts in each pass before. So sentence pairs go to parts of target words, a part works its words out some at a time, and
the sums of the parts, a number a word, go to all tasks of the next pass. A part's counts of earlier passes are worked out
again rather than written, as there are far more word pairs than words.

Words are numbered by frequency. A task looks numbers up by digest, 12 bytes a word; were two words to share a digest,
another salt is taken.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.columns import dealt
from bitloom.functions.scratch import Scratch
from bitloom.operators.lexical import _distinct, tokens

#: Word pairs of sentence pairs that a part has, about.
PART = 12_000_000
#: A target word that has more is a part of its own, read some at a time.
HEAVY = 3_000_000
#: Word pairs of sentence pairs that are worked out at once, the last target word's beyond it.
AT_ONCE = 1_000_000
#: A source word's sum is taken to keep this share of it from one pass to the next; words that don't are looked at once more.
KEPT = 0.5
CODEC = "zstd"
ARRAYS = ("s", "sn", "ls", "t", "tn", "lt")
BLOBS = ", ".join(f"{a} binary" for a in ARRAYS)
COUNTS = "e int, f int, v double"
#: In place of a target word: the row has a source word's sum over all those of a part.
SUM = -1


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 31, byte by byte, as most of their upper bytes are zeros."""
    raw = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, CODEC, asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _spots(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of some stretches, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - _starts(lengths), lengths)


def _digests(words: list[str], salt: int) -> np.ndarray:
    own = salt.to_bytes(8, "little")
    return np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8, salt=own).digest() for w in words), "<i8")


def _flat(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the place there of each token, and the number of tokens of each text."""
    each = [tokens(t) for t in texts]
    words = pa.array(chain.from_iterable(each), pa.string()).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), np.array([len(x) for x in each], np.int64)


def _words(pairs: DataFrame, salt: int) -> DataFrame:
    """(side, digest, word, n, weight): how often a word comes, and with how many tokens of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_flat(batch.column(i).to_pylist()) for i in (0, 1)]
            for side, (words, at, lengths) in enumerate(both):
                n, weight = np.bincount(at, minlength=len(words)), np.bincount(at, np.repeat(both[1 - side][2] + 1, lengths), minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), side, np.int32)), pa.array(_digests(words, salt)), pa.array(words, pa.string()), pa.array(n.astype(np.int64)), pa.array(weight.astype(np.int64))],
                    ["side", "digest", "word", "n", "weight"],
                )

    rows = pairs.mapInArrow(run, "side int, digest long, word string, n long, weight long")
    return rows.groupBy("side", "digest", "word").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def _numbered(words: DataFrame, side: int, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of a side in order, the number from 1 of each by what it counts most of, and the counts by number."""
    table = words.where(F.col("side") == side).select("digest", by).toArrow()  # 16 bytes a word
    digest, n = (table.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((digest, -n))
    number = np.empty(len(n), np.int32)
    number[order] = np.arange(1, len(n) + 1)
    sort = np.argsort(digest)
    return digest[sort], number[sort], n[order]


def _blobs(pairs: DataFrame, sides: list[tuple[np.ndarray, np.ndarray]], salt: int) -> DataFrame:
    """Some sentence pairs a row: the distinct words of each, 0 (no word) before the source's, how often, and how many they are;
    a pair without a token on a side goes."""
    shared = pairs.sparkSession.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for i, (digests, numbers) in enumerate(shared.value):
                words, at, lengths = _flat(batch.column(i).to_pylist())
                known = numbers[np.searchsorted(digests, _digests(words, salt))] if words else np.zeros(0, np.int32)
                own.append((known[at].astype(np.int64), lengths, len(digests) + 1))
            full = (own[0][1] > 0) & (own[1][1] > 0)
            (s, sn, ls), (t, tn, lt) = (_distinct(x[np.repeat(full, n)], n[full], size) for x, n, size in own)
            at = _starts(ls)
            arrays = (np.insert(s, at, 0), np.insert(sn, at, 1), ls + 1, t, tn, lt)
            if full.any():
                yield pa.RecordBatch.from_arrays([pa.array([_packed(a)], pa.binary()) for a in arrays], list(ARRAYS))

    return pairs.mapInArrow(run, BLOBS)


def _bounds(weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Of target words by falling weight, the first number of each part but the first, and how many parts are one heavy word."""
    heavy = int((weights > HEAVY).sum())
    rest = weights[heavy:]
    part = np.r_[np.arange(heavy), heavy + (np.cumsum(rest) - rest) // PART].astype(np.int64)
    return np.flatnonzero(np.r_[False, part[1:] != part[:-1]][: len(part)]) + 1, heavy


def _by_part(blobs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(part, blobs): the sentence pairs that hold a part's target words, with these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, sn, ls, t, tn, lt = (_unpacked(batch.column(i)[r].as_py()) for i in range(len(ARRAYS)))
                at, of, part = _starts(ls), np.repeat(np.arange(len(lt)), lt), np.searchsorted(bounds, t, "right")
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]][: len(order)])
                for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                    some = order[lo:hi]
                    first = np.flatnonzero(np.r_[True, of[some][1:] != of[some][:-1]])
                    sent = of[some][first]
                    spots = _spots(at[sent], ls[sent])
                    arrays = (s[spots], sn[spots], ls[sent], t[some], tn[some], np.diff(np.r_[first, len(some)]))
                    yield pa.RecordBatch.from_arrays([pa.array([part[some[0]]], pa.int32()), *(pa.array([_packed(a)], pa.binary()) for a in arrays)], ["part", *ARRAYS])

    return blobs.mapInArrow(run, f"part int, {BLOBS}").repartitionById(len(bounds) + 1, "part")


def _some(s: np.ndarray, sn: np.ndarray, f: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tn: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word pairs (e, f) and their counts after len(sums) + 1 passes. Target words f in order, each once for every sentence pair
    that holds it (tn times), whose source words are at starts; f must be with all of its sentence pairs."""
    spots, row = _spots(starts, lengths), np.repeat(np.arange(len(f)), lengths)
    group = np.cumsum(np.r_[False, f[1:] != f[:-1]][: len(f)])
    # Word pairs are sorted as numbers that hold the place where each was.
    bits, wide = int(len(spots)).bit_length(), int(s.max()).bit_length()
    if bits + wide + int(group[-1]).bit_length() < 63:
        keys = np.sort((((group[row] << wide) | s[spots]) << bits) | np.arange(len(spots)))
        place, keys = keys & ((1 << bits) - 1), keys >> bits
    else:
        place = np.lexsort((s[spots], group[row]))
        keys = (group[row] << wide | s[spots])[place]
    row, e, a = row[place], s[spots[place]], sn[spots[place]].astype(np.float64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    many, own = np.diff(np.r_[first, len(keys)]), e[first]
    whole = np.bincount(row, a, len(f))  # every source word is as likely at first
    counts = np.add.reduceat(a * (tn / whole)[row], first)
    for before in sums:
        share = a * np.repeat(counts / before[own], many)
        counts = np.add.reduceat(share * (tn / np.bincount(row, share, len(f)))[row], first)
    return own, f[row[first]], counts


def _more(pieces: Iterable[tuple]) -> Iterator[list[np.ndarray]]:
    """Pieces put together until they have AT_ONCE source words."""
    some, n = [], 0
    for piece in pieces:
        some.append(piece)
        n += len(piece[0])
        if n >= AT_ONCE:
            yield [np.concatenate(x) for x in zip(*some, strict=True)]
            some, n = [], 0
    if some:
        yield [np.concatenate(x) for x in zip(*some, strict=True)]


def _heavy(pieces: Callable[[], Iterator[tuple]], sums: list[np.ndarray], wide: int) -> np.ndarray:
    """Counts of all source words with one target word, whose sentence pairs are read piece by piece once for each pass."""
    counts = None
    for before in [None, *sums]:
        likely = None if before is None else np.divide(counts, before, out=np.zeros(wide), where=before > 0)
        counts = np.zeros(wide)
        for s, sn, ls, _, tn, _ in _more(pieces()):
            row = np.repeat(np.arange(len(ls)), ls)
            share = sn * (1.0 if likely is None else likely[s])
            counts += np.bincount(s, share * (tn / np.bincount(row, share, len(ls)))[row], wide)
    return counts


def _counts(parts: DataFrame, heavy: int, wide: int, sums: list[np.ndarray], least: np.ndarray | None) -> DataFrame:
    """(e, f, v): the counts after len(sums) + 1 passes of word pairs that reach least[e], and of f = SUM the sums of a part's counts;
    no least: sums alone."""
    shared = parts.sparkSession.sparkContext.broadcast((sums, least))

    def rows(e: np.ndarray, f: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(v)], ["e", "f", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sums, least), at = shared.value, {}
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                for r in range(batch.num_rows):
                    blobs = [batch.column(i + 1)[r].as_py() for i in range(len(ARRAYS))]
                    at.setdefault(batch.column(0)[r].as_py(), []).append((file.tell(), [len(b) for b in blobs]))
                    file.writelines(blobs)

            def pieces(part: int) -> Iterator[tuple]:
                for start, sizes in at[part]:
                    file.seek(start)
                    yield tuple(_unpacked(file.read(n)) for n in sizes)

            for part in sorted(at):
                total = np.zeros(wide)
                for e, f, v in _part(partial(pieces, part), part < heavy, sums, wide):
                    total += np.bincount(e, v, wide)
                    if least is not None:
                        kept = v >= least[e]
                        yield rows(e[kept], f[kept], v[kept])
                e = np.flatnonzero(total)
                yield rows(e, np.full(len(e), SUM), total[e])

    return parts.mapInArrow(run, COUNTS)


def _part(pieces: Callable[[], Iterator[tuple]], heavy: bool, sums: list[np.ndarray], wide: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if heavy:
        counts = _heavy(pieces, sums, wide)
        e = np.flatnonzero(counts)
        yield e, np.full(len(e), next(pieces())[3][0]), counts[e]
        return
    s, sn, ls, t, tn, lt = (np.concatenate(x) for x in zip(*pieces(), strict=True))
    at, of = _starts(ls), np.repeat(np.arange(len(lt)), lt)
    order = np.argsort(t, kind="stable")
    f, of, tn = t[order], of[order], tn[order].astype(np.float64)
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    done = np.r_[0, np.cumsum(ls[of])]
    piece = done[first] // AT_ONCE  # of each word by its first sentence pair
    cuts = first[np.r_[True, piece[1:] != piece[:-1]]]
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(f)], strict=True):
        yield _some(s, sn, f[lo:hi], at[of[lo:hi]], ls[of[lo:hi]], tn[lo:hi], sums)


def _first_sums(blobs: DataFrame, wide: int) -> np.ndarray:
    """The sums of the first pass, in which every source word of a sentence, and none, is as likely: no word pair is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide)
        for batch in batches:
            for r in range(batch.num_rows):
                s, sn, ls, _, tn, lt = (_unpacked(batch.column(i)[r].as_py()) for i in range(len(ARRAYS)))
                of = lambda n: np.repeat(np.arange(len(n)), n)
                each = np.bincount(of(lt), tn, len(lt)) / np.bincount(of(ls), sn, len(ls))
                total += np.bincount(s, sn * each[of(ls)], wide)
        e = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)), pa.array(np.full(len(e), SUM, np.int32)), pa.array(total[e])], ["e", "f", "v"])

    return _collected(blobs.mapInArrow(run, COUNTS), wide)


def _collected(counts: DataFrame, wide: int) -> np.ndarray:
    table, out = counts.where(F.col("f") == SUM).groupBy("e").agg(F.sum("v")).toArrow(), np.zeros(wide)  # 12 bytes a word
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def _shares(counts: DataFrame, whole: np.ndarray, least: float) -> DataFrame:
    """(e, f, p): counts over source words' sums, of `least` or more; words of sum 0 go."""
    shared = counts.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value[batch.column(0).to_numpy()]
            p = np.divide(batch.column(2).to_numpy(), own, out=np.zeros(len(own)), where=own > 0)
            kept = pa.array(p >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["e", "f", "p"]).filter(kept)

    return counts.where(F.col("f") != SUM).mapInArrow(run, "e int, f int, p double")


def word_table(pairs: DataFrame, passes: int, least: float, scratch: Scratch | None = None) -> DataFrame:
    """(src, tgt, p): what becomes of every source word (null: of none) in pairs(src, tgt) after so many passes, p of `least` or more."""
    spark, scratch = pairs.sparkSession, scratch or Scratch(pairs.sparkSession)
    pairs, salt = dealt(pairs.select("src", "tgt")), 0
    while True:
        words = scratch.keep(_words(pairs, salt))
        sides = [_numbered(words, side, by) for side, by in ((0, "n"), (1, "weight"))]
        if all((d[1:] != d[:-1]).all() for d, _, _ in sides):
            break
        scratch.forget(words)
        salt += 1
    numbers, wide = [side[:2] for side in sides], len(sides[0][0]) + 1
    blobs = scratch.keep(_blobs(pairs, numbers, salt))
    bounds, heavy = _bounds(sides[1][2])
    sums = [_first_sums(blobs, wide)]
    while len(sums) < passes - 1:
        scratch.forget()  # what the pass before has shuffled
        sums.append(_collected(_counts(_by_part(blobs, bounds), heavy, wide, sums, None), wide))
    scratch.forget()
    before, last = sums[: passes - 1], KEPT * sums[-1]
    counts = scratch.keep(_counts(_by_part(blobs, bounds), heavy, wide, before, least * last))
    whole = _collected(counts, wide)
    fell = whole < last
    scratch.forget()
    found = _shares(counts, np.where(fell, 0.0, whole), least)
    if fell.any():  # a word whose sum fell by more than was thought may have lost word pairs
        again = scratch.keep(_counts(_by_part(blobs, bounds), heavy, wide, before, np.where(fell, least * (1 - 1e-9) * whole, np.inf)))
        found = found.unionAll(_shares(again, np.where(fell, whole, 0.0), least))
        scratch.forget()
    scratch.forget(blobs)
    shared = spark.sparkContext.broadcast(numbers)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, digest, number = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for i, (digests, own) in enumerate(shared.value):
                number[side == i] = own[np.searchsorted(digests, digest[side == i])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), batch.column(2)], ["side", "number", "word"])

    names = words.select("side", "digest", "word").mapInArrow(named, "side int, number int, word string")
    name = lambda side, number, word: names.where(F.col("side") == side).select(F.col("number").alias(number), F.col("word").alias(word))
    rows = found.select("e", "f", F.round("p", 6).alias("p"))
    return rows.join(name(0, "e", "src"), "e", "left").join(name(1, "f", "tgt"), "f").select("src", "tgt", "p")
