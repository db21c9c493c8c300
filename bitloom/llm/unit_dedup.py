"""Substring dedup by hashing lines and paragraphs, and the pieces of which they are made.

A text is cut into paragraphs, and these into lines. A unit's digest is of its words, lower-cased and
joined by single blanks; digests are grouped over the whole table, the occurrence that is earliest by
(document, offset) stays, and each later line or paragraph of `least_whole` words or more goes.

Passages that stand amid other lines have no line of their own. So lines are also cut at the ends of
sentences, and a sentence of over `longest` words after words chosen by their own letters, so that a
passage is cut alike wherever it stands. Pieces are grouped with the lines; later ones go, if their run
of neighbouring later pieces has at least `least_words` words: so a short phrase that two texts share by
chance stays, and a long passage goes whatever its pieces. `pieces=False` leaves this out.

The least place per digest is aggregated before it is shuffled, and what was cut meets it in a join. A digest
that very many places have is dealt out over SALTS shares there, so a line that a third of all documents
hold is never gathered in one task. Texts are cut once for each: what is cut weighs more than the texts.

Defined results: null and blank texts have no lines; rows equal in id and text are one document;
documents of equal id and different text are ranked by a hash of the text; a null id ranks first;
a text in which all goes becomes empty; an empty table gives an empty result; other columns stay as
they are, whatever their names, in `remove_repeats`, but for `removed`, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import Scratch, apart
from bitloom.llm.secret_scan import masked

#: Cuts between units; no character belongs to a cut.
PARAGRAPHS, LINES, SENTENCES = (re.compile(x) for x in (r"(?<=\n)(?=\n)", r"(?<=\n)", r"(?<=[.!?])(?= )"))
#: Words of the shortest run of later pieces that goes.
LEAST_WORDS = 20
#: Words of the shortest line or paragraph that goes by its own digest: any with a word.
LEAST_WHOLE = 1
#: Words of the longest piece that isn't cut further.
LONGEST = 16
#: What a row is; a line of one piece is both.
PIECE, LINE, PARAGRAPH = 1, 2, 4
#: A digest with at least so many places, and over 1 / HOT_SHARE of all repeated ones', is dealt out over SALTS shares; so there are at most HOT_SHARE.
LEAST_HOT, HOT_SHARE, SALTS = 10_000, 1000, 256
WORD = re.compile(r"\S+")
ROWS_AT_ONCE = 200_000
#: Distinct words of which a worker remembers whether a cut follows.
MEMORY = 120_000


class _Ends(dict):
    """Whether a long unit is cut after a word; a worker remembers so many words."""

    def __missing__(self, w: str) -> bool:
        if len(self) >= MEMORY:
            self.clear()
        self[w] = out = (len(w) + 3 * ord(w[0]) + 5 * ord(w[-1])) & 7 == 0
        return out


ENDS = _Ends()


def _cuts(words: list[str]) -> list[int]:
    """How many words lie before each cut of a long unit: it is cut after words whose length, plus 3 times
    the code of their first and 5 times that of their last character, is divisible by 8."""
    out = [i for i, w in enumerate(words, 1) if ENDS[w]]
    if not out or out[-1] < len(words):
        out.append(len(words))
    return out


def _places(part: str, lead: int, words: list[str], even: bool) -> tuple[list[int], list[int]]:
    """Where the words of a part, whose first follows `lead` white space, start and end; even: each is as long as in lower case."""
    sizes = list(map(len, words if even else part.split()))
    ends = list(accumulate(sizes, lambda at, n: at + 1 + n, initial=lead - 1))[1:]
    if ends[-1] != len(part.rstrip()):  # some words lie further apart than one character
        spans = [m.span() for m in WORD.finditer(part)]
        return [a for a, _ in spans], [b for _, b in spans]
    return [b - n for b, n in zip(ends, sizes, strict=True)], ends


def cut(text: str, pieces: bool = True, least_whole: int = LEAST_WHOLE, longest: int = LONGEST) -> tuple[list[int], ...]:
    """starts, ends, numbers, words, kinds and digests of what a text is cut into; outer white space isn't in a span.

    Pieces are numbered in order; a line or paragraph of several pieces has the first one's number. A
    paragraph of one line isn't listed beside it. Without pieces each line is one piece."""
    starts, ends, nos, counts, kinds, digests = [], [], [], [], [], []
    digest = xxhash.xxh3_128_digest

    def add(start: int, end: int, no: int, words: list[str], kind: int) -> None:
        starts.append(start)
        ends.append(end)
        nos.append(no)
        counts.append(len(words))
        kinds.append(kind)
        digests.append(digest(" ".join(words).encode("utf-8", "surrogatepass")))

    at = no = 0
    for paragraph in PARAGRAPHS.split(text):
        seen: list[list[str]] = []
        begin = stop = first_no = 0
        for line in LINES.split(paragraph):
            parts = [p for p in _sentences(line) if p[1]] if pieces else [(0, line.lower().split(), line, True)]
            # A sentence ends before a blank, so its letters are the same in lower case by itself and in the line.
            all_ = parts[0][1] if len(parts) == 1 else [w for p in parts for w in p[1]]
            if all_:
                start, end, own_no = at + len(line) - len(line.lstrip()), at + len(line.rstrip()), no
                if not seen:
                    begin, first_no = start, no
                stop = end
                seen.append(all_)
                kind = LINE if len(all_) >= least_whole else 0
                for lead, words, part, even in parts:
                    if pieces and len(words) > longest:
                        a, b = _places(part, len(part) - len(part.lstrip()), words, even)
                        last = 0
                        for upto in _cuts(words):
                            add(at + lead + a[last], at + lead + b[upto - 1], no, words[last:upto], PIECE)
                            no += 1
                            last = upto
                    else:
                        add(at + lead + len(part) - len(part.lstrip()), at + lead + len(part.rstrip()), no, words, PIECE)
                        no += 1
                if no == own_no + 1:
                    kinds[-1] |= kind
                elif kind:
                    add(start, end, own_no, all_, LINE)
            at += len(line)
        if len(seen) > 1 and sum(map(len, seen)) >= least_whole:
            add(begin, stop, first_no, [w for words in seen for w in words], PARAGRAPH)
    return starts, ends, nos, counts, kinds, digests


def _sentences(line: str) -> Iterator[tuple[int, list[str], str, bool]]:
    """Where each part begins in the line, its words in lower case, the part, and whether it is as long as in lower case."""
    at = 0
    for part in SENTENCES.split(line):
        low = part.lower()
        yield at, low.split(), part, len(low) == len(part)
        at += len(part)


def units(docs: DataFrame, pieces: bool = True, least_whole: int = LEAST_WHOLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, row (a hash of the text), start, end, no, words, kind and the digest's halves, of each piece, line and paragraph."""
    names = ["doc_id", "row", "start", "end", "no", "words", "kind", "h1", "h2"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        """found: id, row and the lists of cut(), for each document."""
        sizes = [len(f[2]) for f in found]
        spread = np.repeat(np.arange(len(found)), sizes)
        lists = [np.fromiter(chain.from_iterable(f[k] for f in found), np.int32, len(spread)) for k in range(2, 7)]
        halves = np.frombuffer(b"".join(chain.from_iterable(f[7] for f in found)), "<i8").reshape(-1, 2)
        ids = pa.array([f[0] for f in found], pa.int64()).take(pa.array(spread))
        rows = np.array([f[1] for f in found], np.int64)[spread]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows), *map(pa.array, lists), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, waiting = [], 0
            for doc_id, text, row in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                t = text.as_py()
                got = cut(t, pieces, least_whole, longest) if t else ([],)
                if got[0]:
                    found.append((doc_id.as_py(), row.as_py(), *got))
                    waiting += len(got[0])
                if waiting >= ROWS_AT_ONCE:
                    yield batch_of(found)
                    found, waiting = [], 0
            if found:
                yield batch_of(found)

    schema = "doc_id long, row long, start int, end int, no int, words int, kind int, h1 long, h2 long"
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, schema)


def _later(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Of units(), the rows whose digest has an earlier place, and keeper, its document."""
    place = F.struct("doc_id", "row", "start")
    # Written and read again, both sides of the join come from plain exchanges, whose hot partitions can be split.
    first = scratch.keep(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    all_ = first.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(first.where(F.col("n") >= max(LEAST_HOT, -(-all_ // HOT_SHARE))).select("h1", "h2", F.lit(True).alias("hot")))
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(SALTS)).cast("int")).otherwise(0)
    shares = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    key = ["h1", "h2"]
    dealt = found.join(hot, key, "left").withColumn("share", share).drop("hot")
    firsts = first.drop("n").join(hot, key, "left").withColumn("share", shares).drop("hot")
    later = dealt.join(firsts, [*key, "share"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "row", "no", "kind", "start", "end", "words", F.col("first.doc_id").alias("keeper"))


def repeats(docs: DataFrame, pieces: bool = True, least_words: int = LEAST_WORDS, least_whole: int = LEAST_WHOLE, longest: int = LONGEST) -> DataFrame:
    """The spans to remove: doc_id, row, start, end (code points of the original text, end exclusive), n_units
    (pieces of a run; 1 for a line or paragraph by itself), n_words, kept_doc_id, the document that keeps the
    unit or the run's longest piece, and kept_in, the ids of all that keep one. None lies inside another."""
    later = _later(units(docs, pieces, least_whole, longest), Scratch(docs.sparkSession))
    # Rows equal in id and text come several times and count once. Neighbouring numbers less their rank are equal.
    order = Window.partitionBy("doc_id", "row").orderBy("no", "kind")
    again = F.coalesce((F.lag("no").over(order) == F.col("no")) & (F.lag("kind").over(order) == F.col("kind")), F.lit(False))
    run = F.col("no") - F.dense_rank().over(Window.partitionBy("doc_id", "row").orderBy("no"))
    ranked = later.withColumn("again", again).withColumn("run", run).where(~F.col("again"))
    is_piece, is_whole = F.col("kind").bitwiseAND(PIECE) > 0, F.col("kind").bitwiseAND(LINE | PARAGRAPH) > 0
    of_piece = lambda c: F.when(is_piece, c)

    def span(start: Column, end: Column, n: Column, words: Column, keeper: Column, kept_in: Column) -> Column:
        """Of spans that start alike the longest comes first."""
        names = {"start": start, "back": -end, "end": end, "n_units": n.cast("long"), "n_words": words.cast("long"), "kept_doc_id": keeper, "kept_in": kept_in}
        return F.struct(*(c.alias(k) for k, c in names.items()))

    own = span(F.col("start"), F.col("end"), F.lit(1), F.col("words"), F.col("keeper"), F.array("keeper"))
    keeper = F.min_by("keeper", of_piece(F.struct(-F.col("words"), "no")))
    whole_run = span(
        F.min(of_piece(F.col("start"))),
        F.max(of_piece(F.col("end"))),
        F.sum(is_piece.cast("int")),
        F.coalesce(F.sum(of_piece(F.col("words"))), F.lit(0)),
        keeper,
        F.sort_array(F.collect_set(of_piece(F.col("keeper")))),
    )
    runs = ranked.groupBy("doc_id", "row", "run").agg(whole_run.alias("all"), F.sort_array(F.collect_list(F.when(is_whole, own))).alias("wholes"))
    beyond = F.filter("wholes", lambda w: (w["end"] > F.col("all.end")) | (w["start"] < F.col("all.start")))
    found = F.when((F.col("all.n_words") >= least_words) & F.lit(pieces), F.concat(F.array("all"), beyond)).otherwise(F.col("wholes"))
    each = runs.select("doc_id", "row", "run", F.posexplode(found).alias("at", "s"))
    # A line inside a paragraph that goes is part of it.
    reach = F.max("s.end").over(Window.partitionBy("doc_id", "row", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    outer = each.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("s.end") > F.col("reach")))
    return outer.select("doc_id", "row", "s.*").drop("back")


def remove_repeats(docs: DataFrame, pieces: bool = True, least_words: int = LEAST_WORDS, least_whole: int = LEAST_WHOLE) -> DataFrame:
    """docs with the repeats cut out of text, and `removed`, their spans in the original text."""
    own = ("doc_id", "text")
    rest = docs.drop("removed")
    plain = apart(rest, *own).withColumn("row", F.xxhash64("text"))
    spans = repeats(plain, pieces, least_words, least_whole).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("hash"))
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    both = plain.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("hash")), "left")
    text = F.when(F.col("removed").isNotNull(), masked(F.col("text"), F.col("removed"), "")).otherwise(F.col("text"))
    cut_ = both.withColumn("text", text)
    names = [F.col(c if c in own else f"c{i}").alias(c) for i, c in enumerate(rest.columns)]
    return cut_.select(*names, "removed")
