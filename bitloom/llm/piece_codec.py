"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each character its output links
list the pieces that end there, and each relaxes the best score of that position (Viterbi). No piece
holds a line feed, nor a space mark after another character, so paths can be cut before runs of
blanks and around line feeds; the best path of a stretch is then remembered by its characters.

A blank is written as the space mark, one is put before the text, and a character of no piece, or a
space mark of the text itself, becomes its UTF-8 bytes, so that decoding gives back any text exactly.
Among equal scores the longest last piece wins.

Defined results: null and empty texts have no ids and decode to an empty text; rows are kept one to
one with all their columns; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bitloom.llm.common import mapped, place

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a character of no piece costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Stretches that a worker remembers, and their greatest length in characters.
MEMORY, LONGEST = 200_000, 64
STRETCHES = re.compile(f" +[^ \n{MARK}]*|[^ \n{MARK}]+|\n|{MARK}")


@dataclass(frozen=True)
class Pieces:
    """A model's normal pieces, their scores, and the ids of its 256 byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    bytes: tuple[int, ...]

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        """Read on the driver; workers get the pieces with the task, not the path."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        names = [m.id_to_piece(i) for i in normal]
        if any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in names):
            raise ValueError("a piece spans a place where texts are cut")
        return Pieces(tuple(names), tuple(float(m.get_score(i)) for i in normal), tuple(normal), tuple(m.piece_to_id(f"<0x{b:02X}>") for b in range(256)))


@dataclass
class Codec:
    model: Pieces
    memory: dict = field(default_factory=dict)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in zip(self.model.pieces, self.model.scores, self.model.ids, strict=True):
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.unknown = min(self.model.scores) - UNKNOWN_PENALTY
        self.shown = dict(zip(self.model.ids, (p.replace(MARK, " ").encode() for p in self.model.pieces), strict=True))
        self.shown |= {i: bytes([b]) for b, i in enumerate(self.model.bytes)}

    def best_path(self, marked: str) -> list[int]:
        """Ids of the best-scored pieces of a stretch written with space marks."""
        n = len(marked)
        score, start, piece = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        unknown, at = self.unknown, 0
        relaxed = self.automaton.iter(marked)
        ahead = next(relaxed, None)
        while at < n:
            best = where = which = None
            single = False
            while ahead is not None and ahead[0] == at:
                size, gain, i = ahead[1]
                total = score[at + 1 - size] + gain
                if best is None or total > best or (total == best and at + 1 - size < where):
                    best, where, which = total, at + 1 - size, i
                single |= size == 1
                ahead = next(relaxed, None)
            if not single and (best is None or score[at] + unknown > best):
                best, where, which = score[at] + unknown, at, -1
            at += 1
            score[at], start[at], piece[at] = best, where, which
        out = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.model.bytes[b] for b in reversed(marked[start[n] : n].encode("utf-8", "surrogatepass")))
            n = start[n]
        return out[::-1]

    def stretch(self, s: str) -> bytes:
        ids = [self.model.bytes[b] for b in s.encode()] if s == MARK else self.best_path(s.replace(" ", MARK))
        got = np.asarray(ids, np.int32).tobytes()
        if len(s) <= LONGEST:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[s] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        known, stretch = self.memory.get, self.stretch
        return np.frombuffer(b"".join([known(s) or stretch(s) for s in STRETCHES.findall(" " + text)]), np.int32)

    def decode(self, ids) -> str:
        if ids is None or not len(ids):
            return ""
        return b"".join(map(self.shown.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _with(docs: DataFrame, name: str, kind: T.DataType, of: str, each) -> DataFrame:
    """docs with the column that each(batch's column) gives, in Arrow batches."""
    at = place(docs, of, (name,))

    def start():
        convert = each()
        return lambda batch: [convert(batch.column(at))]

    return mapped(docs, {name: kind}, start)


def encode(docs: DataFrame, model: Pieces, out: str = "ids") -> DataFrame:
    """docs with the ids of text, array<int>; a column of docs by that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about a megabyte: bounded by the vocabulary

    def each():
        codec = Codec(shared.value)

        def convert(texts: pa.Array) -> pa.Array:
            parts = [codec.encode(t.as_py()) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))

        return convert

    return _with(docs, out, T.ArrayType(T.IntegerType()), "text", each)


def decode(encoded: DataFrame, model: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text that the ids spell; a column by that name is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def each():
        codec = Codec(shared.value)

        def convert(lists: pa.Array) -> pa.Array:
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            some = (flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            return pa.array([codec.decode(x) for x in some], pa.string())

        return convert

    return _with(encoded, out, T.StringType(), ids, each)


def encoded_documents(docs: DataFrame, model: Pieces, at_once: int = 500) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back; in one pass, at_once rows a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "ids", "round_trip"]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names[1:], (T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                batch = whole.slice(i, at_once)
                texts = batch.column(1).to_pylist()
                parts = [codec.encode(t) for t in texts]
                same = [codec.decode(p.tolist()) == (t or "") for p, t in zip(parts, texts, strict=True)]
                sizes = np.array([len(p) for p in parts])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids, pa.array(same)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
