import random

import pytest

from bitloom.llm import piece_codec as P

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(P.MODEL), reason="no vocabulary files")


@pytest.fixture(scope="module")
def model():
    return P.Pieces.load()


@pytest.fixture(scope="module")
def unigram():
    """The library, led to search best paths over the same pieces and scores."""
    import sentencepiece

    proto = open(P.MODEL, "rb").read()
    at = proto.rindex(b"tok_v0") + len(b"tok_v0")
    assert proto[at : at + 2] == b"\x18\x02"
    return sentencepiece.SentencePieceProcessor(model_proto=proto[:at] + b"\x18\x01" + proto[at + 2 :])


def texts():
    rng = random.Random(2)
    bits = ["the", " ", "  ", "ing", "tion", "\n", "é", "ß", "😀", "\t", "ñu", "Q", ".", "zx", "\x00", "日本", "a", "ement", "     "]
    return ["", " ", "  lead", "trail  ", "a  b\n\nc", "x" * 300] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]


def brute(codec, marked):
    """Best total over all cuts, by trying every piece at every place."""
    gain = dict(zip(codec.model.pieces, codec.model.scores, strict=True))
    best = [0.0] + [float("-inf")] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(j):
            g = gain.get(marked[i:j], codec.unknown if j - i == 1 else None)
            if g is not None:
                best[j] = max(best[j], best[i] + g)
    return best[-1]


def test_ids_equal_the_library(model, unigram):
    """Where no total is so large (-1e9: unknown characters, some runs of blanks) that the library's single precision loses the rest."""
    codec = P.Codec(model)
    gain = dict(zip(model.ids, model.scores, strict=True))
    same = 0
    for t in texts() + [t.replace("\n", " ").replace("\t", "").replace("\x00", "").replace("     ", " ") for t in texts()]:
        ids = codec.encode(t).tolist()
        if len(t) < 150 and all(gain.get(i, -1e9) > -1e6 for i in ids):
            assert ids == unigram.nbest_encode_as_ids(t, 2)[0], t
            same += 1
    assert same > 50


def test_score_is_the_best_of_all_cuts(model):
    codec = P.Codec(model)
    gain = dict(zip(model.ids, model.scores, strict=True))
    for t in texts()[6:60]:
        marked = (" " + t).replace(" ", P.MARK)
        ids = codec.encode(t).tolist()
        known = sum(gain[i] for i in ids if i in gain)
        rest = marked.encode().__len__() - sum(len(codec.shown[i].replace(b" ", P.MARK.encode())) for i in ids if i in gain)
        unknown = [c for c in marked if c not in model.pieces]
        assert sum(len(c.encode()) for c in unknown) == rest
        assert known + len(unknown) * codec.unknown == pytest.approx(brute(codec, marked))


def test_round_trip_and_nulls(spark, model):
    docs = [(i, t, "z") for i, t in enumerate([None, P.MARK, f"a{P.MARK}{P.MARK} b {P.MARK}", "w" * 20_000 + " " * 3_000, *texts()])]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string")
    got = P.encoded_documents(df, model).collect()
    assert len(got) == len(docs) and all(r.round_trip for r in got)
    assert next(r for r in got if r.doc_id == 0).n_tokens == 0
    back = P.decode(P.encode(df, model), model)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert P.encoded_documents(df.limit(0), model).count() == 0


def test_memory_may_run_full(model, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 3)
    a, b = P.Codec(model), P.Codec(model)
    for t in texts()[:80]:
        assert b.decode(a.encode(t).tolist()) == t
