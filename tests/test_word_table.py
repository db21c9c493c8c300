import random

import pytest

from bitloom.operators import word_table
from bitloom.plans import entries
from tests.test_beam_lexical import plain_model


def many_words(n, seed=4):
    """Sentences of some frequent words and many rare ones, a few of them longer than 128 tokens."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(12)}" if rng.random() < 0.5 else f"w{rng.randrange(4000)}"
    return [tuple(" ".join(word() for _ in range(140 if i % 20 == 0 else rng.randint(1, 12))) for _ in "st") for i in range(n)]


def plain_table(rows, passes, least):
    """Every word pair of a share of `least` or more."""
    t, _ = plain_model(rows, passes)
    return {k: p for k, p in t.items() if p >= least}


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert r["p"] == pytest.approx(want[r["src"], r["tgt"]], abs=1e-6)


@pytest.mark.parametrize(("part", "heavy", "kept", "passes"), [(10**8, 10**8, 0.5, 1), (900, 10**8, 0.5, 2), (900, 400, 0.5, 3), (900, 400, 3.0, 3), (10**8, 400, 0.9, 4)])
def test_whole_table_equals_a_plain_loop(spark, monkeypatch, part, heavy, kept, passes):
    """Words and tokens beyond any bound, in one part or in many, heavy words and words whose sums fall among them."""
    for name, value in (("PART", part), ("HEAVY", heavy), ("KEPT", kept)):
        monkeypatch.setattr(word_table, name, value)
    rows = many_words(120)
    df = spark.createDataFrame([*rows, ("", "x"), ("x", None)], "src string, tgt string").repartition(3)
    want = plain_table(rows, passes, 0.01)
    check(word_table.word_table(df, passes, 0.01).collect(), want)
    assert len({e for e, _ in want}) > 600


def test_empty_table(spark):
    assert word_table.word_table(spark.createDataFrame([], "src string, tgt string"), 3, 0.01).collect() == []


def test_words_that_share_a_digest(spark, monkeypatch):
    """Another salt is taken."""
    taken, own = [], word_table._numbered

    def same(words, side, by):
        digests, numbers, n = own(words, side, by)
        taken.append(side)
        return (digests * 0 if len(taken) <= 2 else digests), numbers, n

    monkeypatch.setattr(word_table, "_numbered", same)
    rows = many_words(20)
    check(word_table.word_table(spark.createDataFrame(rows, "src string, tgt string"), 2, 0.01).collect(), plain_table(rows, 2, 0.01))
    assert len(taken) == 4


def test_query_has_every_word_and_token(spark, tmp_path):
    """Hundreds of words, and segments of more than 128 tokens."""
    lines = many_words(150)
    docs = [(i, "\n".join(pair), "en", f"src{i % 3}") for i, pair in enumerate(lines)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["src"], r["tgt"]) for r in entries._stratified(spark, str(tmp_path)).where("split = 'train'").collect()]
    assert max(len(s.split()) for s, _ in rows) > 128 and len({w for s, _ in rows for w in s.split()}) > 500
    check(entries.lexical_table(spark, str(tmp_path)).collect(), plain_table(rows, 3, 0.01))
