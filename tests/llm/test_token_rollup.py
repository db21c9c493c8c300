import os
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bitloom.llm import token_rollup as K

EVENTS = "kind string, source string, lang string, version string, n_tokens long, old_tokens long, text string"


def events(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choice(["insert", "delete", "revise"])
        key = (rng.choice(["hot"] * 5 + ["a", None]), rng.choice(["en", "de", None]), rng.choice(["v1", "v2"]))
        out.append((kind, *key, None if kind == "delete" else rng.choice([None, 5, 70]), None if kind == "insert" else rng.randint(0, 9), "x"))
    return out


def plain(batches):
    docs, tokens = Counter(), Counter()
    for kind, s, lang, v, new, old, _ in (e for b in batches for e in b):
        k = (s, lang, v)
        docs[k] += {"insert": 1, "delete": -1, "revise": 0}[kind]
        tokens[k] += {"insert": new or 0, "delete": -(old or 0), "revise": (new or 0) - (old or 0)}[kind]
    return {(*k, docs[k], tokens[k]) for k in docs}


def state(r):
    return {tuple(x) for x in r.totals().collect()}


def test_batches_replays_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    batches = [events(rng, n) for n in (40, 0, 7, 90)]
    r = K.Rollup(spark, str(tmp_path / "r"))
    assert state(r) == set()
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, EVENTS).repartition(3)
        assert r.apply(f"b{i}", df) and not r.apply(f"b{i}", df)
        assert state(r) == plain(batches[: i + 1])
        if i == 2:
            r.compact("c0")
            assert state(r) == plain(batches[:3])
            assert not r.apply("b1", df)  # a replaced batch stays committed
    assert state(K.Rollup(spark, str(tmp_path / "r"))) == plain(batches)


def test_a_batch_that_died_before_its_record(spark, tmp_path):
    r = K.Rollup(spark, str(tmp_path / "r"))
    b = events(random.Random(2), 20)
    df = spark.createDataFrame(b, EVENTS)
    K.deltas(df.limit(3)).write.parquet(f"{r.path}/deltas/b")  # what a lost driver left
    assert state(r) == set()
    assert r.apply("b", df) and state(r) == plain([b])


def test_two_writers_of_one_batch(spark, tmp_path):
    r = K.Rollup(spark, str(tmp_path / "r"))
    b = events(random.Random(4), 20)
    mine, other = (r._written(K.deltas(spark.createDataFrame(b, EVENTS))) for _ in range(2))
    assert r._commit("b", [], mine) and not r._commit("b", [], other)
    assert r._live() == {"b": mine} and state(r) == plain([b])


def test_very_long_text(spark):
    vocabulary = {bytes([i]): i for i in range(256)}
    df = spark.createDataFrame([(1, "ab cd " * 200_000), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens) for r in K.count_tokens(df, vocabulary).collect()} == {(1, 1_200_000), (2, 0)}


def test_unknown_kind_fails_and_commits_nothing(spark, tmp_path):
    r = K.Rollup(spark, str(tmp_path / "r"))
    with pytest.raises(PySparkException):
        r.apply("b", spark.createDataFrame([("drop", "s", "l", "v", 1, 1, "x")], EVENTS))
    assert not r.committed("b") and state(r) == set()


@pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary files")
def test_corpus_replay_against_plain_counts(spark, tmp_path):
    import tiktoken

    vocabulary = K.ranks()
    coder = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    count = lambda t: len(coder.encode_ordinary(t))
    rng = random.Random(3)
    docs = [(i, rng.choice([None, "", "one line", "two\nlines", "é 😀\n\nx", f"own {i}"]), rng.choice(["s0", None]), "en", 1) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_tokens long")
    got = {tuple(x) for x in K.replayed_corpus(df, str(tmp_path / "r"), vocabulary, "v").collect()}
    first, want, size, n = {}, Counter(), Counter(), Counter()
    for i, t, s, _, _ in docs:
        n[s] += 0
        if t is None or first.setdefault(t, i) == i:  # null texts are no copies of each other
            n[s] += 1
            want[s] += count((t or "").replace("\n", " "))
            size[s] += len((t or "").encode())
    assert got == {(s, "en", "v", n[s], want[s]) for s in n} | {(s, "en", K.BYTES, n[s], size[s]) for s in n}
    assert K.replayed_corpus(df.limit(0), str(tmp_path / "e"), vocabulary, "v").count() == 0
    assert K.count_tokens(df, vocabulary).agg(F.sum("n_tokens")).first()[0] == sum(count(t or "") for _, t, *_ in docs)
