import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import ngram_join as J
from tests.llm.test_near_dedup import corpus, plain_roots, plain_set


def plain(docs, n, percent):
    sets = {i: plain_set(t, n) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = plain_roots(ids, links)
    return {(i, len(sets[i]), roots[i]) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def result(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("n", "percent", "orders"), [(4, 85, 3), (2, 60, 2), (1, 50, 1)])
def test_against_all_pairs(spark, n, percent, orders):
    docs = corpus(random.Random(n))
    assert result(J.similar_documents(frame(spark, docs), n, percent, orders)) == plain(docs, n, percent)


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_similar_sets_share_a_prefix_under_every_order(percent):
    rng = np.random.default_rng(percent)
    counts = rng.integers(1, 5000, 2 << J.COUNTER_BITS)
    met = 0
    for _ in range(900):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 60), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**64, rng.integers(0, 5), np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
            continue
        met += 1
        for x, y in zip(J.prefixes(a, counts, percent, 3), J.prefixes(b, counts, percent, 3), strict=True):
            assert set(x) & set(y)
    assert met > 20


def test_orders_differ_and_put_rare_tokens_first():
    items = np.sort(np.random.default_rng(1).integers(0, 2**64, 400, np.uint64))
    counts = np.full(2 << J.COUNTER_BITS, 5)
    counts[J._slots(items[:100]).ravel()] = 5000
    first, second = J.prefixes(items, counts, 85, 2)
    assert not set(first) & set(items[:100].view(np.int64)) and not set(second) & set(items[:100].view(np.int64))
    assert len(set(first) & set(second)) < 40


def test_other_orders_rule_pairs_out(spark):
    """Pairs that meet under the first order by the one word they share go by the others, but for chance."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    df = frame(spark, [(i, " ".join(["same", *[word() for _ in range(60)]])) for i in range(60)])
    share = spark.sparkContext.broadcast
    counts = share(np.ones(2 << J.COUNTER_BITS, np.int64))
    sets = J.sets_and_prefixes(df, share(np.full((1 << J.MAP_BITS) // 8, 255, np.uint8)), 1, 85, 3, counts).cache()
    pairs = sets.select(F.col("id").alias("u")).join(sets.select(F.col("id").alias("v")), F.col("u") < F.col("v"))
    left = {tuple(r) for r in J.sharing_prefixes(pairs, sets, 3).collect()}
    arrays = {r["id"]: (set(r["o1"]), set(r["o2"])) for r in sets.collect()}
    assert left == {(u, v) for u in arrays for v in arrays if u < v and all(a & b for a, b in zip(arrays[u], arrays[v], strict=True))}
    assert len(left) < pairs.count() and {tuple(r) for r in J.sharing_prefixes(pairs, sets, 1).collect()} == {tuple(r) for r in pairs.collect()}


@pytest.mark.parametrize("least", [1, 20_000])
def test_prefixes_by_exact_counts(spark, monkeypatch, least):
    """Of unlike documents no token is a key, whatever the load of the counters; similar ones still share one, also if tokens are frequent."""
    monkeypatch.setattr(J, "LEAST_COMMON", least)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    docs = [(i, " ".join(["same", "start", "here", "again", *[word() for _ in range(60)]])) for i in range(200)]
    docs += [(200 + i, t + " more") for i, (_, t) in enumerate(docs[:5])] + [(300, docs[9][1])]
    df = frame(spark, docs)
    members = spark.createDataFrame([(i, len(plain_set(t, 4)), 9 if i == 300 else i) for i, t in docs], "doc_id long, n long, rep long")
    # All counters at one value: as over a table much larger than they are.
    counts = spark.sparkContext.broadcast(np.full(2 << J.COUNTER_BITS, 5))
    keys = {(r["id"], r["bucket"]) for r in J.shared_prefixes(df, members, 4, 85, counts).collect()}
    assert {i for i, _ in keys} == {*range(5), *range(200, 205)}
    assert all({b for j, b in keys if j == i} & {b for j, b in keys if j == 200 + i} for i in range(5))
    assert {(i, c) for i, _, c in result(J.similar_documents(df, 4, 85)) if i != c} == {*((200 + i, i) for i in range(5)), (300, 9)}


def test_bitmap_holds_every_key(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    bits = J.membership(spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(3))
    assert J._may_hold(bits, keys).all() and J._may_hold(bits, keys + 1).mean() < 0.01


def test_a_large_group_beside_a_common_passage(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqr") + rng.choice("stuvwxyz") + rng.choice("abcde")
    base, passage = [word() for _ in range(120)], [word() for _ in range(12)]
    docs = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(120)] = word()
        docs.append((i, " ".join(own)))
    docs += [(300 + i, " ".join([word() for _ in range(60)] + passage)) for i in range(200)]
    got = result(J.similar_documents(frame(spark, docs), 4, 85))
    assert {c for i, _, c in got if i < 300} == {0}
    assert all(i == c for i, _, c in got if i >= 300)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (5, "One two"), (4, "one TWO"), (7, long), (6, long + " x"), (None, "one two"), (None, None), (8, "a b c d e"), (8, "a b c d e"), (9, "Éa b c d e")]
    df = frame(spark, rows).select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("slot"), F.lit(0).alias("a.b"), F.lit(0).alias("rep"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar_documents(df, 4, 85).collect()), key=str)
    n = 60_000 - 3
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 4), (4, 1, 4), (7, n, 6), (6, n + 1, 6), (None, 1, 4), (None, 0, None), (8, 2, 8), (8, 2, 8), (9, 2, 9)]
    assert got == sorted(want, key=str)
    assert J.similar_documents(frame(spark, rows).limit(0)).count() == 0
