import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import near_dedup as N
from bitloom.llm.common import Scratch
from bitloom.llm.components import components


def plain_set(text, n):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_roots(nodes, links):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in nodes}


def plain(docs, n):
    sets = {i: plain_set(t, n) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = plain_roots(ids, links)
    return {(i, len(sets[i]), roots[i], roots[i] == i) for i in ids}


def corpus(rng):
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("uvwxyz")
    docs = [None, "", " \n", "one", "One", "one two", "Éa éa", "éa éa"]
    for size in (6, 12, 40, 150):
        for _ in range(4):
            base = [word() for _ in range(size)]
            docs.append(" ".join(base))
            for _ in range(8):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 12))):
                    copy[rng.randrange(size)] = word()
                docs.append(" ".join(copy))
                if rng.random() < 0.3:  # chains of edits
                    base = copy
    ids = rng.sample(range(1000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("n", [2, 5])
def test_against_all_pairs(spark, n):
    docs = corpus(random.Random(n))
    df = spark.createDataFrame([(i, t, None, 0) for i, t in docs], "doc_id long, text string, bands string, n long").repartition(6)
    got = {tuple(r) for r in N.near_duplicates(df, shingle=n).collect()}
    assert got == plain(docs, n)


def test_bucket_with_several_components(spark):
    """One bucket holds everything; chains and strangers must still come out right."""
    rng = random.Random(3)
    sets = {}
    for i in range(60):
        start = 3 * (i // 12) * 1000 + (i % 12) * rng.choice([1, 2, 9])
        sets[i] = list(range(start, start + 20))
    reps = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    buckets = reps.select("id", F.lit(20).cast("long").alias("n"), F.lit(7).cast("long").alias("bucket"))
    got = {r.id: r.root for r in N.linked(buckets, lambda ids: reps.join(ids, "id", "left_semi"), 80, Scratch(spark)).collect()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]
    assert {i: got.get(i, i) for i in sets} == plain_roots(sets, links)


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, None), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(4, 3, 4, True), (4, 3, 4, True), (None, 3, 4, False), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert N.near_duplicates(df.limit(0), 2).count() == 0


@pytest.mark.parametrize("few", [-1, 1000])
def test_components_of_a_long_chain(spark, few):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 150), (150, 170)], "u long, v long")
    got = {r.id: r.root for r in components(links, Scratch(spark), few).collect()}
    assert got == {**{i: 0 for i in range(71)}, 150: 150, 170: 150, 200: 150}


def test_signature_is_the_circulant_minimum():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    at = (N.mixed(s * N.ODD[1]) >> np.uint64(64 - N.WIDTH_BITS)).astype(np.int64)
    rank = N._ranks(8)[:, 0]
    assert list(N.signature(s, 8, chunk=7)) == [min(rank[(p + k) % len(rank)] for p in at) if max(at) + 8 < len(rank) else N.signature(s, 8)[k] for k in range(8)]


def test_components_of_random_links(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    df = spark.createDataFrame(links, "u long, v long")
    roots = plain_roots(range(300), links)
    for few in (-1, 1000):
        got = {r.id: r.root for r in components(df, Scratch(spark), few).collect()}
        assert got == {i: roots[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(df.limit(0), Scratch(spark)).count() == 0


def test_very_long_text(spark):
    long = " ".join(map(str, range(60_000)))
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, "x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df, 2).collect()} == {1: 1, 2: 1, 3: 3}


def test_null_ids_meet_exact_copies_only(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"])]
    df = spark.createDataFrame([(5, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2])], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (None, 5, False), (None, None, True), (None, None, True)], key=str)
