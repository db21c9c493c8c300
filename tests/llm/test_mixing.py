import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import mixing as M


def corpus(rng, n):
    own = {"a": ["red", "rose", "ruby"], "b": ["blue", "sky", "sea"], "c": ["grass", "leaf", "moss"]}
    stock = ["the", "of", "and", "to", "is", "on", "it", "by"]
    rows = []
    for i in range(n):
        d = rng.choices("abc", [0.7, 0.2, 0.1])[0]
        words = [rng.choice(stock) if rng.random() < 0.8 else rng.choice(own[d]) for _ in range(rng.randint(4, 40))]
        rows.append((i, " ".join(words), d, 1.5))
    return rows


SCHEMA = "doc_id long, text string, domain string, rate double"


@pytest.fixture(scope="module")
def model():
    rows = corpus(random.Random(1), 900)
    return M.train([t for _, t, *_ in rows], [d for _, _, d, _ in rows], ("a", "b", "c"), Counter(d for _, _, d, _ in rows))


def plain_solution(p, n, want, mu):
    """The least of the same sum by many plain projected steps on every document."""
    every = n.sum()
    share = n @ p / every
    r = np.ones(len(p))
    for _ in range(20_000):
        g = p @ (((n * r) @ p / every - want) / share) + mu * (r - 1)
        r = np.maximum(0, r - 0.5 * g)
    return r


def test_rates_against_a_plain_solver(spark, model):
    rows = corpus(random.Random(2), 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = {"a": 0.4, "b": 0.4, "c": 0.2}
    rows_, plan = M.mixed(df, model, want)
    got = rows_.collect()
    p, n = np.array([r.posterior for r in got]), np.array([r.n_tokens for r in got], float)
    assert [r.n_tokens for r in got] == [len(r.text.split()) for r in got]
    assert np.allclose(p.sum(1), 1) and np.allclose(p * M.RESOLUTION, np.round(p * M.RESOLUTION))
    rates = np.array([r.rate for r in got])
    assert rates.min() >= 0
    assert rates == pytest.approx(plain_solution(p, n, np.array([0.4, 0.4, 0.2]), 1e-3), abs=0.02)
    assert (n * rates) @ p / n.sum() == pytest.approx([0.4, 0.4, 0.2], abs=0.01)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert plan.reached == pytest.approx((0.4, 0.4, 0.2), abs=0.01) and plan.wanted == pytest.approx((0.4, 0.4, 0.2))


def test_bounded_rates_fall_short_by_a_known_figure(spark, model):
    df = spark.createDataFrame(corpus(random.Random(5), 300), SCHEMA).repartition(4)
    rows, plan = M.mixed(df, model, {"a": 0.1, "b": 0.1, "c": 0.8}, most=2.0)
    got = rows.collect()
    assert max(r.rate for r in got) <= 2 and max(r.copies for r in got) <= 2
    p, n, rates = np.array([r.posterior for r in got]), np.array([r.n_tokens for r in got], float), np.array([r.rate for r in got])
    assert (n * rates) @ p / n.sum() == pytest.approx(plan.reached, abs=1e-6)
    assert plan.reached[2] < 0.5 < plan.wanted[2]


def test_a_few_telling_words_count_alike_in_short_and_long_texts():
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(3000)]
    text = lambda n, own: " ".join([*(rng.choice(stock) for _ in range(n)), *own])
    rows = [(text(rng.choice([30, 100, 500, 1500]), own), d) for d, own in (("a", ()), ("b", ("vile", "foul"))) for _ in range(300)]
    m = M.train([t for t, _ in rows], [d for _, d in rows], ("a", "b"), {"a": 300, "b": 300})
    marks = M.Marks()
    for n in (20, 200, 2000):
        hit = [m.posterior(M.features(text(n, own), marks))[1] > 0.5 for own in ((), ("vile", "foul")) for _ in range(50)]
        assert np.mean(hit[:50]) < 0.1 and np.mean(hit[50:]) > 0.9, n



def test_posteriors_on_held_out_rows(model):
    rows = corpus(random.Random(3), 400)
    marks = M.Marks()
    p = np.array([model.posterior(M.features(t, marks)) for _, t, *_ in rows])
    hit = np.mean([model.domains[i] == d for i, (_, _, d, _) in zip(p.argmax(1), rows, strict=True)])
    assert hit > 0.9
    # Soft memberships are honest: their means come near the domains' true shares.
    assert p.mean(0) == pytest.approx([np.mean([d == x for _, _, d, _ in rows]) for x in "abc"], abs=0.06)


def test_steps_of_posteriors():
    for p in ([1 / 3, 1 / 3, 1 / 3], [1.0, 0, 0], [0.9971, 0.0019, 0.001]):
        q = M.stepped(np.array(p))
        assert q.sum() == pytest.approx(1) and np.abs(q - p).max() <= 1 / M.RESOLUTION


def test_learning_and_resampling(spark):
    rows = corpus(random.Random(4), 400) + [(900, None, "a", 0.0), (901, "x", None, 0.0), (902, "", "zz", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = M.learn(df.repartition(3), df.repartition(3), ("a", "b", "c"))
    assert np.allclose(m.weights, M.learn(df.repartition(7), df.repartition(7), ("a", "b", "c")).weights)
    out = M.resampled(df, m, {"a": 0.4, "b": 0.4, "c": 0.2})
    assert out.columns == df.columns
    full = {r.doc_id: r.copies for r in M.mixed(df, m, {"a": 0.4, "b": 0.4, "c": 0.2})[0].collect()}
    assert len(full) == len(rows)
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: c for i, c in full.items() if c})


def test_label_domains(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 0), (4, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.domain for r in M.label_domains(labels).collect()} == {1: "toxic", 2: "clean", 3: "low", 4: None, 5: "toxic"}


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1, "a b", "a", 0.0), (2, None, "a", 0.0)], SCHEMA)
    one = M.learn(df, df, ("a", "b"))
    assert {(r.doc_id, r.n_tokens, r.rate > 0) for r in M.mixed(df, one, {"a": 1.0, "b": 0.0})[0].collect()} == {(1, 2, True), (2, 0, True)}
    none = M.learn(df.limit(0), df.limit(0), ("a", "b"))
    assert M.mixed(df.limit(0), none, {"a": 1.0, "b": 1.0})[0].count() == 0
    assert M.mixed(df.where(F.col("text").isNull()), one, {"a": 1.0})[0].first().rate == 1.0


def test_very_long_text_and_columns_of_the_operators_names(spark, model):
    long_ = "rose ruby the of " * 300_000
    df = spark.createDataFrame([(1, long_, "x", 99, -7.5), (2, None, "y", 98, -8.5), (None, "sea sky", "z", 97, -9.5)], "doc_id long, text string, posterior string, copies int, rate double")
    rows, _ = M.mixed(df, model, {"a": 1.0, "b": 1.0, "c": 1.0})
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].n_tokens == 1_200_000 and got[1].posterior[0] > 0.9 and got[2].n_tokens == 0 and len(got) == 3
    kept = M.resampled(df, model, {"a": 1.0, "b": 1.0, "c": 1.0}).collect()
    assert {tuple(r)[2:] for r in kept} <= {("x", 99, -7.5), ("y", 98, -8.5), ("z", 97, -9.5)} and kept
