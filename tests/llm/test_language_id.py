import random
from collections import Counter

import pytest

from bitloom.llm import language_id as L


def plain_grams(text):
    n = Counter()
    word = ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            padded = f" {word} "
            n.update(padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1) if padded[i : i + k] != " ")
            word = ""
    # A blank between two words belongs to both; it is no n-gram by itself, and no n-gram spans it.
    return n


def rank(n, size):
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][:size]


def plain_predict(profiles, text, size):
    own = rank(plain_grams(text), size)
    if not own:
        return "und", 0.0
    far = {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) / len(own) / size for lang, p in profiles.items()}
    best = min(sorted(far), key=lambda x: far[x])
    return best, 1 - far[best]


def corpus(rng):
    syllables = {"aa": ["the", "ing", "tion", "sh"], "bb": ["ung", "sch", "ß", "ei"], "cc": ["é", "eau", "oi", "ou"]}
    rows = []
    for i in range(150):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words).title() if i % 3 else " ".join(words), lang if i % 11 else None, "x"))
    return rows + [(900, None, "aa", None), (901, "", "bb", None), (902, "123 !?", "cc", None), (903, "日本 x", None, None), (904, "İstanbul ǅ a" * 50, "aa", None)]


@pytest.mark.parametrize("size", [12, 400])
def test_against_plain_profiles(spark, size):
    rows = corpus(random.Random(size))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(5)
    profiles = L.learn(df, size, shares=3)
    counts = {}
    for _, t, lang, _ in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    plain = {lang: rank(n, size) for lang, n in counts.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, profiles).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        want = plain_predict(plain, t, size)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1])


def test_counts_do_not_depend_on_batches(spark):
    df = spark.createDataFrame(corpus(random.Random(1)), "doc_id long, text string, lang string, x string")
    a = {tuple(r) for r in L.gram_counts(df.coalesce(1)).collect()}
    b = {tuple(r) for r in L.gram_counts(df.repartition(7), at_once=10).collect()}
    assert a == b


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    profiles = L.learn(df.where("doc_id % 4 <> 2").drop("lang_pred"))
    got = L.identify(df.where("doc_id % 4 = 2 AND lang IS NOT NULL AND doc_id < 900"), profiles).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    kept = L.keep_known(df, profiles)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, *_ in rows[:150]}
    assert not {900, 901, 902} & {r.doc_id for r in kept.collect()}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    p = L.learn(df)
    assert L.identify(df, p).count() == 0 and p.predict("abc") == ("und", 0.0)


def test_very_long_text_and_letters_of_all_planes(spark):
    rows = corpus(random.Random(9))
    long_ = " ".join(t for _, t, lang, _ in rows if lang == "bb") * 200 + " \U00031350\U00020000"
    df = spark.createDataFrame(rows + [(950, long_, None, "x"), (951, "\U00031350", None, "x")], "doc_id long, text string, lang string, x string")
    profiles = L.learn(df)
    counts = {}
    for _, t, lang, _ in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    plain = {lang: rank(n, L.PROFILE) for lang, n in counts.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df.where("doc_id >= 950"), profiles).collect()}
    for i, t in ((950, long_), (951, "\U00031350")):
        want = plain_predict(plain, t, L.PROFILE)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1])
    assert got[950][0] == "bb" and got[951][0] != "und"
