import math
import time
from collections import Counter

import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions.stemming import ACCENTED_VERBS, E_VERBS, PRONOUNS, SUFFIXES, VERBS, Y_VERBS
from tests.plain_stemmer import spanish
from bitloom.operators import lexicon, metrics, translate

PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def hyps(spark, rows):
    return spark.createDataFrame([(str(i), s, h, r) for i, (s, h, r) in enumerate(rows)], "seg_id string, system string, hyp string, ref string")


def grams(x, n):
    return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))


def words(t):
    out = []
    for w in t.split():
        out += [w] if len(w) < 2 else [w[:-1], w[-1]] if w[-1] in PUNCT else [w[0], w[1:]] if w[0] in PUNCT else [w]
    return out


def plain_chrf(pairs, word_order, beta):
    p = r = k = 0
    for cut, orders in ((lambda t: "".join(t.split()), 6), (words, word_order)):
        for n in range(1, orders + 1):
            h = g = m = 0
            for hyp, ref in pairs:
                a, b = grams(cut(hyp), n), grams(cut(ref), n)
                h += sum(a.values()) if b else 0
                g += sum(b.values())
                m += sum((a & b).values())
            if h and g:
                p, r, k = p + m / h, r + m / g, k + 1
    p, r = p / k, r / k
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


ROWS = [("a", "the cat sat on the mat.", "the cat sat on a mat."), ("a", "hello (world)", "hello, world"), ("a", "x", "yy zz"), ("b", "niño 😀 go", "niña 😀 go"), ("b", "", "empty"), ("b", "It's 3.5-4 km &amp; more!", "It's 3.5-4 km and more!"), ("c", "qq", "zz")]


def test_chrf_against_plain_counts(spark):
    stats = metrics.ngram_stats(hyps(spark, ROWS), ("char", "word"))
    for w in (0, 2):
        for beta in (1, 2):
            got = {r.system: r.score for r in metrics.chrf(stats, w, beta).collect()}
            for s in "abc":
                assert got[s] == pytest.approx(plain_chrf([(h, r) for x, h, r in ROWS if x == s], w, beta))


def test_many_rows_are_counted_in_time_and_like_plain_counts(spark):
    """Rows of several slices, groups of null and of several columns; a long pair takes no time that grows with its n-grams' number squared."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abé 😀.") for _ in range(rng.randrange(12)))
    rows = [(rng.choice(["x", None]), rng.choice("pq"), text(), text()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "`a b` string, k string, hyp string, ref string").coalesce(1)
    got = {(r["a b"], r.k, r.n): (r.hyp, r.hyp_all, r.ref, r.match) for r in metrics.ngram_stats(df, ("char",), ("a b", "k")).collect()}
    cut = lambda t: "".join(t.split())
    for a, k in {r[:2] for r in rows}:
        for n in range(1, 7):
            both = [(grams(cut(h), n), grams(cut(r), n)) for x, y, h, r in rows if (x, y) == (a, k)]
            assert got[a, k, n] == (sum(h.total() for h, r in both if r), sum(h.total() for h, _ in both), sum(r.total() for _, r in both), sum((h & r).total() for h, r in both))
    assert metrics.ngram_stats(df.limit(0), ("char", "bleu"), ("a b", "k")).count() == 0
    started = time.monotonic()
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(400_000))
    stats = metrics.ngram_stats(hyps(spark, [("s", long, long)]), ("char",)).collect()
    assert len(stats) == 6 and all(r.match == r.hyp == r.ref > 1_000_000 for r in stats) and time.monotonic() - started < 20


def test_equal_texts_score_100_and_word_splits(spark):
    same = hyps(spark, [("s", t, t) for t in ("A full sentence, with words enough.", "Another one here: also long!")])
    stats = metrics.ngram_stats(same, ("char", "word", "bleu"))
    assert {round(r.score, 9) for r in metrics.chrf_all(stats).collect()} == {100.0}
    assert metrics.bleu(stats).first().score == pytest.approx(100)
    got = spark.createDataFrame([("(a) b, . x.. 'q'",)], "t string").select(metrics.chrf_words(F.col("t"))).first()[0]
    assert got == words("(a) b, . x.. 'q'")


def test_bleu_by_hand(spark):
    # 6 tokens against 6: 5 unigrams, 3 bigrams, 2 trigrams and 1 four-gram match.
    one = metrics.ngram_stats(hyps(spark, [("s", "a b c d x f", "a b c d e f")]), ("bleu",))
    assert metrics.bleu(one).first().score == pytest.approx(100 * (5 / 6 * 3 / 5 * 2 / 4 * 1 / 3) ** 0.25)
    # Shorter by two; no four-gram: the count of zeros halves 1/total.
    two = metrics.ngram_stats(hyps(spark, [("s", "a b x d", "a b c d e f")]), ("bleu",))
    assert metrics.bleu(two).first().score == pytest.approx(100 * math.exp(1 - 6 / 4) * (3 / 4 * 1 / 3 * 1 / (2 * 2) * 1 / (4 * 1)) ** 0.25)


def test_systems_without_a_match_or_without_output_score_0(spark):
    rows = [("none", "", "a b c d e"), ("none", None, "f g"), ("other", "q r s t u", "a b c d e"), ("same", "a b c d e", "a b c d e"), ("short", "a b", "a b")]
    stats = metrics.ngram_stats(hyps(spark, rows), ("char", "word", "bleu"))
    assert {r.system: round(r.score, 6) for r in metrics.bleu(stats).collect()} == {"none": 0, "other": 0, "same": 100, "short": 0}
    for r in metrics.chrf_all(stats).collect():
        assert round(r.score, 6) == {"none": 0, "other": 0, "same": 100, "short": 100}[r.system], (r.system, r.word_order, r.beta)


def test_results_summary_and_samples(spark):
    rows = spark.createDataFrame([("d", "2", "a-b", "x", "s", "the cat sat here", "the cat sat here"), ("d", "1", "a-b", "y", "s", "one two", "one two"), ("d", "1", "b-a", "y", "s", "", "z")], "source_doc string, seg_id string, direction string, src string, system string, hyp string, ref string")
    table = metrics.results(rows)
    assert table.columns == ["system", "direction", "BLEU", "ChrF", "ChrF++", "ChrF2", "ChrF2++"]
    assert {tuple(r) for r in table.collect()} == {("s", "a-b", *[100.0] * 5), ("s", "b-a", *[0.0] * 5)}
    assert metrics.summary(table).splitlines()[1].split() == ["s", "a-b", *["100.00"] * 5]
    assert [r.seg_id for r in metrics.samples(rows.where("direction = 'a-b'"), 1).collect()] == ["1"]


def test_13a_tokens(spark):
    df = spark.createDataFrame([("He said: \"3,000.5 km!\" - a-b 9-10 &quot;x&quot;.",)], "t string")
    assert df.select(metrics.bleu_tokens(F.col("t"))).first()[0] == ["He", "said", ":", '"', "3,000.5", "km", "!", '"', "-", "a-b", "9", "-", "10", '"', "x", '"', "."]


def test_word_frequencies(spark):
    df = spark.createDataFrame([("s", 1, "Casa casas la CASA x1 ñandú sol"), ("s", 2, "casas perro de casas Sol")], "system string, ord long, text string")
    freq = lexicon.word_freq(df)
    assert [(r.word, r.n) for r in lexicon.top_words(freq, 3).orderBy("rank").collect()] == [("casas", 3), ("casa", 2), ("sol", 2)]
    stems = {r.stem: (r.word, r.n) for r in lexicon.word_freq(df, lexicon.spanish_stem).collect()}
    assert stems["cas"] == ("casas", 5)
    both = lexicon.word_freq(df.union(df.selectExpr("'t'", "ord", "'perro gato'")))
    assert [(r["rank"], r.word_left, r.word_right) for r in lexicon.compare_top(both, "s", "t", 20).orderBy("rank").collect()] == [(1, "casas", "perro"), (2, "casa", "gato")]


def test_words_are_counted_by_hash_and_their_first_place_is_exact(spark):
    """No task sorts its words; places of the largest and of negative rows are right."""
    big = (1 << 63) - 1
    df = spark.createDataFrame([("s", big, "uno dos tres"), ("s", big - 1, "cuatro tres uno"), ("s", -big, "cinco seis"), ("s", -5, "seis siete"), ("s", None, "nada"), ("s", 3, "siete nada")], "system string, ord long, text string")
    freq = lexicon.word_freq(df)
    got = {r.word: (r.first["ord"], r.first["at"]) for r in freq.collect()}
    assert got == {"uno": (big - 1, 2), "dos": (big, 1), "tres": (big - 1, 1), "cuatro": (big - 1, 0), "cinco": (-big, 0), "seis": (-big, 1), "siete": (-5, 1), "nada": (None, 0)}
    plan = freq._jdf.queryExecution().sparkPlan().toString()
    by_word = [line for line in plan.splitlines() if "Aggregate(key" in line and "word#" in line.split("functions=")[0]]
    assert by_word and not any("SortAggregate" in line for line in by_word)


# From the public sample vocabulary of the algorithm.
@pytest.mark.parametrize("word,stem", [
    ("cheque", "chequ"), ("chico", "chic"), ("chicas", "chic"), ("chihuahua", "chihuahu"), ("chillaba", "chill"), ("chimenea", "chimene"), ("chinos", "chin"), ("chocolate", "chocolat"),
    ("torneado", "torn"), ("tórax", "torax"), ("torres", "torr"), ("toreando", "tor"), ("toros", "tor"), ("torpeza", "torpez"), ("torturas", "tortur"),
    ("nacionalidades", "nacional"), ("rápidamente", "rapid"), ("biología", "biolog"), ("soluciones", "solucion"), ("dándole", "dandol"), ("haciéndola", "hac"), ("comprarlo", "compr"), ("construyendo", "constru"), ("paguen", "pag"), ("el", "el"), ("", ""),
])
def test_spanish_stems(word, stem):
    assert spanish(word) == stem


def test_stem_expression_equals_the_plain_stemmer(spark):
    rng = random.Random(5)
    roots = ["habl", "com", "viv", "nacion", "rápid", "biolog", "constru", "pag", "segu", "avergü", "arguy", "a", "o", "é", "niñ", "ll", "c", "actu"]
    middle = ["", "at", "ic", "iv", "abil", "ativ", "os", "ad", "ant", "gu", "u", "uy"]
    ends = ["", *PRONOUNS, *ACCENTED_VERBS, *Y_VERBS, *E_VERBS, *VERBS, *SUFFIXES, "amente", "os", "a", "é", "ándolas", "iéndoselo", "uyendola"]
    words = sorted({rng.choice(roots) + rng.choice(middle) + rng.choice(ends) + rng.choice(["", "", *PRONOUNS]) for _ in range(3000)} | {"", "y", "aé", "ñ", "ÑU", "Él"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = df.select("word", lexicon.spanish_stem(F.col("word")).alias("stem")).collect()
    assert {r.word: r.stem for r in got} == {w: spanish(w) for w in words}
    assert spark.createDataFrame([(None,)], "word string").select(lexicon.spanish_stem(F.col("word"))).first()[0] is None


def test_translate_both_ways(spark):
    pairs = spark.createDataFrame([("d", "1", "ab", "xy"), ("d", "2", "c", "z")], "source_doc string, seg_id string, src string, tgt string")
    rows = translate.both_directions(pairs, ("p", "q"))
    got = translate.translate(rows, [translate.System("rev", translate.reversing), translate.System("mark", translate.marking, 1)])
    assert {(r.seg_id, r.direction, r.system, r.hyp) for r in got.collect()} == {
        ("1", "p-q", "rev", "ba"), ("1", "q-p", "rev", "yx"), ("2", "p-q", "rev", "c"), ("2", "q-p", "rev", "z"),
        ("1", "p-q", "mark", "[p>q] ab"), ("1", "q-p", "mark", "[q>p] xy"), ("2", "p-q", "mark", "[p>q] c"), ("2", "q-p", "mark", "[q>p] z"),
    }
    w = translate.wide(got.where("direction = 'p-q'"), ["rev", "mark"]).orderBy("seg_id").collect()
    assert (w[0].rev, w[0].mark) == ("ba", "[p>q] ab")
    with pytest.raises(RuntimeError, match="torch"):
        translate.neural("nowhere")("p", "q")
    assert translate.missing_artefacts([translate.System("s", translate.marking, paths=(("p-q", "/x"), ("q-p", "/y")))], lambda p: p == "/x") == [("s", "q-p", "/y")]
