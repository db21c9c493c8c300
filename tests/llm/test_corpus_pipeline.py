"""The pipeline against plain versions of its stages, one after another."""

import random

import numpy as np
import pytest

import corpus_pipeline as C
from bitloom.llm import mixing as M
from bitloom.llm import piece_codec as P
from tests.llm import test_language_id as language
from tests.llm import test_near_dedup as near
from tests.llm import test_secret_scan as secrets

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(P.MODEL), reason="no vocabulary files")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    rows = []
    for lang, syllables in (("aa", ["the", "ing", "tion", "sh"]), ("bb", ["ung", "sch", "ei", "ß"])):
        for _ in range(40):
            words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 80))]
            rows.append([" ".join(words), lang])
    for i in range(0, 60, 3):
        w = rows[i][0].split()
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        rows.append([" ".join(w), rows[i][1]])
    for i in range(5, 60, 9):
        rows[i][0] += " password = 'Ab3dEf6hIj9kLm' end"
    for i in range(1, 60, 7):
        rows[i][0] = "#### " * 30 + rows[i][0]
    rows += [[None, "aa"], ["", "bb"], ["123 456 !!!", "aa"], ["the", None]]
    ids = rng.sample(range(5000), len(rows))
    return [(i, t, lang, "s", len(t or "")) for i, (t, lang) in zip(ids, rows, strict=True)]


def redacted(text):
    out, at = "", 0
    for a, _, b in secrets.plain(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_against_plain_stages(spark, tmp_path):
    rng = random.Random(8)
    docs = corpus(rng)
    labels = [(i, int("####" not in (t or "")), int(n % 29 == 0)) for n, (i, t, *_) in enumerate(docs)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    counts = {}
    for _, t, lang, *_ in docs:
        if lang:
            counts.setdefault(lang, language.Counter()).update(language.plain_grams(t))
    profiles = {lang: language.rank(n, 400) for lang, n in counts.items()}
    one = [d for d in docs if language.plain_predict(profiles, d[1], 400)[0] != "und" and language.plain_predict(profiles, d[1], 400)[1] > 0]
    kept = {i for i, _, _, stays in near.plain([(d[0], d[1]) for d in one], 5) if stays}
    three = {d[0]: redacted(d[1]) for d in one if d[0] in kept}
    assert len(docs) - 4 < len(one) < len(docs) and len(three) < len(one) - 15 and any("[SECRET]" in t for t in three.values())

    # The mixture: the same classifier, its rates by a plain loop over the documents.
    domain = {i: "toxic" if tox else "clean" if q else "low" for i, q, tox in labels}
    frame = spark.createDataFrame(list(three.items()), "doc_id long, text string")
    model = M.learn(frame, spark.createDataFrame(list(domain.items()), "doc_id long, domain string"), M.LABEL_DOMAINS)
    found = {i: M.features(t, M.Marks()) for i, t in three.items()}
    p = np.array([M.stepped(model.posterior(f)) for f in found.values()])
    n = np.array([f[2] for f in found.values()], float)
    share = n @ p / n.sum()
    want = np.array([M.TARGETS[d] for d in M.LABEL_DOMAINS]) * C.BUDGET / sum(M.TARGETS.values())
    r = np.ones(len(p))
    for _ in range(5000):
        r = np.clip(r - 0.5 * (p @ (((n * r) @ p / n.sum() - want) / np.maximum(share, 1e-9)) + 1e-3 * (r - 1)), 0, M.MOST)
    rows, plan = M.mixed(frame, model, M.TARGETS, C.BUDGET, M.MOST)
    mixed = {x.doc_id: x for x in rows.collect()}
    copies = {i: x.copies for i, x in mixed.items()}
    cost = lambda r: ((((n * r) @ p / n.sum() - want) ** 2 / np.maximum(share, 1e-9)).sum() + 1e-3 * (n * (r - 1) ** 2).sum() / n.sum()) / 2
    got_rates = np.array([mixed[i].rate for i in found])
    assert cost(got_rates) <= cost(r) + 0.02 * cost(np.ones(len(p)))  # of what there was to gain, 98 %
    assert (n * got_rates) @ p / n.sum() == pytest.approx(plan.reached, abs=1e-6) and plan.wanted == pytest.approx(want)
    assert all(c in (int(mixed[i].rate), int(mixed[i].rate) + 1) for i, c in copies.items())

    codec = P.Codec(P.Pieces.load())
    final = sorted((i, tuple(codec.encode(three[i]).tolist())) for i, c in copies.items() for _ in range(c))
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, tuple(x.ids)) for x in got) == final and all(x.round_trip and x.n_tokens == len(x.ids) for x in got)
    clean = [i for i, d in domain.items() if d == "clean" and i in three]
    assert sum(copies[i] > 0 for i in clean) / len(clean) > 0.75


def test_stages_keep_extra_and_clashing_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = [("rate", "double", -7.5), ("posterior", "array<int>", [1]), ("score", "string", "x"), ("copies", "int", 99), ("n_tokens", "long", 5), ("spans", "string", "y"), ("id", "int", 8), ("hash", "int", 9), ("kept", "int", 3), ("c0", "int", 4), ("row", "int", 6), ("lang_pred", "string", "z")]
    values = [v for *_, v in own]
    rows = [(1, "the thing is here", "aa", "s", 17, *values), (1, "the thing is here", "aa", "s", 17, *values), (None, None, None, None, None, *[None] * len(own))]
    extra = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} {t}" for n, t, _ in own))
    for df in (extra, extra.limit(0)):
        docs = df
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == df.columns, name
            assert all(tuple(x) == rows[0] for x in docs.collect() if x.doc_id is not None), name
        assert {x.doc_id for x in docs.collect()} <= {1}
        assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= 2
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mixing", "piece_encoding"]


@pytest.mark.parametrize("natural", [(0.5, 0.3, 0.2), (0.8, 0.1, 0.1), (0.05, 0.05, 0.9), (0.0, 0.0, 1.0)])
def test_the_mixture_meets_its_targets_whatever_the_natural_shares(spark, tmp_path, natural):
    rng = random.Random(13)
    own = {"clean": ["rose", "ruby", "coral"], "low": ["sky", "sea", "lake"], "toxic": ["moss", "leaf", "grass"]}
    domain = [d for d, share in zip(M.LABEL_DOMAINS, natural, strict=True) for _ in range(round(1000 * share))]
    docs = [(i, " ".join(rng.choice(own[d] + ["the", "of"]) for _ in range(20)), "aa", "s", 1) for i, d in enumerate(domain)]
    labels = [(i, int(d == "clean"), int(d == "toxic")) for i, d in enumerate(domain)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = C.to_target_mixture(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), str(tmp_path)).collect()
    got = [sum(domain[x.doc_id] == d for x in out) / len(docs) for d in M.LABEL_DOMAINS]
    # As far as the greatest rate goes.
    want = [min(C.BUDGET * M.TARGETS[d], M.MOST * share) for d, share in zip(M.LABEL_DOMAINS, natural, strict=True)]
    assert got == pytest.approx(want, abs=0.04)


def test_texts_of_languages_not_learnt_go(spark):
    known = [d for d in corpus(random.Random(14)) if d[2] and len(d[1] or "") > 20]
    short = [(6000 + i, " ".join(d[1].replace("#", "").split()[:4]), None, "s", 1) for i, d in enumerate(known)]
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах a",
        "aGVsbG8gd29ybGQgYmFzZTY0IGp1bmsgd2l0aG91dCBhbnkgbWVhbmluZyBhdCBhbGwsIGl0IGp1c3QgZ29lcyBvbg==",
    ]
    rows = [*known, *short, *((9000 + i, t, None, "s", 1) for i, t in enumerate(strange))]
    got = {x.doc_id for x in C.known_language(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}
    assert got == {d[0] for d in known + short}
