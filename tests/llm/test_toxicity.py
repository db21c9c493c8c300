import itertools
import math
import os
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from bitloom.llm import entries
from bitloom.llm import toxicity as X

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_kernel(s, t):
    def features(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < X.REACH:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + X.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = lambda f: math.sqrt(sum(v * v for v in f.values()))
    return sum(v * b.get(u, 0) for u, v in a.items()) / (norm(a) * norm(b) or 1)


def test_kernel_against_plain_subsequences():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcxyz") for _ in range(rng.randint(3, 20))) for _ in range(30)]
    got = X.kernel(words, X.triple_features(words[:10]))
    for i, s in enumerate(words):
        for j, t in enumerate(words[:10]):
            assert got[i, j] == pytest.approx(plain_kernel(s, t), abs=1e-5)


def test_folded_weights_equal_the_landmark_sum():
    """The machine's one weight per triple gives the same margins as the kernel expansion."""
    rng = np.random.default_rng(1)
    marks = ["badword", "nasty", "clean", "thing"]
    phi, alpha = X.triple_features(marks), rng.normal(size=4)
    m = X.Machine(phi.T @ alpha, 0.25, 1, 0)
    words = ["baadword", "clean", "xx", "thingy", "é", "averyveryverylongwordthatneedswindows"]
    assert m.margins(words)[:5] == pytest.approx(X.kernel(words, phi)[:5] @ alpha + 0.25, abs=1e-5)


def test_spaced_letters():
    assert X.spaced("you i d i o t of a b".split()) == ["idiot"]
    assert X.spaced([]) == []


def corpus(rng, n):
    syll = ["ka", "lo", "mi", "ne", "ru", "ta", "vo", "shi", "po", "de"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 3)))
    insult = ["grubzak", "fwistle", "snorvq", "blexxing"]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(insult))
        rows.append((i, " ".join(w).capitalize() + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def machine():
    rows = corpus(random.Random(2), 600)
    return X.train([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy(spark, machine):
    rows = corpus(random.Random(3), 400)
    df = spark.createDataFrame([(i, t, y, "q") for i, t, y in rows], "doc_id long, text string, toxic int, score string")
    got = X.score(df, machine).collect()
    assert len(got) == 400
    hit = sum((r.score >= 0.7) == (r.toxic == 1) for r in got)
    assert hit / len(got) > 0.97


def test_gapped_and_inserted(machine):
    s = X.Scorer(machine)
    plain, *odd = s.scores(["kalo mine grubzak ruta", "kalo mine gru.bzak ruta", "kalo mine g r u b z a k ruta", "kalo mine grubzaak ruta", "kalo mine grubbzak ruta"])
    clean = s.scores(["kalo mine taruka ruta"])[0]
    assert plain > 0.7 and min(odd) > 0.7 and clean < 0.2


def test_learning_from_tables(spark):
    rows = corpus(random.Random(4), 300)
    df = spark.createDataFrame(rows + [(900, None, 1), (901, "x", None), (902, "", 0)], "doc_id long, text string, toxic int")
    a, b = X.learn(df.repartition(3), df), X.learn(df.repartition(7), df.union(df))
    assert a.landmarks == b.landmarks and np.allclose(a.weights, b.weights)
    got = {r.doc_id: r.score for r in X.score(df, a).where("doc_id >= 900").collect()}
    assert got[900] == got[902] < 0.2


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, toxic int")
    m = X.learn(df, df)
    assert X.score(df, m).first().score < 1e-6
    assert X.score(df.limit(0), m).count() == 0 and X.learn(df.limit(0), df.limit(0)).landmarks == ()


def test_long_texts_and_words(machine):
    s = X.Scorer(machine)
    assert all(0 <= p <= 1 for p in s.scores(["z" * 5000, "kalo " * 20_000, None, "😀 \n", "a" * 24 + "grubzak"]))


def test_sentences_of_toxic_documents_are_not_all_toxic():
    """Training is on sentences: what stands beside a toxic one isn't learnt as toxic, though it never stands in clean documents."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    sentence = lambda *own: " ".join([word() for _ in range(8)] + list(own)).capitalize() + "."
    rows = []
    for i in range(500):
        toxic = i % 3 == 0
        body = [sentence() for _ in range(rng.randint(2, 6))]
        if toxic:
            body.append(sentence(rng.choice(["grubzak", "fwistle", "snorvq"])))
        rows.append((" ".join(body), int(toxic)))
    s = X.Scorer(X.train([t for t, _ in rows], [y for _, y in rows]))
    beside = [t.rsplit(". ", 1)[0] + "." for t, y in rows if y]
    assert np.mean(np.array(s.scores(beside)) >= 0.7) < 0.05
    assert np.mean(np.array(s.scores([sentence(w) for w in ("grubzak", "fwistle", "snorvq") for _ in range(30)])) >= 0.7) > 0.95


def plain_scores(machine, texts):
    """Each text's score by a walk over the letters of its words."""

    def code(c):
        if c.isalpha():
            low = unicodedata.normalize("NFKD", c.lower())[0]
            return ord(low) - 96 if "a" <= low <= "z" else 28 + ord(c) % 4
        return 27 if c.isdigit() else 0

    def margin(unit):
        letters = [k for k in map(code, unit) if k]
        if len(letters) < 3:
            return machine.bias
        n = X.LONGEST
        windows = [letters] if len(letters) <= n else [letters[i : i + n] for i in [*range(0, len(letters) - n, n // 2), len(letters) - n]]
        best = -math.inf
        for w in windows:
            triples = defaultdict(float)
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + X.REACH)):
                        triples[(w[i] * X.BASE + w[j]) * X.BASE + w[k]] += X.DECAY ** (k - i + 1)
            norm = math.sqrt(sum(v * v for v in triples.values()))
            best = max(best, sum(machine.weights[t] * v for t, v in triples.items()) / norm + machine.bias)
        return best

    known = {}
    out = []
    for t in texts:
        words = (t or "").lower().split()
        runs, run = [], []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
            else:
                runs += ["".join(run)] * (len(run) > 2)
                run = []
        most = max((known.setdefault(u, margin(u)) if u not in known else known[u] for u in words + runs), default=machine.bias)
        out.append(machine.floor + (1 - machine.floor) / (1 + math.exp(-max(-500, min(500, machine.slope * most + machine.shift)))))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_query_against_a_plain_version(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    toxic = {}
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        if not held(r["doc_id"]) and r["toxic"] is not None:
            toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"])
    fit = sorted((d["doc_id"], d["text"]) for d in docs if d["doc_id"] in toxic and d["text"] is not None and len(d["text"]) <= X.SAMPLE_CHARS)
    machine = X.train([t for _, t in fit], [toxic[i] for i, _ in fit])
    want = {d["doc_id"]: s for d, s in zip(docs, plain_scores(machine, [d["text"] for d in docs]), strict=True)}
    got = entries.op1_toxicity(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held(r.doc_id) and r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == int(r.score >= 0.7)
