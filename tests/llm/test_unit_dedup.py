import random
import re
import time

import pytest

from bitloom.llm import unit_dedup as U


def pieces_of(line, at, longest):
    """(start, end, words) of a line's pieces, by a walk over its characters."""
    sentences, here = [], ""
    for i, c in enumerate(line):
        here += c
        if c in ".!?" and line[i + 1 : i + 2] == " ":
            sentences.append((i + 1 - len(here), here))
            here = ""
    sentences.append((len(line) - len(here), here))
    out = []
    for pos, s in sentences:
        spots = [(m.start(), m.end()) for m in re.finditer(r"\S+", s)]
        own = []
        for k, (a, b) in enumerate(spots):
            own.append((a, b))
            if k == len(spots) - 1 or (len(spots) > longest and (b - a + 3 * ord(s[a].lower()) + 5 * ord(s[b - 1].lower())) % 8 == 0):
                out.append((at + pos + own[0][0], at + pos + own[-1][1], [s[x:y].lower() for x, y in own]))
                own = []
    return out


def plain_units(text, pieces=True, least_whole=U.LEAST_WHOLE, longest=U.LONGEST):
    """(start, end, no, words, kind) of pieces, lines and paragraphs."""
    out, at, no = [], 0, 0
    paragraphs, here = [], []
    for line in text.split("\n"):
        if line == "" and here:
            paragraphs.append(here)
            here = []
        here.append((at, line))
        at += len(line) + 1
    for paragraph in [*paragraphs, here]:
        filled = [(a, s) for a, s in paragraph if s.split()]
        first = no
        for a, s in filled:
            lead = a + len(s) - len(s.lstrip())
            whole = (lead, a + len(s.rstrip()), s.lower().split())
            own = pieces_of(s, a, longest) if pieces else [whole]
            is_line = U.LINE if len(whole[2]) >= least_whole else 0
            if len(own) > 1 and is_line:
                out.append((whole[0], whole[1], no, whole[2], U.LINE))
            for x, y, w in own:
                out.append((x, y, no, w, U.PIECE | (is_line if len(own) == 1 else 0)))
                no += 1
        words = [w for _, s in filled for w in s.lower().split()]
        if len(filled) > 1 and len(words) >= least_whole:
            (a, s), (z, t) = filled[0], filled[-1]
            out.append((a + len(s) - len(s.lstrip()), z + len(t.rstrip()), first, words, U.PARAGRAPH))
    return out


def plain(docs, pieces=True, least_words=U.LEAST_WORDS, least_whole=U.LEAST_WHOLE):
    rows = [(i, *u) for i, t in {(i, t) for i, t, *_ in docs if t} for u in plain_units(t, pieces, least_whole)]
    first, later = {}, {}
    for i, a, b, no, w, kind in sorted(rows):
        if " ".join(w) in first:
            later.setdefault(i, []).append((no, kind, a, b, len(w), first[" ".join(w)]))
        else:
            first[" ".join(w)] = i
    out = []
    for i, own in later.items():
        runs = []
        for no in sorted({r[0] for r in own}):
            if runs and runs[-1][-1] == no - 1:
                runs[-1].append(no)
            else:
                runs.append([no])
        for run in runs:
            mine = [r for r in own if r[0] in run]
            parts = [r for r in mine if r[1] & U.PIECE]
            spans = [(r[2], -r[3], 1, r[4], [r[5]]) for r in mine if r[1] & (U.LINE | U.PARAGRAPH)]
            if pieces and sum(r[4] for r in parts) >= least_words:
                a, b = min(r[2] for r in parts), max(r[3] for r in parts)
                spans = [(a, -b, len(parts), sum(r[4] for r in parts), sorted({r[5] for r in parts}))] + [s for s in spans if s[0] < a or -s[1] > b]
            reach = 0
            for a, b, n, words, kept in sorted(spans):
                if -b > reach:
                    out.append((i, a, -b, n, words, kept))
                    reach = -b
    return sorted(out)


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 12))).capitalize() + rng.choice(".!?")
    passages = [rng.choice([" ", "\n"]).join(sentence() for _ in range(rng.randint(1, 8))) for _ in range(6)]
    docs = [(1000, None, 1), (1001, "", 1), (1002, " \n ", 1), (1003, "É a. É A.\né  a.", 1)]
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(1, 9))]
        docs.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts), 1))
    return docs + [docs[20], docs[21], (1004, docs[30][1].upper(), 1)]


@pytest.mark.parametrize("pieces", [True, False])
@pytest.mark.parametrize("least_words, least_whole", [(1, 1), (15, 5), (20, 5)])
@pytest.mark.parametrize("hot", [U.LEAST_HOT, 3])
def test_against_a_plain_pass(spark, pieces, least_words, least_whole, hot, monkeypatch):
    monkeypatch.setattr(U, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(U, "LEAST_HOT", hot)
    docs = corpus(random.Random(4))
    df = spark.createDataFrame(docs, "doc_id long, text string, words int").repartition(5)
    got = sorted((r.doc_id, r.start, r.end, r.n_units, r.n_words, list(r.kept_in)) for r in U.repeats(df, pieces, least_words, least_whole).collect())
    assert got == plain(docs, pieces, least_words, least_whole) and got


def test_units_against_a_walk():
    rng = random.Random(11)
    for k in range(600):
        t = "".join(rng.choice(["ab", " ", "  ", ".", "! ", "\n", "\n\n", "\t", "c", "é", "? ", " d e f g", " hij"]) for _ in range(rng.randint(0, 60)))
        got = U.cut(t, k % 2 == 0, 3, 5)
        rows = sorted((a, b, no, n, kind) for a, b, no, n, kind, _ in zip(*got, strict=True))
        assert rows == sorted((a, b, no, len(w), kind) for a, b, no, w, kind in plain_units(t, k % 2 == 0, 3, 5))
        assert " ".join(t[a:b] for a, b, _, _, kind, _ in zip(*got, strict=True) if kind & U.PIECE).split() == t.split()


def test_removal_keeps_offsets_and_one_copy(spark):
    passage = " ".join(f"Sentence {i} of a passage that returns word for word." for i in range(6))
    docs = [(3, f"Own words here. {passage} More of three.", "x", 7), (1, passage, "y", 8), (2, f"é {passage}", "z", 9), (4, None, "n", 0), (4, "", "n", 0), (5, passage, "q", 1), (5, passage, "q", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string, id int")
    out = U.remove_repeats(df)
    assert out.columns == [*df.columns, "removed"]
    got = out.collect()
    text = {r.doc_id: r.text for r in got}
    assert text[1] == passage and text[3] == "Own words here.  More of three." and text[5] == ""
    assert sorted((r.doc_id, r.row, r.id) for r in got) == sorted((i, x, k) for i, _, x, k in docs)
    original = {i: t for i, t, *_ in docs if t}
    assert all(original[r.doc_id][a:b] in passage for r in got for a, b in r.removed or [])


def test_clean_documents_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Yes. It is so. Alpha beta."), (2, "Yes. It is so. Gamma delta.")], "doc_id long, text string")
    assert U.repeats(df).count() == 0
    assert U.repeats(df.limit(0)).count() == 0
    assert U.remove_repeats(df.limit(0)).count() == 0


def test_passages_without_ends_inside_other_sentences(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(25)]
    docs = [(i, f"{prose(30)} {passages[i % 25]} {prose(30)}") for i in range(75)] + [(i, prose(120)) for i in range(100, 140)]
    got = U.repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {(r.doc_id, r.kept_doc_id) for r in got.collect()}
    # Cuts fall at random, so a few passages have too little between two of them; nothing else is found.
    assert found <= {(i, i % 25) for i in range(25, 75)} and len(found) >= 46
    assert U.repeats(spark.createDataFrame(docs, "doc_id long, text string"), pieces=False).count() == 0


def test_short_lines_and_paragraphs_between_unique_ones(spark):
    rng = random.Random(12)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8))
    licence = "Licensed under the terms of the example public licence, version two."
    menu = "Home\nAbout us\nContact now"
    docs = [(i, f"{own()}\n{licence}\n{own()}\n\n{menu}\n\n{own()} yes it is") for i in range(12)] + [(20, f"{own()}\nyes it is\n{own()}"), (21, f"{own()}\nyes it is\n{own()}"), (22, f"{licence} {own()}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in U.remove_repeats(df).collect()}
    assert licence in got[0].text and menu in got[0].text and got[0].removed is None
    for i in range(1, 12):
        assert licence not in got[i].text and "Contact" not in got[i].text and got[i].text.count("yes it is") == 1
    # A later line goes however short it is, a phrase that is only part of a line stays.
    assert "yes it is" in got[20].text and "yes it is" not in got[21].text and licence in got[22].text
    assert "yes it is" in {r.doc_id: r.text for r in U.remove_repeats(df, least_whole=5).collect()}[21]
    assert sorted((i, a, b) for i, r in got.items() for a, b in r.removed or []) == [x[:3] for x in plain(docs)]


def test_very_long_texts_take_time_in_proportion(spark):
    rng = random.Random(13)
    lines = [" ".join(str(rng.randint(0, 10**9)) for _ in range(12)) for _ in range(40_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[::2])), (3, " ".join("w" * 5 for _ in range(400_000)))]
    began = time.perf_counter()
    got = U.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 90
    assert {(r.doc_id, r.n_words) for r in got if r.doc_id == 2} == {(2, 20_000 * 12)}


def test_each_word_of_a_line_is_lowered_once():
    """Lines aren't lowered beside their sentences, and long sentences' words are measured without another split."""
    lowered = []

    class Text(str):
        def lower(self):
            lowered.append(len(self))
            return str(self).lower()

    line = "One two three. " + " ".join(f"w{i}" for i in range(40)) + ". ΑΣ. İx end."
    want = U.cut(line)
    old, U.SENTENCES = U.SENTENCES, type("Split", (), {"split": staticmethod(lambda t, s=U.SENTENCES: [Text(p) for p in s.split(t)])})
    lines, U.LINES = U.LINES, type("Split", (), {"split": staticmethod(lambda t, s=U.LINES: [Text(p) for p in s.split(t)])})
    try:
        assert U.cut(line) == want and sum(lowered) == len(line)
    finally:
        U.SENTENCES, U.LINES = old, lines
