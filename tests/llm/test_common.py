import os
import random
import threading
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline
from bitloom.llm import common as C
from bitloom.llm import language_id, mixing, piece_codec, secret_scan, token_rollup, toxicity, unit_dedup


def test_work_tables_go_after_the_result(spark):
    df = spark.range(5)
    with C.dropped_after():
        scratch = C.Scratch(spark)
        kept = scratch.keep(df)
        assert kept.count() == 5 and os.path.isdir(scratch.base)
    assert not os.path.isdir(scratch.base)
    other = C.Scratch(spark)
    one, two = other.keep(df), other.keep(df)
    other.drop(0)
    assert not os.path.isdir(f"{other.base}/0") and two.count() == 5 and one.columns == ["id"]
    other.drop()
    assert not os.path.isdir(other.base)


def test_a_cluster_must_name_its_shared_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            C.shared_folder(session(master))


def test_names_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "t", 2, 3.5, "x")], "doc_id long, text string, c0 int, `a.b` double, rate string")
    plain = C.apart(df, "doc_id", "text")
    assert plain.columns == ["doc_id", "text", "c2", "c3", "c4"]
    back = C.together(plain.withColumn("rate", plain.doc_id), df, "doc_id", "text")
    assert back.columns == df.columns and tuple(back.first()) == (1, "t", 2, 3.5, "x")


def test_two_threads_keep_their_tables(spark):
    """A block of one thread doesn't drop what another makes meanwhile."""
    began, ended, found = threading.Event(), threading.Event(), {}

    def other():
        with C.dropped_after():
            scratch = C.Scratch(spark)
            kept = scratch.keep(spark.range(7))
            began.set()
            assert ended.wait(60)
            found["rows"], found["path"] = kept.count(), scratch.base

    with C.dropped_after():
        thread = threading.Thread(target=other)
        thread.start()
        assert began.wait(60)
        mine = C.Scratch(spark)
        mine.keep(spark.range(3))
    assert not os.path.isdir(mine.base)
    ended.set()
    thread.join()
    assert found["rows"] == 7 and not os.path.isdir(found["path"])


ODD = ["a.b", "a `tick", "two words", "c0", "c1", "m0", "score", "posterior", "ids", "lang_pred", "rate", "n_tokens"]


def odd_frame(spark):
    rng = random.Random(1)
    words = ["rose", "sky", "moss", "the", "of", "password = abcdefghijkl9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "aa", "s", 1, *range(len(ODD))) for i in range(40)] + [(None, None, None, None, None, *range(len(ODD)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"x{i} int" for i in range(len(ODD))))
    return df.toDF(*df.columns[:5], *ODD)


@pytest.mark.parametrize("name", ["identify", "keep_known", "posteriors", "rate_of", "mixed", "resampled", "encode", "decode", "score", "count_tokens", "redact", "remove_repeats"])
def test_columns_of_any_name_stay(spark, name):
    df = odd_frame(spark)
    model = lambda: mixing.learn(df, df.selectExpr("doc_id", "IF(doc_id % 2 = 0, 'clean', 'low') AS domain").where("doc_id IS NOT NULL"), ("clean", "low"))
    posts = lambda: mixing.posteriors(df, model())
    plan = mixing.Plan(np.zeros((0, 2)), 1e-3)
    made = {
        "identify": lambda: language_id.identify(df, language_id.learn(df.select("text", "lang"))),
        "keep_known": lambda: language_id.keep_known(df, language_id.learn(df.select("text", "lang"))),
        "posteriors": posts,
        "rate_of": lambda: mixing.rate_of(posts(), plan),
        "mixed": lambda: mixing.mixed(df, model(), {"clean": 0.7, "low": 0.3})[0],
        "resampled": lambda: mixing.resampled(df, model(), {"clean": 0.7, "low": 0.3}),
        "encode": lambda: piece_codec.encode(df, piece_codec.Pieces.load()),
        "decode": lambda: piece_codec.decode(piece_codec.encode(df, piece_codec.Pieces.load(), out="x.y"), piece_codec.Pieces.load(), ids="x.y"),
        "score": lambda: toxicity.score(df, toxicity.learn(df, df.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic"))),
        "count_tokens": lambda: token_rollup.count_tokens(df, token_rollup.ranks(token_rollup.VOCABULARY)),
        "redact": lambda: secret_scan.redact(df),
        "remove_repeats": lambda: unit_dedup.remove_repeats(df),
    }[name]()
    replaced = {"identify": {"lang_pred", "score"}, "posteriors": {"n_tokens", "posterior"}, "rate_of": {"rate", "n_tokens", "posterior"}, "mixed": {"n_tokens", "posterior", "rate", "copies"}, "encode": {"ids"}, "score": {"score"}, "count_tokens": {"n_tokens"}}.get(name, set())
    rows = made.collect()
    assert rows
    for i, c in enumerate(ODD):
        if c not in replaced:
            assert made.columns.count(c) == 1 and {r[made.columns.index(c)] for r in rows} == {i}, c


def test_all_stages_keep_columns_of_any_name(spark, tmp_path):
    df = odd_frame(spark)
    df.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality", "CAST(doc_id % 5 = 0 AS int) AS toxic").where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "labels.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
