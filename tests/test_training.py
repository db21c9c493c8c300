import os

import numpy as np
import pytest

from bitloom.operators import lexical, training
from tests.test_beam_lexical import pairs


def test_a_model_is_saved_whole_and_in_half_precision(spark, tmp_path):
    model = lexical.learn(pairs(spark, 50)[1], passes=2)
    training.save(spark, model, str(tmp_path / "m"))
    got = training.load(spark, str(tmp_path / "m"))
    assert (got.src, got.tgt, got.ratio, got.loglik) == (model.src, model.tgt, model.ratio, model.loglik)
    assert np.array_equal(got.table, model.table) and np.allclose(got.after, model.after)
    training.save(spark, model, str(tmp_path / "h"), np.float16)
    half = training.load(spark, str(tmp_path / "h"))
    assert half.table.dtype == np.float16 and np.allclose(half.table, model.table, atol=1e-3)


def test_a_run_that_was_stopped_gives_what_one_in_a_piece_gives(spark, tmp_path):
    train, dev = pairs(spark, 120)[1], pairs(spark, 20, seed=9)[1]
    whole = training.Run(spark, str(tmp_path / "a"), "s", "x-y")
    want = whole.train(train, dev, 4)
    broken = training.Run(spark, str(tmp_path / "b"), "s", "x-y")

    def stop(record):
        if record["epoch"] == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        broken.train(train, dev, 4, after=stop)
    assert [r["epoch"] for r in broken.ledger()] == [1, 2]
    # A checkpoint without a record, as of a run killed between the two, is nothing.
    training.save(spark, want, f"{broken.base}/checkpoints/half-done")
    got = broken.train(train, dev, 4)
    assert [r["epoch"] for r in broken.ledger()] == [1, 2, 3, 4]
    assert np.allclose(got.table, want.table, atol=1e-12) and [r["dev"] for r in broken.ledger()] == pytest.approx([r["dev"] for r in whole.ledger()])
    # The last and the best stay.
    assert set(os.listdir(f"{broken.base}/checkpoints")) == {broken.ledger()[-1]["part"], broken.best()["part"]}
    assert broken.best()["dev"] == max(r["dev"] for r in broken.ledger())
    assert broken.saved().table.dtype == np.float16
    # Nothing is left to do, and nothing is done.
    assert np.array_equal(broken.train(train, dev, 4).table, got.table) and len(broken.ledger()) == 4


def test_an_epoch_is_committed_once(spark, tmp_path):
    assert training.write_once(spark, str(tmp_path / "l" / "1.json"), b"one") and not training.write_once(spark, str(tmp_path / "l" / "1.json"), b"two")
    assert (tmp_path / "l" / "1.json").read_bytes() == b"one" and [f for f in os.listdir(tmp_path / "l") if not f.startswith(".")] == ["1.json"]
    none = training.Run(spark, str(tmp_path / "n"), "s", "x-y")
    assert none.train(pairs(spark, 5)[1].limit(0), pairs(spark, 5)[1], 3) is None and none.ledger() == []


def test_dev_pairs_are_encoded_once_for_all_epochs(spark, tmp_path):
    train, dev = pairs(spark, 60)[1], pairs(spark, 20, seed=9)[1]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    run = training.Run(spark, str(tmp_path), "s", "x-y")
    model = run.train(train, dev.mapInArrow(counted, dev.schema), 3)
    assert read.value == 20
    texts = []
    real = training.encoded
    try:
        training.encoded = lambda *a: texts.append(a) or real(*a)
        run.train(train, dev, 6)
    finally:
        training.encoded = real
    assert len(texts) == 1
    loglik, n = lexical.log_likelihood(dev, model)
    assert n == 20 and run.ledger()[2]["dev"] == pytest.approx(loglik / n)
