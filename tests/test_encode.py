import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitloom.operators import encode, translate

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no public vocabulary")


def examples(spark, texts):
    rows = [("d", str(i), a, b) for i, (a, b) in enumerate(texts)]
    return translate.both_directions(spark.createDataFrame(rows, "source_doc string, seg_id string, src string, tgt string"), ("xx", "yy"))


def test_ids_tags_and_limit(spark):
    made, tags = encode._tokenizer(encode.VOCABULARY), encode.tag_ids(("xx", "yy"))
    texts = [("Some words here.", "Otras palabras, aquí."), (None, ""), ("word " * 500, "<|endoftext|> x")]
    df = examples(spark, texts).withColumn("labels", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("c0", F.lit(3)).withColumn("a `tick", F.lit(4))
    got = {(r["seg_id"], r["direction"]): r for r in encode.encode_pairs(df, ("xx", "yy"), limit=32).collect()}
    assert len(got) == 6 and got["0", "xx-yy"]["a.b"] == 2 and got["0", "xx-yy"]["a `tick"] == 4 and got["0", "xx-yy"]["c0"] == 3
    stop = made.token_to_id("<|endoftext|>")
    for i, (a, b) in enumerate(texts):
        r = got[str(i), "xx-yy"]
        plain = lambda t: made.encode(t or "", add_special_tokens=False).ids[:30]
        assert r["input_ids"] == [tags["xx"], *plain(a), stop] and r["labels"] == [tags["yy"], *plain(b), stop]
        assert r["attention_mask"] == [1] * len(r["input_ids"])
        assert got[str(i), "yy-xx"]["labels"][0] == tags["xx"]
    assert len(got["2", "xx-yy"]["input_ids"]) == 32
    assert encode.encode_pairs(df.limit(0), ("xx", "yy")).count() == 0


def test_batches_hold_every_example_once(spark):
    rows = [(f"k{i}", i % 61) for i in range(700)] + [("long", 128)]
    df = spark.createDataFrame(rows, "key string, length int").repartition(3)
    got = encode.batches(df, "key", "length", buckets=5, budget=256).collect()
    assert sorted((r["key"], r["length"]) for r in got) == sorted(rows)
    by = defaultdict(list)
    for r in got:
        by[r["bucket"], r["batch"]].append(r)
        assert r["places"] % 8 == 0 and r["places"] >= max(1, r["length"])
    most = {b: max(r["batch"] for r in got if r["bucket"] == b) for b in {r["bucket"] for r in got}}
    for (bucket, batch), rs in by.items():
        size = max(1, 256 // rs[0]["places"])
        assert len(rs) == size if batch < most[bucket] else 0 < len(rs) <= size
    share = encode.padding_share(encode.batches(df, "key", "length", 5, 256), "length").collect()
    assert sum(r["examples"] for r in share) == 701 and all(0 <= r["padding"] < 1 for r in share)
    assert encode.batches(df.limit(0), "key", "length").count() == 0


def test_padded_lists_are_of_one_length(spark):
    texts = [("a " * n, "b " * (2 * n % 17)) for n in range(1, 40)]
    rows = encode.encode_pairs(examples(spark, texts).withColumn("key", F.concat_ws("|", "seg_id", "direction")), ("xx", "yy"), limit=24)
    batched = encode.batches(rows.withColumn("length", F.size("input_ids")), "key", "length", 3, 128)
    before = {r["key"]: r for r in rows.collect()}
    by = defaultdict(list)
    for r in encode.padded(batched, pad=7).collect():
        by[r["bucket"], r["batch"]].append(r)
        own = before[r["key"]]
        n, m = len(own["input_ids"]), len(own["labels"])
        assert r["input_ids"] == own["input_ids"] + [7] * (r["places"] - n) and r["attention_mask"] == [1] * n + [0] * (r["places"] - n)
        assert r["labels"][:m] == own["labels"] and set(r["labels"][m:]) <= {encode.IGNORED}
    assert sum(map(len, by.values())) == len(before)
    for rs in by.values():
        assert len({len(r["labels"]) for r in rs}) == 1 and len(rs[0]["labels"]) % 8 == 0


def test_examples_are_encoded_once(spark, monkeypatch):
    """Batches read the examples for lengths, for counts and for themselves; the encoding runs for the first of them alone."""
    from bitloom.plans import entries

    made, real = spark.sparkContext.accumulator(0), encode.encode_pairs

    def counted(rows, *a):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        out = real(rows, *a)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(encode, "encode_pairs", counted)
    got = entries.queries()["encoded_examples"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == made.value > 0 and all(r["attention_mask"][0] == 1 and r["input_ids"] for r in got)
