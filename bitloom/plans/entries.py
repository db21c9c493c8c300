"""Registered queries of the parallel-corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.columns import dealt
from bitloom.functions.scratch import Scratch
from bitloom.functions.text import n_tokens
from bitloom.operators import encode, lexical, lexicon, metrics, sample, splits, stats, training, translate, views, word_table
from bitloom.operators.qc import EVAL, REMOVED, TRAIN, QcPolicy, accepted, add_features, apply_qc, clean, counted_qc, dedup_first, removed_counts
from bitloom.plans import oracles
from bitloom.sources import files, workbook_format
from bitloom.sources.files import Columns, unpivot_names
from bitloom.sources.tables import SYSTEMS, document_pairs, hypotheses, turn_pairs

HOLDOUT = ("src19",)
SAMPLE = 28
Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return clean(document_pairs(spark, d))


def _qc(spark: SparkSession, d: str, policy: QcPolicy) -> DataFrame:
    return apply_qc(_pairs(spark, d), policy)


def _grouped(spark: SparkSession, d: str, policy: QcPolicy, fallback: str) -> DataFrame:
    return _qc(spark, d, policy).withColumn("group_id", splits.group_id(fallback))


def _once(spark: SparkSession, d: str, policy: QcPolicy, fallback: str) -> DataFrame:
    """Quality control and deduplication are run once and written, as a split reads its rows for the groups and for themselves."""
    return Scratch(spark).keep(_grouped(spark, d, policy, fallback))


def _stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(_once(spark, d, TRAIN, "line"), HOLDOUT)


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_shuffle_split(_once(spark, d, EVAL, "document"))


def _hyps(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses(_stratified(spark, d).where("split = 'test'"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    sides = F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("text")) for s in ("src", "tgt")))
    return _qc(spark, d, TRAIN).select("ord", F.explode(sides).alias("x")).select("x.system", "ord", "x.text")


@query
def pairs_clean(spark, d):
    return _pairs(spark, d)


@query
def turn_pairs_eval(spark, d):
    return apply_qc(clean(turn_pairs(spark, d)), EVAL).select("source_doc", "line_id", "src", "tgt")


@query
def qc_features(spark, d):
    counts = ["src_chars", "tgt_chars", "src_tokens", "tgt_tokens"]
    return add_features(_pairs(spark, d)).select("line_id", *counts, F.round("len_ratio", 6).alias("len_ratio"))


@query
def qc_train(spark, d):
    return accepted(_pairs(spark, d), TRAIN).select("line_id", "src", "tgt")


@query
def qc_eval(spark, d):
    return accepted(_pairs(spark, d), EVAL).select("line_id", "src", "tgt")


@query
def dedup_doc_scoped(spark, d):
    return dedup_first(_pairs(spark, d), TRAIN.dedup_key).select("source_doc", "line_id", "src", "tgt")


@query
def dedup_global(spark, d):
    return dedup_first(_pairs(spark, d), EVAL.dedup_key).select("source_doc", "line_id", "src", "tgt")


@query
def qc_removed_counts(spark, d):
    return removed_counts(_pairs(spark, d), TRAIN)


@query
def qc_observed_counts(spark, d):
    """The same counts, taken on the way by the run that writes the accepted segments."""
    rows, counts = counted_qc(_pairs(spark, d), TRAIN)
    Scratch(spark).keep(rows)
    return spark.createDataFrame([tuple(int(counts.get[c] or 0) for c in REMOVED)], ", ".join(f"{c} long" for c in REMOVED))


@query
def corpus_stats_total(spark, d):
    return stats.corpus_stats(_qc(spark, d, TRAIN))


@query
def doc_value_counts(spark, d):
    return stats.value_counts(_qc(spark, d, TRAIN), "source_doc")


@query
def group_ids_line(spark, d):
    return _grouped(spark, d, TRAIN, "line").select("line_id", "group_id")


@query
def group_ids_document(spark, d):
    return _grouped(spark, d, EVAL, "document").select("line_id", "group_id")


@query
def split_stratified(spark, d):
    return _stratified(spark, d).select("line_id", "group_id", "split")


@query
def split_global(spark, d):
    return splits.global_split(_once(spark, d, TRAIN, "line"), HOLDOUT).select("line_id", "group_id", "split")


@query
def group_shuffle_split(spark, d):
    return _shuffled(spark, d).select("line_id", "group_id", "split")


@query
def split_stats(spark, d):
    return stats.split_stats(_stratified(spark, d))


@query
def leak_groups(spark, d):
    return splits.leaks(_stratified(spark, d), ["group_id"])


@query
def leak_pairs(spark, d):
    return splits.leaks(_stratified(spark, d), ["src", "tgt"])


@query
def test_contamination(spark, d):
    test, train = _shuffled(spark, d).where("split = 'test'"), _stratified(spark, d).where("split = 'train'")
    return splits.contamination(test, train).select("source_doc", "line_id")


@query
def view_line(spark, d):
    return views.line_view(_qc(spark, d, TRAIN))


@query
def view_sentence(spark, d):
    return views.sentence_view(_qc(spark, d, TRAIN))


@query
def view_fragment(spark, d):
    return views.fragment_view(_qc(spark, d, TRAIN), "fragment_id")


@query
def view_level(spark, d):
    return views.levels(_qc(spark, d, TRAIN))


@query
def metadata_unpivot(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    named = part.select(
        F.col("p_partkey").cast("string").alias("line_id"),
        F.col("p_name").alias("name_part_src"),
        F.col("p_type").alias("name_part_tgt"),
        F.col("p_brand").alias("name_brand_src"),
        F.when(F.length("p_name") > 12, "N/A").otherwise(F.col("p_brand")).alias("name_brand_tgt"),
    )
    return unpivot_names(named, ["line_id"], Columns())


@query
def char_ngram_stats(spark, d):
    return metrics.ngram_stats(_hyps(spark, d), ("char", "word", "bleu"))


@query
def chrf_scores(spark, d):
    counts = metrics.ngram_stats(_hyps(spark, d), ("char", "word"))
    return metrics.chrf_all(counts).withColumn("score", F.round("score", 4))


@query
def bleu_scores(spark, d):
    return metrics.bleu(metrics.ngram_stats(_hyps(spark, d), ("bleu",))).withColumn("score", F.round("score", 4))


@query
def metric_delta(spark, d):
    scores = metrics.chrf_all(metrics.ngram_stats(_hyps(spark, d).where(F.col("system").isin("sys_lower", "sys_novowel")), ("char", "word")))
    wide = scores.groupBy("word_order", "beta").pivot("system", ["sys_lower", "sys_novowel"]).agg(F.first("score"))
    return wide.select("word_order", "beta", F.round(F.col("sys_lower") - F.col("sys_novowel"), 4).alias("delta"))


@query
def hyp_wide(spark, d):
    return translate.wide(_hyps(spark, d), list(SYSTEMS))


@query
def word_freq_top(spark, d):
    return lexicon.top_words(lexicon.word_freq(_texts(spark, d)), 100)


@query
def word_freq_compare(spark, d):
    return lexicon.compare_top(lexicon.word_freq(_texts(spark, d)), "src", "tgt", 20)


@query
def word_freq_stemmed(spark, d):
    return lexicon.top_words(lexicon.word_freq(_texts(spark, d), lexicon.spanish_stem), 100)


@query
def word_stems(spark, d):
    """The stem of every distinct word."""
    words = lexicon.word_freq(_texts(spark, d)).select("word").distinct()
    return words.select("word", lexicon.spanish_stem(F.col("word")).alias("stem"))


@query
def sample_allocation(spark, d):
    return sample.allocate(_shuffled(spark, d).where("split = 'test'"), SAMPLE)


@query
def stratified_sample(spark, d):
    return sample.stratified_sample(_shuffled(spark, d).where("split = 'test'").withColumnRenamed("line_id", "seg_id"), SAMPLE).select("source_doc", "seg_id", "src", "tgt")


@query
def rating_sheet(spark, d):
    test = _shuffled(spark, d).where("split = 'test'").withColumnRenamed("line_id", "seg_id")
    chosen = sample.stratified_sample(test, SAMPLE).withColumnRenamed("seg_id", "line_id")
    two = ["sys_copy", "sys_lower"]
    return sample.rating_sheet(translate.wide(hypotheses(chosen).where(F.col("system").isin(two)), two), two, "a", "b")


def _translated(spark: SparkSession, d: str) -> DataFrame:
    rows = translate.both_directions(_shuffled(spark, d).where("split = 'test'").withColumnRenamed("line_id", "seg_id"), ("aa", "bb"))
    return translate.translate(rows, [translate.System("back", translate.reversing), translate.System("mark", translate.marking, 8)])


@query
def translate_stub(spark, d):
    return _translated(spark, d).select("seg_id", "direction", "system", "hyp")


def _trained(spark: SparkSession, d: str) -> DataFrame:
    """The test segments in both directions by models learnt from the training segments, after one pass and after five."""
    scratch = Scratch(spark)
    rows = scratch.keep(_stratified(spark, d).select("source_doc", F.col("line_id").alias("seg_id"), "src", "tgt", "split"))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    first, fifth = {}, {}
    for way, pairs in ((("aa", "bb"), train), (("bb", "aa"), train.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))):
        models = [m for m, _ in zip(lexical.epochs(pairs, scratch=scratch), range(lexical.PASSES), strict=False)]
        empty = lexical.learn(pairs, passes=0)
        first[way], fifth[way] = (models[0], models[-1]) if models else (empty, empty)
    # A sentence is searched on its own, so the batch is for speed alone.
    systems = [translate.System("one_pass", translate.lexical(first, batch_size=256), 256), translate.System("five_passes", translate.lexical(fifth, no_repeat=3, batch_size=256), 256)]
    return translate.translate(translate.both_directions(test, ("aa", "bb")), systems)


@query
def trained_translations(spark, d):
    return _trained(spark, d).select("seg_id", "direction", "system", "hyp")


@query
def trained_results(spark, d):
    return metrics.results(_trained(spark, d))


@query
def training_run(spark, d):
    """The ledger of four epochs in either direction, taken up again after two: likelihood of a pair of the dev segments, and which epoch is kept."""
    scratch = Scratch(spark)
    rows = scratch.keep(_stratified(spark, d).select("src", "tgt", "split"))
    back = rows.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "split")
    out = []
    for way, pairs in (("aa-bb", rows), ("bb-aa", back)):
        run = training.Run(spark, scratch.folder("runs"), "words", way)
        for n in (2, 4):
            run.train(pairs.where("split = 'train'"), pairs.where("split = 'dev'"), n)
        best = run.best()
        out += [("words", way, r["epoch"], round(r["dev"], 4), r == best) for r in run.ledger()]
    return spark.createDataFrame(out, "system string, direction string, epoch int, dev_loglik double, kept boolean")


@query
def lexical_table(spark, d):
    """What all words of the training segments become, by three passes over all of their tokens; shares of a hundredth or more."""
    scratch = Scratch(spark)
    return word_table.word_table(scratch.keep(_stratified(spark, d).where("split = 'train'").select("src", "tgt")), 3, 0.01, scratch)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    train = _stratified(spark, d).where("split = 'train'")
    return translate.both_directions(train.withColumnRenamed("line_id", "seg_id"), ("aa", "bb"))


@query
def encoded_examples(spark, d):
    """The training segments in both directions as ids, tagged, cut, batched and padded."""
    scratch = Scratch(spark)
    pairs = scratch.keep(_stratified(spark, d).where("split = 'train'").select("source_doc", F.col("line_id").alias("seg_id"), "src", "tgt"))
    rows = encode.encode_pairs(translate.both_directions(dealt(pairs), ("aa", "bb")), ("aa", "bb"))
    # Written once: batches read the lengths, the counts and the rows.
    own = F.concat_ws("|", "seg_id", "direction").alias("key"), F.size("input_ids").alias("length")
    rows = scratch.keep(rows.select("seg_id", "direction", *own, "input_ids", "attention_mask", "labels"))
    batched = encode.batches(rows, "key", "length")
    return encode.padded(batched).select("seg_id", "direction", "bucket", "batch", "input_ids", "attention_mask", "labels")


def _batched(spark: SparkSession, d: str) -> DataFrame:
    """Lengths are words here, up to the limit, so that SQL can follow."""
    rows = _examples(spark, d).select(F.concat_ws("|", "seg_id", "direction").alias("key"), F.least(n_tokens(F.col("src")), F.lit(encode.LIMIT)).alias("length"))
    return encode.batches(rows, "key", "length")


@query
def length_batches(spark, d):
    return _batched(spark, d).select("key", "length", "bucket", "places", "batch")


@query
def padding_by_bucket(spark, d):
    return encode.padding_share(_batched(spark, d), "length")


@query
def eval_results(spark, d):
    return metrics.results(_translated(spark, d))


@query
def eval_samples(spark, d):
    return metrics.samples(_hyps(spark, d))


@query
def csv_round_trip(spark, d):
    """All turns with their answers, written as CSV in their order and read again as pairs."""
    scratch = Scratch(spark)
    path = scratch.folder("turns")
    files.write_csv(turn_pairs(spark, d).select(F.col("src").alias(" first "), F.col("tgt").alias("second"), "ord"), path, ["ord"])
    return files.csv_pairs(spark, path, "first", "second", "The Turns", scratch=scratch).select("source_doc", "line_id", "src", "tgt", "sheet_name")


@query
def csv_lineage(spark, d):
    """Of each CSV file of the turns, how many pairs it gave, and the first and last of their numbers: without gaps, in the files' order."""
    scratch = Scratch(spark)
    path = scratch.folder("turns")
    files.write_csv(turn_pairs(spark, d).select(F.col("src").alias("first"), F.col("tgt").alias("second"), "ord"), path, ["ord"])
    rows = files.csv_pairs(spark, path, "first", "second", "The Turns", scratch=scratch)
    number = F.regexp_extract("line_id", "_([0-9]+)$", 1).cast("long")
    by_file = rows.groupBy("source_path").agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(F.lit(1)).alias("n"))
    return by_file.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum((F.col("hi") - F.col("lo") + 1 != F.col("n")).cast("long")), F.lit(0)).alias("files_with_gaps"))


@query
def workbook_round_trip(spark, d):
    """The training segments as workbooks by document, with a broken one among them, written and read again by the workbook source."""
    workbook_format.register(spark)
    scratch = Scratch(spark)
    path = scratch.folder("books")
    rows = _qc(spark, d, TRAIN).select("source_doc", F.coalesce("section_id", F.lit("lines")).alias("sheet_name"), "line_id", "fragment_id", "section_id", "src", "tgt", "ord")
    laid = rows.repartitionByRange("source_doc", "ord").sortWithinPartitions("source_doc", "sheet_name", "ord").drop("ord")
    laid.write.format("workbook").mode("append").option("rowsPerFile", 5000).save(path)
    files.write_bytes(spark, f"{path}/part-broken/Broken.xlsx", b"no workbook")
    read = spark.read.format("workbook").load(path)
    return read.select("source_doc", "sheet_name", "line_id", "fragment_id", "section_id", "src", "tgt", F.col("corrupt").isNotNull().alias("corrupt"))


@query
def xlsx_round_trip(spark, d):
    """The nations as a line sheet, and the regions' names as a sheet of name columns, written as a workbook and read again."""
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    has = F.col("n_nationkey") % 3 > 0
    lines = nation.select(F.col("n_name").alias("line_src"), F.lower("n_name").alias("line_tgt"), F.when(has, F.col("n_nationkey")).alias("id_line"), F.col("n_regionkey").alias("id_section")).orderBy("n_nationkey")
    named = region.select(F.col("r_name").alias("name_region_src"), F.when(F.col("r_regionkey") == 2, "N/A").otherwise(F.lower("r_name")).alias("name_region_tgt")).orderBy("r_regionkey")
    scratch = Scratch(spark)
    path = scratch.folder("book")
    files.write_xlsx({"lines": lines, "names": named}, f"{path}/The Nations.xlsx", spark=spark)
    return files.fill_line_ids(files.workbook_pairs(spark, path), scratch).select("source_doc", "line_id", "section_id", "src", "tgt", "sheet_name")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
