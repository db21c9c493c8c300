"""Word frequencies by stem, top lists and their comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.stemming import spanish

#: Letters of a counted word.
LETTERS = "a-záéíóúüñ"
#: More than a text can have words.
PLACES = 1 << 31
#: The words that aren't counted.
STOPWORDS = (
    "de la el en y a que se los las un una con "
    "no lo es su al del por le me te nos les "
    "más si pero ya o era han hay fue ser son "
    "como cuando para esto esta este eso esa ese "
    "sus él ella ellos ellas yo tú tu mi mis "
    "también todo todos toda todas muy bien así "
    "porque entre hasta desde sobre sin ni e u "
    "unos unas an has have the le les nos os"
).split()


def words_of(text: Column, stopwords: list[str] | tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased runs of letters, numbers and underscores that are all Spanish letters, over two long, and no stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda w: F.regexp_like(w, F.lit(f"^[{LETTERS}]+$")) & (F.length(w) > 2) & ~w.isin(list(stopwords)))


def word_freq(texts: DataFrame, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """(system, stem, word, n) of texts(system, ord, text): counts by stem, shown by its most frequent
    surface form, of equal ones the first."""
    spots = texts.select("system", "ord", F.posexplode(words_of(F.col("text"))).alias("at", "word"))
    # Place and row as one number, which a hash aggregation updates in place: the least of structs would sort all words of a task.
    none = F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")
    spot = F.coalesce(F.col("ord").cast("decimal(20,0)"), none) * F.lit(PLACES).cast("decimal(10,0)") + F.col("at")
    forms = spots.groupBy("system", "word").agg(F.count(F.lit(1)).alias("n"), F.min(spot.cast("decimal(31,0)")).alias("first"))
    at = F.pmod("first", F.lit(PLACES).cast("decimal(31,0)"))
    ord_ = F.nullif(((F.col("first") - at) / F.lit(PLACES).cast("decimal(10,0)")).cast("decimal(20,0)"), none).cast(texts.schema["ord"].dataType)
    forms = forms.select("system", "word", "n", F.struct(ord_.alias("ord"), at.cast("int").alias("at")).alias("first"))
    # Stems are taken of distinct words only.
    stemmed = forms.withColumn("stem", stem(F.col("word")) if stem else F.col("word"))
    best = F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("word"))
    return stemmed.groupBy("system", "stem").agg(F.min(best).alias("b"), F.sum("n").cast("long").alias("n"), F.min("first").alias("first")).select("system", "stem", F.col("b.word").alias("word"), "n", "first")


def top_words(freq: DataFrame, k: int) -> DataFrame:
    """(system, rank, word, n): the k most frequent of each system, ties by first occurrence."""
    at = F.row_number().over(Window.partitionBy("system").orderBy(F.desc("n"), "first", "stem"))
    return freq.withColumn("rank", at.cast("long")).where(F.col("rank") <= k).select("system", "rank", "word", "n")


def compare_top(freq: DataFrame, left: str, right: str, k: int = 20) -> DataFrame:
    """The k-th word of one system beside the k-th of the other, as far as both go."""
    top = top_words(freq.where(F.col("system").isin(left, right)), k)
    side = lambda s, tag: top.where(F.col("system") == s).select("rank", F.col("word").alias(f"word_{tag}"), F.col("n").alias(f"count_{tag}"))
    return side(left, "left").join(side(right, "right"), "rank")


def spanish_stem(word: Column) -> Column:
    return spanish(word)
