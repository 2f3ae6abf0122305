"""Language identification from letter statistics. Training texts are (lang, text); tests are (id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numeric import pearson
from tessera.operators import counting, ranking
from tessera.storage import materialize

#: Languages are preferred in this order where scores tie; others follow by name.
PREFERENCE = ("en", "fr", "it")


def profile(texts: DataFrame, key: str) -> DataFrame:
    """(key, letter, freq): relative letter frequencies."""
    n = counting.characters(texts, key, _only_letters(F.col("text"))).groupBy(key, "letter").agg(F.sum("n").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"))
    return n.join(total, key).select(key, "letter", (F.col("n") / F.col("total")).alias("freq"))


def _order(lang: Column) -> Column:
    at = F.lit(len(PREFERENCE))
    for i, name in enumerate(PREFERENCE):
        at = F.when(lang == name, i).otherwise(at)
    return F.struct(-at, F.translate(lang, "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))


def best(scores: DataFrame, floor: float | None) -> DataFrame:
    """(id, lang, score) of the best score above the floor; null where none is."""
    ok = F.col("score").isNotNull() & ~F.isnan("score")
    ok = ok & (F.col("score") > floor) if floor is not None else ok
    rank = F.when(ok, F.struct("score", _order(F.col("lang"))))
    return scores.groupBy("id").agg(F.max_by(F.when(ok, F.col("lang")), rank).alias("lang"), F.max(F.when(ok, F.col("score"))).alias("score"))


def correlation_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, lang, score): correlation of letter frequencies over the common letters."""
    trained = profile(train, "lang").withColumnRenamed("freq", "x")
    tested = profile(test, "id").withColumnRenamed("freq", "y")
    scored = tested.join(trained, "letter").groupBy("id", "lang").agg(pearson(F.col("x"), F.col("y")).alias("score"))
    every = test.select("id").join(F.broadcast(train.select("lang").distinct()))
    return every.join(scored, ["id", "lang"], "left")


def by_correlation(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, lang, score) by letter correlation; the floor is -1."""
    return best(correlation_scores(train, test), -1.0)


def _only_letters(text: Column) -> Column:
    """``T.letters`` as one string."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", "")


def transitions(train: DataFrame) -> DataFrame:
    """(lang, a, b, p): row-normalised transition probabilities between consecutive letters, other characters left out first."""
    pairs = counting.character_pairs(train, "lang", _only_letters(F.col("text"))).groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "letter-pairs")
    rows = pairs.groupBy("lang", "a").agg(F.sum("n").alias("total"))
    return pairs.join(rows, ["lang", "a"]).select("lang", "a", "b", (F.col("n") / F.col("total")).alias("p"))


def _expected(train: DataFrame) -> DataFrame:
    """(a, b, lang, p) of all pairs inside each language's alphabet, p null where training has not seen the pair; grows with alphabets, not with texts."""
    alphabet = materialize(counting.characters(train, "lang", _only_letters(F.col("text"))).groupBy("lang", "letter").agg(F.sum("n").alias("n")), "alphabet").select("lang", "letter")
    inside = alphabet.withColumnRenamed("letter", "a").join(alphabet.withColumnRenamed("letter", "b"), "lang")
    return inside.join(transitions(train), ["lang", "a", "b"], "left").select("a", "b", "lang", "p")


def chain_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, lang, log_p, unseen): log-probability of a text's seen pairs, and the number of pairs inside the language's alphabet that it has never seen.

    The text keeps its case and its other characters; pairs with a character outside the alphabet are skipped. A text's pairs are counted where it is
    read, meet a table as small as the alphabets and are summed before anything is shuffled.
    """
    pairs = counting.character_pairs(test, "id", F.col("text"))
    expected = materialize(_expected(train), "expected-pairs")
    scored = pairs.join(ranking.small(expected), ["a", "b"]).groupBy("id", "lang").agg(F.coalesce(F.sum(F.col("n") * F.log("p")), F.lit(0.0)).alias("log_p"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n"))), F.lit(0)).alias("unseen"))
    every = test.select("id").join(F.broadcast(train.select("lang").distinct()))
    return every.join(scored, ["id", "lang"], "left").select("id", "lang", F.coalesce("log_p", F.lit(0.0)).alias("log_p"), F.coalesce("unseen", F.lit(0)).alias("unseen"))


def by_chain(scores: DataFrame) -> DataFrame:
    """(id, lang, score) with score the log-probability; languages with unseen pairs have probability 0 and can't win."""
    return best(scores.select("id", "lang", F.when(F.col("unseen") == 0, F.col("log_p")).alias("score")), None)


def by_chain_product(scores: DataFrame) -> DataFrame:
    """As ``by_chain`` with the plain product, which is 0 by underflow for long texts."""
    return best(scores.select("id", "lang", F.when(F.col("unseen") == 0, F.exp("log_p")).otherwise(0.0).alias("score")), 0.0)


def accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (n_equal, n_total, percent) over ids in both."""
    both = predicted.select("id", F.col("lang").alias("p")).join(gold.select("id", F.col("lang").alias("g")), "id")
    return both.agg(F.count(F.when(T.same_line(F.col("p"), F.col("g")), 1)).alias("n_equal"), F.count("*").alias("n_total")).withColumn("percent", F.coalesce(F.try_divide(F.col("n_equal") * 100.0, F.col("n_total")), F.lit(0.0)))
