"""Zipf's and Heaps' laws. Ranks and running sums go by ranges of their order, so no task sees a whole vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators.prefix import numbered, sums_before

SHARES = (0.10, 0.20, 0.30, 0.35)


def ranked(vocab: DataFrame) -> DataFrame:
    """(term, cf, rank): ranks from 1 by falling frequency, ties by term."""
    return numbered(vocab.select("term", "cf"), [F.desc("cf"), F.asc("term")], "rank")


def zipf_fit(ranks: DataFrame) -> DataFrame:
    """One row (alpha, c): frequency = c * rank ** -alpha, by least squares on logarithms."""
    x, y = F.log("rank"), F.log("cf")
    return ranks.agg((-N.slope(x, y)).alias("alpha"), F.exp(N.intercept(x, y)).alias("c"))


def coverage(ranks: DataFrame) -> DataFrame:
    """``ranks`` with cumulative shares of the text: as counted and under the fitted law."""
    fit = F.broadcast(zipf_fit(ranks))
    model = N.power_law(F.col("c"), F.col("rank").cast("double"), -F.col("alpha"))
    got = sums_before(ranks.join(fit).select("term", "cf", "rank", model.alias("model")), ["rank"], cf_before=F.col("cf"), model_before=F.col("model"))
    total = got.agg(F.sum("cf").alias("all_cf"), F.sum("model").alias("all_model"))
    share = ((F.col("cf_before") + F.col("cf")) / F.col("all_cf")).alias("share")
    return got.join(F.broadcast(total)).select("term", "cf", "rank", share, ((F.col("model_before") + F.col("model")) / F.col("all_model")).alias("model_share"))


def thresholds(covered: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(share_of, n_real, n_model): words needed to reach each share of the text."""
    n = covered.agg(F.count("*").alias("n"))
    wanted = covered.sparkSession.createDataFrame([(float(s),) for s in shares], "share_of double")
    reached = covered.join(F.broadcast(wanted)).groupBy("share_of").agg(F.min(F.when(F.col("share") >= F.col("share_of"), F.col("rank"))).alias("r"), F.min(F.when(F.col("model_share") >= F.col("share_of"), F.col("rank"))).alias("m"))
    return reached.join(F.broadcast(n)).select("share_of", F.coalesce("r", F.col("n") + 1).alias("n_real"), F.coalesce("m", F.col("n") + 1).alias("n_model"))


def pruning(covered: DataFrame, stop: list[str], shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(share_of, n_pruned, n_stop, n_other, stop_percent): stop words among the words that cover each share."""
    cut = F.broadcast(thresholds(covered, shares))
    pruned = covered.join(cut, F.col("rank") <= F.col("n_real"))
    is_stop = F.count(F.when(F.col("term").isin(stop), 1))
    return pruned.groupBy("share_of").agg(F.count("*").alias("n_pruned"), is_stop.alias("n_stop")).select("share_of", "n_pruned", "n_stop", (F.col("n_pruned") - F.col("n_stop")).alias("n_other"), N.percent(F.col("n_stop"), F.col("n_pruned")).alias("stop_percent"))


def heaps_samples(docs: DataFrame, words, every: int = 100) -> DataFrame:
    """(n, v): distinct terms after each ``every`` tokens of the collection read in id order; the tail is left out.

    Documents' offsets are running sums by ranges of ids, and only first occurrences (one row per term) are counted over.
    """
    counted = docs.select("doc_id", words.alias("words")).withColumn("n", F.size("words"))
    offsets = sums_before(counted.select("doc_id", "n"), ["doc_id"], offset=F.col("n"))
    first = counted.select("doc_id", F.posexplode("words").alias("pos", "term")).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    at = first.select(F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos")).join(offsets.select("doc_id", "offset"), "doc_id").select((F.ceil((F.col("offset") + F.col("pos") + 1) / every) * every).cast("long").alias("n"))
    new = at.groupBy("n").agg(F.count("*").alias("new"))
    total = offsets.agg(F.floor(F.sum("n") / every).cast("long").alias("k"))
    steps = total.select(F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("long"), F.col("k"))).otherwise(F.array().cast("array<long>"))).alias("k")).select((F.col("k") * every).alias("n"))
    grown = sums_before(steps.join(new, "n", "left").select("n", F.coalesce("new", F.lit(0)).alias("new")), ["n"], before=F.col("new"))
    return grown.select("n", (F.col("before") + F.col("new")).cast("long").alias("v"))


def heaps_fit(samples: DataFrame) -> DataFrame:
    """One row (k, b): v = k * n ** b by least squares on logarithms."""
    x, y = F.log("n"), F.log("v")
    return samples.agg(F.exp(N.intercept(x, y)).alias("k"), N.slope(x, y).alias("b"))


def heaps_anchored(samples: DataFrame, exponents: tuple[float, ...] = (0.4, 0.5, 0.6)) -> DataFrame:
    """(b, k): the factor that makes the curve pass through the first sample."""
    first = samples.agg(F.min_by("v", "n").alias("v"), F.min("n").alias("n"))
    b = F.explode(F.array(*map(F.lit, exponents))).alias("b")
    return first.select(b, "n", "v").select("b", (F.col("v") / F.pow("n", "b")).alias("k"))
