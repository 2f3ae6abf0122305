"""Ranked retrieval: one scorer for a whole table of queries at once.

Query terms (qid, term, qtf) meet the postings in one join, weights are an expression, and the best k per query come from a
window over the scored documents. Scores are rounded before they are ordered, so that ties fall the same way everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators import counting
from tessera.storage import materialize

Weight = Callable[[], Column]
DIGITS = 6
BROADCAST_ROWS = 500_000
#: A task groups about this many pairs of query and document at most.
PAIRS_AT_ONCE = 1_000_000


def query_terms(topics: DataFrame, words: Column) -> DataFrame:
    """(qid, term, qtf, first_at) of a words column over ``topics``; qtf keeps repeated terms."""
    return topics.select("qid", F.posexplode(words).alias("at", "term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("at").alias("first_at"))


def matches(postings: DataFrame, queries: DataFrame, vocab: DataFrame, n_docs: Column) -> DataFrame:
    """(qid, doc_id, term, tf, qtf, df, cf, n_docs): postings of the queries' terms, dealt out by document."""
    return by_document(postings, known_terms(queries, vocab).withColumn("n_docs", n_docs))


def known_terms(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``queries`` with (df, cf), terms outside the vocabulary left out; stored, as they are few beside the postings."""
    return materialize(small(materialize(queries, "queries")).join(vocab.select("term", "df", "cf"), "term"), "query-terms")


def small(table: DataFrame) -> DataFrame:
    """A stored table to be broadcast if its rows are few; else joins shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def pairs_of(terms: DataFrame) -> int:
    """How many pairs of query and document the postings of ``terms`` (qid, term, df, perhaps n_docs) make at most: a term has df postings, and no query meets more than all documents."""
    hits = F.sum("df")
    met = terms.groupBy("qid").agg((F.least(hits, F.max("n_docs")) if "n_docs" in terms.columns else hits).alias("n"))
    return met.agg(F.sum("n")).first()[0] or 0


def by_document(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``postings`` joined with a small stored table (qid, term, df, ...) on ``term``.

    Only postings of its terms are shuffled, once, and by document: what is then grouped by query and document is grouped
    in place, and only the best of each task go on. There are as many tasks as the postings' bytes ask for, and as the pairs do that
    are grouped, so that a task's memory grows neither with the collection nor with the number of queries.
    """
    partitions = max(counting.partitions_for(postings), min(counting.MOST_DEALT, -(-pairs_of(terms) // PAIRS_AT_ONCE)))
    terms = small(terms)
    wanted = postings.join(small(materialize(terms.select("term").distinct(), "wanted")), "term", "left_semi")
    return wanted.repartition(partitions, "doc_id").join(terms, "term")


def top(scored: DataFrame, k: int | None, ties: str = "asc", extra: tuple[str, ...] = ()) -> DataFrame:
    """(qid, doc_id, score, rank): the k best of each query by rounded score, then document id."""
    by = F.asc("doc_id") if ties == "asc" else F.desc("doc_id")
    scored = scored.withColumn("score", F.round("score", DIGITS))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *extra, by))
    ranked = scored.withColumn("rank", rank)
    ranked = ranked.where(F.col("rank") <= k) if k else ranked
    return ranked.select("qid", "doc_id", "score", "rank")


def vsm(hits: DataFrame, norms: DataFrame) -> DataFrame:
    """Vector space with log-tf weights; the query's own norm is left out. (qid, doc_id, score)."""
    idf = N.idf_ln(F.col("n_docs"), F.col("df"))
    dot = F.sum((1 + F.log("qtf")) * idf * N.log_tf(F.col("tf"), idf))
    return hits.groupBy("qid", "doc_id").agg(dot.alias("dot")).join(norms, "doc_id").select("qid", "doc_id", N.cosine(F.col("dot"), F.col("norm"), F.lit(1.0)).alias("score"))


def cosine_topk(hits: DataFrame, norms: DataFrame, queries: DataFrame, vocab: DataFrame, n_docs: Column, k: int = 10) -> DataFrame:
    """Cosine with raw tf and base-2 idf; each occurrence of a query term counts; ties to the larger id."""
    idf = N.idf_log2(F.col("n_docs"), F.col("df"))
    q = queries.join(vocab.select("term", "df"), "term").withColumn("n_docs", n_docs).groupBy("qid").agg(F.sqrt(F.sum(F.col("qtf") * idf * idf)).alias("q_norm"))
    dot = hits.groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * idf * N.raw_tf(F.col("tf"), idf)).alias("dot"))
    scored = dot.join(norms, "doc_id").join(q, "qid").select("qid", "doc_id", N.cosine(F.col("dot"), F.col("q_norm"), F.col("norm")).alias("score"))
    return top(scored, k, ties="desc")


def count_scores(hits: DataFrame, order: str = "taat", k: int | None = None) -> DataFrame:
    """Number of query term occurrences that match. ``taat`` orders ties by the first query term that touched the document, ``daat`` by id."""
    scored = hits.groupBy("qid", "doc_id").agg(F.sum("qtf").cast("double").alias("score"), F.min("first_at").alias("touched"))
    return top(scored, k, extra=("touched",) if order == "taat" else ())


def weighted(hits: DataFrame, weight: Column, k: int | None = 10) -> DataFrame:
    """Best k by the sum of a weight expression over a document's matches."""
    return top(hits.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score")), k)


def with_lengths(hits: DataFrame, doc_stats: DataFrame, collection: DataFrame) -> DataFrame:
    """``hits`` with dl, avg_dl and n_tokens. The collection is one row; hits that bring dl along meet no other table."""
    c = collection.select("n_tokens", F.col("avg_dl"))
    if "dl" in hits.columns:
        return hits.join(F.broadcast(c))
    return hits.join(doc_stats.select("doc_id", F.col("n_tokens").alias("dl")), "doc_id").join(F.broadcast(c))


def tf_weight() -> Column:
    """Term frequency."""
    return F.col("tf").cast("double") * F.col("qtf")


def robertson_tf_idf(k1: float = 1.2, b: float = 0.75) -> Column:
    """Robertson's tf times log2(n / df + 1)."""
    tf, dl = F.col("tf"), F.col("dl")
    return F.col("qtf") * (k1 * tf / (tf + k1 * (1 - b + b * dl / F.col("avg_dl")))) * F.log2(F.col("n_docs") / F.col("df") + 1)


def bm25(k1: float = 1.2, b: float = 0.75, k3: float = 8.0) -> Column:
    """Okapi BM25 with query term saturation."""
    tf, dl, qtf = F.col("tf"), F.col("dl"), F.col("qtf")
    idf = F.log2((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return ((k3 + 1) * qtf / (k3 + qtf)) * ((k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / F.col("avg_dl")))) * idf


def hiemstra(lam: float = 0.15) -> Column:
    """Linearly smoothed language model, Hiemstra's form."""
    return F.col("qtf") * F.log(1 + (lam * F.col("tf") * F.col("n_tokens")) / ((1 - lam) * F.col("cf") * F.col("dl")))


def dirichlet(mu: float = 1000.0) -> Column:
    """Language model with Dirichlet smoothing."""
    return F.col("qtf") * (F.log(1 + F.col("tf") / (mu * F.col("cf") / F.col("n_tokens"))) + F.log(mu / (F.col("dl") + mu)))


def systems(hits: DataFrame, models: dict[str, Column], k: int = 50) -> DataFrame:
    """(name, qid, doc_id, score, rank) of several weighting models over the same matches."""
    out = None
    for name, weight in models.items():
        run = weighted(hits, weight, k).select(F.lit(name).alias("name"), "qid", "doc_id", "score", "rank")
        out = run if out is None else out.unionByName(run)
    return out


def result_lines(run: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, line): ``name:doc_id:score`` in rank order."""
    named = run.join(docs.select("doc_id", "name"), "doc_id", "left")
    return named.select("qid", "rank", F.format_string("%s:%d:%.6f", F.coalesce("name", F.format_string("__doc_%d__", "doc_id")), "doc_id", "score").alias("line")).orderBy("qid", "rank").drop("rank")
