"""Retrieval evaluation. A run is (qid, doc_id, rank[, name]); judgements are (qid, doc_id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(run: DataFrame) -> list[str]:
    return ["name", "qid"] if "name" in run.columns else ["qid"]


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` with its label (0 where not judged), and its query's number of relevant documents."""
    total = qrels.groupBy("qid").agg(F.count(F.when(F.col("label") > 0, 1)).alias("n_rel"))
    labels = qrels.select("qid", "doc_id", "label")
    return run.join(labels, ["qid", "doc_id"], "left").join(total, "qid").withColumn("label", F.coalesce("label", F.lit(0)))


def at_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(.., rank, rel, precision, recall) at every rank."""
    keys = _keys(run)
    before = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = (F.col("label") > 0).cast("int")
    got = judged(run, qrels).withColumn("rel", rel).withColumn("hits", F.sum("rel").over(before))
    return got.select(*keys, "rank", "rel", (F.col("hits") / F.col("rank")).alias("precision"), F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n_rel")), F.lit(0.0)).alias("recall"), "label", "n_rel", "hits")


def interpolated(points: DataFrame, keys: list[str]) -> DataFrame:
    """(.., level, precision): the best precision at a recall of at least 0.0, 0.1, .. 1.0; 0 where none is."""
    level = F.explode(F.sequence(F.lit(0), F.lit(10))).alias("level")
    wide = points.select(*keys, "precision", "recall", level)
    best = F.max(F.when(F.round(F.col("recall") * 10, 9) >= F.col("level"), F.col("precision")))
    return wide.groupBy(*keys, "level").agg(F.coalesce(best, F.lit(0.0)).alias("precision")).withColumn("level", F.col("level") / 10)


def measures(run: DataFrame, qrels: DataFrame, cut: int = 10) -> DataFrame:
    """Per query: ap, p_cut, r_cut, r_precision, p_half_recall, rr, dcg_cut, idcg_cut, ndcg_cut, ndcg, recall. Queries without results have no row."""
    keys = _keys(run)
    points = at_rank(run, qrels)
    gain = F.col("label") / F.log2(F.col("rank") + 1)
    ideal = Window.partitionBy("qid").orderBy(F.desc("label"), "doc_id")
    best = qrels.where("label > 0").withColumn("k", F.row_number().over(ideal)).withColumn("g", F.col("label") / F.log2(F.col("k") + 1))
    best = best.groupBy("qid").agg(F.sum(F.when(F.col("k") <= cut, F.col("g")).otherwise(0.0)).alias("idcg_cut"), F.sum("g").alias("idcg"))
    found = points.groupBy(*keys).agg(
        F.sum(F.when(F.col("rel") == 1, F.col("precision")).otherwise(0.0)).alias("sum_p"),
        F.sum(F.when(F.col("rank") <= cut, F.col("rel")).otherwise(0)).alias("hits_cut"),
        F.sum(F.when(F.col("rank") <= F.col("n_rel"), F.col("rel")).otherwise(0)).alias("hits_r"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rel"),
        F.max(F.when(F.col("hits") * 2 >= F.col("n_rel"), F.col("precision"))).alias("p_half"),
        F.sum(F.when(F.col("rank") <= cut, gain).otherwise(0.0)).alias("dcg_cut"),
        F.sum(gain).alias("dcg"), F.sum("rel").alias("hits"), F.first("n_rel").alias("n_rel"),
    )
    some = F.when(F.col("n_rel") > 0, F.col("n_rel"))
    share = lambda a: F.coalesce(F.try_divide(a.cast("double"), some), F.lit(0.0))
    return found.join(best, "qid", "left").select(
        *keys, share(F.col("sum_p")).alias("ap"), (F.col("hits_cut") / cut).alias("p_cut"), share(F.col("hits_cut")).alias("r_cut"), share(F.col("hits_r")).alias("r_precision"),
        F.coalesce("p_half", F.lit(0.0)).alias("p_half_recall"), F.coalesce(1 / F.col("first_rel"), F.lit(0.0)).alias("rr"), "dcg_cut", F.coalesce("idcg_cut", F.lit(0.0)).alias("idcg_cut"),
        F.coalesce(F.try_divide("dcg_cut", "idcg_cut"), F.lit(0.0)).alias("ndcg_cut"), F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"), share(F.col("hits")).alias("recall"),
    )


def recall_at(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(keys, cut, recall) at several cuts in one pass over the run."""
    keys = _keys(run)
    points = at_rank(run, qrels).groupBy(*keys).agg(F.first("n_rel").alias("n_rel"), *[F.sum(F.when(F.col("rank") <= c, F.col("rel")).otherwise(0)).alias(f"c{c}") for c in cuts])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"c{c}").alias("hits")) for c in cuts]))
    rows = points.select(*keys, "n_rel", each.alias("x"))
    return rows.select(*keys, "x.cut", F.coalesce(F.try_divide(F.col("x.hits").cast("double"), F.col("n_rel")), F.lit(0.0)).alias("recall"))


def long_form(per_query: DataFrame, names: list[str]) -> DataFrame:
    """(.., measure, value) rows of chosen measures."""
    keys = [c for c in ("name", "qid") if c in per_query.columns]
    return per_query.unpivot(keys, names, "measure", "value")


def wide_form(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per query, one column per measure."""
    keys = [c for c in ("name", "qid") if c in rows.columns]
    return rows.groupBy(*keys).pivot("measure", names).agg(F.first("value"))


def means(per_query: DataFrame, names: list[str]) -> DataFrame:
    """Means over queries, per system where there are several."""
    keys = [c for c in ("name",) if c in per_query.columns]
    return per_query.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def compare_rankings(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, overlap, spearman): shared share of the first k, and rank correlation over shared documents."""
    from tessera.functions.numeric import pearson

    both = a.select("qid", "doc_id", F.col("rank").alias("ra")).join(b.select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"])
    w = Window.partitionBy("qid")
    both = both.withColumn("xa", F.row_number().over(w.orderBy("ra"))).withColumn("xb", F.row_number().over(w.orderBy("rb")))
    return both.groupBy("qid").agg((F.count(F.when((F.col("ra") <= k) & (F.col("rb") <= k), 1)) / k).alias("overlap"), pearson(F.col("xa"), F.col("xb")).alias("spearman"))
