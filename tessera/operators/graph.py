"""Link graphs: PageRank, HITS and crawl orders. Each round is one plan; its result is a written table, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import pearson, percent
from tessera.storage import materialize


def crawled_graph(edges: DataFrame, crawled: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between crawled nodes (node), without self-loops."""
    inside = edges.where("src <> dst").join(crawled.select(F.col("node").alias("src")), "src", "left_semi").join(crawled.select(F.col("node").alias("dst")), "dst", "left_semi")
    return inside.select("src", "dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """(node) of all ends."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def capped_edges(edges: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` links (src, pos, dst) of each node, for drawing."""
    return edges.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("pos"))).where(F.col("nth") <= most).drop("nth")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, pagerank). Nodes without links give their rank to all; stops early where the L1 change is below n * tolerance.

    Duplicate edges count once. ``tolerance=None`` runs exactly ``rounds`` rounds.
    """
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = materialize(edges.join(degree, "src"), "edges")
    nodes = materialize(nodes_of(edges).join(degree, F.col("node") == F.col("src"), "left").select("node", "degree"), "nodes")
    n = nodes.count()
    rank = nodes.select("node", "degree", F.lit(1.0 / n if n else 0.0).alias("pagerank"))
    for _ in range(rounds if n else 0):
        dangling = rank.where("degree IS NULL").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("lost"))
        given = edges.join(rank.select(F.col("node").alias("src"), "pagerank"), "src").groupBy("dst").agg(F.sum(F.col("pagerank") / F.col("degree")).alias("got"))
        new = rank.join(given, F.col("node") == F.col("dst"), "left").join(F.broadcast(dangling))
        new = new.select("node", "degree", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("pagerank"), F.col("pagerank").alias("before"))
        new = materialize(new, "pagerank")
        rank = new.select("node", "degree", "pagerank")
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()[0] < n * tolerance:
            break
    return rank.select("node", "pagerank")


def hits(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """(node, hub, authority), each summing to 1 (power iteration from equal hubs)."""
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    nodes = materialize(nodes_of(edges), "nodes")
    n = nodes.count()
    hub = nodes.select("node", F.lit(1.0 / n if n else 0.0).alias("hub"))
    out = hub.withColumn("authority", F.lit(0.0))
    for _ in range(rounds if n else 0):
        authority = edges.join(hub.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
        authority = materialize(authority.join(F.broadcast(authority.agg(F.max("a").alias("most")))).select("node", (F.col("a") / F.col("most")).alias("a")), "authority")
        new = edges.join(authority.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("h"))
        new = new.join(F.broadcast(new.agg(F.max("h").alias("most")))).select("node", (F.col("h") / F.col("most")).alias("h"))
        out = materialize(nodes.join(new, "node", "left").join(authority, "node", "left").join(hub.withColumnRenamed("hub", "before"), "node").select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"), "before"), "hits")
        hub = out.select("node", "hub")
        if tolerance is not None and out.agg(F.sum(F.abs(F.col("hub") - F.col("before")))).first()[0] < tolerance:
            break
    total = out.agg(F.sum("hub").alias("th"), F.sum("authority").alias("ta"))
    return out.join(F.broadcast(total)).select("node", F.coalesce(F.try_divide("hub", "th"), F.lit(0.0)).alias("hub"), F.coalesce(F.try_divide("authority", "ta"), F.lit(0.0)).alias("authority"))


def rerank(scores: DataFrame, ranks: DataFrame, alpha: float) -> DataFrame:
    """(node, score, pagerank, mixed): alpha * score + (1 - alpha) * pagerank, both as shares of their largest."""
    both = scores.join(ranks, "node")
    most = both.agg(F.max("score").alias("ms"), F.max("pagerank").alias("mp"))
    mixed = alpha * F.coalesce(F.try_divide("score", "ms"), F.lit(0.0)) + (1 - alpha) * F.coalesce(F.try_divide("pagerank", "mp"), F.lit(0.0))
    return both.join(F.broadcast(most)).select("node", "score", "pagerank", mixed.alias("mixed"))


def crawl_curves(nodes: DataFrame, k: int = 50, digits: int = 12) -> DataFrame:
    """(strategy, position, node, overlap): share of the k best authorities found after each page, by crawl order, PageRank and authority.

    ``nodes`` is (node, fifo, pagerank, authority); scores are rounded before they are ordered, ties keep the crawl order. Windows see one row per crawled page.
    """
    authority, pagerank_ = F.desc(F.round("authority", digits)), F.desc(F.round("pagerank", digits))
    top = nodes.withColumn("best", F.row_number().over(Window.orderBy(authority, "fifo"))).withColumn("by_rank", F.row_number().over(Window.orderBy(pagerank_, "fifo"))).withColumn("by_crawl", F.row_number().over(Window.orderBy("fifo")))
    top = top.withColumn("in_top", (F.col("best") <= k).cast("int"))
    n_top = F.least(F.lit(k), F.count("*").over(Window.partitionBy()))
    rows = top.withColumn("k", n_top).select("node", "in_top", "k", F.explode(F.create_map(F.lit("fifo"), "by_crawl", F.lit("pagerank"), "by_rank", F.lit("ideal"), "best")).alias("strategy", "position"))
    upto = Window.partitionBy("strategy").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("strategy", F.col("position").cast("long").alias("position"), "node", (F.sum("in_top").over(upto) / F.col("k") * 100).alias("overlap"))


def pages_needed(curves: DataFrame, share: float) -> DataFrame:
    """(strategy, pages): first position with at least ``share`` percent, or the number of pages."""
    return curves.groupBy("strategy").agg(F.coalesce(F.min(F.when(F.round("overlap", 9) >= share, F.col("position"))), F.max("position")).alias("pages"))


def crawl_report(curves: DataFrame, nodes: DataFrame, k: int = 50) -> DataFrame:
    """(strategy, auc, jaccard, pearson): normalised area, likeness of the first k pages to the k best authorities, PageRank against authority."""
    best = curves.where((F.col("strategy") == "ideal") & (F.col("position") <= k)).select("node")
    first = curves.where(F.col("position") <= k)
    n_best = best.agg(F.count("*").alias("n_best"))
    shared = first.join(best, "node", "left_semi").groupBy("strategy").agg(F.count("*").alias("shared"))
    area = curves.groupBy("strategy").agg((F.avg("overlap") / 100).alias("auc"), F.count(F.when(F.col("position") <= k, 1)).alias("n_first"))
    r = nodes.agg(pearson(F.col("pagerank"), F.col("authority")).alias("pearson"))
    got = area.join(shared, "strategy", "left").join(F.broadcast(n_best)).join(F.broadcast(r))
    s = F.coalesce("shared", F.lit(0))
    return got.select("strategy", "auc", F.coalesce(F.try_divide(s.cast("double"), F.col("n_first") + F.col("n_best") - s), F.lit(0.0)).alias("jaccard"), "pearson")


def share_by_kind(pages: DataFrame, column: str) -> DataFrame:
    """(column, n, percent) of pages."""
    n = pages.groupBy(column).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select(column, "n", percent(F.col("n"), F.col("total")).alias("percent"))
