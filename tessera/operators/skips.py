"""Skip lists over postings: one block per floor(sqrt(df)) documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import block_size


def numbered(postings: DataFrame) -> DataFrame:
    """(term, doc_id, at, df, block): position from 0 in the term's list, and its block."""
    per = Window.partitionBy("term")
    got = postings.select("term", "doc_id", (F.row_number().over(per.orderBy("doc_id")) - 1).cast("long").alias("at"), F.count("*").over(per).alias("df"))
    return got.withColumn("block", F.floor(F.col("at") / block_size(F.col("df"))).cast("long"))


def skip_blocks(postings: DataFrame) -> DataFrame:
    """(term, block, max_doc_id, start): a block's largest document and its first position."""
    return numbered(postings).groupBy("term", "block").agg(F.max("doc_id").alias("max_doc_id"), F.min("at").alias("start"))


def skip_and(postings: DataFrame, short: str, long: str) -> DataFrame:
    """(doc_id, found, skip_comparisons, scan_comparisons) for each document of the short list looked up in the long one.

    A lookup compares with block maxima up to the first that is not smaller, then scans that block (the last one where all are
    smaller) up to the first document that is not smaller.
    """
    target = postings.where(F.col("term") == short).select(F.col("doc_id").alias("target"))
    blocks = numbered(postings.where(F.col("term") == long))
    ends = blocks.groupBy("block").agg(F.max("doc_id").alias("top"))
    n = ends.agg(F.count("*").alias("n_blocks"))
    # positions on the block axis: an equi-join on nothing would be a cross join, so both lists are merged and windowed
    marks = target.select(F.col("target").alias("d"), F.lit(1).alias("is_target")).unionByName(ends.select(F.col("top").alias("d"), F.lit(0).alias("is_target")))
    below = F.sum(1 - F.col("is_target")).over(Window.orderBy("d", F.desc("is_target")).rowsBetween(Window.unboundedPreceding, 0))
    placed = marks.withColumn("below", below).where("is_target = 1").select(F.col("d").alias("target"), "below").join(F.broadcast(n))
    placed = placed.select("target", F.least("below", F.col("n_blocks") - 1).alias("block"), F.least(F.col("below") + 1, F.col("n_blocks")).alias("skips"))
    scan = placed.join(blocks.select("block", "doc_id"), "block").groupBy("target", "skips").agg(
        F.max(F.col("doc_id") == F.col("target")).alias("found"),
        F.count(F.when(F.col("doc_id") < F.col("target"), 1)).alias("less"),
        F.count("*").alias("size"),
    )
    return scan.select(F.col("target").alias("doc_id"), "found", F.col("skips").cast("long").alias("skip_comparisons"), F.least(F.col("less") + 1, F.col("size")).alias("scan_comparisons"))


def skip_listing(postings: DataFrame, docs: DataFrame, term: str) -> DataFrame:
    """(line): ``name:document`` of the term's skip entries in document order."""
    blocks = skip_blocks(postings.where(F.col("term") == term))
    named = blocks.join(docs.select(F.col("doc_id").alias("max_doc_id"), "name"), "max_doc_id", "left").orderBy("max_doc_id")
    return named.select(F.format_string("%s:%d", F.coalesce("name", F.format_string("__doc_%d__", "max_doc_id")), "max_doc_id").alias("line"))
