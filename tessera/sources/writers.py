"""Sinks for indexes, reports and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_json(lists: DataFrame, statistics: DataFrame, path: str) -> None:
    """Inverted lists (term, docid, freq, df) under ``data``, and the one row of (N, num_terms, num_tokens) under ``statistics``."""
    lists.select("term", "docid", "freq", "df").write.mode("overwrite").json(f"{path}/data")
    statistics.select(F.col("n_docs").alias("N"), F.col("n_terms").alias("num_terms"), F.col("n_tokens").alias("num_tokens")).write.mode("overwrite").json(f"{path}/statistics")


def term_lines(vocab: DataFrame, path: str) -> None:
    """Lines ``term cf df`` by falling frequency."""
    vocab.orderBy(F.desc("cf"), "term").select(F.concat_ws(" ", "term", "cf", "df").alias("value")).write.mode("overwrite").text(path)


def statistics_lines(statistics: DataFrame, path: str) -> None:
    """The corpus statistics row as a seven-line report."""
    lines = F.array(
        F.concat_ws(" ", "n_docs"), F.concat_ws(" ", "n_tokens", "n_terms"), F.concat_ws(" ", "mean_tokens", "mean_terms"), F.concat_ws(" ", "mean_term_length"),
        F.concat_ws(" ", "shortest_doc", "shortest_terms"), F.concat_ws(" ", "longest_doc", "longest_terms"), F.concat_ws(" ", "n_hapax"),
    )
    statistics.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def extremes(vocab: DataFrame, n: int = 10) -> DataFrame:
    """(which, term, cf): the most and least frequent terms."""
    top = vocab.orderBy(F.desc("cf"), "term").limit(n).select(F.lit("top").alias("which"), "term", "cf")
    return top.unionByName(vocab.orderBy("cf", F.desc("term")).limit(n).select(F.lit("bottom").alias("which"), "term", "cf"))


def pairs_lines(samples: DataFrame, path: str) -> None:
    """Lines ``n v``."""
    samples.orderBy("n").select("n", "v").write.mode("overwrite").option("sep", " ").csv(path)


def labelled_lines(predicted: DataFrame, path: str) -> None:
    """Lines ``id lang``."""
    predicted.orderBy("id").select(F.concat_ws(" ", "id", F.coalesce("lang", F.lit("None"))).alias("value")).write.mode("overwrite").text(path)


def compressed_index(packed: DataFrame, path: str) -> None:
    """Compressed lists (term, df, docid_bytes, freq_bytes), sorted by term."""
    packed.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def posting_lines(found: DataFrame) -> DataFrame:
    """Lines ``name:doc_id:tf``."""
    return found.select(F.format_string("%s:%d:%d", "name", "doc_id", "tf").alias("line"))
