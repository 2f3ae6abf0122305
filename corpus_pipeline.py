"""The corpus pipeline: documents to packed training sequences, one written table per stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, packing, quality, substring
from tessera.llm.common import materialize, shared_dir, table
from tessera.storage import remove, remove_tables, tables_written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject. It is fitted on labelled rows among ``docs``.

    Null and empty texts are judged as empty texts; repeated rows alike; an empty table stays empty; other columns are kept.
    """
    return quality.keep_good(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more): the one with the smallest id.

    Rows that repeat both id and text, or the text where the id is null, are one row afterwards; rows with one id and different texts stay or go together.
    """
    dropped = minhash.near_duplicates(docs, percent=80).where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    dropped = materialize(dropped, "dropped-ids")  # few, and of a known size: the texts are shuffled only where it is large
    key = ["row_id", "h", "g"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("row_id"), F.xxhash64(docs["text"]).alias("h"), F.xxhash64(F.lit(1), docs["text"]).alias("g"))
    left = rows.join(dropped, F.col("row_id") == F.col("dropped_id"), "left_anti")
    repeated = materialize(rows.groupBy(*key).count().where("count > 1").select(*[F.col(c).alias(f"{c}_of") for c in key]), "repeated-rows")
    if repeated.head(1):
        left = materialize(left, "kept-rows")
        same = F.col("row_id").eqNullSafe(F.col("row_id_of")) & (F.col("h") == F.col("h_of")) & (F.col("g") == F.col("g_of"))
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(key))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur elsewhere too.

    Null texts stay null; a text that loses all of its words is empty; a row that repeats another's text loses its windows as that one does.
    """
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks.

    Null texts and a null source count as ``mixing`` says; rows that repeat an id are repeated alike; an empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens.

    Null and empty texts are the end token alone; copies that the mix made are documents of their own; an empty table gives no sequences.
    """
    return packing.pack(packing.tokenize(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Co-training, LSH and best-fit packing can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read and its own intermediate tables are deleted then."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = tables_written()
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{k}")
        remove_tables(spark, before)
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The one query of this module."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """Its SQL, if there is any."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
