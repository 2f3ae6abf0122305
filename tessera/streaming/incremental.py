"""Document frequencies kept up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def document_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_frequencies(docs: DataFrame, words: Column) -> DataFrame:
    """(term, df): documents per term so far. The state has one counter per term."""
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def write_frequencies(frequencies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed terms; a batch that is tried again overwrites its own folder, so results count once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frequencies.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) as of the last batch."""
    return spark.read.parquet(path).groupBy("term").agg(F.max_by("df", "batch").alias("df"))
