"""Mixing sources to target weights, with DataFrame functions alone.

Tokens are aggregated per source; a water-filling over the aggregated sources gives each its target; the rate of a source is
target / size. A document is emitted floor(rate) times, plus once more when a hash of its id and the
seed falls below the rate's fraction. Only (id, source, size) is shuffled, never texts; the join with
the per-source table is an ordinary one, which Spark broadcasts or splits by measured sizes.

Defined cases: null texts have size 0; a null source is a source of its own, last in order; rows that
repeat an id decide alike; a very long text is counted whole, in memory of one task in proportion to it; a source of size 0 has target 0; an empty table gives an empty mix; other
columns are carried by ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(mix_source, mix_source_size, mix_target) from rows (mix_source, mix_size).

    Weights are 1, 2, 3, 1, ... by source in code point order, null last. Targets share the total by
    weight but stop at ``most`` times the source's size, the excess being shared again.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    order = Window.orderBy(F.col("mix_source").isNull(), F.col("mix_source"))
    per = per.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.col("mix_source_size") * most)
    # sources in the order in which they reach their cap as the water rises
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").isNull(), F.col("mix_source"))
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("left", F.sum("mix_source_size").over(everything) - F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        .withColumn("w_left", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("free", F.col("cap").cast("decimal(28,0)") * F.col("w_left").cast("decimal(9,0)") > F.col("left").cast("decimal(28,0)") * F.col("w").cast("decimal(9,0)"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(-F.col("w_left"), "left", "w_left"))).over(everything))
    )
    target = F.when(F.col("free"), (F.col("level.left") * F.col("w")).cast("double") / F.col("level.w_left")).otherwise(F.col("cap").cast("double"))
    return per.select("mix_source", "mix_source_size", target.alias("mix_target"))


def fraction_of(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id: 52 bits of MD5, so that any engine can recompute it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def decide(docs: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """``docs`` rows as (doc_id, size, source_size, target, copies, taken)."""
    sized = materialize(docs.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), word_count(F.col("text")).alias("mix_size")), "mix-sizes")
    return _decided(sized, seed, most).select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def _decided(sized: DataFrame, seed: int, most: int) -> DataFrame:
    targets = source_targets(sized, most)
    right = targets.withColumnRenamed("mix_source", "mix_of")
    rate = F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(fraction_of(F.col("mix_id"), seed) < rate - whole, 1).otherwise(0)
    return sized.join(right, F.col("mix_source").eqNullSafe(F.col("mix_of"))).withColumn("mix_copies", copies.cast("long"))


def mix(docs: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs``, with its columns, as many times as decided."""
    sizes = materialize(docs.select(F.col("source").alias("mix_source"), word_count(F.col("text")).alias("mix_size")).groupBy("mix_source").agg(F.sum("mix_size").alias("mix_size")), "mix-sources")
    targets = source_targets(sizes, most).withColumnRenamed("mix_source", "mix_of")
    rate = F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(fraction_of(F.col("mix_id"), seed) < rate - whole, 1).otherwise(0)).cast("int")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("mix_row"), docs["doc_id"].alias("mix_id"), docs["source"].alias("mix_source"))
    rows = rows.join(targets, F.col("mix_source").eqNullSafe(F.col("mix_of"))).withColumn("mix_copies", copies).where("mix_copies > 0")
    return rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM per
), rising AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source IS NULL, source COLLATE "C") AS k FROM ranked
), level AS (
  SELECT *, ((SELECT sum(source_size) FROM per) - sum(cap) OVER (ORDER BY k) + cap)::BIGINT AS rest, (sum(w) OVER (ORDER BY k DESC))::BIGINT AS w_left FROM rising
), free AS (
  SELECT *, cap * w_left > rest * w AS free FROM level
), chosen AS (
  SELECT rest, w_left FROM free WHERE free ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN free THEN ((SELECT rest FROM chosen) * w)::DOUBLE / (SELECT w_left FROM chosen) ELSE cap::DOUBLE END AS target FROM free
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0.0) AS rate,
    ('0x' || substr(md5('0:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
