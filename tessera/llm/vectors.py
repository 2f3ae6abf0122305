"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine of at least t lie within the squared distance 2 - 2t. After a fixed random rotation the dimensions fall
into blocks; a pair within the budget is within its proportional share in at least one block. Each block is a range join on
its leading coordinate: cells as wide as the block's radius, so a vector meets its own cell and the one before. Within a cell the
block's squared distances thin the pairs, and every survivor is verified in double precision on the whole vectors. A pair
that several blocks would find belongs to the first of them, so it counts once; pairs never become rows: a cell
returns each vector's number of links and a spanning forest. Cells larger than a tile are laid out over all
pairs of their parts, so no task holds more than two tiles. Equal vectors (of one label) are joined as one with its multiplicity.

Defined cases: vectors that are null, empty, all zero, or hold null, NaN or infinite components have no links, nor have rows with a null
label; vectors of different lengths never link; a null vec_id is one id among others for its own row (kept true) and never links; rows that
repeat an id with the same vector are links of no one but count in their partners'; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.components import connected_components, roots_of

BLOCK, BOX = 8, 256
#: Most vectors, and most components, of one part of a cell: 4 MB in double precision.
TILE, TILE_VALUES = 8192, 1 << 19
WIDTH = 2  # of a cell, in radii of its block
_EPS = 1e-7


@cache
def rotation(dimensions: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _blocks(dimensions: int) -> list[slice]:
    n = max(1, round(dimensions / BLOCK))
    cuts = [dimensions * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _unit(flat: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, label, embedding) to a row per block and cell: own (role 0) and, as guest of those within a radius, the next (role 1)."""
    for batch in batches:
        lengths = np.array([len(x) for x in batch.column(3).to_pylist()], np.int64)
        for d in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == d)
            if not d or not len(rows):
                continue
            part = batch.take(pa.array(rows))
            flat = part.column(3).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
            turned = _unit(flat) @ rotation(d)
            for k, s in enumerate(_blocks(d)):
                radius = math.sqrt((2 - 2 * threshold + _EPS) * (s.stop - s.start) / d)
                at = turned[:, s.start] / (WIDTH * radius)
                cell = np.floor(at).astype(np.int64)
                reach = np.flatnonzero(cell + 1 - at <= 1 / WIDTH + 1e-9)
                for role, sent in ((0, np.arange(len(rows))), (1, reach)):
                    n = len(sent)
                    own = part.take(pa.array(sent)) if role else part
                    yield pa.RecordBatch.from_arrays(
                        [own.column(2), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell[sent] + role), pa.array(np.full(n, role, np.int32)), own.column(0), own.column(1), own.column(3)],
                        ["label", "d", "block", "cell", "role", "id", "n", "v"],
                    )


def _boxes(points: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of ``points`` in sets of at most ``BOX``, split at medians of the widest coordinate."""
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BOX:
            yield rows
            continue
        axis = np.ptp(points[rows], axis=0).argmax()
        half = len(rows) // 2
        order = np.argpartition(points[rows, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]


def _join_tile(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids with links, their weighted numbers, forest edges a, b) of one tile."""
    d, k = group.column("d")[0].as_py(), group.column("block")[0].as_py()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    role, part = group.column("role").to_numpy(), group.column("part").to_numpy()
    order = np.argsort(group.column("id").to_numpy(), kind="stable")
    role, part = role[order], part[order]
    ids, n = group.column("id").to_numpy()[order], group.column("n").to_numpy()[order]
    flat = group.column("v").combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)[order]
    unit = _unit(flat)
    turned = unit @ rotation(d)
    blocks = _blocks(d)
    total = 2 - 2 * threshold + _EPS
    budgets = [total * (s.stop - s.start) / d for s in blocks]
    # pairs of the home cell with itself, and of home with guests; of parts (i, j) both ways round
    home = np.flatnonzero(role == 0)
    links = np.zeros(len(ids), np.int64)
    forest_a = forest_b = np.zeros(0, np.int64)
    mine = turned[:, blocks[k]]
    # one single-precision product gives squared distances to within 1e-5; what passes is decided in double precision below
    square = (mine * mine).sum(1, keepdims=True)
    ones = np.ones_like(square)
    left = np.hstack([-2 * mine, square, ones]).astype(np.float32)
    right = np.hstack([mine, ones, square]).astype(np.float32)
    for box in _boxes(mine[home]):
        x = home[box]
        if not len(x):
            continue
        away = np.maximum(np.maximum(mine[x].min(0) - mine, mine - mine[x].max(0)), 0)
        y = np.flatnonzero((away * away).sum(1) <= budgets[k] + 1e-9)
        p, q = np.nonzero(left[x] @ right[y].T <= np.float32(budgets[k] + 1e-5))
        new_a, new_b = [forest_a], [forest_b]
        for lo in range(0, len(p), 1 << 16):
            a, b = x[p[lo : lo + (1 << 16)]], y[q[lo : lo + (1 << 16)]]
            ok = ((role[b] == 1) | (b > a)) & (np.minimum(part[a], part[b]) == i) & (np.maximum(part[a], part[b]) == j)
            a, b = a[ok], b[ok]
            ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold - 1e-7
            a, b = a[ok], b[ok]
            ok = cosine(flat[a], flat[b]) >= threshold
            a, b = a[ok], b[ok]
            for e in range(k + 1):  # this block's pairs, but for those that an earlier one has already
                diff = turned[a, blocks[e]] - turned[b, blocks[e]]
                ok = ((diff * diff).sum(1) <= budgets[e]) == (e == k)
                a, b = a[ok], b[ok]
            ok = ids[a] != ids[b]
            np.add.at(links, a[ok], n[b[ok]])
            np.add.at(links, b[ok], n[a[ok]])
            new_a.append(a), new_b.append(b)
        if len(p):  # a box's links are thinned at once, so a dense tile holds a forest, not its pairs
            root = roots_of(np.concatenate(new_a), np.concatenate(new_b), len(ids))
            forest_a = np.flatnonzero(root != np.arange(len(ids)))
            forest_b = root[forest_a]
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], ids[forest_a], ids[forest_b]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("string").alias("label"))
    good = F.coalesce(
        F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = materialize(rows.withColumn("good", good), "vectors")
    # 0.0 and -0.0 are one number
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x))
    named = rows.where("good").select("vec_id", plain.alias("v"), "label")
    same = materialize(named.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "distinct-vectors")

    cells = same.select("id", "n", "label", "v").mapInArrow(lambda it: _cells(it, threshold), f"label string, d int, block int, cell long, role int, id long, n long, v {kind}")
    key = ["label", "d", "block", "cell"]
    cells = materialize(cells, "cells")
    most = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_VALUES) / F.col("d"))))
    sizes = cells.groupBy(*key).agg(F.count("*").alias("rows"), F.min("role").alias("home")).where("home = 0 AND rows > 1")
    sizes = sizes.select(*[F.col(c).alias(f"{c}_of") for c in key], F.ceil(F.col("rows") / most).cast("int").alias("parts"))
    on = [F.col(c) == F.col(f"{c}_of") for c in key]
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    laid = cells.join(sizes, on).withColumn("part", part)
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))
    tiled = laid.withColumn("tile", F.explode(others)).select(*key, F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "role", "part", "id", "n", "v")

    def join(group: pa.Table) -> pa.Table:
        ids, links, a, b = _join_tile(group, threshold)
        return pa.table({"a": pa.array(np.concatenate([ids, a])), "b": pa.array([None] * len(ids) + b.tolist(), pa.int64()), "links": pa.array(links.tolist() + [None] * len(a), pa.int64())})

    found = materialize(tiled.groupBy(*key, "i", "j").applyInArrow(join, "a long, b long, links long"), "vector-links")
    counts = found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("of"), "links")
    components = connected_components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("id").alias("member"), "component")
    first = same.select(F.col("label").alias("label_of"), F.col("v").alias("v_of"), F.col("id").alias("first_id"), "n").where("n > 1")
    # only vectors with copies need their representative looked up, by a digest of label and components
    digest = lambda label, v: F.sha2(F.concat_ws("|", F.col(label), F.concat_ws(",", F.col(v).cast("array<string>"))), 256)
    first = first.select(digest("label_of", "v_of").alias("digest_of"), "first_id", "n")
    out = rows.select("vec_id", "good", "label", plain.alias("pv")).select("vec_id", "good", F.when(F.col("good"), digest("label", "pv")).alias("digest"))
    out = out.join(first, F.col("digest") == F.col("digest_of"), "left").withColumn("rep", F.when(F.col("good"), F.coalesce("first_id", "vec_id")))
    out = out.join(counts, F.col("rep") == F.col("of"), "left").join(components, F.col("rep") == F.col("member"), "left")
    n_links = F.when(F.col("good"), F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def embedding_links_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings beside a changed copy of each: its first four components halved. Every table has links then."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    halved = F.transform("embedding", lambda x, at: F.when(at < 4, x / 2).otherwise(x))
    return near_vectors(rows.select((F.col("vec_id") * 2).alias("vec_id"), "label", "embedding").unionByName(rows.select((F.col("vec_id") * 2 + 1).alias("vec_id"), "label", halved.alias("embedding"))))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), good AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), unit AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / norm) AS u FROM good WHERE norm > 0
), linked AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.93
), reach(x, y) AS (
  SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reach r JOIN linked l ON r.y = l.x
), component AS (
  SELECT x, min(y) AS low FROM reach GROUP BY x
), number AS (
  SELECT x, count(*) AS n FROM linked GROUP BY x
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM e LEFT JOIN component c ON c.x = vec_id LEFT JOIN number m ON m.x = vec_id
"""

DERIVED_ORACLE = ORACLE.replace(
    "FROM embeddings\n",
    """FROM (
    SELECT vec_id * 2 AS vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings
    UNION ALL
    SELECT vec_id * 2 + 1, label, list_transform(embedding::DOUBLE[], lambda x, k: CASE WHEN k <= 4 THEN x / 2 ELSE x END) FROM embeddings
  )
""",
)
