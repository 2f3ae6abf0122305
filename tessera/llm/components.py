"""Connected components of an edge table by alternating stars.

Edges are first thinned to a spanning forest inside each partition. Where ``AT_ONCE`` edges or fewer are left, one task
of bounded memory ends the job; else large-star and small-star
rounds rewire every vertex towards the smallest vertex it can reach until nothing changes, in a
number of rounds about logarithmic in the longest path. All state is in tables; only two counts per round reach
the driver. A hub is an aggregated minimum and a join whose large keys Spark splits at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Edges (16 bytes each) that one task takes in: all of a smaller forest, or what is thinned together of a larger one.
AT_ONCE = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of 0..n-1 under the edges (a, b)."""
    root = np.arange(n)
    a, b = np.asarray(a), np.asarray(b)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low != high
        if not live.any():
            break
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _forest(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("a", "b")) -> Iterator[pa.RecordBatch]:
    ids_a, ids_b, held = [], [], 0

    def thin(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(a), np.concatenate(b)
        ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots_of(code[: len(a)], code[len(a) :], len(ids))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return ids[own], ids[root[own]]

    for batch in batches:
        if batch.num_rows:
            ids_a.append(batch.column(0).to_numpy())
            ids_b.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > 2 * AT_ONCE:  # bounded memory: what is thinned so far goes out, as edges like any others
                a, b = thin(ids_a, ids_b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)
                ids_a, ids_b, held = [], [], 0
    if ids_a:
        a, b = thin(ids_a, ids_b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)


def connected_components(edges: DataFrame) -> DataFrame:
    """Vertices with at least one edge to another: ``(id, component)``, component the smallest id reachable.

    ``edges`` has two long columns (any names). Nulls, self-loops and repeated edges are ignored; an empty table gives an empty one.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = materialize(edges.mapInArrow(_forest, "a long, b long"), "forest")
    if now.count() <= AT_ONCE:  # rounds cost several shuffles each, however few the edges; thinned in one piece, every vertex has an edge to its smallest
        return materialize(now.coalesce(1).mapInArrow(lambda it: _forest(it, ("id", "component")), "id long, component long"), "stars")
    seen = None
    while now.head(1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined: a hub's edges then meet one row of a plain table, and Spark can split them
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "minima")
        # large star: every larger neighbour of u goes to u's smallest
        large = materialize(both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-stars")
        # small star: u and its smaller neighbours go to the smallest of them (edges point downwards now)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "minima")
        moved = large.join(least, F.col("a") == F.col("u"))
        nxt = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(nxt, "stars")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
