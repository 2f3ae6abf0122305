"""MinHash near-duplicate groups through an LSH forest, confirmed on full shingle sets.

1. *Sketch* each document (no shuffle): the number and a 128-bit fingerprint of its distinct k-word shingles, its minhash signature's
   sorted orders and a 2-bit-per-hash sketch. Documents with the same set are one from here on.
2. *Forest*: each tree reads the signature in an order of its own; a subtree is the documents that share a prefix of that order. Trees start at
   subtrees of ``DEPTHS[0]`` hashes, enough trees that a pair at the threshold misses all of them with a probability of ``MISS`` at most. Subtrees are
   counted first; those of one document end there. Depth adapts: where more than ``DENSE`` documents share a subtree, it is
   entered one level deeper, and again. In a subtree of up to ``DENSE`` rows, sorted by the rest of its order, each row meets its
   neighbours, which have the longest common prefixes with it, and then what these have not connected; candidates pass a sketch. Rows of a subtree that is dense
   at the last level share ``DEPTHS[-1]`` hashes and are candidates together.
3. *Confirm*: groups of connected candidates meet their texts in tiles of bounded size, where an exact set-similarity
   join (rarest shingles first, prefix and length filters) finds links between unconnected parts. A group larger than a tile is dealt
   into blocks, each with the same few pivots of the group, so that the copies of one text are connected here, however many.
4. *Complete*: going deeper, or dealing into blocks, parts pairs that share a dense subtree. All documents of a dense subtree, with their groups, form a *wide group*; where it is
   not all connected by now, its documents outside of its largest component meet all of its documents in tiles. So nothing is lost to density; a wide
   group without a large component costs the square of its number of tiles.

No pair of a group's all pairs is ever a row: tiles return a spanning forest, and links, not candidates, make the components. Nothing of the corpus reaches the driver.

Defined cases: null, empty or blank texts have no shingles and are linked with nothing; texts of 1 to k-1 words are one
shingle; rows that repeat an id are one document with that id; a null id is never linked (component null, kept true);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, tidied
from tessera.llm.components import connected_components, roots_of
from tessera.llm.textscan import U, mix64, shingle_sets, slabs

TREES, DEPTHS = 12, (4, 8, 12)
HASHES = 128
#: All trees miss a pair at exactly the threshold with this probability at most, as far as the hashes go (0.79 and above).
MISS = 1.5e-4
#: Candidates need this estimated similarity: five standard errors below the threshold (a pair at the threshold fails with 3e-7).
SLACK = 5.0
DENSE = 512
TILE_ROWS, TILE_BYTES, PIVOTS = 2048, 6 << 20, 16
#: Words, of 64 bits, of the filter of keys that are wanted.
FILTER_WORDS = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(7))
_A = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minhashes of a set of mixed 64-bit values."""
    x = (shingles >> U(32)).astype(np.uint32)[None, :]
    step = max(1, (1 << 16) // HASHES * 4)
    out = ((x[:, :step] ^ _B) * _A).min(1)
    for i in range(step, x.shape[1], step):
        np.minimum(out, ((x[:, i : i + step] ^ _B) * _A).min(1), out=out)
    return out


def trees_for(percent: int) -> int:
    """Number of trees for a threshold: TREES, or as many more as MISS asks."""
    p = (percent / 100) ** DEPTHS[0]
    need = math.ceil(math.log(MISS) / math.log1p(-p)) if 0 < p < 1 else 0
    return max(TREES, min(need, HASHES // DEPTHS[0]))


@cache
def orders(trees: int) -> np.ndarray:
    """The first ``DEPTHS[-1]`` hashes of each tree's order: no two trees share any of their first ``DEPTHS[0]``; the others are drawn for each tree."""
    rng = np.random.Generator(np.random.PCG64(23))
    own = np.arange(HASHES)[: trees * DEPTHS[0]].reshape(trees, DEPTHS[0])
    more = [rng.permutation(np.setdiff1d(np.arange(HASHES), x))[: DEPTHS[-1] - DEPTHS[0]] for x in own]
    return np.concatenate([own, np.array(more)], axis=1)


def _two_bits(sig: np.ndarray) -> np.ndarray:
    """Two well-mixed bits of each minhash, packed: HASHES / 4 bytes."""
    v = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
    return v[:, 0] | v[:, 1] << 2 | v[:, 2] << 4 | v[:, 3] << 6


def _sketches(batches: Iterator[pa.RecordBatch], k: int, trees: int) -> Iterator[pa.RecordBatch]:
    picks = orders(trees)
    for batch in batches:
        for slab in slabs(batch.column(1)):
            n, prints, keys, bits = [], [], [], []
            for s in shingle_sets(slab, k):
                n.append(len(s))
                if not len(s):
                    prints.append(None), keys.append(None), bits.append(None)
                    continue
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s)
                bits.append(_two_bits(sig).tobytes())
                # a tree's keys: hashes of the prefixes of its order
                used, h, levels = sig[picks].astype(U), np.arange(1, trees + 1, dtype=U), []
                for j in range(DEPTHS[-1]):
                    h = mix64(h * U(0x2545F4914F6CDD1D) + used[:, j])
                    if j + 1 in DEPTHS:
                        levels.append(h)
                keys.append(np.stack(levels, 1).astype("<i8").tobytes())
            rows = [batch.column(0).slice(slab.lo, slab.rows), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_shingles", "print", "keys", "bits"])


_LEVELS = [f"k{j}" for j in range(len(DEPTHS))]


def _explode(batches: Iterator[pa.RecordBatch], trees: int, deep: bool) -> Iterator[pa.RecordBatch]:
    """A row per tree: its subtree on the first level, or (``deep``) on every level, with id and sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(batch.num_rows * trees, len(DEPTHS))
        if not deep:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy())], _LEVELS[:1])
            continue
        bits = batch.column(2).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, j].copy()) for j in range(len(DEPTHS))), pa.array(np.repeat(batch.column(0).to_numpy(), trees)), bits], [*_LEVELS, "id", "bits"])


def _subtree_edges(bits: np.ndarray, least: float) -> np.ndarray:
    """Root index of each of a subtree's sketches, in the order of their labels, under 'estimated similarity at least ``least``'."""
    n = len(bits)
    words = bits.reshape(n, -1).view(U)
    odd = U(0x5555555555555555)
    most = int((1 - (0.25 + 0.75 * least)) * HASHES)  # differing 2-bit fields

    def near(d: np.ndarray) -> np.ndarray:
        return np.bitwise_count((d | d >> U(1)) & odd).sum(-1) <= most

    nearest = np.flatnonzero(near(words[1:] ^ words[:-1]))  # neighbours in the order
    a, b = [nearest], [nearest + 1]
    root = roots_of(nearest, nearest + 1, n)
    if root.any():
        for i in range(0, n, 256):
            x, y = np.nonzero(near(words[i : i + 256, None, :] ^ words[None, i:, :]))
            keep = (y > x) & (root[x + i] != root[y + i])
            a.append(x[keep] + i), b.append(y[keep] + i)
    return roots_of(np.concatenate(a), np.concatenate(b), n)


def _scan(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Candidate edges of rows (subtree, id, sketch) sorted by subtree and the rest of the order; holds one subtree of up to DENSE rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    subtree = None
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def close() -> None:
        if sum(len(x) for x, _ in held) > 1:
            ids, bits = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            root = _subtree_edges(bits, least)
            own = np.flatnonzero(root != np.arange(len(ids)))
            a.append(ids[own]), b.append(ids[root[own]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
        cut = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
            if keys[lo] != subtree:
                close()
                held, subtree = [], keys[lo]
            held.append((ids[lo:hi], bits[lo:hi]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b = [], []
    close()
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _perhaps(rows: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """The rows of ``rows`` whose hashed ``key`` meets a bit that a value of ``wanted``'s column ``of`` has set: all that are among them and a few more.

    Only these are shuffled to meet ``wanted``. However many values there are, at most ``FILTER_WORDS`` rows of two longs are broadcast;
    with very many of them the filter lets more rows through, which costs shuffle and changes no result.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS))
    bit = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(c), 32), F.lit(64)).cast("int")
    words = wanted.groupBy(word(of).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(of))).alias("bits_set"))
    words = materialize(words, "key-filter")
    met = (word(key) == F.col("word")) & (F.call_function("shiftrightunsigned", F.col("bits_set"), bit(key)).bitwiseAND(F.lit(1)) == 1)
    return rows.join(F.broadcast(words), met, "left_semi")


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """How many of ``rows`` share each key; written, so that a hot key's rows can be split where they meet it."""
    return materialize(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("of"), "n"), name)


def _starred(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Edges (a, b) from each of ``rows`` to the smallest id with its key."""
    low = materialize(rows.groupBy(key).agg(F.min("id").alias("b")).select(F.col(key).alias("of"), "b"), name)
    return rows.join(low, F.col(key) == F.col("of")).select(F.col("id").alias("a"), "b").where("a <> b")


def _forest(first: DataFrame, trees: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """Candidate edges, and the edges that hold dense subtrees together (None without any), of rows (id, keys, bits)."""
    sketch = first.select("id", "keys", "bits")
    shape = ", ".join(f"{c} long" for c in _LEVELS)
    sizes = _counted(sketch.mapInArrow(tidied(lambda it: _explode(it, trees, False)), "k0 long"), "k0", "subtrees")
    rows = sketch.mapInArrow(tidied(lambda it: _explode(it, trees, True)), f"{shape}, id long, bits binary")
    rows = materialize(_perhaps(rows, "k0", sizes, "of").join(sizes, F.col("k0") == F.col("of")).drop("of"), "subtree-rows")
    dense = rows.where(F.col("n") > DENSE)
    scanned = rows.where(F.col("n") <= DENSE).select(F.col("k0").alias("subtree"), "id", "bits", *_LEVELS)
    found, wide, now = [], None, dense.drop("n")
    for c in _LEVELS[1:]:  # deeper, where too many share a subtree
        if not now.head(1):
            break
        wide = wide or _starred(dense, "k0", "dense-roots")
        counted = materialize(now.join(_counted(now, c, "subtrees"), F.col(c) == F.col("of")).drop("of"), "subtree-rows")
        scanned = scanned.unionByName(counted.where(F.col("n") <= DENSE).select(F.col(c).alias("subtree"), "id", "bits", *_LEVELS))
        now = counted.where(F.col("n") > DENSE).drop("n")
    else:
        found.append(_starred(now, _LEVELS[-1], "deepest-roots"))
    in_order = scanned.repartition("subtree").sortWithinPartitions("subtree", *_LEVELS, "id").select("subtree", "id", "bits")
    return reduce(DataFrame.unionByName, found, in_order.mapInArrow(tidied(lambda it: _scan(it, least)), "a long, b long")), wide


def exact_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links with ``100 * |x & y| >= percent * |x | y|`` among non-empty sets.

    Exact: two sets that similar share one of their rarest shingles, within prefixes of ``n - ceil(n * percent / 100) + 1``.
    Sets already connected are not compared again, nor sets with one label in ``known``.
    """
    size = np.array([len(s) for s in sets])
    by_size = np.argsort(size, kind="stable")
    _, token, count = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True, return_counts=True)
    token = np.argsort(np.argsort(count, kind="stable"), kind="stable")[token]  # rarest first
    size = size[by_size]
    starts = np.concatenate([[0], np.cumsum(size)])
    rows = np.repeat(np.arange(len(size)), size)
    token = token[np.lexsort((token, rows))]
    need = -(-size * percent // 100)
    posts: dict[int, list[int]] = {}
    mark = np.zeros(len(count), bool)
    root = list(range(len(size)))
    if known is not None:
        _, leader, code = np.unique(known[by_size], return_index=True, return_inverse=True)
        root = leader[code].tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x in range(len(size)):
        own = token[starts[x] : starts[x + 1]]
        prefix = own[: size[x] - need[x] + 1].tolist()
        found: set[int] = set()
        for t in prefix:
            at = posts.setdefault(t, [])
            found.update(at)
            at.append(x)
        todo = sorted((y for y in found if size[y] >= need[x]), reverse=True)
        if not todo:
            continue
        mark[own] = True
        at = 0
        while at < len(todo):
            part, seen = [], find(x)
            while at < len(todo) and len(part) < 64:
                if find(todo[at]) != seen:
                    part.append(todo[at])
                at += 1
            if not part:
                continue
            part_a = np.array(part)
            lens = size[part_a]
            ends = np.cumsum(lens)
            where = np.arange(ends[-1]) + np.repeat(starts[part_a] - (ends - lens), lens)
            common = np.add.reduceat(mark[token[where]].astype(np.int64), ends - lens)
            for y in part_a[100 * common >= percent * (size[x] + lens - common)].tolist():
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    links.append((int(by_size[x]), int(by_size[y])))
        mark[own] = False
    return links


def _tiles(texts: DataFrame, by: str) -> DataFrame:
    """(of, blocks, rows) per group: its number of tiles and of rows."""
    rows = texts.select("id", by, "n_shingles")
    sizes = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("words"))
    blocks = F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("words") * 8 / TILE_BYTES)).cast("int")
    return materialize(sizes.select(F.col(by).alias("of"), blocks.alias("blocks"), "rows"), "tiles-of-groups")


def _confirm(percent: int, k: int):
    """Links within a tile of rows (id, text, known)."""

    def confirm(group: pa.Table) -> pa.Table:
        ids, known = group.column("id").to_numpy(), group.column("known").to_numpy()
        sets = [s for slab in slabs(group.column("text")) for s in shingle_sets(slab, k)]
        order = np.lexsort((known, ids))
        order = [i for i in order.tolist() if len(sets[i])]
        links = exact_links([sets[i] for i in order], percent, known[order]) if len(order) > 1 else []
        a, b = ([int(ids[order[pair[side]]]) for pair in links] for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return confirm


def _first_links(texts: DataFrame, sizes: DataFrame, percent: int, k: int) -> DataFrame:
    """Links inside the tiles of every group (column ``g``); a group of several tiles has its pivots in each of them."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(1), "id"), F.col("rows")) < PIVOTS)
    tiles = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    rows = texts.join(sizes, F.col("g") == F.col("of")).withColumn("tile", F.explode(tiles)).select("g", "tile", "id", "text", F.col("id").alias("known"))
    return rows.groupBy("g", "tile").applyInArrow(_confirm(percent, k), "a long, b long")


def _more_links(texts: DataFrame, components: DataFrame, percent: int, k: int) -> DataFrame:
    """Links that tiles have not seen in the wide groups (column ``wide``): documents outside of the largest component meet all of their group."""
    names = components.select(F.col("id").alias("member"), "component")
    rows = texts.join(names, F.col("id") == F.col("member"), "left").withColumn("known", F.coalesce("component", "id")).drop("member", "component")
    rows = materialize(rows.select("id", "wide", "n_shingles", "known"), "wide-rows")
    parts = rows.groupBy("wide", "known").agg(F.count("*").alias("n"))
    parts = parts.groupBy("wide").agg(F.max_by("known", F.struct("n", "known")).alias("largest"), F.sum("n").alias("rows"), F.max("n").alias("in_largest"), F.count("*").alias("parts")).where("parts > 1")
    words = _tiles(rows.withColumnRenamed("wide", "w"), "w").select(F.col("of").alias("w"), "blocks")
    parts = parts.join(words, F.col("wide") == F.col("w")).withColumn("outer_blocks", F.least("blocks", F.ceil((F.col("rows") - F.col("in_largest")) / TILE_ROWS)).cast("int"))
    parts = materialize(parts.select(F.col("wide").alias("of"), "largest", "blocks", "outer_blocks"), "wide-groups")
    laid = rows.join(parts, F.col("wide") == F.col("of")).select(F.col("id").alias("row_id"), F.col("known"), "wide", "largest", "blocks", "outer_blocks")
    # a row's own block meets each of the outer blocks; an outer row's meets, besides, each of all blocks
    block, outer = F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "row_id"), F.col("outer_blocks")).cast("int")
    as_inner = F.transform(F.sequence(F.lit(0), F.col("outer_blocks") - 1), lambda i: F.struct(i.alias("i"), block.alias("j")))
    as_outer = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(outer.alias("i"), j.alias("j")))
    tiles = F.when(F.col("known") == F.col("largest"), as_inner).otherwise(F.array_union(as_inner, as_outer))
    laid = laid.withColumn("tiles", tiles).select("row_id", "known", F.col("wide").alias("w"), "tiles")
    rows = texts.join(laid, (F.col("id") == F.col("row_id")) & (F.col("wide") == F.col("w"))).withColumn("tile", F.explode("tiles"))
    return rows.select("w", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "id", "text", "known").groupBy("w", "i", "j").applyInArrow(_confirm(percent, k), "a long, b long")


def _members(edges: DataFrame, name: str) -> DataFrame:
    """Every vertex of ``edges`` with its component, as (member, ``name``)."""
    got = connected_components(edges)
    return got.select(F.col("id").alias("member"), F.col("component").alias(name)).unionByName(got.select(F.col("component").alias("member"), F.col("component").alias(name)).distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    small_batches(docs.sparkSession)
    p, trees = percent / 100, trees_for(percent)
    least = max(0.0, p - SLACK * math.sqrt((0.25 + 0.75 * p) * (0.75 - 0.75 * p) / HASHES) / 0.75)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(docs.mapInArrow(tidied(lambda it: _sketches(it, k, trees)), "doc_id long, n_shingles long, print binary, keys binary, bits binary"), "sketches")
    named = sketched.where("print IS NOT NULL AND doc_id IS NOT NULL")
    first = materialize(named.groupBy("print").agg(F.min("doc_id").alias("id"), F.min("keys").alias("keys"), F.min("bits").alias("bits"), F.min("n_shingles").alias("n_shingles")), "distinct-sets")
    candidates, wide = _forest(first, trees, least)
    candidates = materialize(candidates, "candidates")
    groups = _members(candidates, "g")
    if wide is None:
        groups = groups.select(F.col("member").alias("id"), "g", F.col("g").alias("wide"))
    else:
        wider = _members(candidates.unionByName(wide), "wide").withColumnRenamed("member", "id")
        groups = wider.join(groups, F.col("id") == F.col("member"), "left").select("id", F.coalesce("g", "id").alias("g"), "wide")
    groups = groups.join(first.select(F.col("id").alias("first_id"), "n_shingles"), F.col("id") == F.col("first_id")).drop("first_id")
    groups = materialize(groups, "candidate-groups")
    texts = _perhaps(docs, "doc_id", groups, "id").join(groups, F.col("doc_id") == F.col("id"))
    texts = materialize(texts.select("id", "g", "wide", "n_shingles", "text"), "candidate-texts")
    tiles = _tiles(texts, "g")
    links = materialize(_first_links(texts, tiles, percent, k), "links")
    # only a group of several tiles, or one that is wider than its candidates, can have more
    large = texts.join(tiles.where("blocks > 1"), F.col("g") == F.col("of"), "left_semi").unionByName(texts.where("wide <> g")).select(F.col("wide").alias("asked"))
    large = materialize(large.distinct(), "wide-asked")
    if large.head(1):
        rest = texts.join(large, F.col("wide") == F.col("asked")).drop("asked")
        links = links.unionByName(materialize(_more_links(rest, connected_components(links), percent, k), "links"))
    components = connected_components(links).select(F.col("id").alias("member"), "component")
    prints = first.select(F.col("print").alias("print_of"), F.col("id").alias("first_id"))
    joined = sketched.select("doc_id", "n_shingles", "print").join(prints, (F.col("print") == F.col("print_of")) & F.col("doc_id").isNotNull(), "left")
    joined = joined.join(components, F.col("first_id") == F.col("member"), "left")
    component = F.coalesce("component", "first_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
