"""Quality classifier by co-training of two views.

One view sees a document's text content (shares of character classes, repetition of words and of pairs, word lengths, lines), the other its page
metadata (source, language, declared length, also by classes of length). Each is a logistic regression; over ``ROUNDS`` rounds each labels for the other the rows of an
unlabelled pool it is surest of: of either label at most ``GROW`` a round, and of the pool the share ``SUREST`` that it puts highest, or lowest, times that label's share of
the labelled rows. A pseudo-label weighs what its view has earned: twice its area under the ROC curve less one, found by cross-validation on
labelled rows, so a view that knows nothing hands over labels that weigh nothing. Both are then calibrated (Platt) on a fold neither has seen,
and a last logistic regression combines the calibrated views. Fitting uses at most ``LABELLED_ROWS`` labelled and ``POOL_ROWS``
unlabelled rows, both by a hash of the id, so neither grows with the corpus; scoring covers every document, without a shuffle.

Defined cases: null and empty texts have the features of an empty text; null metadata is a value of its own; with one label only, or none, every score is near that label's
rate (0.5 for none); a very long text is measured whole, in memory of one task; sources that the fitted rows do not hold share one feature; an id with both labels is not fitted on; rows that repeat an id are scored by their own texts; an empty table gives an
empty result; other columns are ignored by ``score_quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, tidied
from tessera.llm.learn import LABELLED_ROWS, Logistic, auc, fold_of, labelled_sample
from tessera.llm.textscan import U, mix64, slabs

POOL_ROWS, ROUNDS, GROW, SUREST = 10_000, 4, 500, 0.2
#: Sources with a feature of their own, the most frequent of the fitted rows; all others share one.
SOURCES = 256
LENGTHS = (50, 100, 200, 400, 800, 1600, 3200, 6400, 12800)
THRESHOLD = 0.5
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "mark": b"#$%&*@^~_=+<>{}[]\\", "bang": b"!?", "bar": b"|", "stop": b".,;:", "line": b"\n", "space": b" \t", "wide": range(128, 256)}
_CODE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values(), 1):
    _CODE[list(_bytes)] = _k
N_CLASSES = len(_CLASSES) + 1
N_TEXT = N_CLASSES - 1 + 8


def text_features(column: pa.Array) -> np.ndarray:
    """A row of N_TEXT features per text."""
    out = []
    for slab in slabs(column):
        size = np.diff(slab.offsets)
        rows = np.repeat(np.arange(slab.rows), size)
        counts = np.bincount(rows * N_CLASSES + _CODE[slab.raw], minlength=slab.rows * N_CLASSES).reshape(slab.rows, N_CLASSES)
        f = np.zeros((slab.rows, N_TEXT))
        n_bytes = np.maximum(1, size)[:, None]
        f[:, : N_CLASSES - 1] = np.sqrt(counts[:, 1:] / n_bytes)
        w = slab.word_hashes(lower=True)
        n = np.diff(slab.first)
        length = slab.ends - slab.starts
        row = slab.word_rows()
        total = np.bincount(row, length, slab.rows)
        squares = np.bincount(row, length.astype(float) ** 2, slab.rows)
        many = np.maximum(1, n)
        f[:, N_CLASSES - 1] = np.log1p(n)
        f[:, N_CLASSES] = total / many
        f[:, N_CLASSES + 1] = np.sqrt(np.maximum(0, squares / many - (total / many) ** 2))
        twice = np.zeros(len(w), bool)
        twice[1:] = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
        f[:, N_CLASSES + 2] = np.sqrt(np.bincount(row[twice], minlength=slab.rows) / many)
        f[:, N_CLASSES + 3] = np.bincount(row, (length <= 1).astype(float), slab.rows) / many
        if len(w):
            pairs = mix64(w[:-1] * U(0x2545F4914F6CDD1D) + w[1:])
        for r in range(slab.rows):
            a, b = slab.first[r], slab.first[r + 1]
            if b - a > 1:
                s = np.sort(w[a:b])
                edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
                f[r, N_CLASSES + 4] = (len(edge) - 1) / (b - a) ** 0.75
                f[r, N_CLASSES + 5] = np.diff(edge).max() / (b - a)
                s = np.sort(pairs[a : b - 1])
                f[r, N_CLASSES + 6] = 1 - np.count_nonzero(s[1:] != s[:-1]) / (b - a)
        out.append(f)
    return np.concatenate(out) if out else np.zeros((0, N_TEXT))


def meta_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array, sources: Sequence[str]) -> np.ndarray:
    """A row of features per document: the declared length and its class, language by hash, and source (one of ``sources``, another, or null)."""
    n, at = len(source), 2 + len(LENGTHS) + 1
    f = np.zeros((n, at + 16 + len(sources) + 2))
    length = n_chars.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    f[:, 0], f[:, 1] = np.log1p(np.maximum(length, 0)), length < 0
    f[np.arange(n), 2 + np.searchsorted(LENGTHS, length, "right")] = 1
    place = {s: i for i, s in enumerate(sources)}
    for column, first, slot, null in ((lang, at, lambda v: _slot(v, 16), 0), (source, at + 16, lambda v: place.get(v, len(sources)), len(sources) + 1)):
        coded = column.dictionary_encode()
        slots = np.array([slot(v) for v in coded.dictionary.to_pylist()] + [null], int)
        index = coded.indices.fill_null(len(slots) - 1).to_numpy(zero_copy_only=False)
        f[np.arange(n), first + slots[index]] = 1
    return f


def _slot(value: str, size: int) -> int:
    import zlib

    return 1 + zlib.crc32(value.encode()) % (size - 1)


@dataclass
class CoTrained:
    """The two views, their calibrations and the combination."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    sources: Sequence[str] = ()
    handed: Sequence[Sequence[int]] = ()  # pseudo-labels of 0 and of 1 that the text view gave, and the metadata view
    earned: Sequence[float] = ()  # what a pseudo-label of the text view weighs, and of the metadata view

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality: text view, metadata view, combined."""
        a, b = self.text_scale.margin(self.text.margin(text)[:, None]), self.meta_scale.margin(self.meta.margin(meta)[:, None])
        p = self.both.probability(np.column_stack([a, b]))
        return 1 / (1 + np.exp(-np.clip(a, -40, 40))), 1 / (1 + np.exp(-np.clip(b, -40, 40))), p


def cotrain(text: np.ndarray, meta: np.ndarray, label: np.ndarray, calibrate: np.ndarray) -> CoTrained:
    """Fit on rows with labels 0 or 1 (``calibrate`` marks those kept for calibration) and -1 for the unlabelled pool."""
    known = (label >= 0) & ~calibrate
    pool = label < 0
    views = (text, meta)
    extra: list[dict[int, int]] = [{}, {}]  # pool rows that the other view labelled
    earned = [_earned(x[known], label[known]) for x in views]
    share = float(label[known].mean()) if known.any() else 0.5

    def fit(v: int) -> Logistic:
        rows = np.concatenate([np.flatnonzero(known), np.array(list(extra[v]), int)])
        y = np.concatenate([label[known], np.array(list(extra[v].values()), int)]).astype(float)
        weight = np.concatenate([np.ones(known.sum()), np.full(len(extra[v]), earned[1 - v])])
        return Logistic().fit(views[v][rows], y, weight)

    models = [fit(0), fit(1)]
    unlabelled = np.flatnonzero(pool)
    for _ in range(ROUNDS):
        for v in (0, 1):
            p = models[v].probability(views[v][unlabelled])
            for y, sure, part in ((1, p, share), (0, 1 - p, 1 - share)):
                most = min(GROW, int(len(unlabelled) * SUREST * part))
                rows = unlabelled[np.argsort(-sure, kind="stable")[: ROUNDS * most]].tolist()
                extra[1 - v].update({r: y for r in [r for r in rows if r not in extra[1 - v]][:most]})
        models = [fit(0), fit(1)]
    held = (label >= 0) & calibrate
    y = label[held].astype(float)
    scales = [Logistic(0.1).fit(models[v].margin(views[v][held])[:, None], y) for v in (0, 1)]
    margins = np.column_stack([scales[v].margin(models[v].margin(views[v][held])[:, None]) for v in (0, 1)])
    handed = [[sum(y == k for y in extra[1 - v].values()) for k in (0, 1)] for v in (0, 1)]
    return CoTrained(models[0], models[1], scales[0], scales[1], Logistic(0.1).fit(margins, y), handed=handed, earned=earned)


def _earned(x: np.ndarray, y: np.ndarray) -> float:
    """Twice the area under the ROC curve of a view, less one, by cross-validation in two halves; 0 where it can't be found."""
    half = np.arange(len(y)) % 2 == 0
    got = [auc(Logistic().fit(x[~h], y[~h].astype(float)).probability(x[h]), y[h]) for h in (half, ~half) if len(y) > 1]
    return float(np.clip(2 * np.mean(got) - 1, 0, 1)) if got and not np.isnan(got).any() else 0.0


def _columns(docs: DataFrame) -> list:
    got = set(docs.columns)
    string = lambda c: F.col(c).cast("string").alias(c) if c in got else F.lit(None).cast("string").alias(c)
    n_chars = F.col("n_chars").cast("long") if "n_chars" in got else F.lit(None).cast("long")
    return [F.col("text"), string("source"), string("lang"), n_chars.alias("n_chars")]


def train_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, pool: int = POOL_ROWS) -> CoTrained:
    """Fit on bounded samples; their features, not their texts, reach the driver."""
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), *_columns(docs))
    sample = labelled_sample(labels, "quality", most)
    ids = docs.select(doc_id.alias("doc_id")).where("doc_id IS NOT NULL").withColumn("order", F.xxhash64("doc_id"))
    chosen = ids.orderBy("order", "doc_id").limit(pool).select(F.col("doc_id").alias("label_id")).distinct().withColumn("label", F.lit(-1)).withColumn("fold", F.lit(0).cast("long"))
    every = sample.unionByName(chosen.where(fold_of(F.col("label_id")) != 2).join(F.broadcast(sample.select("label_id")), "label_id", "left_anti"))
    taken = materialize(every, "quality-ids")  # at most ``most + pool`` rows
    known = rows.join(F.broadcast(taken), F.col("doc_id") == F.col("label_id")).where("source IS NOT NULL").groupBy("source").count()
    sources = tuple(r["source"] for r in known.orderBy(F.desc("count"), "source").limit(SOURCES).collect())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = text_features(batch.column(2)), meta_features(batch.column(3), batch.column(4), batch.column(5), sources)
            packed = [np.concatenate([a, b]).astype("<f4").tobytes() for a, b in zip(x, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(6), pa.array(packed, pa.binary())], ["label", "fold", "id", "x"])

    joined = rows.join(F.broadcast(taken), F.col("doc_id") == F.col("label_id")).select("label", "fold", "text", "source", "lang", "n_chars", "doc_id")
    got = joined.mapInArrow(tidied(features), "label int, fold long, id long, x binary").toArrow()
    rows_x = got.column("x").to_pylist()
    width = N_TEXT + meta_features(pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64()), sources).shape[1]
    x = np.frombuffer(b"".join(rows_x), "<f4").reshape(-1, width).astype(float)
    ids = got.column("id").to_pylist()
    order = np.array(sorted(range(len(x)), key=lambda i: (ids[i], rows_x[i])), int)  # the same rows in the same order whatever the partitions
    label, fold = got.column("label").to_numpy()[order], got.column("fold").to_numpy()[order]
    x = x[order]
    model = cotrain(x[:, :N_TEXT], x[:, N_TEXT:], label, fold == 3)
    model.sources = sources
    return model


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, text_score, meta_score, score, kept) per row of ``docs``."""
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, p = model.scores(text_features(batch.column(2)), meta_features(batch.column(3), batch.column(4), batch.column(5), model.sources))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a), pa.array(b), pa.array(p), pa.array(p >= threshold)], ["doc_id", "held_out", "text_score", "meta_score", "score", "kept"])

    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold_of(doc_id) == 2, F.lit(False)).alias("held_out"), *_columns(docs))
    return rows.mapInArrow(tidied(judge), "doc_id long, held_out boolean, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns; no shuffle."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    at = len(columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(text_features(batch.column(at)), meta_features(batch.column(at + 1), batch.column(at + 2), batch.column(at + 3), model.sources))[2]
            yield pa.RecordBatch.from_arrays(batch.columns[:at], columns).filter(pa.array(p >= threshold))

    wide = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)] + [c.alias(f"q{i}") for i, c in enumerate(_columns(docs))]
    return docs.select(*wide).mapInArrow(tidied(judge), docs.schema)


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
