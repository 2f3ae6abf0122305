"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lower-cases, takes accents away, maps look-alike letters of other scripts, digits and signs to the letters they stand for (1, l, i, | and an inner ! are one
letter, as are @, 4 and a, or $, 5 and s), closes up words that are spaced out letter by letter, and turns what is no letter into single
spaces. Terms and exception phrases are folded by the same map. The lexicon is learned: from at most ``LABELLED_ROWS`` labelled rows, words and word beginnings are weighted by
their log-odds between toxic and other documents (folds 0 and 1); a logistic calibration on fold 3 turns
weight per length, total weight and distinct terms into the score. Where phrases of ``EXCEPTIONS`` stand, the terms in them don't
count. Only the lexicon (at most ``TERMS`` entries) and four numbers travel to the tasks; scoring has no shuffle.

Defined cases: null and empty texts have no hits and get the score of such; a missing class gives scores near the other's rate;
rows that repeat an id are scored alike if their texts are alike; labels for unknown ids are ignored, and of an id with both labels neither counts; a null id
is scored, held_out false; very long texts are folded whole, in memory of one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.learn import LABELLED_ROWS, Logistic, fold_of, labelled_sample, sigmoid

TERMS = 4000
PREFIXES = range(4, 9)
LEAST_TOXIC, LEAST_PRECISION = 6, 0.85
THRESHOLD = 0.3
EXCEPTIONS: tuple[str, ...] = ("trash can", "trash bin", "trash collection", "clown fish", "clown car", "pond scum", "stupid simple")
_LOOKALIKE = dict(zip("аеорсухівкмнтьѕјԁɡɩοαερτυνκικβ", "aeopcyxibkmhtbsjdgioaeptuvkikb"))
#: Characters that stand for one letter are one class; i, l, 1 and | are all written i.
_CLASSES = {"o": "0", "i": "1l|", "e": "3", "a": "4@", "s": "5$", "t": "7", "b": "8", "g": "9"}
_FOLD = {ord(k): ("i" if v == "l" else v) for k, v in _LOOKALIKE.items()} | {ord(k): v for v, ks in _CLASSES.items() for k in ks}
_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
_MARKS = re.compile("[\u0300-\u036f\u200b-\u200d\u00ad]+")
#: Letters spaced out one by one ("s t u p i d", "s.t.u.p.i.d"), and short runs of letters with marks between them ("st.u.p.i.d").
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[ .*_-][^\W\d_]){3,}(?![^\W\d_])|(?<![^\W\d_])[^\W\d_]{1,3}(?:[.*_-][^\W\d_]{1,2}){2,}(?![^\W\d_])")
_GAPS = re.compile(r"[ .*_-]")


def fold_text(text: str) -> list[str]:
    """The folded words of a text."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.translate(_FOLD)
    if "!" in text:
        text = _INNER.sub("i", text)
    return _LETTERS.findall(_SPACED.sub(lambda m: _GAPS.sub("", m[0]), text))


@dataclass
class Lexicon:
    """Terms (a word, or its beginning followed by ``*``) with weights, and the calibration."""

    weights: Mapping[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    model: Logistic | None = None
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "model": self.model, "_automaton": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def automaton(self) -> ahocorasick.Automaton:
        """Terms anchored at word borders in space-joined folded words."""
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                folded = " ".join(fold_text(term.removesuffix("*")))
                if folded:
                    pattern = f" {folded}" if term.endswith("*") else f" {folded} "
                    found.add_word(pattern, (len(pattern), weight, term))
            for phrase in self.exceptions:
                folded = " ".join(fold_text(phrase))
                if folded:
                    pattern = f" {folded} "
                    found.add_word(pattern, (len(pattern), None, phrase))
            found.make_automaton() if len(found) else None
            self._automaton = found
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(log weight per 100 words, log total weight, log distinct terms)."""
        words = fold_text(text) if text else []
        if not words or not len(self.automaton()):
            return 0.0, 0.0, 0.0
        best: dict[int, tuple[float, str]] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, weight, term) in self.automaton().iter(f" {' '.join(words)} "):
            start = end - n + 1
            if weight is None:
                excused.append((start, end))
            elif start not in best or best[start][0] < weight:
                best[start] = (weight, term)
        for a, b in excused:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        total = sum(w for w, _ in best.values())
        return float(np.log1p(100 * total / len(words))), float(np.log1p(total)), float(np.log1p(len({t for _, t in best.values()})))

    def score(self, rows: Sequence[tuple[float, float, float]]) -> np.ndarray:
        return self.model.probability(np.array(rows, float).reshape(-1, 3)) if self.model else sigmoid(np.zeros(len(rows)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) to partial counts (term, toxic, other) over documents."""
    for batch in batches:
        counts = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = set(fold_text(text.as_py() or ""))
            counts[label].update(words)
            counts[label].update({f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n})
        terms = list(counts[1] if not counts[0] else counts[1] | counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "other"])


def learn_lexicon(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = EXCEPTIONS, most: int = LABELLED_ROWS) -> Lexicon:
    """A calibrated lexicon from the labelled rows outside the held-out fold."""
    sample = labelled_sample(labels, "toxic", most)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("label", "fold", "text")
    sample = materialize(sample, "toxic-sample")
    first = sample.where("fold <> 3")
    by_label = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    terms = first.select("label", "text").mapInArrow(_count_terms, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    precise = F.col("toxic") * (n0 + 1) >= LEAST_PRECISION * (F.col("toxic") * (n0 + 1) + F.col("other") * (n1 + 1))
    chosen = terms.where((F.col("toxic") >= LEAST_TOXIC) & precise & (weight > 1)).select("term", weight.alias("weight"), "toxic")
    chosen = chosen.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(TERMS).collect()
    lexicon = Lexicon({r["term"]: r["weight"] for r in chosen}, tuple(exceptions))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3))], ["label", "a", "b", "c"])

    held = sample.where("fold = 3").select("label", "text").mapInArrow(measure, "label int, a double, b double, c double").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in held], float).reshape(-1, 3)
    lexicon.model = Logistic(0.5).fit(x, np.array([r["label"] for r in held], float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = lexicon.score([lexicon.features(x.as_py()) for x in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold_of(doc_id) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))
