"""Substring dedup: words covered by a window of ``WINDOW`` words that occurs elsewhere are removed.

Against a *bounded reference* (a benchmark, say), ``strip_reference`` does as the method says: the reference is cut
into shards of bounded size, each shard becomes a suffix automaton over word hashes, the automata are broadcast, and documents
stream through them: matching statistics give the maximal spans that reach the threshold.

Against *each other* (``find_repeats``) the documents are their own reference, which grows without bound: broadcasting automata of
all its shards to all documents costs the square of the corpus. There the spans come from equal keys instead, with the same result:

1. Every window has an *anchor*, its smallest ``GRAM``-word hash, so equal windows have equal anchors. A document emits its distinct
   anchors (about one per 12 words), each with the hash of the widest context that its windows can span and the
   range of windows that chose it. Anchors are counted (pre-aggregated); those that occur once are done.
2. The windows of an anchor that occurs again are repeated, unless the context is the only one of its kind: where all contexts of an
   anchor are equal nothing is left to do, elsewhere the contexts are counted, and the one row of each unique context is taken out again.
3. For contexts so taken out, the windows of one representative of each context of that anchor are
   hashed (128 bits) and counted; they are a small part, at the ends of shared passages and beside edits.
4. Spans (with signs: put in, taken out) meet the texts again by document. The one join on a hot anchor is of two plain tables, of which
   one has a single row for each anchor, so Spark splits its large side at run time; nothing is joined on contexts.

A row's identity is its id and a hash of its text, or two hashes of its text where the id is null: rows that are alike in both are copies of each other, so all their windows are repeated.

Defined cases: null and empty texts have no words; texts shorter than a window keep all; a document that repeats itself counts; rows that repeat an id are
documents of their own, as are rows with a null id: a text that stands in two rows is repeated, whatever their ids; an empty table gives an
empty result; other columns are ignored by ``find_repeats`` and kept, under any name, by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, tidied
from tessera.llm.textscan import U, Slab, mix64, prefix, ranged, slabs

WINDOW, GRAM = 35, 12
SHARD_WORDS, MOST_SHARDS = 200_000, 64
_Q1, _Q2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of each run of ``width`` values."""
    at, best, have = np.arange(len(v)), v, 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step]), have + step
    return at


def _anchors(slab: Slab, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, two context hashes, first window, last window) of each anchor; window positions count from the row's first word."""
    w = slab.word_hashes()
    n = len(w)
    none = (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < window:
        return none
    row = slab.word_rows()
    sums = prefix(w, _Q1)
    at = np.arange(n - gram + 1)
    grams = ranged(sums, at, at + gram, _Q1)
    anchor = _sliding_argmin(grams, window - gram + 1)[: n - window + 1]
    valid = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(valid):
        return none
    anchor = anchor[valid]
    # windows of a row that share an anchor are consecutive
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[valid[1:]] != row[valid[:-1]])]))
    last = np.append(new[1:], len(valid)) - 1
    pos = anchor[new]
    lo, hi = valid[new], valid[last]
    first, end = slab.first[row[pos]], slab.first[row[pos] + 1]
    reach = window - gram
    a, b = np.maximum(first, pos - reach), np.minimum(end, pos + window)
    at = (pos - a).astype(U) * U(0x9FB21C651E98DF25)
    context, second = mix64(ranged(sums, a, b, _Q1) ^ at), mix64(ranged(prefix(w, _Q2), a, b, _Q2) ^ at)
    return row[pos], grams[pos], context, second, lo - first, hi - first


def _emit_anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, d, text) to a row per anchor: (id, d, v, f, g, lo, hi)."""
    for batch in batches:
        for slab in slabs(batch.column(2)):
            row, grams, context, second, lo, hi = _anchors(slab, window, gram)
            if len(row):
                own = pa.array(row + slab.lo)
                longs = [pa.array(grams.astype(np.int64)), pa.array(context.astype(np.int64)), pa.array((second >> U(32)).astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *longs, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["id", "d", "v", "f", "g", "lo", "hi"])


def _emit_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, d, text, ranges) to a row per window in the ranges: (id, d, at, h1, h2, alone)."""
    for batch in batches:
        ranges = batch.column(3)
        for slab in slabs(batch.column(2)):
            w = slab.word_hashes()
            s1, s2 = prefix(w, _Q1), prefix(w, _Q2)
            row, at, alone = [], [], []
            for r in range(slab.rows):
                for x in ranges[slab.lo + r].as_py():
                    at.append(np.arange(x["lo"], x["hi"] + 1) + slab.first[r])
                    row.append(np.full(len(at[-1]), r))
                    alone.append(np.full(len(at[-1]), x["alone"]))
            if not at:
                continue
            row_a, at_a = np.concatenate(row), np.concatenate(at)
            h1, h2 = ranged(s1, at_a, at_a + window, _Q1), ranged(s2, at_a, at_a + window, _Q2)
            own = pa.array(row_a + slab.lo)
            hashes = [pa.array((at_a - slab.first[row_a]).astype(np.int32)), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), pa.array(np.concatenate(alone))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *hashes], ["id", "d", "at", "h1", "h2", "alone"])


def identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two longs that tell rows apart, but for rows that share both id and text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.lit(1), text)), F.xxhash64(text)


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, d, spans): per ``identity`` with repeated windows, first and last starts of runs of windows with a sign; a window repeats where its signs add up to more than 0."""
    small_batches(docs.sparkSession)
    id_, d = identity(docs["doc_id"], docs["text"])
    docs = docs.select(id_.alias("id"), d.alias("d"), "text").where("text IS NOT NULL")
    anchors = materialize(docs.mapInArrow(tidied(lambda it: _emit_anchors(it, window, gram)), "id long, d long, v long, f long, g int, lo int, hi int"), "anchors")
    same = (F.min("f") == F.max("f")) & (F.min("g") == F.max("g"))
    # written, so that the join below is of two plain tables and a hot anchor's rows can be split
    shared = materialize(anchors.groupBy("v").agg(F.count("*").alias("n"), same.alias("same")).where("n > 1").select(F.col("v").alias("v_of"), "same"), "shared")
    again = materialize(anchors.join(shared, F.col("v") == F.col("v_of")).drop("v_of"), "shared-anchors")

    own = [F.first(c).alias(c) for c in ("id", "d", "lo", "hi")]  # all of one row
    contexts = materialize(again.where("NOT same").groupBy("v", "f", "g").agg(F.count("*").alias("n"), *own).select("id", "d", "lo", "hi", (F.col("n") == 1).alias("alone")), "contexts")
    asked = contexts.groupBy("id", "d").agg(F.collect_list(F.struct("lo", "hi", "alone")).alias("ranges")).select(F.col("id").alias("id_of"), F.col("d").alias("d_of"), "ranges")
    windows = docs.join(asked, (F.col("id") == F.col("id_of")) & (F.col("d") == F.col("d_of"))).select("id", "d", "text", "ranges")
    windows = materialize(windows.mapInArrow(tidied(lambda it: _emit_windows(it, window)), "id long, d long, at int, h1 long, h2 long, alone boolean"), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("alone").alias("any")).where("n > 1 AND any").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    found = windows.where("alone").join(materialize(repeated, "repeated"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("id", "d", F.col("at").alias("lo"), F.col("at").alias("hi"), F.lit(1).alias("sign"))
    signed = again.select("id", "d", "lo", "hi", F.lit(1).alias("sign")).unionByName(contexts.where("alone").select("id", "d", "lo", "hi", F.lit(-1).alias("sign"))).unionByName(found)
    return signed.groupBy("id", "d").agg(F.collect_list(F.struct("lo", "hi", "sign")).alias("spans"))


def _covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of a row's ``n`` words the repeated windows cover."""
    signs, edges = np.zeros(n + 1, np.int64), np.zeros(n + window + 1, np.int64)
    lo, hi, sign = (np.array([x[c] for x in spans]) for c in ("lo", "hi", "sign"))
    np.add.at(signs, lo, sign)
    np.add.at(signs, hi + 1, -sign)
    starts = np.flatnonzero(np.cumsum(signs) > 0)
    edges[starts] += 1
    edges[starts + window] -= 1
    return np.cumsum(edges)[:n] > 0


def _remove(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Columns (key, text, spans) to (key, n_words, n_removed, kept): kept a digest, or the text (unchanged where nothing goes)."""
    for batch in batches:
        for slab in slabs(batch.column(1), 1 << 20):
            n_words, n_removed, kept = [], [], []
            for r in range(slab.rows):
                n = int(slab.first[r + 1] - slab.first[r])
                spans = batch.column(2)[slab.lo + r].as_py()
                gone = int((drop := _covered(n, spans, window)).sum()) if spans else 0
                n_words.append(n), n_removed.append(gone)
                if digest or gone:
                    words = slab.words(r)
                    text = b" ".join([x for x, d in zip(words, drop.tolist()) if not d] if gone else words)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8"))
                else:
                    kept.append(batch.column(1)[slab.lo + r].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(slab.lo, slab.rows), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """(r, spans): every row of ``docs`` as a struct, with its spans."""
    spans = find_repeats(docs, window)
    id_, d = identity(docs["doc_id"], docs["text"])
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r"), id_.alias("row_id"), d.alias("row_d"))
    return rows.join(spans, (F.col("row_id") == F.col("id")) & (F.col("row_d") == F.col("d")), "left").select("r", "spans")


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``."""
    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window).select("r.doc_id", "r.text", "spans")
    return rows.mapInArrow(tidied(lambda it: _remove(it, window, True)), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words gone from ``text``; its columns and their order stay."""
    columns = docs.columns
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at), batch.column(len(columns))], ["k", "text", "spans"])
            text = pa.concat_arrays([x.column(3) for x in _remove(iter([part]), window, False)] or [pa.array([], pa.string())])
            yield pa.RecordBatch.from_arrays([text if i == at else batch.column(i) for i in range(len(columns))], columns)

    return _with_spans(docs, window).select(*[F.col("r").getField(c).alias(f"c{i}") for i, c in enumerate(columns)], "spans").mapInArrow(tidied(cut), docs.schema)


class SuffixAutomaton:
    """Suffix automaton of word-hash sequences; a separator that no word equals stands between texts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, c: int) -> None:
        """Append one word."""
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[self.last] + 1)
        p = self.last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: list[int]) -> None:
        """Append a text as a sequence of its own."""
        self.last = 0
        for c in words:
            self._extend_general(c)

    def _extend_general(self, c: int) -> None:
        q = self.next[self.last].get(c)
        if q is not None:  # the state is there from an earlier text
            p = self.last
            if self.length[q] == self.length[p] + 1:
                self.last = q
                return
            clone = len(self.next)
            self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = clone
                p = self.link[p]
            self.link[q] = clone
            self.last = clone
            return
        self.extend(c)

    def statistics(self, words: list[int]) -> list[int]:
        """For each position, the length of the longest run ending there that the automaton knows."""
        state = have = 0
        out = []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            to = self.next[state].get(c)
            state, have = (to, have + 1) if to is not None else (0, 0)
            out.append(have)
        return out


def strip_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the maximal spans of at least ``window`` words that also stand in ``reference`` (column ``text``).

    The reference must be bounded: beyond ``MOST_SHARDS`` shards of ``SHARD_WORDS`` words this raises ``ValueError``.
    """
    most = SHARD_WORDS * MOST_SHARDS
    total = reference.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    if total > most:
        raise ValueError(f"the reference has {total} words; at most {most} can be broadcast")
    shards: list[list[list[int]]] = [[]]
    held = 0
    for (text,) in reference.select("text").where("text IS NOT NULL").toLocalIterator():
        words = next(iter(slabs(pa.array([text])))).word_hashes().tolist() if text else []
        if len(words) >= window:
            shards[-1].append(words)
            held += len(words)
            if held >= SHARD_WORDS:
                shards.append([])
                held = 0
    spark = docs.sparkSession
    built = []
    for shard in shards:
        automaton = SuffixAutomaton()
        for words in shard:
            automaton.add(words)
        built.append(spark.sparkContext.broadcast((automaton.next, automaton.link, automaton.length)))
    columns, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for b in built:
            automaton = SuffixAutomaton()
            automaton.next, automaton.link, automaton.length = b.value
            automata.append(automaton)
        for batch in batches:
            texts = []
            for slab in slabs(batch.column(at)):
                hashes = slab.word_hashes()
                for r in range(slab.rows):
                    words = hashes[slab.first[r] : slab.first[r + 1]].tolist()
                    drop = np.zeros(len(words) + 1, np.int32)
                    for automaton in automata:
                        for end, have in enumerate(automaton.statistics(words)):
                            if have >= window:
                                drop[end + 1 - have] += 1
                                drop[end + 1] -= 1
                    gone = np.cumsum(drop[:-1]) > 0
                    texts.append(b" ".join(x for x, d in zip(slab.words(r), gone.tolist()) if not d).decode() if gone.any() else batch.column(at)[slab.lo + r].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], columns)

    return docs.mapInArrow(cut, docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    return removal_report(table(spark, sf_dir, "documents"))
