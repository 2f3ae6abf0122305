"""Counting inside documents, batch by batch in Arrow: what a document holds more than once becomes one row before anything is grouped or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessera.functions import text as T

#: Items (words, characters) that are counted at once, unless a single row has more.
AT_ONCE = 1_000_000
#: Partitions of what is dealt out by document or term hold about this much of the stored table.
DEALT_BYTES, MOST_DEALT, UNKNOWN = 8 << 20, 4096, 1 << 50
#: The default analysis' letters as UTF-8: a-z are one byte each, all others begin with the same byte.
_LETTER, _AFTER_LEAD = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LEAD = "á".encode()[0]
for _c in T.LOW_ES.removeprefix("a-z"):
    assert len(_c.encode()) == 2 and _c.encode()[0] == _LEAD
    _AFTER_LEAD[_c.encode()[1]] = True


def _slices(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with ``at_once`` items at most, or one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        yield a, b
        a = b


def _tally(ids: pa.Array, flat: pa.Array, n: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each row's distinct words: ``flat`` holds the words of all rows, one after the other, and ``n`` how many each row has."""
    flat = flat.dictionary_encode(null_encoding="encode")
    width = len(flat.dictionary)
    key, first, tf = np.unique(np.repeat(np.arange(len(n)), n) * width + flat.indices.to_numpy(), return_index=True, return_counts=True)
    row = key // width
    return pa.RecordBatch.from_arrays(
        [flat.dictionary.take(pa.array(key % width)), ids.take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array((first - (np.cumsum(n) - n)[row]).astype(np.int32)), pa.array(n[row])], schema=schema
    )


def _words(batches: Iterator[pa.RecordBatch], schema: pa.Schema, at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for a, b in _slices(sizes, at_once):
            flat = batch.column(1).slice(a, b - a).flatten()
            if len(flat):
                yield _tally(batch.column(0).slice(a, b - a), flat, sizes[a:b].astype(np.int64), schema)


def _runs(texts: pa.Array, shortest: int, longest: int) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, one after the other, and their number for each text: ``T.analyzed(T.letter_words(text))``, found in the texts' bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = np.zeros(len(texts), np.int64)
    if at[0] == at[-1]:
        return pa.array([], pa.string()), n
    data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    letter = _LETTER[data]
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == _LEAD) & _AFTER_LEAD[data[1:]]
    letter |= lead
    letter[1:] |= lead[:-1]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends with its text
    begins[edges] = letter[edges]
    ends[edges - 1] = letter[edges - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    size = ends - begins - (leads[ends] - leads[begins])
    kept = (size >= shortest) & (size <= longest)
    begins, ends = begins[kept], ends[kept]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    held = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    np.add.at(n, np.searchsorted(at, begins, side="right") - 1, 1)
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(held)), n


def _letter_words(batches: Iterator[pa.RecordBatch], schema: pa.Schema, at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for a, b in _slices(sizes, at_once):
            flat, n = _runs(batch.column(1).slice(a, b - a), T.MIN_LENGTH, T.MAX_LENGTH)
            if len(flat):
                yield _tally(batch.column(0).slice(a, b - a), flat.cast(pa.string()), n, schema)


def _tallied(docs: DataFrame, words: Column, count) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("term", StringType()), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("tf", LongType()), StructField("pos", IntegerType()), StructField("dl", LongType())])
    arrow, at_once = to_arrow_schema(schema), AT_ONCE
    return docs.select("doc_id", words.alias("words")).mapInArrow(lambda batches: count(batches, arrow, at_once), schema)


def words_by_row(docs: DataFrame, words: Column) -> DataFrame:
    """(term, doc_id, tf, pos, dl) for each row of ``docs`` and each of its distinct words: how often, where first (from 0), and the row's number of words."""
    return _tallied(docs, words, _words)


def letter_words_by_row(docs: DataFrame) -> DataFrame:
    """``words_by_row`` of the default analysis of the texts, without a regular expression: words are runs of letters' bytes in whole batches."""
    return _tallied(docs, F.lower("text"), _letter_words)


def unique_ids(docs: DataFrame) -> bool:
    """Whether no two rows share a doc_id."""
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0


def words_by_document(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """``words_by_row`` (without ``words``: ``letter_words_by_row``) with rows of the same doc_id taken together, as if their words followed each other. Nothing is shuffled where ids are unique."""
    rows = letter_words_by_row(docs) if words is None else words_by_row(docs, words)
    if unique_ids(docs):
        return rows
    merged = rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.min("pos").alias("pos"))
    lengths = rows.groupBy("doc_id").agg(F.sum("tf").alias("dl")).withColumnRenamed("doc_id", "of")
    return merged.join(lengths, F.col("doc_id").eqNullSafe(F.col("of"))).select("term", "doc_id", "tf", "pos", "dl")


def partitions_for(table: DataFrame) -> int:
    """Into how many partitions a stored table is dealt: as its bytes ask, and no fewer than the session's. Tables of unknown size get the session's."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_DEALT, -(-size // DEALT_BYTES)) if size < UNKNOWN else 0)


def _codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one row, and their number for each text (null: 0)."""
    parts = [(x or "").encode("utf-32-le") for x in text.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint32).astype(np.int64), np.array([len(x) // 4 for x in parts], np.int64)


def _characters(batches: Iterator[pa.RecordBatch], schema: pa.Schema, pairs: bool, at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for a, b in _slices(sizes, at_once):
            keys = batch.column(0).slice(a, b - a).dictionary_encode(null_encoding="encode")
            codes, n = _codes(batch.column(1).slice(a, b - a))
            text = np.repeat(np.arange(b - a), n)
            owner = keys.indices.to_numpy()[text]
            if pairs:
                inside = text[:-1] == text[1:]
                packed = (owner[:-1].astype(np.int64) << 42 | codes[:-1] << 21 | codes[1:])[inside]
            else:
                packed = owner.astype(np.int64) << 21 | codes
            found, count = np.unique(packed, return_counts=True)
            if not len(found):
                continue
            last = pa.array(_strings(found & 0x1FFFFF))
            columns = [pa.array(_strings(found >> 21 & 0x1FFFFF)), last] if pairs else [last]
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(found >> (42 if pairs else 21))), *columns, pa.array(count.astype(np.int64))], schema=schema)


def _strings(codes: np.ndarray) -> pa.Array:
    """One-character strings."""
    known, at = np.unique(codes, return_inverse=True)
    return pa.array([chr(c) for c in known], pa.string()).take(pa.array(at))


def _counted(texts: DataFrame, key: str, text: Column, pairs: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ["a", "b"] if pairs else ["letter"]
    schema = StructType([StructField(key, texts.schema[key].dataType), *[StructField(c, StringType()) for c in names], StructField("n", LongType())])
    arrow, at_once = to_arrow_schema(schema), AT_ONCE
    return texts.select(key, text.alias("text")).mapInArrow(lambda batches: _characters(batches, arrow, pairs, at_once), schema)


def character_pairs(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, a, b, n): adjacent characters of each text, counted within batches; a key may come again in other batches."""
    return _counted(texts, key, text, True)


def characters(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, letter, n), counted within batches."""
    return _counted(texts, key, text, False)
