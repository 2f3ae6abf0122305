"""Best-fit packing of tokenised documents into sequences.

Tokenising: the vocabulary's words never cross white space, so a text's ids are the ids of its chunks, and a
bounded memo of chunks, kept by each Python worker, spares much of the work; chunks that hold rarer white space go to the tokenizer as they are.

Packing: pieces are dealt by hash to bins of bounded size, several thousand pieces each, and each bin is packed by
vector best-fit decreasing: a sequence has capacities of tokens, documents and attention cost (sum of squared lengths),
and a piece goes to the open sequence where it fits under every one of them and the weighted norm of the residuals
after it is least (or their dot-product with the piece's demands is largest). Only lengths are shuffled there, never ids.

Defined cases: a null or empty text is the end token alone; documents longer than a sequence are cut; repeated rows are documents
of their own (their pieces share doc_id and piece); a null id is kept; very long texts are tokenised whole, in memory of one task; an empty table gives no sequences;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, tidied
from tessera.llm.textscan import Slab, slabs

CAPACITY, END = 4096, 1
BIN_PIECES = 8192
WEIGHTS = (1.0, 1e-3, 1e-3)
def default_vocabulary() -> str:
    """Path of the public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks of letters with punctuation after them: one word to the tokenizer, or two.
_MARKS = r"!-&(-/:-@\[-`{-~"
_SIMPLE = rf"^[A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{12f}}\x{{131}}-\x{{24f}}]+[{_MARKS}]*$"
_MARKED = rf"[{_MARKS}]$"
_SECOND = 0xD1342543DE82EF95


class Ids:
    """Ids of texts, a slab at a time, with a memo of chunks (runs without white space) that is emptied when large.

    The memo is arrays sorted by a chunk's hash: a second hash, and where its ids lie. New chunks of the common form are encoded many in one text and
    told apart by the ids that end a word; the rest one by one.
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.levels = [none, none]  # (hash, second hash, place, number): all, and the latest
        self.flat, self.held = np.zeros(1 << 20, np.uint32), 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_chunks(self, slab: Slab, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks at bytes ``a..b`` of a slab: their order, each one's number of ids, and the ids end to end in that order."""
        raw, starts = _laid(slab.raw, a, b)
        chunks = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(starts), pa.py_buffer(raw))
        bare = pc.utf8_slice_codeunits(chunks, 0, -1)  # without the space
        simple = pc.match_substring_regex(bare, _SIMPLE).to_numpy(zero_copy_only=False) & (b - a <= 64)
        words = 1 + pc.match_substring_regex(bare, _MARKED).to_numpy(zero_copy_only=False).astype(np.int64)
        plain, rest = np.flatnonzero(simple), np.flatnonzero(~simple).tolist()
        if rest:
            raw, starts = _laid(slab.raw, a[plain], b[plain])
            words = words[plain]
        counts, found = [], []
        cuts = [*range(0, len(plain), 256), len(plain)]
        for lo in range(0, len(cuts) - 1, 16):
            part = cuts[lo : lo + 17]
            texts = [raw[starts[i] : starts[j]].decode() for i, j in zip(part, part[1:])]
            for i, j, got in zip(part, part[1:], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(got.ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                upto = np.cumsum(words[i:j])
                if len(last) == upto[-1]:
                    counts.append(np.diff(last[upto - 1], prepend=-1))
                    found.append(ids)
                else:
                    rest += plain[i:j].tolist()
                    plain[i:j] = -1
        alone = [self.encode(bare[i].as_py()) for i in rest]
        order = np.concatenate([plain[plain >= 0], np.array(rest, np.int64)])
        return order, np.concatenate([*counts, np.array([len(x) for x in alone], np.int64)]), np.concatenate([*found, *alone])

    def _find(self, level: tuple, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Row of each key in a level, or -1."""
        if not len(level[0]):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(level[0], h), len(level[0]) - 1)
        return np.where((level[0][at] == h) & (level[1][at] == g), at, -1)

    def _add(self, h: np.ndarray, g: np.ndarray, order: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put new keys, in the order of their hashes, into the memo; their places and numbers."""
        place, number = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        place[order], number[order] = self.held + np.cumsum(counts) - counts, counts
        end = self.held + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.held], np.zeros(max(end, len(self.flat)), np.uint32)])
        self.flat[self.held : end] = ids
        self.held = end
        self.levels[1] = self._merged(self.levels[1], (h, g, place, number))
        if len(self.levels[1][0]) > 200_000:
            self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return place, number

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))

    def of_slab(self, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row's begin (and the last ends)."""
        if sum(len(level[0]) for level in self.levels) > self.most:
            self.clear()
        h, g = slab.word_hashes(), slab.word_hashes(base=_SECOND)
        keys, first, code = np.unique(h, return_index=True, return_inverse=True)
        seconds = g[first]
        if len(h) and not np.array_equal(seconds[code], g):  # two chunks of one hash
            rows = [self.encode(slab.text(r)) for r in range(slab.rows)]
            return np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        place, number = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for level in self.levels:
            row = self._find(level, keys, seconds)
            hit = row >= 0
            place[hit], number[hit] = level[2][row[hit]], level[3][row[hit]]
        new = np.flatnonzero(place < 0)
        if len(new):
            got = self.encode_chunks(slab, slab.starts[first[new]], slab.ends[first[new]])
            place[new], number[new] = self._add(keys[new], seconds[new], *got)
        count = number[code]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(place[code] - upto[:-1], count)]
        return ids, upto[slab.first]


def _laid(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes at each ``a..b`` end to end, a space after each, and where each begins (and the last ends)."""
    n = b - a
    starts = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)
    data = np.full(starts[-1], 32, np.uint8)
    each = np.arange(n.sum())
    data[each + np.repeat(np.arange(len(n)), n)] = raw[each + np.repeat(a - (np.cumsum(n) - n), n)]
    return data.tobytes(), starts


@functools.cache
def _shared_ids(path: str) -> Ids:
    """One per Python worker, for all of its tasks."""
    return Ids(path)


def tokenize(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of the documents; no shuffle."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _shared_ids(path)
        for batch in batches:
            for slab in slabs(batch.column(1)):
                ids, bounds = memo.of_slab(slab)
                ids = np.insert(ids, bounds[1:], END).astype("<u4", copy=False)
                bounds = bounds + np.arange(len(bounds))
                out: list[list] = [[] for _ in names]
                for doc_id, lo, hi in zip(batch.column(0).slice(slab.lo, slab.rows).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    for k, at in enumerate(range(lo, hi, capacity)):
                        part = ids[at : min(at + capacity, hi)]
                        for column, v in zip(out, (doc_id, k, at - lo, len(part), zlib.crc32(part), part.tobytes() if keep_ids else None)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, most_docs: int = CAPACITY, most_attention: float = float(CAPACITY) ** 2, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, longest piece first.

    Residuals and demands are counted as shares of their capacities. ``rule`` is ``norm`` (least weighted norm of what is left) or ``dot``
    (largest weighted dot-product of demand and residual).
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, n))  # shares of tokens, documents, attention left in each open sequence
    used = np.zeros(n, np.int64)
    w, made = np.asarray(weights)[:, None], 0
    live = np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths[order[-1]] / capacity if n else 0
    slack = 1e-12
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size / capacity, 1 / most_docs, size * size / most_attention])
        pick = -1
        if len(live):
            rest = left[:, live] - need[:, None]
            fits = (rest >= -slack).all(0)
            if fits.any():
                score = (w * rest * rest).sum(0) if rule == "norm" else -(w * need[:, None] * left[:, live]).sum(0)
                pick = int(live[np.where(fits, score, np.inf).argmin()])
        if pick < 0:  # a piece goes alone where even an empty sequence is too small for it
            pick, made = made, made + 1
            left[:, pick] = 1.0
            live = np.append(live, pick)
        bins[i], offsets[i] = pick, used[pick]
        used[pick] += size
        left[:, pick] -= need
        if (left[:, pick] < np.array([smallest, 1 / most_docs, smallest * smallest]) - slack).any():
            live = live[live != pick]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_docs: int = CAPACITY, most_attention: float = float(CAPACITY) ** 2, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``pieces`` with (sequence_id, offset). The table is written first, so its rows are counted and dealt once."""
    pieces = materialize(pieces, "pieces")
    bins = max(1, math.ceil(pieces.count() / BIN_PIECES))
    columns = pieces.columns
    # a row's place in the written table is in the hash, so that many copies of one row are dealt out too
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(bins))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit(group["length"].to_numpy(), capacity, most_docs, most_attention, rule, weights)
        return group.assign(sequence_id=group["pack_bin"].to_numpy() * (1 << 24) + where, offset=offset)[[*columns, "sequence_id", "offset"]]

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return pieces.withColumn("pack_bin", key.cast("long")).groupBy("pack_bin").applyInPandas(one, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.expr("CAST('' AS BINARY)"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack(tokenize(table(spark, sf_dir, "documents")))
