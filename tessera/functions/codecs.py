"""Postings compression: gaps, variable bytes and Elias gamma.

Sizes are expressions; bytes are made by Arrow-batched UDFs, one value per posting list.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


def vbyte_encode(values: Iterable[int]) -> bytes:
    """7 bits a byte, most significant first; the last byte of a value has its high bit set."""
    out = bytearray()
    for n in values:
        if n < 0:
            raise ValueError("variable bytes need values of 0 or more")
        at = len(out)
        out.append(n & 127 | 128)
        while n := n >> 7:
            out.insert(at, n & 127)
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    """Inverse of ``vbyte_encode``."""
    out, n = [], 0
    for byte in data:
        n = n << 7 | byte & 127
        if byte & 128:
            out.append(n)
            n = 0
    return out


def gamma_encode(values: Iterable[int]) -> bytes:
    """As many zeros as the value has bits after its first, then the value; the list padded to whole bytes."""
    bits = []
    for n in values:
        if n < 1:
            raise ValueError("Elias gamma needs values of 1 or more")
        bits.append("0" * (n.bit_length() - 1) + f"{n:b}")
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")


def gamma_decode(data: bytes, count: int) -> list[int]:
    """The first ``count`` values."""
    text, at, out = f"{int.from_bytes(data, 'big'):0{len(data) * 8}b}" if data else "", 0, []
    for _ in range(count):
        one = text.index("1", at)
        end = 2 * one - at + 1
        out.append(int(text[one:end], 2))
        at = end
    return out


def gaps(values: Iterable[int]) -> list[int]:
    """Differences of consecutive values, the first from 0."""
    out, last = [], 0
    for v in values:
        out.append(v - last)
        last = v
    return out


def ungaps(values: Iterable[int]) -> list[int]:
    """Running sums."""
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def bit_length(n: Column) -> Column:
    """Bits of a value of 0 or more (0 for 0)."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def vbyte_size(n: Column) -> Column:
    """Bytes of a value."""
    return F.greatest(F.lit(1), F.ceil(bit_length(n) / 7)).cast("long")


def gamma_bits(n: Column) -> Column:
    """Bits of a value of 1 or more."""
    return (2 * bit_length(n) - 1).cast("long")


def with_gaps(postings: DataFrame) -> DataFrame:
    """``postings`` with ``gap``, the difference to the term's document before."""
    before = F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id"))
    return postings.withColumn("gap", F.col("doc_id") - F.coalesce(before, F.lit(0)))


def without_gaps(gapped: DataFrame) -> DataFrame:
    """Document ids restored from (term, ord, gap)."""
    return gapped.withColumn("doc_id", F.sum("gap").over(Window.partitionBy("term").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


@F.pandas_udf(BinaryType())
def vbyte_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: vbyte_encode(int(x) for x in v))


@F.pandas_udf(BinaryType())
def vbyte_gaps_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: vbyte_encode(gaps(int(x) for x in v)))


@F.pandas_udf(BinaryType())
def gamma_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: gamma_encode(int(x) for x in v))


@F.pandas_udf(ArrayType(LongType()))
def vbyte_sums(data: pd.Series) -> pd.Series:
    """The ids whose gaps are encoded, by one running sum a list."""
    return data.map(lambda d: np.cumsum(vbyte_decode(d), dtype=np.int64))


@F.pandas_udf(ArrayType(LongType()))
def vbyte_values(data: pd.Series) -> pd.Series:
    return data.map(vbyte_decode)


@F.pandas_udf(ArrayType(LongType()))
def gamma_values(data: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([gamma_decode(d, int(n)) for d, n in zip(data, count)], dtype=object)


def compress_index(lists: DataFrame, d_gaps: bool = True) -> DataFrame:
    """(term, docid, freq, df) lists, or blocks of them, to (term, df, docid_bytes, freq_bytes); further columns stay. Gaps begin anew in each row."""
    ids = vbyte_gaps_column("docid") if d_gaps else vbyte_column("docid")
    return lists.select(*[c for c in lists.columns if c not in ("docid", "freq")], ids.alias("docid_bytes"), gamma_column("freq").alias("freq_bytes"))


def decompress_index(packed: DataFrame, d_gaps: bool = True) -> DataFrame:
    """Inverse of ``compress_index``."""
    ids = vbyte_sums("docid_bytes") if d_gaps else vbyte_values("docid_bytes")
    return packed.select(*[c for c in packed.columns if c not in ("docid_bytes", "freq_bytes")], ids.alias("docid"), gamma_values("freq_bytes", "df").alias("freq"))


def fetch_posting(packed: DataFrame, term: str, d_gaps: bool = True) -> DataFrame:
    """(doc_id, tf) of one term; no rows for an unknown one. The filter reaches the table's scan."""
    one = decompress_index(packed.where(F.col("term") == term), d_gaps)
    return one.select(F.explode(F.arrays_zip("docid", "freq")).alias("p")).select(F.col("p.docid").alias("doc_id"), F.col("p.freq").alias("tf"))
