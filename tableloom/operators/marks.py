"""Rows told apart by whether their key may be among many others, without a shuffle of the rows.

The hashes of the keys are marked in bits that are broadcast, 16 MB at most. A
marked row may have one of the keys, one without a mark has none of them for
certain; so an exact join needs the marked rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.session import materialise

# The bounds on the number of bits: about sixteen for each key lie between.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def key_hash(keys: Sequence[str]) -> Column:
    """The hash of a key; equal keys have equal ones, with nulls too."""
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def _free(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Marks:
    """``rows``: a bucket and its marks, of ``bits`` bits in all; no rows where ``empty``."""

    rows: DataFrame
    bits: int
    empty: bool

    def _looked_up(self, rows: DataFrame, keys: Sequence[str], how: str) -> tuple[DataFrame, Column]:
        at, bucket, marks = (_free(rows, n) for n in ("_at", "_in", "_marks"))
        found = F.broadcast(self.rows.toDF(bucket, marks))  # ``MOST_BITS`` at most
        place = F.pmod(key_hash(keys), F.lit(self.bits))
        rows = rows.withColumn(at, place).withColumn(bucket, F.call_function("bitmap_bucket_number", F.col(at)))
        position = F.call_function("bitmap_bit_position", F.col(at))
        byte = F.conv(F.hex(F.substring(marks, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return rows.join(found, bucket, how), F.call_function("getbit", byte, (position % 8).cast("int")) == 1

    def met(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The rows whose key may be marked: all that are, and few others."""
        joined, bit = self._looked_up(rows, keys, "inner")
        return joined.where(bit).select(*[F.col(f"`{c}`") for c in rows.columns])

    def others(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The rows that ``met`` leaves out."""
        if self.empty:
            return rows
        joined, bit = self._looked_up(rows, keys, "left")
        return joined.where(~F.coalesce(bit, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns])


def mark(hashes: DataFrame) -> Marks:
    """Marks for the keys with the hashes in the one column of ``hashes``."""
    written = materialise(hashes.toDF("h"), "marked-keys")
    n = written.count()
    bits = 1 << (min(max(16 * n, LEAST_BITS), MOST_BITS) - 1).bit_length()
    place = F.pmod("h", F.lit(bits))
    rows = written.groupBy(F.call_function("bitmap_bucket_number", place).alias("bucket"))
    rows = rows.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("marks"))
    return Marks(rows, bits, n == 0)
