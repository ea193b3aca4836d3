"""Differences of two keyed tables found by digests, so that equal data stays where it is (E7e, E8e).

Both sides sum the hashes of their rows per bucket of keys, which shrinks each
task's rows to one record per bucket. Buckets whose digests differ are looked at
again in finer buckets, and only rows of fine buckets that still differ are
shuffled and compared field by field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.canonical import row_hash
from tableloom.operators.equivalence import keyed_difference

# Buckets of the first look, and finer ones in each of them: at most their product reaches a broadcast.
BUCKETS, FINER = 1024, 64
_LOW = 0xFFFFFFFF


def _bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by the canonical form of its key, which does not depend on the types of a side."""
    return F.pmod(row_hash(df.select(*keys), rename=lambda n: n)["h0"], F.lit(buckets)).cast("int")


def _digests(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``bucket, n, a, b, c``: count and sums of the halves of the row hashes; repeated rows count as often as they occur."""
    rows = df.select(_bucket(df, keys, buckets).alias("bucket"), row_hash(df, rename=lambda n: n).alias("h"))
    low, high = F.col("h.h0").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("h.h0", 32)
    other = F.shiftrightunsigned("h.h1", 32)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(low).alias("a"), F.sum(high).alias("b"), F.sum(other).alias("c"))


def _differing(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The buckets whose rows are not the same on both sides; one exchange of at most ``buckets`` records per task."""
    sides = [_digests(df, keys, buckets).withColumn("side", F.lit(k)) for k, df in enumerate((left, right))]
    values = F.struct("n", "a", "b", "c")
    both = sides[0].unionByName(sides[1]).groupBy("bucket").agg(*[F.max(F.when(F.col("side") == k, values)).alias(f"s{k}") for k in (0, 1)])
    return both.filter(~F.col("s0").eqNullSafe(F.col("s1"))).select(F.col("bucket").alias("_bucket"))


def _only(df: DataFrame, keys: Sequence[str], buckets: int, wanted: DataFrame) -> DataFrame:
    return df.join(F.broadcast(wanted), _bucket(df, keys, buckets) == F.col("_bucket"), "left_semi")


def suspects(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, finer: int = FINER) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in buckets that differ; every row whose key differs is among them."""
    coarse = _differing(left, right, keys, buckets)
    near = [_only(df, keys, buckets, coarse) for df in (left, right)]
    fine = _differing(*near, keys, buckets * finer)
    return tuple(_only(df, keys, buckets * finer, fine) for df in near)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, finer: int = FINER) -> DataFrame:
    """The rows of :func:`keyed_difference`, with a shuffle that follows the number of differing buckets.

    Equal repeated keys in a bucket without differences are not reported as
    duplicates: the two sides are the same there.
    """
    return keyed_difference(*suspects(left, right, keys, buckets, finer), keys)
