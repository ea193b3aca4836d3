"""Deep pages by distributed ranks (SRT3): only the ranges of rows that a page lies in are read."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.operators.relational import order_terms
from tableloom.session import scratch_dir

_RANGE = "_range"


@dataclass(frozen=True)
class Pages:
    """Rows dealt to ranges of their order, one folder each, with the number of rows in each range.

    The ranges are written once, by one range exchange; any page is then found
    by the counts and read from the one or two ranges that hold it.
    """

    path: str
    frame: DataFrame
    order: tuple[str | tuple[str, str], ...]
    counts: tuple[tuple[int, int], ...]

    def __len__(self) -> int:
        return sum(n for _, n in self.counts)

    def ranges(self, skip: int, take: int) -> tuple[list[int], int]:
        """The ranges with the rows ``skip`` to ``skip + take``, and how many rows of the first lie before them."""
        ends = list(accumulate(n for _, n in self.counts))
        first, last = bisect_right(ends, skip), bisect_right(ends, skip + take - 1)
        if take <= 0 or first >= len(ends):
            return [], 0
        before = ends[first - 1] if first else 0
        return [r for r, _ in self.counts[first : last + 1]], skip - before

    def page(self, skip: int, take: int) -> DataFrame:
        """The rows ``skip`` to ``skip + take`` in order."""
        wanted, before = self.ranges(skip, take)
        rows = self.frame.filter(F.col(_RANGE).isin(wanted)) if wanted else self.frame.limit(0)
        return rows.drop(_RANGE).orderBy(*order_terms(self.order)).offset(before).limit(take)


def paged(df: DataFrame, *order: str | tuple[str, str], ranges: int | None = None) -> Pages:
    """Deal ``df`` to ranges of ``order``; give a unique last term, else ties are open.

    Rows equal in the whole order lie in one range.
    """
    path = scratch_dir(df.sparkSession, "pages")
    terms = order_terms(order)
    dealt = df.repartitionByRange(ranges, *terms) if ranges else df.repartitionByRange(*terms)
    dealt.withColumn(_RANGE, F.spark_partition_id()).write.partitionBy(_RANGE).parquet(path)
    written = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(_RANGE, T.IntegerType())])).parquet(path)
    # One row for each range.
    counts = written.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(_RANGE).collect()
    return Pages(path, written, tuple(order), tuple((r[_RANGE], r["n"]) for r in counts))


def page_of(df: DataFrame, skip: int, take: int, *order: str | tuple[str, str]) -> DataFrame:
    """One deep page of ``df``; for several pages of one order keep :func:`paged`."""
    return paged(df, *order).page(skip, take)


def fill(pages: Pages, size: int) -> Sequence[tuple[int, int]]:
    """The pages of one size as (skip, take)."""
    return [(k, min(size, len(pages) - k)) for k in range(0, len(pages), size)]
