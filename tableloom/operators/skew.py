"""Finding keys that hold too many rows for one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.session import local_frame, materialise

# Most hot keys that are sent to every executor; beyond it the plan joins instead.
BROADCAST_KEYS = 10_000


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``bound`` rows, with their row count ``_n``.

    ``small`` is true when the keys were counted and fit a broadcast.
    """

    rows: DataFrame
    small: bool
    empty: bool

    def marked(self) -> DataFrame:
        return F.broadcast(self.rows) if self.small else self.rows


def hot_keys(df: DataFrame, keys: Sequence[str], bound: int, limit: int = BROADCAST_KEYS) -> HotKeys:
    """Count rows per key in one pass over the key columns and keep the heavy ones.

    The pass combines on the map side, so a hot key costs nothing extra. At
    most ``limit`` + 1 keys reach the driver; more are written once, as plans
    join them in several places.
    """
    heavy = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
    found = heavy.limit(limit + 1).collect()
    if len(found) > limit:
        return HotKeys(materialise(heavy, "hot-keys"), small=False, empty=False)
    return HotKeys(local_frame(df.sparkSession, found, heavy.schema), small=True, empty=not found)
