"""The cut-off extraction as a stream: header-line pairs as their changes arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableloom.operators.relational import literal

_HEAD, _LINE = "_head_at", "_line_at"


def stream_pairs(
    header: DataFrame,
    line: DataFrame,
    on: tuple[str, str],
    changed: tuple[str, str],
    within: dt.timedelta,
    late: dt.timedelta,
    last_cutoff: dt.datetime | None = None,
    new_cutoff: dt.datetime | None = None,
) -> DataFrame:
    """Pairs of two streams of changes, each as soon as its later change is there.

    A pair is emitted once per arrival of the later side; changes more than
    ``within`` apart make no pair, so a row waits no longer than that. Rows
    later than ``late`` behind the newest change are dropped, and the state
    of rows that can meet nothing more is let go. With cut-offs only pairs
    whose later change lies in ``(last_cutoff, new_cutoff]`` are emitted; what
    is newer is not kept.
    """

    def marked(df: DataFrame, column: str, name: str) -> DataFrame:
        if new_cutoff is not None:
            df = df.filter(F.col(column) <= literal(new_cutoff))
        return df.withColumn(name, F.col(column).cast("timestamp")).withWatermark(name, f"{int(late.total_seconds())} seconds")

    apart = F.make_dt_interval(secs=F.lit(within.total_seconds()).cast("decimal(18,6)"))
    h, x = F.col(_HEAD), F.col(_LINE)
    pairs = marked(header, changed[0], _HEAD).join(marked(line, changed[1], _LINE), (F.col(on[0]) == F.col(on[1])) & (x >= h - apart) & (x <= h + apart))
    if last_cutoff is not None:
        pairs = pairs.filter((F.col(changed[0]) > literal(last_cutoff)) | (F.col(changed[1]) > literal(last_cutoff)))
    return pairs.drop(_HEAD, _LINE)


def write_pairs(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the pairs to a folder until the input at hand is used up; a batch that runs again adds nothing."""
    return pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
