"""Text search with a pruned scan (PRE5): Bloom filters of trigrams of bytes tell which files can hold a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.session import local_frame

# Bits of the filter of one file; Spark's bitmaps hold 32 768 each.
BITS = 1 << 18


# Bits of one bitmap.
_BLOCK = 32_768
_TRIGRAMS = 1 << 24
# Bytes of text that are looked at together.
_TOGETHER = 1 << 20


def _numbers(data: np.ndarray) -> np.ndarray:
    """The number of the trigram of bytes at each place but the last two."""
    wide = data.astype(np.uint32)
    return wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]


def _places(trigrams: np.ndarray, bits: int) -> np.ndarray:
    """The bits of trigrams, each once."""
    return np.unique((trigrams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(bits)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """``file, bucket, bits`` of runs of ``file, text``; a run is a file as a task reads it."""
    file, seen = None, None

    def rows() -> pa.RecordBatch:
        marked = np.zeros(-(-bits // _BLOCK) * _BLOCK, dtype=np.uint8)
        marked[_places(np.flatnonzero(seen), bits)] = 1
        blocks = [np.packbits(block, bitorder="little").tobytes() for block in marked.reshape(-1, _BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(blocks)), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], names=["file", "bucket", "bits"])

    for batch in batches:
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            name = files.dictionary[int(codes[low])].as_py()
            if name != file:
                if seen is not None:
                    yield rows()
                file, seen = name, np.zeros(_TRIGRAMS, dtype=bool)
            texts = batch.column(1).slice(low, high - low).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
            if ends[-1] - ends[0] < 3:
                continue
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
            # No trigram reaches from one text into the next.
            across = np.concatenate([ends[1:] - 1, ends[1:] - 2]) - ends[0]
            across.sort()
            for start in range(0, len(data) - 2, _TOGETHER):
                numbers = _numbers(data[start : start + _TOGETHER + 2])
                left = across[np.searchsorted(across, start) : np.searchsorted(across, start + len(numbers))] - start
                inside = np.ones(len(numbers), dtype=bool)
                inside[left] = False
                seen[numbers[inside]] = True
    if seen is not None:
        yield rows()


@dataclass(frozen=True)
class TextIndex:
    """``filters``: ``file, bucket, bits`` beside the table at ``path``."""

    path: str
    schema: object
    column: str
    filters: DataFrame
    bits: int

    def files(self, needle: str) -> list[str] | None:
        """The files that can hold ``needle``, in any case; ``None`` if it is too short to tell."""
        spark = self.filters.sparkSession
        lowered = local_frame(spark, [(needle,)], "needle string").select(F.lower("needle").cast("binary")).first()[0]
        places = _places(_numbers(np.frombuffer(lowered, dtype=np.uint8)), self.bits).tolist() if len(lowered) >= 3 else []
        n = len(places)
        if not n:
            return None
        wanted = local_frame(spark, [(p // _BLOCK, p % _BLOCK) for p in places], "bucket bigint, at int")
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hits = self.filters.join(F.broadcast(wanted), "bucket").filter(F.call_function("getbit", byte, (F.col("at") % 8).cast("int")) == 1)
        found = hits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n)
        return sorted(r["file"] for r in found.select("file").collect())

    def search(self, needle: str, ignore_case: bool = False) -> DataFrame:
        """The rows whose text holds ``needle``; files whose filter lacks one of its trigrams are not opened."""
        spark = self.filters.sparkSession
        chosen = self.files(needle)
        if chosen is None:
            rows = spark.read.schema(self.schema).parquet(self.path)
        elif chosen:
            rows = spark.read.schema(self.schema).parquet(*chosen)
        else:
            return spark.createDataFrame([], self.schema)
        text = F.lower(self.column) if ignore_case else F.col(self.column)
        return rows.filter(text.contains(needle.lower() if ignore_case else needle))


def index_text(spark, path: str, column: str, bits: int = BITS) -> TextIndex:
    """Build the filters of a parquet table in one scan of the text column.

    A task marks the trigrams it sees in one table for each of its files, and
    sends the bits of that table once.
    """
    rows = spark.read.parquet(path)
    texts = rows.select(F.col("_metadata.file_path").alias("file"), F.lower(F.col(column).cast("string")).cast("binary").alias("text"))
    marked = texts.mapInArrow(lambda batches: _marks(batches, bits), "file string, bucket bigint, bits binary")
    filters = marked.groupBy("file", "bucket").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
    return TextIndex(path, rows.schema, column, filters, bits)


def write_index(index: TextIndex, folder: str) -> TextIndex:
    """Store the filters as a side table and read them from there."""
    index.filters.write.mode("overwrite").parquet(folder)
    stored = index.filters.sparkSession.read.schema(index.filters.schema).parquet(folder)
    return TextIndex(index.path, index.schema, index.column, stored, index.bits)
