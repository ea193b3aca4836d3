"""Documents packed into sequences of a fixed window.

Spark cuts the documents into pieces and counts the pieces of each length. The
combinations of up to three lengths that fill the window are enumerated, their
repeat counts solved against that histogram as non-negative least squares and
rounded, and the rest is packed greedily. All of that works on counts, one for
each length, so its size depends on the window alone. A piece then finds its
place from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.tokens import VOCABULARY, encoder, joined
from tableloom.session import materialise

WINDOW = 1024
# Pieces of one length that one task numbers, about.
BLOCK = 20_000


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of each piece, and with ``with_ids`` its ids as bytes.

    A document is its ids and an end id, cut into whole windows and a rest. A
    null or empty text is the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_documents
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
        for batch in joined(batches):
            counts, crcs, raws = [], [], []
            for ids in encode(batch.column(1)):
                counts.append(len(ids))
                raw = memoryview(ids).cast("B")
                found = [raw[at : at + 4 * window] for at in range(0, len(raw), 4 * window)]
                crcs += map(zlib.crc32, found)
                if with_ids:
                    raws += map(bytes, found)
            tokens = np.array(counts, dtype=np.int64)
            many = -(-tokens // window)
            row = np.repeat(np.arange(len(tokens)), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * window
            length = np.minimum(window, tokens[row] - start)
            arrays = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(tokens[row])]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(raws, pa.binary())] * with_ids], names=names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, schema)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Every one to three of the lengths, from the longest down, whose sum is the window; 0 fills the row."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    rows = [np.array([[window, 0, 0]])] if have[window] else []
    a = np.arange((window + 1) // 2, window)
    a = a[have[a] & have[window - a]]
    rows.append(np.stack([a, window - a, np.zeros_like(a)], axis=1))
    for c in lengths[lengths <= window // 3]:
        b = np.arange(c, (window - c) // 2 + 1)
        b = b[have[b] & have[window - c - b]]
        rows.append(np.stack([window - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(rows)


def repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose lengths come nearest to the histogram: projected gradient with momentum."""
    flat = combos.reshape(-1)

    def made(x):
        total = np.bincount(flat, np.repeat(x, 3), minlength=len(histogram))
        total[0] = 0
        return total

    def back(r):
        return r[combos].sum(axis=1)

    scale = max(histogram.max(), 1)
    want = histogram / scale
    probe = np.ones(len(combos))
    for _ in range(20):
        probe = back(made(probe))
        size = np.linalg.norm(probe)
        probe /= size or 1
    rate = 1 / (size * 1.05 or 1)
    x = ahead = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - rate * back(made(ahead) - want))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, x = new + (before - 1) / t * (new - x), new
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use up the histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    window = len(left) - 1
    patterns = []
    lengths = np.flatnonzero(left)
    if len(lengths):
        combos = combinations(lengths, window)
        if len(combos):
            wanted = np.rint(repeats(combos, left.astype(np.float64))).astype(np.int64)
            for k in np.argsort(-wanted, kind="stable"):
                if wanted[k] <= 0:
                    break
                patterns += _take(left, tuple(int(x) for x in combos[k] if x), int(wanted[k]))
    # The rest: the longest piece left, and after it each time the longest that fits.
    while (lengths := np.flatnonzero(left)).size:
        pattern, gap, used = [], window, {}
        for length in lengths[::-1].tolist():
            n = min(gap // length, int(left[length]))
            if n:
                pattern += [length] * n
                used[length] = n
                gap -= n * length
            if gap == 0:
                break
        patterns += _take(left, tuple(pattern), min(int(left[x]) // n for x, n in used.items()))
    return patterns


def _take(left: np.ndarray, pattern: tuple[int, ...], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Use a pattern as often as the lengths left allow, at most ``most`` times."""
    lengths, counts = np.unique(pattern, return_counts=True)
    n = min(most, int((left[lengths] // counts).min()))
    left[lengths] -= n * counts
    return [(pattern, n)] if n else []


class Places:
    """From a length and a number among the pieces of that length to the sequence and the offset in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], window: int):
        rows = [[] for _ in range(window + 1)]
        done = np.zeros(window + 1, dtype=np.int64)
        sequence = 0
        for pattern, n in patterns:
            offset = 0
            for length, many in zip(*(x.tolist() for x in np.unique(pattern, return_counts=True)), strict=True):
                rows[length].append((done[length], many, sequence, offset))
                done[length] += n * many
                offset += many * length
            sequence += n
        self.sequences = sequence
        self.first = np.cumsum([0, *map(len, rows)])
        self.rows = np.array([r for per in rows for r in per], dtype=np.int64).reshape(-1, 4)
        # One sorted key for all lengths.
        self.span = int(done.max()) + 1 if len(done) else 1
        self.keys = np.repeat(np.arange(window + 1), np.diff(self.first)) * self.span + self.rows[:, 0]

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * self.span + number, side="right") - 1
        begin, many, sequence, offset = self.rows[at].T
        nth = number - begin
        return sequence + nth // many, offset + nth % many * length


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; see ``pieces``.

    Sequences are numbered from 0 and hold at most ``window`` ids without gaps.
    Repeated rows are packed as often as they occur; an empty table gives no
    rows; other columns are not read.
    """
    # A dealt number spreads copies of one piece; it is written, so that it stays the same.
    cut = materialise(pieces(docs, window, vocabulary, with_ids).withColumn("deal", F.monotonically_increasing_id() % 1024), "pieces")
    counts = cut.groupBy("length").count().collect()  # one row for each length: ``window`` at most
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts:
        histogram[length] = n
    places = Places(plan(histogram), window)

    # Numbers within a length: by block first, as one length may hold most pieces.
    blocks = max(64, int(histogram.sum()) // BLOCK)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "deal"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32"))
    numbered = dealt.withColumn("nth", nth.cast("bigint") - 1).join(sizes, ["length", "block"])

    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = F.pandas_udf(place, "struct<sequence_id bigint, offset bigint>")(F.col("length"), F.col("before") + F.col("nth"))
    return numbered.withColumn("at", found).select(*cut.drop("deal").columns, "at.sequence_id", "at.offset")
