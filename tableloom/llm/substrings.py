"""Long repeated word sequences, found by recompression.

A text is a sequence of word names, and rounds of recompression cut it into
ever longer symbols: runs of one symbol become a symbol, then pairs of a left
and a right symbol, where a bit of the name says which it is. A name is a digest
of the words that a symbol stands for, so every task gives the same name to the
same words without a table of names. Symbols grow only up to a limit per round.
So whether a position is a border depends on the ``REACH`` words around it, and
equal texts have equal borders, but for so many words at their ends.

A window of ``WINDOW`` words holds a border (or lies in a run) whose surrounding
words lie in the window, so repeated windows share such an anchor: shared
anchors reveal them. Further rounds make symbols of some dozens of words; a pair
of neighbours that occurs twice verifies all windows within it at once. What is
left of the revealed windows is verified by digests of the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.lines import version
from tableloom.session import materialise

WINDOW = 35
# Lengths up to which symbols may merge: one round of runs, then rounds of pairs.
RUNS, PAIRS = 1, (1, 2, 2, 3, 4)
HIGH = (8, 16, 16, 32, 32)
REACH = RUNS + sum(PAIRS)
# Anchors of a window lie in so many positions of it. Symbols that are no runs are shorter; in a longer run every position is an anchor.
ZONE = WINDOW - 2 * REACH + 1
assert 2 * PAIRS[-1] <= ZONE
LONGEST = 1 << 10  # words in a pair of high symbols; longer ones are left to the windows

# Words that are looked at together; a longer text is looked at alone.
WORDS = 200_000
# How an occurrence is known: alone among the texts looked at together, repeated among them, or standing for those.
ALONE, REPEATED, WITNESS = 0, 1, 2

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEED = 42


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: runs without ASCII white space."""
    return text.split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names:
    """Names of any stretches of a sequence of words: polynomials over their 64-bit names, from running sums."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = np.full(n + 1, base, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * power[:n], dtype=np.uint64, out=self.sums[1:])
        power[1:] = pow(base, -1, 1 << 64)
        power[0] = 1
        self.back = np.cumprod(power, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def names_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, _SEED) for w in words), dtype=np.uint64, count=len(words))


def _merged(borders: np.ndarray, fixed: np.ndarray, names: Names, limit: int, turn: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Borders left after a round; ``fixed`` are ends of texts. No turn: runs, else the turn chooses left and right."""
    start, end = borders[:-1], borders[1:]
    name = names.of(start, end)
    short = end - start <= limit
    if turn is None:
        gone = name[:-1] == name[1:]
    else:
        right = _mix(name + np.uint64((turn + 1) * _BASES[1] % (1 << 64))) >> np.uint64(63)
        gone = right[:-1] < right[1:]
    gone &= short[:-1] & short[1:]
    keep = np.ones(len(borders), dtype=bool)
    keep[1:-1] = ~gone | fixed[1:-1]
    return borders[keep], fixed[keep]


def symbols(names: Names, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the low and of the high symbols of texts of ``n`` words in all, which end at ``ends``."""
    borders = np.arange(n + 1)
    fixed = np.zeros(n + 1, dtype=bool)
    fixed[0] = True
    fixed[ends] = True
    borders, fixed = _merged(borders, fixed, names, RUNS, None)
    for turn, limit in enumerate(PAIRS):
        borders, fixed = _merged(borders, fixed, names, limit, turn)
    low = borders
    for turn, limit in enumerate(HIGH, len(PAIRS)):
        borders, fixed = _merged(borders, fixed, names, limit, None)
        borders, fixed = _merged(borders, fixed, names, limit, turn)
    return low, borders


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(before - starts, sizes)


class _Texts:
    """Texts that are looked at together: their rows, word names and places."""

    def __init__(self, rows: list[int], names: list[np.ndarray]):
        self.rows = np.array(rows)
        self.sizes = np.array([len(x) for x in names], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.words = np.concatenate(names)
        self.n = len(self.words)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _grouped(key: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by key, the first of each key among them, and whether the key has several."""
    order = np.lexsort((key2, key))
    a, b = key[order], key2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(order))) > 1
    return order, first, np.repeat(several, np.diff(np.append(first, len(order))))


def _found(texts: _Texts, start: np.ndarray, length: np.ndarray, key: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, start, meta, key, key2`` of stretches, those repeated among these texts marked, with one more row that stands for them.

    ``meta`` is four times the length and the kind.
    """
    order, first, several = _grouped(key, key2)
    owner = texts.owner(start)
    place = start - (texts.ends - texts.sizes)[owner]
    kind = np.where(several, REPEATED, ALONE)
    stands = first[several[first]]
    pick = np.concatenate([order, order[stands]])
    kind = np.concatenate([kind, np.full(len(stands), WITNESS)])
    return texts.rows[owner[pick]], place[pick], length[pick] << 2 | kind, key[pick], key2[pick]


def _occurrences(texts: _Texts) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors (length 0) and pairs of high symbols."""
    names = Names(texts.words, _BASES[0])
    low, high = symbols(names, texts.ends, texts.n)
    sizes = np.diff(low)
    run = sizes > ZONE
    anchors = np.concatenate([low, _ranges(low[:-1][run] + 1, sizes[run] - 1)]) if run.any() else low
    owner = np.minimum(texts.owner(anchors), len(texts.ends) - 1)
    begin = (texts.ends - texts.sizes)[owner]
    anchors = anchors[(anchors - REACH >= begin) & (anchors + REACH <= texts.ends[owner])]
    key = names.of(anchors - REACH, anchors + REACH)
    yield _found(texts, anchors, np.zeros_like(anchors), key, np.zeros_like(key))

    start, end = high[:-2], high[2:]
    size = end - start
    whole = (size >= WINDOW) & (size < LONGEST) & (texts.owner(start) == texts.owner(end - 1))
    start, end = start[whole], end[whole]
    other = Names(_mix(texts.words), _BASES[1])
    yield _found(texts, start, end - start, names.of(start, end), other.of(start, end))


def _windows(texts: _Texts, wanted: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The wanted windows of each text."""
    start = np.concatenate([w + b for w, b in zip(wanted, (texts.ends - texts.sizes).tolist(), strict=True)])
    if len(start):
        end = start + WINDOW
        names, other = Names(texts.words, _BASES[0]), Names(_mix(texts.words), _BASES[1])
        yield _found(texts, start, np.full(len(start), WINDOW), names.of(start, end), other.of(start, end))


def _covered(n: int, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Which of ``n`` places lie between ``at + first`` and ``at + last``."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.clip(at + first, 0, n), 1)
    np.add.at(change, np.clip(at + last + 1, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def _spans(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.clip(start, 0, n), 1)
    np.add.at(change, np.clip(start + size, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def _unverified(n: int, at: np.ndarray) -> np.ndarray:
    """Windows of a text of ``n`` words that shared anchors reveal and no shared pair verifies, and those within pairs that stand for others."""
    windows = n - WINDOW + 1
    start, length = at >> 12, (at >> 2) & 0x3FF
    anchor = length == 0
    stands = ~anchor & ((at & 3) == WITNESS)
    revealed = _covered(windows, start[anchor], -(REACH + ZONE - 1), -REACH)
    verified = _spans(windows, start[~anchor], length[~anchor] - WINDOW + 1)
    shown = _spans(windows, start[stands], length[stands] - WINDOW + 1)
    return np.flatnonzero((revealed & ~verified) | shown)


def _binary(column: pa.Array) -> Iterator[bytes | None]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else None


_FOUND = "bucket int, doc_id array<{}>, version array<bigint>, start array<int>, meta array<smallint>, key array<bigint>, key2 array<int>"
_NAMES = ["bucket", "doc_id", "version", "start", "meta", "key", "key2"]


def _packed(batch: pa.RecordBatch, found: tuple[np.ndarray, ...], buckets: int) -> pa.RecordBatch:
    """One row for each bucket of keys, with the stretches in arrays side by side: a fraction of the size of single rows."""
    row, start, meta, key, key2 = found
    spread = _mix(start.astype(np.uint64) * np.uint64(_BASES[0]) + row.astype(np.uint64))
    bucket = (np.where(meta & 3 == REPEATED, spread, key) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, row, bucket))
    there, first = np.unique(bucket[order], return_index=True)
    ends = pa.array(np.append(first, len(order)), pa.int32())
    rows = pa.array(row[order])
    values = [
        batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(start[order], pa.int32()), pa.array(meta[order], pa.int16()),
        pa.array(key[order].view(np.int64)), pa.array(key2[order].astype(np.uint32).view(np.int32)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.ListArray.from_arrays(ends, v) for v in values)], names=_NAMES)


def _looked_at(docs: DataFrame, look: Callable[[list, list, pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """What ``look`` finds in the texts of at least one window, some of them at a time."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, held = [], [], 0
            for k, text in enumerate(_binary(batch.column("text"))):
                words = words_of(text)
                if len(words) >= WINDOW:
                    rows.append(k)
                    names.append(names_of(words))
                    held += len(words)
                if held >= WORDS:
                    for found in look(rows, names, batch):
                        yield _packed(batch, found, buckets)
                    rows, names, held = [], [], 0
            if rows:
                for found in look(rows, names, batch):
                    yield _packed(batch, found, buckets)

    return docs.mapInArrow(run, _FOUND.format(docs.schema["doc_id"].dataType.simpleString()))


def _shared(found: DataFrame) -> DataFrame:
    """``doc_id, version, at`` of the stretches that occur elsewhere.

    Those repeated among texts looked at together are known already and are
    spread over the buckets; for all of them one goes to the bucket of the key.
    So a stretch of a third of all texts sends a few rows of each task there. Of
    each key one row is kept as ``WITNESS``: its text shows the stretch to others.
    """
    dealt = found.repartition("bucket")
    rows = dealt.select("bucket", F.inline(F.arrays_zip(*_NAMES[1:])))
    kind = F.col("meta").bitwiseAND(F.lit(3).cast("smallint"))
    group = Window.partitionBy("bucket", "key", "key2")
    place = F.struct("doc_id", "version", "start", "meta")
    rows = rows.select("doc_id", "version", "start", "meta", F.count(F.lit(1)).over(group).alias("n"), F.max(kind).over(group).alias("most"), F.min(F.when(kind != REPEATED, place)).over(group).alias("low"))
    both = (kind != REPEATED) & ((F.col("n") > 1) | (F.col("most") == WITNESS))
    stands = both & place.eqNullSafe(F.col("low"))
    shared = (kind == REPEATED) | stands | (both & (kind == ALONE))
    plain = F.shiftleft(F.col("start").cast("bigint"), 12) + F.col("meta") - kind
    return rows.where(shared).select("doc_id", "version", F.when(stands, plain + WITNESS).otherwise(plain).alias("at"))


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "version").agg(F.collect_list("at").alias("found"))


def _with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their part of ``found``, a written table; texts of other rows are sorted out before they travel."""
    rows = max(found.count(), 1)
    bits = 1 << min(max(16 * rows, 1 << 16) - 1, (1 << 27) - 1).bit_length()
    place = F.pmod(F.xxhash64("doc_id", "version"), F.lit(bits))
    marks = found.select(place.alias("place")).groupBy(F.call_function("bitmap_bucket_number", F.col("place")).alias("_bucket"))
    marks = marks.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("place"))).alias("_marks"))
    # At most 16 MB of bits, whatever the number of rows; they only sort out.
    left = docs.withColumn("_place", place).withColumn("_bucket", F.call_function("bitmap_bucket_number", F.col("_place")))
    position = F.call_function("bitmap_bit_position", F.col("_place"))
    byte = F.conv(F.hex(F.substring("_marks", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    left = left.join(F.broadcast(marks), "_bucket").where(F.call_function("getbit", byte, (position % 8).cast("int")) == 1)
    right = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    return left.join(right, same).select("doc_id", "version", "text", "found")


def _list(column: pa.Array, k: int) -> np.ndarray:
    return np.unique(column[k].values.to_numpy(zero_copy_only=False))


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, version, at`` of repeated stretches of ``WINDOW`` words or more: ``at`` is the first word times 4096 and four times the length.

    The stretches of a text cover exactly the words of its windows that start
    anywhere else too, in another row, in an equal row or in the same text.
    """
    texts = docs.select("doc_id", version(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"))

    def first(rows: list, names: list, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        return _occurrences(_Texts(rows, names))

    def second(rows: list, names: list, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        wanted = [_unverified(len(n), _list(batch.column("found"), k)) for k, n in zip(rows, names, strict=True)]
        return _windows(_Texts(rows, names), wanted)

    shared = materialise(_shared(_looked_at(texts, first)), "shared-symbols")
    revealed = materialise(_by_document(shared), "revealed")
    windows = _shared(_looked_at(_with_found(texts, revealed), second))
    pairs = shared.where(F.shiftright("at", 2).bitwiseAND(F.lit(0x3FF)) > 0)
    return pairs.unionByName(windows)


def _kept(words: list[bytes], at: np.ndarray) -> list[bytes]:
    gone = _spans(len(words), at >> 12, (at >> 2) & 0x3FF)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``, and with ``with_text`` the kept ``text``.

    A word goes if a window of ``WINDOW`` words over it occurs at another place
    too; windows are those of the input. Kept words are joined by one space.
    Words are runs without ASCII white space, unchanged. Null and empty texts
    have no words; equal rows are places of their own, so both lose their
    windows; other columns are not read; an empty table gives no rows. Memory
    in a task is that of some hundred thousand words or of one long text.
    """
    texts = docs.select("doc_id", version(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"))
    found = materialise(_by_document(repeats(docs)), "repeats")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for k, text in enumerate(_binary(batch.column("text"))):
                words = words_of(text)
                left = _kept(words, _list(batch.column("found"), k))
                sizes.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield _digests(batch, sizes, kept, with_text)

    schema = f"doc_id {kind}, version bigint, n bigint, kept_sha256 string" + ", text string" * with_text
    changed = _with_found(texts, found).mapInArrow(cut, schema).dropDuplicates(["doc_id", "version"])
    changed = changed.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("n").alias("_removed"), F.col("kept_sha256").alias("_kept"), *[F.col("text").alias("_text")] * with_text)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(text) for text in _binary(batch.column("text"))]
            yield _digests(batch, [len(w) for w in words], [b" ".join(w) for w in words], with_text)

    rows = texts.mapInArrow(plain, schema)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    out = rows.join(changed, same, "left")
    columns = ["doc_id", F.col("n").alias("n_words"), F.coalesce("_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("_kept", "kept_sha256").alias("kept_sha256")]
    return out.select(*columns, *[F.coalesce("_text", "text").alias("text")] * with_text)


def _digests(batch: pa.RecordBatch, numbers: list[int], texts: list[bytes], with_text: bool) -> pa.RecordBatch:
    digests = [hashlib.sha256(x).hexdigest() for x in texts]
    columns = [batch.column("doc_id"), batch.column("version"), pa.array(numbers, pa.int64()), pa.array(digests)]
    if with_text:
        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "n", "kept_sha256", "text"][: len(columns)])
