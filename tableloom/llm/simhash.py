"""Near-duplicate documents by SimHash.

A fingerprint is cut into segments of two bits, and the bit counts of the
segments are its embedding. The Manhattan distance of two embeddings is never
above the Hamming distance of the fingerprints, so all close pairs meet in a
grid over the embeddings: of ``radius + agree`` groups of segments, close pairs
agree in ``agree`` at least. In a cell the Manhattan distance and then the
exact distance decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.components import connected
from tableloom.llm.lines import version
from tableloom.session import local_frame, materialise

SEED = 42
WORDS = 4
RADIUS = 4
# Rows of one cell that one task compares; larger cells are compared block by block.
BLOCK = 50_000
# Large cells that are broadcast; beyond that they are joined.
FEW_CELLS = 10_000
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the word shingles of a text in order, repeats included; none without words."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    if len(parts) <= words:
        starts, ends = [0], [len(joined)]
    else:
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        ends = ends[words - 1 :].tolist()
    shingles = (joined[a:b] for a, b in zip(starts, ends, strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(starts))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of the word shingles of a text, repeats included; 0 without words."""
    return fingerprint_from(shingle_hashes(text, words))


def fingerprint_from(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_of(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a bigint with the bits of the unsigned number."""

    def many(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return F.pandas_udf(many, "bigint")(text.cast("string"))


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each as ones from the right.

    In that form the Manhattan distance is the number of different bits.
    """
    half = 0x5555555555555555
    right = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(right).bitwiseAND(F.lit(half))
    both = fp.bitwiseAND(right).bitwiseAND(F.lit(half))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_for(n: int, radius: int) -> int:
    """How many groups a cell should fix for ``n`` fingerprints; the result does not depend on it.

    More fixed groups give more cells for each fingerprint and fewer others in
    each cell: equal counts say as much as 0.7 equal bits, and comparing two
    costs a tenth of sending one. Three groups at least, which serve up to
    millions of fingerprints.
    """

    def cost(agree: int) -> float:
        cells = comb(radius + agree, agree)
        return cells * (1 + n / 2 ** (0.7 * 64 * agree / (radius + agree)) / 10)

    return min(range(3, 33 - radius), key=cost)


def _groups(radius: int, agree: int) -> list[int]:
    """Masks of ``radius + agree`` groups of whole segments."""
    cuts = np.linspace(0, 32, radius + agree + 1).round().astype(int)
    return [((1 << 2 * int(b)) - 1) ^ ((1 << 2 * int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _cells(radius: int, agree: int) -> list[tuple[int, ...]]:
    return list(combinations(range(radius + agree), agree))


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """Edges ``a, b`` between fingerprints ``fp`` that connect all pairs within ``radius``.

    Not all pairs are returned: in each cell the edges form a forest with the
    same components. ``nodes`` holds each fingerprint once and is read twice.
    """
    agree = agree or grid_for(nodes.count(), radius)
    masks = _groups(radius, agree)
    options = [sum(masks[g] for g in cell) for cell in _cells(radius, agree)]
    u = embedding(F.col("fp"))
    cell = F.explode(F.array(*(F.struct(F.lit(k).alias("grid"), F.col("u").bitwiseAND(F.lit(_signed(m))).alias("cell")) for k, m in enumerate(options))))
    rows = nodes.select("fp", u.alias("u")).select("fp", "u", cell.alias("at")).select("fp", "u", "at.grid", "at.cell")
    large = rows.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    few = large.limit(FEW_CELLS + 1).collect()
    pair = F.lit(0).alias("pair")
    if few:
        if len(few) <= FEW_CELLS:
            large = F.broadcast(local_frame(nodes.sparkSession, [tuple(r) for r in few], "grid int, cell bigint, n bigint"))
        # Each row goes to all pairs of blocks that hold its own block.
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))
        rows = rows.join(large, ["grid", "cell"], "left").withColumn("blocks", blocks).withColumn("own", own)
        pair = F.explode(to).alias("pair")
    rows = rows.select("grid", "cell", "fp", "u", pair).repartition("grid", "cell", "pair").sortWithinPartitions("grid", "cell", "pair", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            yield from _edges({c: table[c].to_numpy() for c in table.column_names}, radius, agree)

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a cell does; memory holds some rows or one cell."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        keys = [table[c].to_numpy() for c in ("grid", "cell", "pair")]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).combine_chunks().to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def _edges(rows: dict[str, np.ndarray], radius: int, agree: int, small: int = 24) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((rows["fp"], rows["pair"], rows["cell"], rows["grid"]))
    grid, cell, pair = (rows[c][order] for c in ("grid", "cell", "pair"))
    fp, u = rows["fp"][order].view(np.uint64), rows["u"][order].view(np.uint64)
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    masks = np.array(_groups(radius, agree), dtype=np.uint64)
    codes = np.array([sum(1 << g for g in c) for c in _cells(radius, agree)])

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of rows are within the radius and meet here first, not in a cell of other groups."""
        apart = u[a] ^ u[b]
        ok = np.bitwise_count(apart) <= radius
        ok[ok] = np.bitwise_count(fp[a[ok]] ^ fp[b[ok]]) <= radius
        equal = (apart[ok, None] & masks) == 0
        equal &= np.cumsum(equal, axis=1) <= agree
        ok[ok] = (equal.astype(np.int64) << np.arange(len(masks))).sum(axis=1) == codes[grid[a[ok]]]
        return ok

    group = np.repeat(np.arange(len(starts)), sizes)
    member = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= small))
    for gap in range(1, small):
        a, b = member[:-gap], member[gap:]
        same = group[a] == group[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        ok = close(a, b)
        if ok.any():
            yield _batch(fp[a[ok]], fp[b[ok]])
    for k in np.flatnonzero(sizes > small):
        a, b = _forest(np.arange(starts[k], starts[k] + sizes[k]), close)
        if len(a):
            yield _batch(fp[a], fp[b])


def _forest(members: np.ndarray, close) -> tuple[np.ndarray, np.ndarray]:
    """A search from row to row over the rows not reached yet; dense groups are reached in few steps."""
    left, ahead, heads, tails = members, [], [], []
    while len(left):
        if ahead:
            at = ahead.pop()
        else:
            at, left = left[0], left[1:]
        ok = close(np.full(len(left), at), left)
        if ok.any():
            reached = left[ok]
            left = left[~ok]
            ahead.extend(reached.tolist())
            heads.append(np.full(len(reached), at))
            tails.append(reached)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (none, none)


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def components(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``doc_id, version, fp, root, component_id`` of every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked.
    ``root`` is the smallest fingerprint and ``component_id`` the smallest id
    that a document reaches, itself included (null only if all of them are
    null). A null or empty text has fingerprint 0, linked like any other;
    repeated rows stay, equal texts share a fingerprint; other columns are not
    read. Equal fingerprints are one node, so copies never meet as pairs.
    """
    rows = docs.select("doc_id", version(F.col("text").cast("string")).alias("version"), fingerprint_of(F.col("text"), words).alias("fp"))
    rows = materialise(rows, "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    nodes = materialise(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(nodes, "fp").select("doc_id", "version", "fp", "root", "component_id")


def representatives(found: DataFrame) -> DataFrame:
    """``doc_id, version`` of one document of each component: the smallest id, then the smallest version."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("at")
    return found.groupBy("root").agg(first).select("at.doc_id", "at.version")
