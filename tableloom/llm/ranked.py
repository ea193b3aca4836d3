"""Ranked lexical search without random access: sorted reads with score intervals (NRA).

Documents are counted once, and each shard of them has a list of postings per
query term, sorted by falling impact (weight times saturated frequency). An
item reads its lists from the top, all down to the same impact in each round. A
document met so far has a score between what was read of it and that plus the
largest impacts still unread in the lists where it was not met; an unmet one
may have at most the largest unread impacts of all lists. Documents that cannot
reach the k-th lower bound are dropped, and once no unmet one can, none is taken
up. Reading goes on until every interval left is closed, so members, ties and
scores are exact. The best of all shards are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableloom.session import materialise

TOP = 10
# Shares of an item's postings after which a round of reading ends, from the largest impacts down; the result does not depend on them.
ROUNDS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85)
# Rows of documents in a shard, whose lists one task reads.
SHARD = 20_000
# Different query terms that are sent to every task that counts; beyond it all terms are counted.
SENT_TERMS = 200_000
# Terms of items that are searched for at a time.
SENT_ROWS = 500_000

# A term is a run of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased.
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(ord(chr(b).lower()) if b in _LETTERS else b if b > 0x7F else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return text.translate(_TABLE).split() if text else []


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else None


def query_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term``: every different term of every row of ``items``; ``item`` tells the rows apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(_texts(batch.column("text"))):
                own = sorted(set(terms_of(text)))
                at += [k] * len(own)
                found += own
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("item"), some.column("item_id"), pa.array(found, pa.binary()).cast(pa.string())], names=["item", "item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(rows, f"item bigint, item_id {kind}, term string")


def count_terms(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """``row, doc_id, n, terms, tfs`` of every row of ``docs``: its number of terms, and the wanted ones (None: all) with their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in _texts(batch.column("text")):
                own = terms_of(text)
                sizes.append(len(own))
                tf = Counter(own if wanted is None else filter(wanted.__contains__, own))
                found.append(list(tf))
                counts.append(list(tf.values()))
            columns = [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], names=["row", "doc_id", "n", "terms", "tfs"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(rows, f"row bigint, doc_id {kind}, n bigint, terms array<string>, tfs array<bigint>")


class Lists:
    """The postings of one shard by term, each list sorted by falling impact."""

    def __init__(self, term: np.ndarray, row: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((row, -impact, term))
        self.row, self.impact = row[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.first[term], self.first[term + 1])
        return self.row[here], self.impact[here]


def best_rows(lists: Sequence[tuple[np.ndarray, np.ndarray]], n_rows: int, k: int, rounds: Sequence[float] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be among the ``k`` best, with their exact scores: all of the k best, and those that tie with the last."""
    lists = [x for x in lists if len(x[0])]
    none = np.zeros(0, dtype=np.int64)
    if not lists:
        return none, none
    falling = -np.sort(-np.concatenate([x for _, x in lists]))
    edges = np.unique(np.append(falling[[min(int(len(falling) * r), len(falling) - 1) for r in rounds]], 1))[::-1]
    score = np.zeros(n_rows, dtype=np.int64)
    met = np.zeros((n_rows, len(lists)), dtype=bool)
    # Not met, met, or dropped.
    state = np.zeros(n_rows, dtype=np.int8)
    at = np.zeros(len(lists), dtype=np.int64)
    ahead = np.array([x[0] for _, x in lists])  # the largest impact unread of each list
    taking = True
    for edge in edges.tolist():
        for t, (rows, impacts) in enumerate(lists):
            end = int(np.searchsorted(-impacts, -edge, side="right"))
            rows, read = rows[at[t] : end], impacts[at[t] : end]
            at[t] = end
            ahead[t] = impacts[end] if end < len(impacts) else 0
            use = state[rows] != 2 if taking else state[rows] == 1
            rows, read = rows[use], read[use]
            score[rows] += read  # a list has a row once
            met[rows, t] = True
            state[rows] = 1
        left = np.flatnonzero(state == 1)
        low = score[left]
        least = int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0
        high = low + (~met[left]) @ ahead
        state[left[high < least]] = 2
        taking = int(ahead.sum()) >= max(least, 1)
        if not taking and (high == low)[high >= least].all():
            break
    left = np.flatnonzero(state == 1)
    return left, score[left]


def _query(rows: Sequence) -> tuple[pa.Array, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Terms and weights of collected rows ``item, term, w``, and the numbers of the terms of each item."""
    weights = {r.term: r.w for r in rows}
    number = {t: k for k, t in enumerate(weights)}
    items: dict[int, list[int]] = {}
    for r in rows:
        items.setdefault(r.item, []).append(number[r.term])
    return pa.array(list(weights), pa.string()), np.array(list(weights.values()), dtype=np.int64), [(i, np.array(t)) for i, t in items.items()]


def _search_shard(shard: pa.Table, query, n_docs: int, n_terms: int, k: int, rounds: Sequence[float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``item``, rows of the shard and their scores, the ``k`` best of each item."""
    words, weights, items = query
    terms, tfs = shard["terms"].combine_chunks(), shard["tfs"].combine_chunks()
    row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    number = pc.fill_null(pc.index_in(terms.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    asked = number >= 0
    row, number, tf = row[asked], number[asked], tfs.flatten().to_numpy(zero_copy_only=False)[asked]
    m = np.array([10 + 90 * n * n_docs // max(n_terms, 1) for n in shard["n"].to_pylist()], dtype=np.int64)
    impact = weights[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    some = impact > 0
    lists = Lists(number[some], row[some], impact[some], len(words))
    ids = shard["doc_id"].combine_chunks()
    by_id = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(ids), dtype=np.int64)
    place[by_id] = np.arange(len(ids))
    for item, own in items:
        found, score = best_rows([lists.of(t) for t in own], len(terms), k, rounds)
        top = np.lexsort((place[found], -score))[:k]
        yield item, found[top], score[top]


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, rounds: Sequence[float] = ROUNDS, shard: int = SHARD) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs`` for every row of ``items``, scores above 0.

    Equal scores are ranked by ascending ``doc_id`` (null last). Null and empty
    texts have no terms: as documents they are not counted and never found, as
    items they give no rows. Repeated rows are documents or items of their own;
    other columns are not read; empty tables give no rows. Texts are read
    whole. Items are searched for in blocks of some hundred thousand terms; a
    task holds one block, the counts of one shard and its lists.
    """
    terms = materialise(query_terms(items), "query-terms")
    words = terms.select("term").distinct()
    sent = words.limit(SENT_TERMS + 1).collect()
    wanted = frozenset(r.term.encode() for r in sent) if len(sent) <= SENT_TERMS else None
    counted = materialise(count_terms(docs, wanted), "term-counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = counted.select(F.explode("terms").alias("term"))
    df = (each if wanted is not None else each.join(words, "term", "left_semi")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    asked = materialise(terms.join(df.select("term", weight.alias("w")), "term"), "asked")

    blocks = max(1, -(-asked.count() // SENT_ROWS))
    kind = counted.schema["doc_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "term", "w").collect()
        query = docs.sparkSession.sparkContext.broadcast(_query(rows))

        def run(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            for part in _shards(batches, shard):
                own, at, scores = [], [], []
                for item, row, score in _search_shard(part, query.value, n_docs, n_terms, k, rounds):
                    own.append(np.full(len(row), item))
                    at.append(row)
                    scores.append(score)
                if own:
                    some = part.select(["row", "doc_id"]).take(pa.array(np.concatenate(at))).combine_chunks()
                    columns = [pa.array(np.concatenate(own)), some["row"].combine_chunks(), some["doc_id"].combine_chunks(), pa.array(np.concatenate(scores))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "row", "doc_id", "score"])

        one = counted.mapInArrow(run, f"item bigint, row bigint, doc_id {kind}, score bigint")
        found = one if found is None else found.unionByName(one)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = found.select("item", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return top.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
