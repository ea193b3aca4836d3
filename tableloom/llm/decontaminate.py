"""Passages of benchmark items in documents, found with DataFrame functions only.

Windows of an item's size slide over the documents. Windows without a shared
shingle have similarity zero, so only those are looked at that a shingle of the
item puts in place. Their SimHashes meet the item's in a multi-index over
``radius + 1`` blocks of bits, which finds every fingerprint within the radius,
and the exact weighted similarity of the shingles decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.lines import SPACE, lower_ascii, version
from tableloom.session import materialise

WORDS = 5
SIMILARITY = 0.8
# Fingerprints of windows at the least similarity differ in 10 bits at the mean; this is 5 deviations more.
RADIUS = 24
# Anchors (shingle, item, position) that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    """The words of a text between white space, with A-Z lower-cased; null or blank has none."""
    trimmed = F.btrim(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def _starts(words: Column, size: Column) -> Column:
    """Starts of the shingles of ``size`` words."""
    n = F.size(words)
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _shingle(words: Column, start: Column, most: int) -> list[Column]:
    # Reads of single words; a slice would copy the whole array each time.
    # Behind the last word they are null, which the hash and the text leave out.
    return [F.get(words, start + j) for j in range(most)]


def hashes(words: Column, size: Column, most: int = WORDS) -> Column:
    """Hashes of the shingles of ``size`` words, at most ``most``; fewer only where that is all words."""
    return F.transform(_starts(words, size), lambda i: F.xxhash64(*_shingle(words, i, most)))


def shingles(words: Column, size: Column, most: int = WORDS) -> Column:
    return F.transform(_starts(words, size), lambda i: F.concat_ws(" ", *_shingle(words, i, most)))


# Arrays are exploded with the outer form: for the other, Spark puts a filter on
# the size of the array below, which computes words and hashes once more.


def items_of(benchmark: DataFrame, k: int) -> DataFrame:
    """Each different item text once: ``item, words, n_words, k`` with the shingle size of the item."""
    rows = benchmark.select(words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.select(F.md5(F.array_join("words", " ").cast("binary")).alias("item"), "words").dropDuplicates(["item"])
    n = F.size("words")
    return rows.select("item", "words", n.alias("n_words"), F.least(n, F.lit(k)).alias("k"))


def anchors_of(items: DataFrame, similarity: float, k: int = WORDS) -> DataFrame:
    """``k, h, item, at, n_words, slack``: enough shingles of each item that a similar window holds one.

    A window of the least similarity holds ceil(similarity * n) of the item's n
    shingles, so any n - ceil(similarity * n) + 1 of them include one it holds.
    """
    rows = items.select("item", "k", "n_words", F.posexplode_outer(hashes(F.col("words"), F.col("k"), k)).alias("at", "h"))
    n = F.col("n_words") - F.col("k") + 1
    missing = n - F.ceil(n * similarity - 1e-9).cast("int")
    nth = F.row_number().over(Window.partitionBy("item").orderBy("h", "at"))
    first = F.min("nth").over(Window.partitionBy("item", "h"))
    rows = rows.withColumn("nth", nth).withColumn("first", first).where(F.col("first") <= missing + 1)
    # Words that may be put in or left out before an anchor: each is the first of a shingle that the other side has not.
    return rows.select("k", "h", "item", "at", "n_words", missing.alias("slack"))


def regions(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``doc_id, version, item, region``: words around each place where an anchor puts an item."""
    rows = docs.select("doc_id", version(F.col("text").cast("string")).alias("version"), words_of(F.col("text")).alias("words"))
    sizes = sorted(r.k for r in anchors.select("k").distinct().collect())  # at most ``WORDS`` sizes
    small = anchors.count() <= BROADCAST_ROWS
    found = None
    for k in sizes:
        own = anchors.where(F.col("k") == k).select("h", "item", "at", "n_words", "slack")
        own = F.broadcast(own) if small else own
        carried = rows.withColumn("hashes", hashes(F.col("words"), F.lit(k), k))
        start = F.greatest(F.col("pos") - F.col("at") - F.col("slack"), F.lit(0))
        size = F.col("n_words") + 2 * F.col("slack") + F.least(F.col("pos") - F.col("at") - F.col("slack"), F.lit(0))
        cut = F.array_join(F.slice("words", start + 1, F.greatest(size, F.lit(0))), " ").alias("region")
        if small:
            # The words stay in place until an anchor matches.
            hits = carried.select("doc_id", "version", "words", F.posexplode_outer("hashes").alias("pos", "h")).join(own, "h")
        else:
            places = carried.select("doc_id", "version", F.posexplode_outer("hashes").alias("pos", "h")).join(own, "h")
            places = places.select("doc_id", "version", "pos", "item", "at", "n_words", "slack").distinct()
            texts = rows.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "words")
            hits = places.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
        hits = hits.select("doc_id", "version", "item", cut)
        found = hits if found is None else found.unionAll(hits)
    return found.distinct() if found is not None else None


def _simhash(rows: DataFrame, key: list[str]) -> DataFrame:
    """The SimHash of the array ``hashes`` of each row; a bit is set if over half the hashes have it."""
    bits = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{i}") for i in range(64)]
    sums = rows.select(*key, F.explode_outer("hashes").alias("h")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *bits)
    fp = F.lit(0).cast("bigint")
    for i in range(64):
        bit = (1 << i) - (1 << 64 if i == 63 else 0)
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return sums.select(*key, fp.alias("fp"))


def _blocks(radius: int) -> list[int]:
    """Masks of ``radius + 1`` blocks of the 64 bits."""
    cuts = np.linspace(0, 64, radius + 2).round().astype(int).tolist()
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _indexed(rows: DataFrame, radius: int) -> DataFrame:
    parts = [F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for k, m in enumerate(_blocks(radius))]
    return rows.select("*", F.explode(F.array(*parts)).alias("index")).select(*rows.columns, "index.block", "index.bits")


def similar_regions(places: DataFrame, items: DataFrame, similarity: float, radius: int, k: int = WORDS) -> DataFrame:
    """``item, region, similarity`` of the different regions that hold a similar window; the best window counts."""
    items = items.withColumn("hashes", hashes(F.col("words"), F.col("k"), k))
    own = _simhash(items, ["item"]).withColumnRenamed("fp", "item_fp")

    split = F.split("region", " ", -1)
    content = places.select("item", "region").distinct().join(items.select("item", "n_words", "k"), "item").withColumn("words", split)
    # Item-sized windows; a region that is smaller is one window.
    last = F.greatest(F.size("words") - F.col("n_words"), F.lit(0))
    windows = content.select("item", "region", "k", "n_words", "words", F.explode_outer(F.sequence(F.lit(0), last)).alias("start"))
    windows = windows.select("item", "region", "k", "start", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("words"))
    windows = windows.where(F.size("words") >= F.col("k")).withColumn("window", F.array_join("words", " "))
    texts = windows.select("item", "window", "k", "words").dropDuplicates(["item", "window"])

    key = ["item", "window"]
    prints = _simhash(texts.withColumn("hashes", hashes(F.col("words"), F.col("k"), k)), key)
    left = _indexed(prints, radius)
    right = _indexed(own.withColumnRenamed("item_fp", "fp"), radius).withColumnRenamed("fp", "item_fp")
    close = left.join(right, ["item", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    close = close.select(*key).distinct()

    # Weighted similarity: the sum of the smaller over the sum of the larger numbers of occurrences.
    of_window = texts.join(close, key, "left_semi").select(*key, F.explode_outer(shingles(F.col("words"), F.col("k"), k)).alias("shingle"))
    of_window = of_window.groupBy(*key, "shingle").agg(F.count(F.lit(1)).alias("n"))
    of_item = items.select("item", F.explode_outer(shingles(F.col("words"), F.col("k"), k)).alias("shingle"))
    of_item = of_item.groupBy("item", "shingle").agg(F.count(F.lit(1)).alias("m"))
    sizes = items.select("item", (F.col("n_words") - F.col("k") + 1).alias("total"))
    shared = of_window.join(of_item, ["item", "shingle"], "left").groupBy(*key)
    shared = shared.agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("both")).join(sizes, "item")
    value = F.col("both") / (F.col("n") + F.col("total") - F.col("both"))
    good = shared.select(*key, value.alias("similarity")).where(F.col("similarity") >= similarity)
    return windows.select("item", "region", "window").join(good, key).groupBy("item", "region").agg(F.max("similarity").alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, k: int = WORDS) -> DataFrame:
    """``doc_id, version, item_id, similarity``: documents with a window like an item, and the best similarity.

    Shingles have ``k`` words, those of shorter items all their words. Null or
    blank documents and items match nothing; equal items are all reported;
    repeated documents give one row; an empty table on either side gives none;
    other columns are not read.
    """
    items = materialise(items_of(benchmark, k), "items")
    anchors = materialise(anchors_of(items, similarity, k), "anchors")
    places = regions(docs, anchors)
    if places is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, version bigint, item_id bigint, similarity double")
    places = materialise(places, "regions")
    good = similar_regions(places, items, similarity, radius, k)
    found = places.join(good, ["item", "region"]).groupBy("doc_id", "version", "item").agg(F.max("similarity").alias("similarity"))
    ids = benchmark.select("item_id", F.md5(F.array_join(words_of(F.col("text")), " ").cast("binary")).alias("item")).distinct()
    return found.join(ids, "item").select("doc_id", "version", "item_id", "similarity")
