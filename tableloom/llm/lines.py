"""Lines that repeat across documents, found with DataFrame functions only.

Hashes of the lines are range-partitioned and sorted by document and position,
so each partition streams the occurrences of its lines in order. The result is
a bitmap of kept lines for each document; texts do not travel with the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.columns import free_name
from tableloom.session import materialise

# White space at both ends of a line, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A line with this share of all lines is spread over the tasks; there are at most 1 / HOT of them.
HOT = 0.001
# Bits in one bitmap of Spark's bitmap functions.
BITS = 32_768


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; plain ASCII takes the fast function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def version(text: Column) -> Column:
    """Tells different texts under one id apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row for each line: ``doc_id, version, pos, h1, h2``; the hashes are null for a blank line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", version(F.col("text").cast("string")).alias("version"), F.posexplode(F.split(lower_ascii(text), "\n", -1)))
    key = F.btrim(F.col("col"), F.lit(SPACE))
    rows = rows.select("doc_id", "version", "pos", F.when(key != "", key).alias("key"))
    some = F.col("key").isNotNull()
    return rows.select(
        "doc_id", "version", "pos", F.when(some, F.xxhash64("key")).alias("h1"), F.when(some, F.xxhash64(F.lit(1), "key")).alias("h2")
    )


def _hot(lines: DataFrame) -> list[int]:
    """Hashes among which are all lines with more than their share of rows; at most 1 / HOT."""
    found = lines.where(F.col("h1").isNotNull()).select("h1").stat.freqItems(["h1"], HOT).first()
    return sorted(x for x in (found[0] or []) if x is not None) if found else []


def keep_flags(lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """``doc_id, version, pos, keep`` of every line.

    ``lines`` is read several times, so it should be a written table.
    """
    hot = _hot(lines)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    some = lines.where(F.col("h1").isNotNull())

    cold = some.where(~is_hot).repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "version", "pos")
    line = Window.partitionBy("h1", "h2")
    cold = cold.withColumns({"nth_doc": F.dense_rank().over(line.orderBy("doc_id")), "nth": F.row_number().over(line.orderBy("doc_id", "version", "pos"))})
    cold = cold.withColumn("n_docs", F.max("nth_doc").over(line)).withColumn("first", F.col("nth") == 1)

    # A hot line is counted by document first; the few counts then meet its rows where they lie.
    place = F.struct("doc_id", "version", "pos")
    counts = (
        some.where(is_hot)
        .groupBy("h1", "h2", "doc_id")
        .agg(F.min(F.struct("version", "pos")).alias("at"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", F.col("at.version").alias("version"), F.col("at.pos").alias("pos"))).alias("at"))
    )
    spread = some.where(is_hot).join(F.broadcast(counts), ["h1", "h2"]).withColumn("first", place.eqNullSafe(F.col("at")))

    kept = F.col("n_docs") < min_docs
    if keep_first:
        kept = kept | F.col("first")
    columns = ["doc_id", "version", "pos"]
    flags = [cold.select(*columns, kept.alias("keep")), lines.where(F.col("h1").isNull()).select(*columns, F.lit(True).alias("keep"))]
    if hot:
        flags.append(spread.select(*columns, kept.alias("keep")))
    out = flags[0]
    for f in flags[1:]:
        out = out.unionAll(f)
    return out


def bitmaps(flags: DataFrame) -> DataFrame:
    """``doc_id, version, n_lines, n_kept, keep``: the kept lines of each document as bits.

    ``keep`` maps a bucket of ``BITS`` lines (from 1) to its bits, cut after
    the last line. It is null where all lines are kept.
    """
    at = F.col("pos").cast("bigint") + 1
    rows = flags.select("doc_id", "version", "keep", at.alias("at"), F.call_function("bitmap_bucket_number", at).alias("bucket"))
    # Dealt by document first: one bitmap has a fixed size, so none may be made for each task and document.
    parts = (
        rows.repartition("doc_id", "version")
        .groupBy("doc_id", "version", "bucket")
        .agg(
            F.max("at").alias("n_lines"),
            F.expr("bitmap_construct_agg(bitmap_bit_position(at)) FILTER (WHERE keep)").alias("bits"),
        )
    )
    in_bucket = F.col("n_lines") - (F.col("bucket") - 1) * BITS
    bits = F.expr("substring(bits, 1, CAST((n_lines - (bucket - 1) * 32768 + 7) DIV 8 AS INT))")
    parts = parts.select("doc_id", "version", "bucket", "n_lines", in_bucket.alias("n"), bits.alias("bits"), F.call_function("bitmap_count", "bits").alias("n_kept"))
    whole = parts.groupBy("doc_id", "version").agg(
        F.max("n_lines").alias("n_lines"),
        F.sum("n_kept").alias("n_kept"),
        F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("keep"),
    )
    return whole.withColumn("keep", F.when(F.col("n_kept") < F.col("n_lines"), F.col("keep")))


def find(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """The bitmaps of ``docs``: lines found in ``min_docs`` or more documents are dropped.

    A line counts once for each ``doc_id`` (null is one of them), compared
    without white space at its ends and with A-Z lower-cased; blank lines are
    never dropped. With ``keep_first`` the first occurrence by document, version
    and position stays. Repeated rows share one bitmap; a null or empty text has
    one blank line; an empty table gives no rows.
    """
    lines = materialise(occurrences(docs.select("doc_id", "text")), "lines")
    return bitmaps(keep_flags(lines, min_docs, keep_first))


def _kept(keep: Column, pos: Column) -> Column:
    """Whether the bit of a position is set."""
    bits = F.element_at(keep, (pos.cast("bigint") / BITS).cast("bigint") + 1)
    byte = F.conv(F.hex(F.substring(bits, ((pos % BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (pos % 8).cast("int")) == 1


def apply(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its kept lines in ``text``, and ``n_lines`` and ``n_dropped``.

    A document all of whose lines are dropped has an empty text; one that loses
    none keeps its text, null included.
    """
    mark, other, bits = (free_name(docs, x) for x in ("_version", "_id", "_keep"))
    found = found.where(F.col("keep").isNotNull()).select(
        F.col("doc_id").alias(other), F.col("version").alias(f"{mark}2"), F.col("keep").alias(bits), F.col("n_kept").alias(f"{bits}_n")
    )
    left = docs.withColumn(mark, version(F.col("text").cast("string")))
    joined = left.join(found, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(mark) == F.col(f"{mark}2")), "left")
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: _kept(F.col(bits), i)), "\n")
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    n = F.size(lines).cast("bigint")
    return joined.select(
        *passed,
        F.when(F.col(bits).isNull(), F.col("text")).otherwise(kept).alias(text),
        n.alias("n_lines"),
        F.coalesce(n - F.col(f"{bits}_n"), F.lit(0).cast("bigint")).alias("n_dropped"),
    )
