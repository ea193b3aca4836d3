"""Are two results the same, and where do they differ (E1e to E13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.canonical import canonical_json, canonical_value, row_hash, row_hashes
from tableloom.functions.leaves import leaves, member_path, once, parse, unpacked

# Fixed status words.
EQUIVALENT = "Equivalent"
DIFFERENT = "Differences Found"
NOT_OBJECT = "Query payload is not an object."
SOURCE_FAILED = "Source query failed: "
TARGET_FAILED = "Target query failed: "
NO_COMMON = "No matching query keys found between source and target."

_PAYLOAD = "count bigint, firstSample string, lastSample string, error string"


# --- summaries ------------------------------------------------------------


def read_payloads(payloads: DataFrame) -> DataFrame:
    """Parse ``(query_id, payload)``; ``is_object`` tells JSON objects from anything else, broken JSON included (E2e).

    Samples are variants: objects, lists, texts, numbers or nothing. A text
    that holds an object or a list counts as that.
    """
    parsed = payloads.select("query_id", parse(F.col("payload")).alias("p"))

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get("p", f"$.{name}", kind)

    error = F.coalesce(member("error", "string"), F.to_json(member("error", "variant")))
    return parsed.select(
        "query_id",
        F.try_variant_get("p", "$", "map<string,variant>").isNotNull().alias("is_object"),
        member("count", "bigint").alias("count"),
        unpacked(member("firstSample", "variant")).alias("first_sample"),
        unpacked(member("lastSample", "variant")).alias("last_sample"),
        F.when(error != "null", error).alias("error"),
    )


def sample_leaves(sample: Column, schema: str | T.StructType) -> list[tuple[str, Column]]:
    """The declared leaves of the JSON text of a sample as ``(path, canonical text)`` (E4e).

    A nested list is one leaf: its canonical elements sorted, copies kept, so
    that order does not count but multiplicity does.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _leaves(F.from_json(sample, struct), struct, "")


def _leaves(column: Column, dtype: T.DataType, path: str) -> list[tuple[str, Column]]:
    if isinstance(dtype, T.StructType):
        out = []
        for f in sorted(dtype.fields, key=lambda f: f.name):
            name = member_path(f.name)
            out += _leaves(column[f.name], f.dataType, f"{path}.{name}" if path else name)
        return out
    value = canonical_value(column, dtype, sort_arrays=True, rename=lambda n: n, texts=True)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        value = F.to_json(value, {"ignoreNullFields": "false"})
    return [(path, value.cast("string"))]


def other_leaves(sample: Column, declared: Sequence[str] = ()) -> Column:
    """The leaves of a variant sample that are not ``declared``, as a map from path to canonical text (E4e).

    They come from the data, at any depth, so a field that only one side has is
    seen. A list is one leaf without an order, and so is a sample that is no
    object.
    """
    return leaves(sample, declared)


def other_differing(old: Column, new: Column) -> Column:
    """The entries in which two maps of leaves differ, in the form of :func:`differing`."""
    paths = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    every = F.transform(paths, lambda p: F.struct(p.alias("path"), F.element_at(old, p).alias("old"), F.element_at(new, p).alias("new")))
    return F.filter(every, lambda d: ~d.old.eqNullSafe(d.new))


def differing(old: list[tuple[str, Column]], new: list[tuple[str, Column]]) -> Column:
    """The leaves that differ, as ``array<struct<path, old, new>>``."""
    every = F.array(
        *[F.struct(F.lit(p).alias("path"), a.alias("old"), b.alias("new")) for (p, a), (_, b) in zip(old, new)]
    )
    return F.filter(every, lambda d: ~d.old.eqNullSafe(d.new))


def distance(old: list[tuple[str, Column]], new: list[tuple[str, Column]]) -> Column:
    """Changed leaves over all leaves; 0 means the same (E9e)."""
    return F.size(differing(old, new)) / F.lit(max(1, len(old)))


def with_distance(df: DataFrame, old: str, new: str, schema: str | T.StructType = "", name: str = "distance") -> DataFrame:
    """``df`` with the changed leaves of two variant samples over all leaves of either; 0 means the same (E9e).

    Leaves that ``schema`` declares compare in their type, all others as they
    stand in the data.
    """
    typed = [sample_leaves(F.to_json(F.col(s)), schema) if schema else [] for s in (old, new)]
    declared = [path for path, _ in typed[0]]
    held = [f"_leaves_of_{s}" for s in (old, new)]
    rows = df.withColumns({h: once(other_leaves(F.col(s), declared)) for h, s in zip(held, (old, new))})
    maps = [F.col(h) for h in held]
    changed = F.size(other_differing(*maps)) + (F.size(differing(*typed)) if declared else F.lit(0))
    every = F.size(F.array_union(*[F.map_keys(m) for m in maps])) + F.lit(len(declared))
    return rows.withColumn(name, changed / F.greatest(every, F.lit(1))).drop(*held)


def compare_summaries(
    source: DataFrame, target: DataFrame, sample_schema: str | T.StructType = "", allow_swap: bool = True
) -> DataFrame:
    """Compare two tables of ``(query_id, payload)`` query by query (E1e to E6e).

    Only ids on both sides are compared. Fields of ``sample_schema`` compare in
    their declared type, all others as they stand in the data. First and last
    samples may be swapped between the sides unless ``allow_swap`` is off. One
    row per id with ``status``, ``error`` and the differences; a payload that is
    no object and a side that failed give an error and no status; if there is no
    common id, one error row.
    """
    # Few bytes, but much work for each row: the number of partitions is given, so small ones are not merged.
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (read_payloads(side.repartition(parts, "query_id")).alias(name) for side, name in ((source, "a"), (target, "b")))
    held = ("is_object", "count", "first_sample", "last_sample", "error")
    both = a.join(b, "query_id").select("query_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in held])
    samples = ("a_first_sample", "a_last_sample", "b_first_sample", "b_last_sample")
    typed = {c: sample_leaves(F.to_json(F.col(c)), sample_schema) if sample_schema else [] for c in samples}
    declared = [path for path, _ in typed[samples[0]]]
    # Each sample is compared twice, so its leaves are columns of their own.
    both = both.withColumns(
        {f"{c}_other": once(other_leaves(F.col(c), declared)) for c in samples}
        | {f"{c}_{k}": once(value) for c in samples for k, (_, value) in enumerate(typed[c])}
    )
    typed = {c: [(path, F.col(f"{c}_{k}")) for k, (path, _) in enumerate(typed[c])] for c in samples}
    none = F.array().cast("array<struct<path:string,old:string,new:string>>")

    def diff(x, y):
        own = differing(typed[x], typed[y]) if declared else none
        return F.concat(own, other_differing(F.col(f"{x}_other"), F.col(f"{y}_other")))

    error = (
        F.when(~(F.col("a_is_object") & F.col("b_is_object")), F.lit(NOT_OBJECT))
        .when(F.col("a_error").isNotNull(), F.concat(F.lit(SOURCE_FAILED), "a_error"))
        .when(F.col("b_error").isNotNull(), F.concat(F.lit(TARGET_FAILED), "b_error"))
    )
    rows = both.select(
        "query_id",
        error.alias("error"),
        F.col("a_count").alias("count_old"),
        F.col("b_count").alias("count_new"),
        diff("a_first_sample", "b_first_sample").alias("first_diffs"),
        diff("a_last_sample", "b_last_sample").alias("last_diffs"),
        diff("a_first_sample", "b_last_sample").alias("swapped_first"),
        diff("a_last_sample", "b_first_sample").alias("swapped_last"),
    )
    same = (F.size("first_diffs") == 0) & (F.size("last_diffs") == 0)
    if allow_swap:
        same = same | ((F.size("swapped_first") == 0) & (F.size("swapped_last") == 0))
    same = same & F.col("count_old").eqNullSafe(F.col("count_new"))
    fine = F.col("error").isNull()
    result = rows.select(
        "query_id",
        F.when(fine, F.when(same, EQUIVALENT).otherwise(DIFFERENT)).alias("status"),
        "error",
        "count_old",
        "count_new",
        F.when(fine & ~same, F.col("first_diffs")).otherwise(none).alias("first_diffs"),
        F.when(fine & ~same, F.col("last_diffs")).otherwise(none).alias("last_diffs"),
    )
    # One error row when nothing is in common: an aggregate over the ids always has one row.
    empty = both.agg(F.count("query_id").alias("n")).filter(F.col("n") == 0)
    error = empty.select(
        *[
            (F.lit(NO_COMMON) if f.name == "error" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in result.schema.fields
        ]
    )
    return result.unionByName(error)


# --- whole datasets -------------------------------------------------------


def multiset_difference(left: DataFrame, right: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Row hashes that occur a different number of times on the two sides (E7e).

    Nested lists are order-free. Hashes travel, rows do not, and copies
    collapse on the map side: one shuffle of at most one record per distinct
    row and task.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marked = row_hashes(left, drop).select("h0", "h1", one.alias("l"), none.alias("r")).unionByName(
        row_hashes(right, drop).select("h0", "h1", none.alias("l"), one.alias("r"))
    )
    return (
        marked.groupBy("h0", "h1")
        .agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count"))
        .filter(F.col("left_count") != F.col("right_count"))
    )


def equivalence(left: DataFrame, right: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row: status and how many rows only one side has (E7e)."""
    diff = multiset_difference(left, right, drop)
    only_left = F.sum(F.greatest(F.col("left_count") - F.col("right_count"), F.lit(0)))
    only_right = F.sum(F.greatest(F.col("right_count") - F.col("left_count"), F.lit(0)))
    return diff.agg(
        F.when(F.count(F.lit(1)) == 0, EQUIVALENT).otherwise(DIFFERENT).alias("status"),
        F.coalesce(only_left, F.lit(0)).alias("only_left"),
        F.coalesce(only_right, F.lit(0)).alias("only_right"),
    )


def differing_rows(left: DataFrame, right: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """The canonical text of each differing row with its count on both sides."""
    diff = multiset_difference(left, right, drop)

    def texts(df):
        return df.select(
            row_hash(df, drop).alias("h"), canonical_json(df, sort_arrays=True, drop=drop, texts=True).alias("row")
        ).select("h.h0", "h.h1", "row")

    hashes = ["h0", "h1"]
    found = texts(left).unionByName(texts(right)).join(diff.select(*hashes), hashes, "left_semi").distinct()
    return found.join(diff, hashes).select("row", "left_count", "right_count")


def keyed_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field-level differences of two tables with the same key (E8e).

    Rows: key columns, ``kind`` (added, removed, changed, duplicate),
    ``column``, ``old``, ``new``. Both sides are stacked and grouped by key
    instead of joined, so repeated keys neither multiply nor pile up; a key
    that repeats is reported as such.
    """
    values = [c for c in left.columns if c not in keys]

    def side(df, flag):
        texts = [
            canonical_value(F.col(f.name), f.dataType, True, lambda n: n, texts=True) for f in df.select(*values).schema
        ]
        as_text = [
            (F.to_json(t, {"ignoreNullFields": "false"}) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else t.cast("string")).alias(f.name)
            for t, f in zip(texts, df.select(*values).schema)
        ]
        return df.select(*keys, F.lit(flag).alias("_side"), F.struct(*as_text).alias("_row"))

    stacked = side(left, "l").unionByName(side(right, "r"))
    on = {s: F.when(F.col("_side") == s, F.col("_row")) for s in "lr"}
    grouped = stacked.groupBy(*keys).agg(
        F.max(on["l"]).alias("_old"),
        F.max(on["r"]).alias("_new"),
        F.count(on["l"]).alias("_nl"),
        F.count(on["r"]).alias("_nr"),
    )
    kind = (
        F.when((F.col("_nl") > 1) | (F.col("_nr") > 1), "duplicate")
        .when(F.col("_nl") == 0, "added")
        .when(F.col("_nr") == 0, "removed")
        .otherwise("changed")
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_old.{c}").alias("old"), F.col(f"_new.{c}").alias("new")) for c in values]
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    changed = F.filter(cells, lambda c: ~c.old.eqNullSafe(c.new))
    return (
        grouped.withColumn("kind", kind)
        .withColumn("_cells", F.when(F.col("kind") == "changed", changed).otherwise(whole))
        .select(*keys, "kind", F.explode("_cells").alias("c"))
        .select(*keys, "kind", "c.column", "c.old", "c.new")
    )


def difference_counts(difference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys added, removed, changed and duplicated, and changed cells per column."""
    return difference.groupBy("kind", "column").agg(F.count(F.lit(1)).alias("cells")).orderBy("kind", "column")


# --- logs and runs --------------------------------------------------------


def latest_outcome(log: DataFrame, run: str, seq: str, text: str, passed: str, failed: str, runs: DataFrame | None = None) -> DataFrame:
    """Latest outcome per run from an ordered log.

    A message that holds both markers counts as passed. Runs without a marker
    are ``missing``.
    """
    outcome = F.when(F.col(text).contains(passed), "passed").when(F.col(text).contains(failed), "failed")
    marked = log.select(run, F.col(seq).alias("_seq"), outcome.alias("_outcome"))
    known = F.when(F.col("_outcome").isNotNull(), F.col("_seq"))
    found = marked.groupBy(run).agg(F.max_by("_outcome", known).alias("outcome"))
    if runs is not None:
        found = runs.select(run).distinct().join(found, run, "left")
    return found.withColumn("outcome", F.coalesce("outcome", F.lit("missing")))


def present_tokens(text: Column, tokens: Sequence[str]) -> Column:
    """The given tokens that occur in a text, case aside; null for a blank text."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(x) for x in tokens]), lambda x: F.contains(low, x))
    return F.when(F.trim(text) != "", found)


def new_tokens(source: Column, target: Column) -> Column:
    """Tokens present in the target but not in the source; none if the source is blank.

    Both sides come from :func:`present_tokens`, so a pair is joined on a few
    short words, never on whole texts.
    """
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_except(F.coalesce(target, none), source), none)


def correctness_rate(outcomes: DataFrame, pair: Sequence[str], status: str = "status") -> DataFrame:
    """Share of translations per pair that ran and gave the result of the source."""
    right = F.when(F.col(status) == EQUIVALENT, 1.0).otherwise(0.0)
    return outcomes.groupBy(*pair).agg(F.count(F.lit(1)).alias("translations"), F.avg(right).alias("rate"))


def run_metrics(steps: DataFrame, run: str, failed: Column, retry: Column, tool: Column) -> DataFrame:
    """Per run: steps, share of failed steps, length of the retry chain, tool calls."""
    return steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("steps"),
        (F.count_if(failed) / F.count(F.lit(1))).alias("exception_rate"),
        F.coalesce(F.max(retry), F.lit(0)).alias("retry_chain"),
        F.count_if(tool).alias("tool_calls"),
    )
