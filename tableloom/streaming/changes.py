"""Cut-off extraction and change feeds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableloom.operators.documents import Collection, TableMapping, build_collection, document_id, whole_key
from tableloom.operators.marks import key_hash, mark
from tableloom.operators.relational import literal
from tableloom.session import materialise


def incremental_extract(
    header: DataFrame,
    line: DataFrame,
    on: tuple[str, str],
    changed: tuple[str, str],
    last_cutoff: dt.datetime,
    new_cutoff: dt.datetime,
) -> DataFrame:
    """Header-line pairs whose later change lies in ``(last_cutoff, new_cutoff]``.

    Two joins share the work: lines changed in the interval with their headers,
    and older lines with headers changed in it. Each has one side that both
    bounds cut down in the scan, so the history is not joined with itself.
    """
    low, high = literal(last_cutoff), literal(new_cutoff)
    h, x = F.col(changed[0]), F.col(changed[1])
    pair = F.col(on[0]) == F.col(on[1])
    new_lines = header.filter(h <= high).join(line.filter((x > low) & (x <= high)), pair)
    new_headers = header.filter((h > low) & (h <= high)).join(line.filter(x <= low), pair)
    return new_lines.unionAll(new_headers)


# --- change feeds ---------------------------------------------------------


def last_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change per key. An aggregate that combines on the map side, so a busy key is no hot task."""
    picked = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("r"))
    return picked.select("r.*")


def apply_changes(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op", delete: str = "delete"
) -> DataFrame:
    """The target after a change feed: the last change per key wins, deletes remove.

    ``changes`` has the columns of ``target`` plus ``op`` and the order columns.
    """
    last = last_changes(changes, keys, order)
    kept = target.join(last.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(last.filter(F.col(op) != delete).select(*target.columns))


def stream_changes(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]
) -> StreamingQuery:
    """Fold a change stream into one small file set per batch: the last change per key of that batch.

    A batch writes its own folder and overwrites it when it is run again, so a
    restart repeats nothing. Read the table back with :func:`current_rows`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last_changes(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rows(
    target: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], op: str = "op", delete: str = "delete"
) -> DataFrame:
    """The target with every batch written by :func:`stream_changes` applied."""
    return apply_changes(target, target.sparkSession.read.parquet(path).drop("batch"), keys, order, op, delete)


def stream_into_table(
    changes: DataFrame,
    table: str,
    checkpoint: str,
    empty: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    op: str = "op",
    delete: str = "delete",
) -> StreamingQuery:
    """Keep a whole table current: batch ``n`` writes version ``n`` from the changes so far.

    The changes so far are the last change per key with its order columns,
    deletes included, so a late change of an earlier time neither overwrites a
    newer one nor brings a deleted row back. Batch ``n`` folds its changes into
    those of batch ``n - 1``; versions and changes are folders below ``table``,
    and a batch that runs again writes the same folders from the same input.
    ``empty`` is the table before the first change. Each batch rewrites the
    table, so this is for tables that are small against their feed; for large
    ones use :func:`stream_changes`, whose batches write only changes, and
    :func:`current_rows`.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        so_far = batch
        if batch_id:
            so_far = spark.read.schema(batch.schema).parquet(f"{table}/changes={batch_id - 1}").unionByName(batch)
        path = f"{table}/changes={batch_id}"
        last_changes(so_far, keys, order).write.mode("overwrite").parquet(path)
        after = apply_changes(empty, spark.read.schema(batch.schema).parquet(path), keys, order, op, delete)
        after.write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_changes(spark: SparkSession, path: str, compacted: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Fold all batches below ``path`` into one set of last changes below ``compacted``.

    :func:`current_rows` reads the result like any batches; it keeps deletes
    and order columns, so later batches can be added to it.
    """
    last_changes(spark.read.parquet(path).drop("batch"), keys, order).write.parquet(f"{compacted}/batch=0")


# --- documents under change -----------------------------------------------


def touched_roots(
    mapping: TableMapping, tables: Mapping[str, DataFrame], changed: Mapping[str, DataFrame], before: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Keys of the root rows whose document holds a changed row (S3).

    ``changed`` gives, per table, the keys of changed rows under the key
    columns of its mapping. Children lead to their parents over the link, level
    by level. ``before`` holds the tables as they were, so that a row that
    moved to another parent or went away also touches the parent it left.
    """
    versions = [tables] + ([before] if before else [])
    return _touched(mapping, versions, changed).distinct()


def _touched(mapping: TableMapping, versions: Sequence[Mapping[str, DataFrame]], changed: Mapping[str, DataFrame]) -> DataFrame:
    own = changed.get(mapping.table)
    parts = [own.select(*mapping.key)] if own is not None else []
    for child in mapping.children:
        below = _touched(child, versions, changed)
        parent_key, child_key = (whole_key([pair[side] for pair in child.pairs]) for side in (0, 1))
        for tables in versions:
            # Changed child rows, then the link values they carry, then the parents with those values.
            links = tables[child.table].join(below, child.key, "left_semi").select(child_key.alias("_k")).distinct()
            rows = tables[mapping.table]
            parts.append(rows.join(links, parent_key == F.col("_k"), "left_semi").select(*mapping.key))
    if not parts:
        any_version = versions[0][mapping.table]
        return any_version.select(*mapping.key).filter(F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def refresh_collection(
    name: str, mapping: TableMapping, collection: Collection, tables: Mapping[str, DataFrame], touched: DataFrame
) -> Collection:
    """A collection with only the touched documents rebuilt; touched roots that are gone lose theirs (S3)."""
    key = mapping.key
    affected: dict[str, DataFrame] = {}
    touched = materialise(touched, "touched-roots")
    narrowed = _narrow(mapping, tables, tables[mapping.table].join(touched, key, "left_semi"), "/", affected)
    rebuilt = build_collection(name, narrowed, affected)
    stale = touched.select(document_id(name, key).alias("_id"))
    # Only documents that may be stale travel to the ids.
    marks = mark(stale.select(key_hash(["_id"])))
    documents = marks.others(collection.documents, ["_id"]).unionByName(rebuilt.documents)
    if not marks.empty:
        documents = documents.unionByName(marks.met(collection.documents, ["_id"]).join(stale, "_id", "left_anti"))

    continuations = {}
    for path in {**collection.continuations, **rebuilt.continuations}:
        old, new = collection.continuations.get(path), rebuilt.continuations.get(path)
        if old is not None:
            # The rebuilt owners bring all of their elements along.
            old = old.join(_owners(narrowed, path.split("."), affected), _owner_columns(mapping, path.split(".")), "left_anti")
        continuations[path] = old.unionByName(new) if old is not None and new is not None else (old if new is None else new)
    return Collection(documents, continuations, {path: _owners(mapping, path.split("."), tables) for path in rebuilt.owners})


def _narrow(mapping: TableMapping, tables: Mapping[str, DataFrame], rows: DataFrame, at: str, out: dict[str, DataFrame]) -> TableMapping:
    """The mapping over only those child rows that the given parent rows reach.

    Each place of the tree gets its own table name, as one table may be
    embedded in several places.
    """
    out[at] = rows
    children = []
    for child in mapping.children:
        parent_key, child_key = (whole_key([pair[side] for pair in child.pairs]) for side in (0, 1))
        links = rows.select(parent_key.alias("_k")).distinct()
        below = tables[child.table].join(links, child_key == F.col("_k"), "left_semi")
        children.append(_narrow(child, tables, below, f"{at}{child.path}/", out))
    return replace(mapping, table=at, children=tuple(children))


def _child(mapping: TableMapping, step: str) -> TableMapping:
    return next(c for c in mapping.children if c.path == step)


def _owner_columns(mapping: TableMapping, path: Sequence[str]) -> list[str]:
    for step in path:
        mapping = _child(mapping, step)
    return [c for _, c in mapping.pairs]


def _owners(mapping: TableMapping, path: Sequence[str], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Keys of the rows that own the arrays at ``path``; ``tables`` as narrowed."""
    for step in path[:-1]:
        mapping = _child(mapping, step)
    last = _child(mapping, path[-1])
    return tables[mapping.table].select(*[F.col(p).alias(c) for p, c in last.pairs]).distinct()
