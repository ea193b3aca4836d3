"""A table kept current in hash buckets, of which a batch of changes rewrites only those that it touches.

Below ``path`` lie ``data/batch=n/bucket=b`` with the rows of a bucket as batch
``n`` left them, and ``manifest/batch=n`` with the batch that holds each bucket.
The manifest is written last, so readers see the table before or after a batch
and nothing between. A batch that runs again writes the same folders from the
same input.

A table of documents has the further parts of their arrays in tables of the
same form, one for each array, below ``continuations``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tableloom.operators.documents import Collection, TableMapping, build_collection, document_id
from tableloom.operators.marks import key_hash, mark
from tableloom.session import local_frame, materialise
from tableloom.streaming.changes import _narrow, _owners, last_changes

UPSERT, DELETE = "upsert", "delete"
_BUCKET = "bucket"
# A bucket of more files than this, smaller than so many bytes, is put together again.
FILES, LEAST_FILE = 16, 1 << 20


@dataclass(frozen=True)
class BucketTable:
    """Rows by ``keys``; of several changes of a key the one with the largest ``order`` counts.

    ``schema`` has the columns of the rows, ``order`` those of the changes
    beside them. Deleted keys stay as rows with ``op`` = ``delete``, so a late
    change of an earlier time brings nothing back.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[str, ...]
    order_types: tuple[str, ...]
    buckets: int = 64

    @property
    def _stored(self) -> T.StructType:
        extra = [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(self.order, self.order_types, strict=True) if n not in self.schema.names]
        return T.StructType([*self.schema.fields, T.StructField("op", T.StringType()), *extra])

    def versions(self) -> list[int]:
        """The batches with a manifest, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/manifest")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        whole = [n for n in names if n.startswith("batch=") and system.exists(hadoop.Path(f"{self.path}/manifest/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in whole)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The batch that holds each bucket, in the last version or a given one."""
        found = self.versions()
        version = (found[-1] if found else None) if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.schema(f"{_BUCKET} int, batch bigint").parquet(f"{self.path}/manifest/batch={version}")
        return {r[_BUCKET]: r["batch"] for r in rows.collect()}  # one row for each bucket

    def last_before(self, batch: int) -> int | None:
        """The last version before a batch."""
        return max((v for v in self.versions() if v < batch), default=None)

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self._stored)
        paths = [f"{self.path}/data/batch={n}/{_BUCKET}={b}" for b, n in sorted(held.items())]
        return self.spark.read.schema(self._stored).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one that is still kept."""
        return self._rows(self.manifest(version)).where(F.col("op") != DELETE).select(*self.schema.names)

    def apply(self, changes: DataFrame, batch: int) -> list[int]:
        """Fold one batch of changes in and return the buckets written.

        ``changes`` has the columns of the rows, ``op`` and the order columns.
        A batch without changes still gets a manifest. A row whose key comes
        once among the changes and the touched buckets is written where it is;
        only rows of the other keys are shuffled. A bucket of many small files
        is shuffled into few.
        """
        earlier = self.last_before(batch)
        held = {} if earlier is None else self.manifest(earlier)
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        changes = changes.select(*self._stored.names)
        folder = f"{self.path}/data/batch={batch}"
        keyed = materialise(changes.select(key_hash(self.keys).alias("h"), place.alias(_BUCKET)), "changed-keys")
        touched = sorted(r[0] for r in keyed.select(_BUCKET).distinct().collect())
        if touched:
            rewritten = {b: held[b] for b in touched if b in held}
            old = self._rows(rewritten)
            hashes = keyed.select("h").unionByName(old.select(key_hash(self.keys).alias("h")))
            marks = mark(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
            # The bucket is computed again, so that folders without it and with it read alike.
            kept = marks.others(old, self.keys).withColumn(_BUCKET, place)
            rows = (kept.repartition(len(touched), _BUCKET) if self._in_small_files(rewritten) else kept).unionByName(
                marks.others(changes, self.keys).withColumn(_BUCKET, place)
            )
            if not marks.empty:
                met = marks.met(old, self.keys).unionByName(marks.met(changes, self.keys))
                rows = rows.unionByName(last_changes(met, self.keys, self.order).withColumn(_BUCKET, place))
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy(_BUCKET).parquet(folder)
        after = held | dict.fromkeys(touched, batch)
        listed = local_frame(self.spark, sorted(after.items()), f"{_BUCKET} int, batch bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return touched

    def _in_small_files(self, held: dict[int, int]) -> bool:
        """Whether the buckets have more than ``FILES`` files each, of under ``LEAST_FILE`` bytes."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = size = 0
        for b, n in held.items():
            folder = hadoop.Path(f"{self.path}/data/batch={n}/{_BUCKET}={b}")
            found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(folder)
            files, size = files + found.getFileCount(), size + found.getLength()
        return files > FILES * len(held) and size < LEAST_FILE * files

    def drop_old(self, keep: int = 2) -> list[int]:
        """Remove manifests before the last ``keep`` versions, and data that no version left names; returns the batches removed."""
        found = self.versions()
        return self._drop(found[:-keep], found[-keep:])

    def _drop(self, old: list[int], kept: list[int]) -> list[int]:
        named = {n for v in kept for n in self.manifest(v).values()}
        hadoop, gone = self.spark._jvm.org.apache.hadoop.fs, []
        for v in old:
            # The manifest goes first: data without one is never read.
            for folder in ["manifest"] + ["data"] * (v not in named):
                target = hadoop.Path(f"{self.path}/{folder}/batch={v}")
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            gone.append(v)
        return gone


@dataclass(frozen=True)
class DocumentTable(BucketTable):
    """The documents of a collection by their ``_id``, with the further parts of their arrays; batches are the order of both.

    Parts are rows by owner and ``part``. A batch writes them before the
    manifest of the documents, and they are read as of a version of the
    documents, so both are always of the same batch.
    """

    def _part_table(self, at: str, schema: T.StructType) -> BucketTable:
        # Owner columns, ``part`` and the array.
        return BucketTable(self.spark, f"{self.path}/continuations/{at}", schema, tuple(schema.names[:-1]), self.order, self.order_types, self.buckets)

    def part_tables(self) -> dict[str, BucketTable]:
        """The table of further parts for each array that has or had some."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/continuations")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return {}
        out = {}
        for at in sorted(s.getPath().getName() for s in system.listStatus(folder)):
            written = f"{self.path}/continuations/{at}/schema"
            if system.exists(hadoop.Path(f"{written}/_SUCCESS")):
                row = self.spark.read.schema("schema string").json(written).first()
                out[at] = self._part_table(at, T.StructType.fromJson(json.loads(row["schema"])))
        return out

    def collection(self, version: int | None = None) -> Collection:
        """The documents and the further parts of their arrays, of the last version or of an earlier one that is still kept."""
        found = self.versions()
        if version is None and not found:
            return Collection(self.read(), {})
        version = found[-1] if version is None else version
        last = {at: (parts, parts.last_before(version + 1)) for at, parts in self.part_tables().items()}
        return Collection(self.read(version), {at: parts.read(v) for at, (parts, v) in last.items() if v is not None})

    def apply_parts(self, collection: Collection, batch: int, present: Callable[[str], DataFrame] | None = None) -> None:
        """Fold the further parts of a collection in, before its documents: its owners lose the parts they had and get the new ones.

        Owners that ``present`` of the array does not have lose theirs too.
        What a batch left whose documents were never written goes first.
        """
        stored, versions, earlier = self.part_tables(), self.versions(), self.last_before(batch)
        for table in stored.values():
            found = table.versions()
            lost = [v for v in found if v not in versions and (earlier is None or v > earlier)]
            if lost:
                table._drop(lost, [v for v in found if v not in lost])
        for at in {**stored, **collection.continuations}:
            parts = collection.continuations.get(at)
            if at not in stored:
                stored[at] = self._part_table(at, parts.schema)
                listed = local_frame(self.spark, [(parts.schema.json(),)], "schema string")
                listed.coalesce(1).write.mode("overwrite").json(f"{stored[at].path}/schema")
            table = stored[at]
            parts = self.spark.createDataFrame([], table.schema) if parts is None else parts
            changes, owner = _as_changes(parts, UPSERT, batch), list(table.keys[:-1])
            last = table.last_before(batch)
            if last is not None:
                old = table.read(last).select(*table.keys)
                gone = old.join(collection.owners.get(at, parts).select(*owner), owner, "left_semi")
                if present is not None:
                    gone = gone.unionByName(old.join(present(at), owner, "left_anti"))
                # A part that comes again is written over.
                gone = materialise(gone.join(parts, list(table.keys), "left_anti"), "gone-parts")
                nothing = F.lit(None).cast(table.schema[-1].dataType).alias(table.schema[-1].name)
                changes = changes.unionByName(_as_changes(gone.select(*table.keys, nothing), DELETE, batch))
            table.apply(changes, batch)

    def drop_old(self, keep: int = 2) -> list[int]:
        """As for any table; parts stay as far back as the documents."""
        gone, found = super().drop_old(keep), self.versions()
        for table in self.part_tables().values() if found else ():
            last = table.last_before(found[0] + 1)
            if last is not None:
                versions = table.versions()
                table._drop([v for v in versions if v < last], [v for v in versions if v >= last])
        return gone


def stream_into_buckets(changes: DataFrame, table: BucketTable, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Keep ``table`` current from a stream of changes: a micro-batch writes the buckets it touches, then the manifest."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch is read for its buckets and for its rows.
        batch = batch.persist()
        try:
            table.apply(batch, batch_id)
            table.drop_old(keep)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_table(spark: SparkSession, path: str, documents: DataFrame, buckets: int = 64) -> DocumentTable:
    """A bucket table for the documents of a collection, by their ``_id``; batches are their order."""
    return DocumentTable(spark, path, documents.schema, ("_id",), ("_batch",), ("bigint",), buckets)


def _as_changes(documents: DataFrame, op: str, batch: int) -> DataFrame:
    return documents.withColumns({"op": F.lit(op), "_batch": F.lit(batch).cast("bigint")})


def store_documents(table: DocumentTable, collection: Collection, batch: int = 0) -> list[int]:
    """Write all documents of a collection and the further parts of their arrays; returns the buckets of documents written.

    A collection that does not know the owners of its arrays, as one read from
    files, replaces the parts of those owners only of which it has parts.
    """
    table.apply_parts(collection, batch)
    return table.apply(_as_changes(collection.documents, UPSERT, batch), batch)


def refresh_documents(table: DocumentTable, name: str, mapping: TableMapping, tables, touched: DataFrame, batch: int, **bounds: int) -> list[int]:
    """Rebuild the touched documents only and write only their buckets; a touched root that is gone loses its document (S3).

    The arrays of rebuilt documents get all of their parts anew, and owners that are gone lose theirs.
    ``bounds`` are those of :func:`build_collection` that the stored collection was built with.
    """
    affected: dict[str, DataFrame] = {}
    touched = materialise(touched, "touched-roots")
    narrowed = _narrow(mapping, tables, tables[mapping.table].join(touched, mapping.key, "left_semi"), "/", affected)
    built = build_collection(name, narrowed, affected, **bounds)
    table.apply_parts(built, batch, lambda at: _owners(mapping, at.split("."), tables))
    rebuilt = built.documents.select(*table.schema.names)
    gone = touched.join(tables[mapping.table].select(*mapping.key), mapping.key, "left_anti")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "_id"]
    lost = gone.select(document_id(name, mapping.key).alias("_id"), *nothing)
    return table.apply(_as_changes(rebuilt, UPSERT, batch).unionByName(_as_changes(lost, DELETE, batch)), batch)
