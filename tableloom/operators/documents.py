"""Relational tables as nested document collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.operators.conformance import spark_type
from tableloom.operators.nesting import MAX_ITEMS, Nested, collect_children
from tableloom.operators.skew import HotKeys, hot_keys

# Fixed mapping kinds.
NEW_DOCUMENT = "NEW_DOCUMENT"
EMBEDDED = "EMBEDDED_DOCUMENT"
EMBEDDED_ARRAY = "EMBEDDED_DOCUMENT_ARRAY"

# Stands behind the name of an array for the number of its parts.
PARTS = "Parts"

# Fixed table: document field types to Spark types. Others keep the source type.
TARGET_TYPES = {
    "INTEGER": "int",
    "LONG": "bigint",
    "STRING": "string",
    "DATE": "timestamp_ntz",
    "DOUBLE": "double",
    "BOOL": "boolean",
    "BIN_DATA": "binary",
    "OBJECT_ID": "string",
}


@dataclass(frozen=True)
class Field:
    """One mapped column (T5)."""

    source: str
    target: str
    type: str | None = None
    included: bool = True
    primary_key: bool = False
    null_excluded: bool = False


@dataclass(frozen=True)
class TableMapping:
    """How one table enters a collection.

    ``link`` pairs a column of the parent table with one of this table, or is a
    tuple of such pairs where a key has several columns.
    """

    kind: str
    table: str
    fields: tuple[Field, ...]
    path: str | None = None
    link: tuple[str, str] | tuple[tuple[str, str], ...] | None = None
    children: tuple["TableMapping", ...] = field(default_factory=tuple)

    @property
    def key(self) -> list[str]:
        return [f.source for f in self.fields if f.primary_key]

    @property
    def pairs(self) -> tuple[tuple[str, str], ...]:
        """``link`` as pairs of a parent column and a column of this table."""
        return (self.link,) if isinstance(self.link[0], str) else self.link


@dataclass(frozen=True)
class Collection:
    """``documents``: one row per root row.

    Beside each array ``x`` stands ``xParts``. It is 1 if the array is whole.
    Otherwise it counts the array in the document and the further parts, which
    are rows of owner key, ``part`` and elements in ``continuations`` at the
    path of the array. Continuations belong to owners that exist. ``owners``
    has the keys of the rows that own the arrays at a path, in parts or not,
    where the collection was built from tables.
    """

    documents: DataFrame
    continuations: dict[str, DataFrame]
    owners: dict[str, DataFrame] = field(default_factory=dict)


def whole_key(columns: Sequence[str]) -> Column:
    """One value for a key of one or more columns; null if any of them is."""
    if len(columns) == 1:
        return F.col(columns[0])
    known = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.struct(*[F.col(c).alias(c) for c in columns]))


def _field_columns(fields: Sequence[Field]) -> list[Column]:
    out = []
    for f in fields:
        if f.included:
            c = F.col(f.source)
            target = TARGET_TYPES.get(f.type or "")
            out.append((c.cast(target) if target else c).alias(f.target))
    return out


def joined_key(head: str, key: Sequence[str]) -> Column:
    """Key columns behind ``head`` with ``:`` between, as one text that no other key has.

    The separator and the escape sign are escaped inside a part; a null has a
    sign of its own.
    """
    parts = [F.col(k).cast("string") for k in key]
    for sign in ("\\", ":"):
        parts = [F.replace(p, F.lit(sign), F.lit("\\" + sign)) for p in parts]
    return F.concat_ws(":", F.lit(head), *[F.coalesce(p, F.lit("\\N")) for p in parts])


def document_id(collection: str, key: Sequence[str]) -> Column:
    """A reproducible document id from collection and key."""
    return F.substring(F.sha2(joined_key(collection, key), 256), 1, 24)


def build_collection(
    name: str,
    root: TableMapping,
    tables: Mapping[str, DataFrame],
    generate_id: bool = True,
    max_items: int = MAX_ITEMS,
    repeat_items: int | None = None,
) -> Collection:
    """Fold the mapping tree bottom-up into one collection.

    Arrays are whole up to ``max_items`` elements; inside an embedded object,
    where every parent repeats them, up to ``repeat_items`` (``max_items`` if
    not given). Longer ones go on in the continuations, and the document says so.

    Every child table is completed before it is embedded, and every array is
    collected on its own key before it meets its parent, so branches never
    multiply.
    """
    rest: dict[str, DataFrame] = {}
    owners: dict[str, DataFrame] = {}
    rows, nested = _fold(root, tables, rest, owners, "", False, max_items, max_items if repeat_items is None else repeat_items)
    columns = _field_columns(root.fields) + [F.col(n) for n in nested]
    if generate_id:
        columns = [document_id(name, root.key).alias("_id"), *columns]
    return Collection(rows.select(*columns), rest, owners)


def _fold(mapping, tables, rest, owners, path, repeated, max_items, repeat_items):
    """Raw columns of the table plus one column per embedded child."""
    rows = tables[mapping.table]
    nested: list[str] = []
    for child in mapping.children:
        at = f"{path}.{child.path}" if path else child.path
        inside_object = repeated or child.kind == EMBEDDED
        below, below_names = _fold(child, tables, rest, owners, at, inside_object, max_items, repeat_items)
        columns = _field_columns(child.fields) + [F.col(n) for n in below_names]
        parent_key, child_key = (whole_key([pair[side] for pair in child.pairs]) for side in (0, 1))
        if child.kind == EMBEDDED:
            embedded = below.select(child_key.alias("_k"), F.struct(*columns).alias(child.path))
            # One row per referenced key: a hot foreign key is split by the join, not collected.
            rows = rows.join(embedded, parent_key == F.col("_k"), "left").drop("_k")
        else:
            owners[at] = tables[mapping.table].select(*[F.col(p).alias(c) for p, c in child.pairs])
            children = below.select(child_key.alias("_k"), *columns)
            order = [f.target for f in child.fields if f.included and f.primary_key]
            order += [f.target for f in child.fields if f.included and not f.primary_key]
            # Embedding keeps the rows of the child table, so the table itself is counted.
            bound = repeat_items if repeated else max_items
            counted = tables[child.table].select(child_key.alias("_k")).filter("_k IS NOT NULL")
            hot = hot_keys(counted, ["_k"], bound)
            got = _array(children, child.path, order, repeated, max_items, hot)
            rows = rows.join(got.rows, parent_key == F.col("_k"), "left").drop("_k")
            empty = F.array().cast(got.rows.schema[child.path].dataType)
            rows = rows.withColumn(child.path, F.coalesce(child.path, empty))
            parts = child.path + PARTS
            if got.continuations is None:
                rows = rows.withColumn(parts, F.lit(1))
            else:
                present = rows.select(parent_key.alias("_k")).distinct()
                tail = got.continuations.join(present, "_k", "left_semi")
                counts = tail.groupBy("_k").agg((F.count(F.lit(1)) + 1).cast("int").alias(parts))
                rows = rows.join(counts, parent_key == F.col("_k"), "left").drop("_k")
                rows = rows.withColumn(parts, F.coalesce(parts, F.lit(1)))
                owner = [c for _, c in child.pairs]
                named = [F.col("_k").alias(owner[0])] if len(owner) == 1 else [F.col(f"_k.{c}").alias(c) for c in owner]
                rest[at] = tail.select(*named, *[c for c in tail.columns if c != "_k"])
            nested.append(parts)
        nested.append(child.path)
    return rows, nested


def _array(children: DataFrame, name: str, order: list[str], repeated: bool, max_items: int, hot: HotKeys) -> Nested:
    """Collect one array branch.

    An array inside an embedded object is repeated in every parent of that
    object. One that is too long for that is kept once, in the continuations,
    instead of once per parent.
    """
    fields = [c for c in children.columns if c != "_k"]
    if not repeated or hot.empty:
        return collect_children(children, ["_k"], name, fields, order, max_items, hot)
    none = HotKeys(hot.rows.filter(F.lit(False)), small=True, empty=True)
    short = collect_children(children.join(hot.marked(), "_k", "left_anti"), ["_k"], name, fields, order, max_items, none)
    once = collect_children(children.join(hot.marked(), "_k", "left_semi"), ["_k"], name, fields, order, max_items)
    first = once.rows.select("_k", F.lit(0).cast("bigint").alias("part"), name)
    tail = first if once.continuations is None else first.unionByName(once.continuations.select("_k", "part", name))
    return Nested(short.rows, tail, ("_k",), name)


def unnest(documents: DataFrame, path: str, keep: Sequence[str] = (), owner: str | None = None) -> DataFrame:
    """The rows embedded at ``path``, each once: the inverse of embedding.

    ``path`` may lead through objects; ``keep`` names document fields to carry
    along. ``owner`` is a field that identifies the object around an array, so
    that one document of each is opened; without it arrays are told apart by
    their whole content.
    """
    dtype = documents.select(F.col(path).alias("x")).schema["x"].dataType
    if isinstance(dtype, T.ArrayType):
        # An array inside an object is repeated in every document of that object: one of each first.
        arrays = documents.select(*keep, *([F.col(owner).alias("_o")] if owner else []), F.col(path).alias("_a"))
        if owner:
            arrays = arrays.dropDuplicates([*keep, "_o"])
        elif "." in path:
            arrays = arrays.distinct()
        rows = arrays.select(*keep, F.explode("_a").alias("_r"))
    else:
        rows = documents.select(*keep, F.col(path).alias("_r")).filter(F.col("_r").isNotNull())
    fields = rows.schema["_r"].dataType.fields
    parts = {f.name + PARTS for f in fields if isinstance(f.dataType, T.ArrayType)}
    plain = [f.name for f in fields if not isinstance(f.dataType, (T.ArrayType, T.StructType)) and f.name not in parts]
    return rows.select(*keep, *[F.col(f"_r.{c}").alias(c) for c in plain]).distinct()


# --- mapping projects -----------------------------------------------------

def _project_schema() -> T.StructType:
    """The parts of a mapping project that are read."""

    def obj(**fields: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    def of(value: T.DataType) -> T.MapType:
        return T.MapType(T.StringType(), value)

    s, b = T.StringType(), T.BooleanType()
    entry = obj(
        target=obj(name=s, included=b, type=s), source=obj(name=s, databaseSpecificType=s, isPrimaryKey=b)
    )
    mapping = obj(settings=obj(type=s, embeddedPath=s), fields=of(entry), collectionId=s, table=s)
    content = obj(
        collections=of(obj(name=s)), tables=of(obj(path=obj(database=s, schema=s, table=s))), mappings=of(mapping)
    )
    return obj(project=obj(content=content))


def _text(c: Column) -> Column:
    """Trimmed text; blank counts as missing."""
    t = F.trim(c)
    return F.when(t != "", t)


def mapping_rows(projects: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Mapping projects (JSON text, one per row) as a flat mapping table.

    One row per mapped column: collection, mapping kind, source schema and
    table, embedded path, source column, database type, key flag, target
    property and type. Excluded, id and untyped fields are left out, and of
    fields that differ in case only the first by field name stays. ``keep``
    names columns that identify a project.
    """
    parsed = projects.select(*keep, F.from_json(text, _project_schema())["project"]["content"].alias("c"))
    mappings = parsed.select(*keep, "c.collections", "c.tables", F.explode("c.mappings").alias("mapping_id", "m"))
    collection = _text(F.try_element_at("collections", _text(F.col("m.collectionId")))["name"])
    path = F.try_element_at("tables", _text(F.col("m.table")))["path"]
    kind = F.coalesce(F.upper(_text(F.col("m.settings.type"))), F.lit(NEW_DOCUMENT))
    schema = F.concat_ws(".", _text(path["database"]), _text(path["schema"]))
    heads = mappings.select(
        *keep,
        "mapping_id",
        collection.alias("collection"),
        kind.alias("mapping_type"),
        _text(schema).alias("source_schema"),
        _text(path["table"]).alias("source_table"),
        F.when(kind != NEW_DOCUMENT, _text(F.col("m.settings.embeddedPath"))).alias("embedded_path"),
        F.explode("m.fields").alias("field_key", "f"),
    ).filter("collection IS NOT NULL AND source_schema IS NOT NULL AND source_table IS NOT NULL")
    fields = heads.select(
        *keep,
        "mapping_id",
        "collection",
        "mapping_type",
        "source_schema",
        "source_table",
        "embedded_path",
        "field_key",
        F.coalesce(_text(F.col("f.source.name")), _text(F.col("field_key"))).alias("source_column"),
        F.lower(_text(F.col("f.source.databaseSpecificType"))).alias("sql_type"),
        F.coalesce("f.source.isPrimaryKey", F.lit(False)).alias("is_primary_key"),
        _text(F.col("f.target.name")).alias("target_property"),
        F.upper(_text(F.col("f.target.type"))).alias("target_type"),
        F.coalesce("f.target.included", F.lit(True)).alias("included"),
        F.col("f.source").isNotNull().alias("has_source"),
    )
    kept = fields.filter(
        "included AND has_source AND source_column IS NOT NULL AND target_property IS NOT NULL "
        "AND sql_type IS NOT NULL AND target_type IS NOT NULL AND source_column <> '_id' AND sql_type <> 'none'"
    )
    group = [*keep, "mapping_id", F.lower("source_column").alias("_s"), F.lower("target_property").alias("_t")]
    row = F.struct(
        "collection", "mapping_type", "source_schema", "source_table", "embedded_path",
        "source_column", "sql_type", "is_primary_key", "target_property", "target_type",
    )
    first = kept.groupBy(*group).agg(F.min_by(row, F.struct(F.lower("field_key"), "field_key")).alias("r"))
    return first.select(*keep, "mapping_id", "r.*")


def sorted_mapping_rows(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The mapping table in reading order."""
    return rows.orderBy(
        *keep, "collection", "mapping_type", "source_schema", "source_table", "embedded_path",
        F.lower("target_property"), F.lower("source_column"),
    )


def fields_of(rows: Sequence) -> tuple[Field, ...]:
    """Fields of one mapping from collected mapping rows, with the declared database types checked."""
    for r in rows:
        spark_type(r["sql_type"])
    return tuple(
        Field(r["source_column"], r["target_property"], r["target_type"], True, r["is_primary_key"]) for r in rows
    )
