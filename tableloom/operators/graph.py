"""Relational tables as a property graph: node and edge tables (G1n to G11n)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tableloom.functions.leaves import once
from tableloom.functions.names import singular
from tableloom.functions.units import is_date_text, is_timestamp_text, text_to_date, text_to_timestamp
from tableloom.operators.documents import joined_key
from tableloom.operators.nesting import MAX_ITEMS, Nested, attach, collect_children
from tableloom.operators.skew import hot_keys


@dataclass(frozen=True)
class NodeMapping:
    """How one table becomes nodes: ``properties`` maps a source column to a property name."""

    label: str
    table: str
    key: tuple[str, ...]
    properties: Mapping[str, str]
    id_space: str | None = None

    @property
    def space(self) -> str:
        return self.id_space or self.label


@dataclass(frozen=True)
class EdgeMapping:
    """How the rows of one table become edges, from the row that holds both keys."""

    type: str
    table: str
    start: tuple[str, tuple[str, ...]]  # (id space, key columns)
    end: tuple[str, tuple[str, ...]]
    properties: Mapping[str, str] = field(default_factory=dict)


def node_id(space: str, key: Sequence[str]) -> Column:
    """``space:key`` with escaped parts; null if any key column is null."""
    known = [F.col(k).isNotNull() for k in key]
    every = known[0]
    for k in known[1:]:
        every = every & k
    return F.when(every, joined_key(space, key))


def _narrowed(df: DataFrame, column: str) -> Column:
    """Decimals become doubles: the graph model has no decimal (G11n)."""
    c = F.col(column)
    return c.cast("double") if isinstance(df.schema[column].dataType, T.DecimalType) else c


def nodes(df: DataFrame, mapping: NodeMapping) -> DataFrame:
    """Node table: ``id, label`` and the properties (G1n)."""
    props = [_narrowed(df, c).alias(p) for c, p in mapping.properties.items()]
    return df.select(node_id(mapping.space, mapping.key).alias("id"), F.lit(mapping.label).alias("label"), *props)


def build_nodes(tables: Mapping[str, DataFrame], mappings: Sequence[NodeMapping]) -> dict[str, DataFrame]:
    """Node tables by label. Mappings of one label are stacked by property name (G3n)."""
    out: dict[str, DataFrame] = {}
    for m in mappings:
        made = nodes(tables[m.table], m)
        out[m.label] = out[m.label].unionByName(made, allowMissingColumns=True) if m.label in out else made
    return out


def edges(df: DataFrame, mapping: EdgeMapping) -> DataFrame:
    """Edge table ``src, dst, type`` and the properties; a row with a null key has no edge (G4n, G5n)."""
    (start_space, start_key), (end_space, end_key) = mapping.start, mapping.end
    props = [_narrowed(df, c).alias(p) for c, p in mapping.properties.items()]
    # Keys are looked at as they are, so that ids are made only where they are read, and once.
    known = df
    for key in dict.fromkeys((*start_key, *end_key)):
        known = known.filter(F.col(key).isNotNull())
    return known.select(
        node_id(start_space, start_key).alias("src"),
        node_id(end_space, end_key).alias("dst"),
        F.lit(mapping.type.upper()).alias("type"),
        *props,
    )


def build_edges(tables: Mapping[str, DataFrame], mappings: Sequence[EdgeMapping]) -> dict[tuple, DataFrame]:
    """Edge tables by (type, start space, end space)."""
    out: dict[tuple, DataFrame] = {}
    for m in mappings:
        name = (m.type.upper(), m.start[0], m.end[0])
        made = edges(tables[m.table], m)
        out[name] = out[name].unionByName(made, allowMissingColumns=True) if name in out else made
    return out


# --- type repair ----------------------------------------------------------


def repair_report(df: DataFrame) -> DataFrame:
    """Per text property: known values and how many look like a timestamp or a date. One pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    c = {n: F.col(n) for n in names}
    one = df.agg(
        *[
            x
            for i, n in enumerate(names)
            for x in (
                F.count(c[n]).alias(f"k{i}"),
                F.count_if(is_timestamp_text(c[n]) & text_to_timestamp(c[n]).isNotNull()).alias(f"t{i}"),
                F.count_if(is_date_text(c[n]) & text_to_date(c[n]).isNotNull()).alias(f"d{i}"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("property"),
                F.col(f"k{i}").alias("known"),
                F.col(f"t{i}").alias("timestamps"),
                F.col(f"d{i}").alias("dates"),
            )
            for i, n in enumerate(names)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def repair_types(df: DataFrame) -> DataFrame:
    """Turn text properties that hold only timestamps or only dates into that type (G7n).

    The decision needs the whole column, so this runs :func:`repair_report`
    once and reads back one small row per text column. A mixed column stays
    text.
    """
    found = {r["property"]: r for r in repair_report(df).collect()}
    out = []
    for name in df.columns:
        r = found.get(name)
        c = F.col(name)
        if r and r["known"] and r["timestamps"] == r["known"]:
            c = text_to_timestamp(c).alias(name)
        elif r and r["known"] and r["dates"] == r["known"]:
            c = text_to_date(c).alias(name)
        out.append(c)
    return df.select(*out)


# --- patterns -------------------------------------------------------------


def follow(start: DataFrame, edge: DataFrame, end: DataFrame, start_id: str = "id", name: str = "end") -> DataFrame:
    """Rows of ``start`` with the node their edge leads to, as a struct column."""
    target = end.select(F.col("id").alias("_e"), F.struct(*end.columns).alias(name))
    hop = edge.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    return start.join(hop, F.col(start_id) == F.col("_s")).join(target, F.col("_d") == F.col("_e")).drop("_s", "_d", "_e")


def collect_incoming(
    target: DataFrame, edge: DataFrame, source: DataFrame, name: str, fields: Sequence[str], order: Sequence[str] | None = None, keep_all: bool = True
) -> Nested:
    """Nodes of ``target`` with the nodes that point to them as an array (G8n, G9n).

    The branch is collected before anything else is joined, so two branches
    of a pattern never multiply.
    """
    reached = edge.select("src", "dst").join(source.select(F.col("id").alias("src"), *fields), "src").drop("src")
    # The edges alone tell how many nodes point to one.
    hot = hot_keys(edge, ["dst"], MAX_ITEMS)
    nested = collect_children(reached, ["dst"], name, fields, order, hot=hot)
    return attach(target, nested, {"id": "dst"}, keep_all)


# --- mapping files --------------------------------------------------------


def _text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


# Position of what a column refers to: after all of its parts.
_LAST = 2**31 - 1
_LISTED = "array<variant>"


def _at(value: Column, *path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, "$" + "".join(f"['{p}']" for p in path), kind)


def _below(place: Column) -> Column:
    """The places below one: its parts in their order, then what it refers to; a place has a ``path`` and a ``node``."""
    parts = F.transform(
        F.coalesce(_at(place["node"], "columns", kind=_LISTED), F.array().cast(_LISTED)),
        lambda x, k: F.struct(F.concat(place["path"], F.array(k)).alias("path"), x.alias("node")),
    )
    referred = _at(place["node"], "referenced-column", kind="variant")
    last = F.struct(F.concat(place["path"], F.array(F.lit(_LAST))).alias("path"), referred.alias("node"))
    return F.concat(parts, F.filter(F.array(last), lambda x: x["node"].isNotNull()))


def _places(column: Column) -> Column:
    """All columns of an entry in reading order, at any depth: ``path, name, table``.

    Each step goes one level down from the places of the last; there are as
    many steps as the text has members that can lead down.
    """
    kind = "array<struct<path: array<int>, node: variant>>"
    first = F.array(F.struct(F.array().cast("array<int>").alias("path"), column.alias("node"))).cast(kind)
    steps = F.regexp_count(F.to_json(column), F.lit('"(columns|referenced-column)":'))

    def down(state: Column, _: Column) -> Column:
        ahead = F.flatten(F.transform(state["ahead"], _below)).cast(kind)
        return F.struct(F.concat(state["found"], ahead).alias("found"), ahead.alias("ahead"))

    walked = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("found"), first.alias("ahead")),
        down,
        lambda state: state["found"],
    )
    return F.array_sort(F.transform(walked, lambda p: F.struct(p["path"].alias("path"), _text(_at(p["node"], "name")).alias("name"), _text(_at(p["node"], "table")).alias("table"))))


def _known(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull()))


def mapping_entries(files: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Graph mapping files (JSON text, one per row) as one row per entry of each graph object.

    ``columns`` names the column of the entry, its parts and what they refer
    to, at any depth, in reading order; ``source_table`` is the first table
    among them. A text that is no list of objects gives no rows.
    """
    objects = files.select(*keep, F.posexplode(F.try_variant_get(F.try_parse_json(text), "$", _LISTED)).alias("object_no", "o"))
    entries = objects.select(
        *keep,
        "object_no",
        _at(F.col("o"), "graph-object-type").alias("object_type"),
        _text(_at(F.col("o"), "schema")).alias("source_schema"),
        F.posexplode(_at(F.col("o"), "mappings", kind=_LISTED)).alias("entry_no", "e"),
    )
    column = _at(F.col("e"), "column", kind="variant")
    entries = entries.withColumn("p", once(F.when(column.isNotNull(), _places(column)).otherwise(F.array())))
    return entries.select(
        *keep,
        "object_no",
        "object_type",
        "source_schema",
        "entry_no",
        _at(F.col("e"), "field", "type").alias("field_type"),
        _text(_at(F.col("e"), "field", "name")).alias("target_property"),
        _text(_at(F.col("e"), "field", "id-space")).alias("id_space"),
        _text(_at(F.col("e"), "field", "neo4j-data-type")).alias("target_type"),
        _text(_at(F.col("e"), "column", "sql-data-type")).alias("sql_type"),
        _known(F.col("p.name")).alias("columns"),
        F.get(_known(F.col("p.table")), F.lit(0)).alias("source_table"),
    )


def _heads(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """:func:`object_heads` with the data entries of each object as ``data``: no more than the text of one file holds."""

    def first(value: Column, of_type: str | None = None) -> Column:
        wanted = value.isNotNull() if of_type is None else value.isNotNull() & (F.col("field_type") == of_type)
        return F.min_by(value, F.when(wanted, F.col("entry_no")))

    column = F.get("columns", F.lit(0))
    # An endpoint entry counts only if it names both a column and an id space.
    end_column = F.when(F.col("id_space").isNotNull(), column)
    end_space = F.when(column.isNotNull(), F.col("id_space"))
    is_data = (
        (F.col("field_type") == "Data")
        & column.isNotNull()
        & F.col("target_property").isNotNull()
        & F.col("sql_type").isNotNull()
        & F.col("target_type").isNotNull()
    )
    data = F.struct("entry_no", column.alias("source_column"), "sql_type", "target_property", "target_type")
    heads = entries.groupBy(*keep, "object_no", "object_type", "source_schema").agg(
        first(F.col("source_table")).alias("source_table"),
        first(column, "Label").alias("label_column"),
        first(F.col("id_space"), "Id").alias("id_space"),
        first(F.upper(column), "RelationshipType").alias("relationship_type"),
        first(end_column, "StartId").alias("start_column"),
        first(end_space, "StartId").alias("start_space"),
        first(end_column, "EndId").alias("end_column"),
        first(end_space, "EndId").alias("end_space"),
        F.flatten(F.collect_list(F.when(F.col("field_type") == "Id", F.transform("columns", lambda x: F.lower(x))))).alias("key_columns"),
        F.collect_list(F.when(is_data, data)).alias("data"),
    )
    return heads.withColumn("label", singular(F.coalesce("label_column", "source_table")))


def object_heads(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per graph object: table, label, id space and key columns (G2n)."""
    return _heads(entries, keep).drop("data")


_IS_NODE = "object_type = 'Node' AND source_schema IS NOT NULL AND source_table IS NOT NULL AND label IS NOT NULL"


def _identified(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Without the rows that no file is known for."""
    return df.dropna(subset=list(keep)) if keep else df


def node_mapping_rows(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Property mappings per node label; of mappings repeated under one label the last wins (G1n to G3n)."""
    heads = _identified(_heads(entries, keep).filter(_IS_NODE), keep)
    # Schema and table of a label are those of its first object.
    label = Window.partitionBy(*keep, "label")
    heads = heads.withColumn("s", F.min_by(F.struct("source_schema", "source_table"), "object_no").over(label))
    rows = heads.select(*keep, "object_no", "label", "s", "key_columns", F.explode("data").alias("d")).select("*", "d.*")
    rows = rows.withColumn("is_primary_key", F.array_contains("key_columns", F.lower("source_column")))
    value = F.struct("source_column", "sql_type", "is_primary_key", "target_property", "target_type")
    # Within one object the first entry counts, across objects of a label the last object.
    group = [*keep, "label", F.lower("source_column").alias("_s"), F.lower("target_property").alias("_t")]
    last = rows.groupBy(*group).agg(F.max_by(value, F.struct("object_no", -F.col("entry_no"))).alias("r"), F.first("s").alias("s"))
    return last.select(*keep, "label", "s.*", "r.*")


def relationship_mapping_rows(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Relationships with their endpoint labels (G4n, G6n).

    An endpoint label is that of the node with the same id space; an unknown
    id space gives its last name segment in singular form.
    """
    return _relationships(entries, keep).select(
        *keep,
        "object_no",
        "relationship_type",
        "source_schema",
        "source_table",
        "start_column",
        "start_entity",
        "end_column",
        "end_entity",
    )


def _relationships(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    known = F.when(F.expr(_IS_NODE), F.struct(F.lower("id_space").alias("space"), "object_no", "label"))
    # The nodes of a file, as many as its text holds.
    spaces = F.collect_list(F.when(F.col("id_space").isNotNull(), known)).over(Window.partitionBy(*keep))
    rels = _heads(entries, keep).withColumn("_spaces", spaces).filter("object_type = 'Relationship'")
    told = F.lit(True)
    for k in keep:
        told = told & F.col(k).isNotNull()

    def entity(side: str) -> Column:
        space = F.col(f"{side}_space")
        fallback = singular(_text(F.element_at(F.split(space, "[.]"), -1)))
        same = F.filter("_spaces", lambda x: x["space"] == F.lower(space))
        # Of several nodes the last.
        last = F.array_max(F.transform(same, lambda x: F.struct(x["object_no"], x["label"])))
        return F.coalesce(F.when(told, last["label"]), fallback)

    done = rels.withColumns({f"{side}_entity": entity(side) for side in ("start", "end")})
    return done.filter(
        "relationship_type IS NOT NULL AND source_schema IS NOT NULL AND source_table IS NOT NULL "
        "AND start_column IS NOT NULL AND start_entity IS NOT NULL AND end_column IS NOT NULL AND end_entity IS NOT NULL"
    )


def relationship_property_rows(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Property mappings of relationships; of repeated ones the first counts (G5n)."""
    rels = _identified(_relationships(entries, keep), keep)
    rows = rels.select(*keep, "object_no", "relationship_type", F.explode("data").alias("d")).select("*", "d.*")
    group = [*keep, "object_no", "relationship_type", F.lower("source_column").alias("_s"), F.lower("target_property").alias("_t")]
    value = F.struct("source_column", "sql_type", "target_property", "target_type")
    return rows.groupBy(*group).agg(F.min_by(value, "entry_no").alias("r")).select(*keep, "object_no", "relationship_type", "r.*")


def compile_graph(entries: DataFrame) -> tuple[list[NodeMapping], list[EdgeMapping]]:
    """Node and edge mappings from the entries of one mapping file, for :func:`build_nodes` and :func:`build_edges`.

    Tables go by ``schema.table``. A file is written by people, so its rows are
    collected. An object without a table, a key or an end is left out, as in
    the mapping tables.
    """
    objects: dict[int, list] = {}
    for r in entries.orderBy("object_no", "entry_no").collect():
        objects.setdefault(r["object_no"], []).append(r)
    labels = {r["object_no"]: r["label"] for r in object_heads(entries, []).select("object_no", "label").collect()}
    made_nodes, made_edges = [], []
    for number, rows in objects.items():
        table = next((r["source_table"] for r in rows if r["source_table"]), None)
        schema = rows[0]["source_schema"]
        if not table or not schema:
            continue
        of_type: dict[str, list] = {}
        for r in rows:
            of_type.setdefault(r["field_type"], []).append(r)
        data = [r for r in of_type.get("Data", []) if r["columns"] and r["target_property"] and r["sql_type"] and r["target_type"]]
        properties: dict[str, str] = {}
        for r in data:
            properties.setdefault(r["columns"][0], r["target_property"])
        name = f"{schema}.{table}"
        if rows[0]["object_type"] == "Node":
            key = [c for r in of_type.get("Id", []) for c in r["columns"]]
            space = next((r["id_space"] for r in of_type.get("Id", []) if r["id_space"]), None)
            if key and labels[number]:
                made_nodes.append(NodeMapping(labels[number], name, tuple(dict.fromkeys(key)), properties, space))
        elif rows[0]["object_type"] == "Relationship":
            ends = [next(((r["id_space"], tuple(r["columns"])) for r in of_type.get(e, []) if r["id_space"] and r["columns"]), None) for e in ("StartId", "EndId")]
            kind = next((r["columns"][0] for r in of_type.get("RelationshipType", []) if r["columns"]), None)
            if kind and all(ends):
                made_edges.append(EdgeMapping(kind, name, ends[0], ends[1], properties))
    return made_nodes, made_edges
