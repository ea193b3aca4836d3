"""Mapping projects that drive the building of collections.

A project (JSON text) names collections, the mappings of tables into them, the
mappings below each mapping, and the foreign keys of the tables. It is read as
tables with one row per mapping, per field and per foreign key column, and those
rows become the mapping trees that ``documents.build_collection`` takes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.operators import documents as D


class ProjectError(ValueError):
    """A project that names no tree of mappings; ``problems`` lists every reason."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


@dataclass(frozen=True)
class Project:
    """Tables ``mappings``, ``fields`` and ``foreign_keys`` of projects, with the columns that tell projects apart."""

    mappings: DataFrame
    fields: DataFrame
    foreign_keys: DataFrame
    keep: tuple[str, ...]


def _schema() -> T.StructType:
    """The members of a project that are read; their names are fixed values."""

    def obj(**fields: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    def of(value: T.DataType) -> T.MapType:
        return T.MapType(T.StringType(), value)

    s, b, i = T.StringType(), T.BooleanType(), T.IntegerType()
    entry = obj(
        target=obj(name=s, included=b, isNullExcluded=b, type=s), source=obj(name=s, databaseSpecificType=s, isPrimaryKey=b)
    )
    mapping = obj(settings=obj(type=s, embeddedPath=s, foreignKeyName=s), fields=of(entry), collectionId=s, table=s)
    below = of(obj(children=T.ArrayType(s)))
    content = obj(
        collections=of(obj(name=s)), tables=of(obj(path=obj(database=s, schema=s, table=s))),
        mappings=of(mapping), relationships=obj(mappings=below),
    )
    column = obj(ordinalPosition=i, foreignKey=obj(name=s, schema=s, table=s, column=s))
    tables = of(obj(columns=of(column)))
    catalog = obj(full=obj(databases=of(obj(schemas=of(obj(tables=tables))))))
    return obj(project=obj(content=content), schema=catalog)


def _text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def _full_name(*parts: Column) -> Column:
    return F.concat_ws(".", *[_text(p) for p in parts])


def read_projects(projects: DataFrame, text: str, keep: Sequence[str] = ()) -> Project:
    """The tables of mapping projects, one JSON text per row; ``keep`` names the columns that tell them apart.

    ``mappings``: mapping_id, collection, kind, source_table, path, foreign_key
    and ``parents``, the (id, position) of the mappings that list it as a child.
    ``fields``: one row per mapped column with all its flags, in the order of
    the names. ``foreign_keys``: one row per column of a foreign key.
    """
    keep = tuple(keep)
    parsed = projects.select(*keep, F.from_json(text, _schema()).alias("p"))
    content = parsed.select(*keep, "p.project.content.*")
    one = content.select(*keep, "collections", "tables", F.explode("mappings").alias("mapping_id", "m"))
    path = F.try_element_at("tables", _text(F.col("m.table")))["path"]
    kind = F.coalesce(F.upper(_text(F.col("m.settings.type"))), F.lit(D.NEW_DOCUMENT))
    heads = one.select(
        *keep,
        "mapping_id",
        _text(F.try_element_at("collections", _text(F.col("m.collectionId")))["name"]).alias("collection"),
        kind.alias("kind"),
        _full_name(path["database"], path["schema"], path["table"]).alias("source_table"),
        F.when(kind != D.NEW_DOCUMENT, _text(F.col("m.settings.embeddedPath"))).alias("path"),
        F.when(kind != D.NEW_DOCUMENT, _text(F.col("m.settings.foreignKeyName"))).alias("foreign_key"),
    )
    lists = content.select(*keep, F.explode("relationships.mappings").alias("parent_id", "r"))
    children = lists.select(*keep, "parent_id", F.posexplode("r.children").alias("position", "mapping_id"))
    parents = children.groupBy(*keep, "mapping_id").agg(F.sort_array(F.collect_set(F.struct("parent_id", "position"))).alias("parents"))
    # Children that no mapping describes stay, so that they can be reported.
    mappings = _joined(heads, parents, [*keep, "mapping_id"], "full")

    entries = one.select(*keep, "mapping_id", F.explode("m.fields").alias("field_key", "f"))
    fields = entries.select(
        *keep,
        "mapping_id",
        "field_key",
        _text(F.col("f.source.name")).alias("source_column"),
        F.lower(_text(F.col("f.source.databaseSpecificType"))).alias("sql_type"),
        F.coalesce("f.source.isPrimaryKey", F.lit(False)).alias("is_primary_key"),
        _text(F.col("f.target.name")).alias("target_property"),
        F.upper(_text(F.col("f.target.type"))).alias("target_type"),
        F.coalesce("f.target.included", F.lit(True)).alias("included"),
        F.coalesce("f.target.isNullExcluded", F.lit(False)).alias("null_excluded"),
    ).filter("source_column IS NOT NULL AND target_property IS NOT NULL AND source_column <> '_id'")

    schemas = parsed.select(*keep, F.explode("p.schema.full.databases").alias("db", "d")).select(*keep, "db", F.explode("d.schemas").alias("owner", "s"))
    columns = schemas.select(*keep, "db", "owner", F.explode("s.tables").alias("tab", "t")).select(
        *keep, "db", "owner", "tab", F.explode("t.columns").alias("column_name", "c")
    )
    referred = F.col("c.foreignKey")
    keys = columns.filter(referred["name"].isNotNull()).select(
        *keep,
        referred["name"].alias("foreign_key"),
        _full_name(F.col("db"), F.col("owner"), F.col("tab")).alias("table"),
        "column_name",
        F.col("c.ordinalPosition").alias("position"),
        _full_name(F.col("db"), F.coalesce(referred["schema"], F.col("owner")), referred["table"]).alias("referred_table"),
        referred["column"].alias("referred_column"),
    )
    return Project(mappings, fields, keys, keep)


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    return left.join(right, list(on), how)


def project_problems(project: Project) -> DataFrame:
    """Every reason why a project names no trees, as rows of ``keep``, mapping_id and ``problem``; for any number of projects."""
    keep, m = list(project.keep), project.mappings
    embedded = m.filter(F.col("kind") != D.NEW_DOCUMENT)
    blank = F.col("source_table").isNull() | (F.col("source_table") == "")
    kinds = [D.NEW_DOCUMENT, D.EMBEDDED, D.EMBEDDED_ARRAY]
    found = [
        m.filter("kind IS NULL").select(*keep, "mapping_id", F.lit("listed as a child but not described").alias("problem")),
        m.filter(F.col("kind").isNotNull() & ~F.col("kind").isin(kinds)).select(*keep, "mapping_id", F.lit("unknown kind").alias("problem")),
        m.filter("kind IS NOT NULL AND collection IS NULL").select(*keep, "mapping_id", F.lit("unknown collection").alias("problem")),
        m.filter(F.col("kind").isNotNull() & blank).select(*keep, "mapping_id", F.lit("unknown table").alias("problem")),
        embedded.filter("parents IS NULL").select(*keep, "mapping_id", F.lit("embedded without a parent").alias("problem")),
        embedded.filter("path IS NULL").select(*keep, "mapping_id", F.lit("embedded without a path").alias("problem")),
        embedded.filter("size(parents) > 1").select(*keep, "mapping_id", F.lit("has several parents").alias("problem")),
        m.filter((F.col("kind") == D.NEW_DOCUMENT) & F.col("parents").isNotNull()).select(*keep, "mapping_id", F.lit("a root below another mapping").alias("problem")),
    ]
    names = project.foreign_keys.select(*keep, "foreign_key").distinct()
    unknown = embedded.join(names, [*keep, "foreign_key"], "left_anti")
    found.append(unknown.select(*keep, "mapping_id", F.lit("unknown foreign key").alias("problem")))
    doubled = project.fields.filter("included").groupBy(*keep, "mapping_id", "target_property").count().filter("count > 1")
    found.append(doubled.select(*keep, "mapping_id", F.concat(F.lit("several fields named "), "target_property").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def compile_project(project: Project) -> dict[str, D.TableMapping]:
    """Collection names and their mapping trees, from the tables of one project.

    A project is a file that people write, so its rows are collected. Parents
    come before their children; a circle, or any row of
    :func:`project_problems`, is an error that names it.
    """
    found = [f"{r['mapping_id']}: {r['problem']}" for r in project_problems(project).collect()]
    mappings = {r["mapping_id"]: r for r in project.mappings.collect() if r["kind"] is not None}
    above = {m: [p["parent_id"] for p in r["parents"] or []] for m, r in mappings.items()}
    try:
        order = [m for m in TopologicalSorter(above).static_order() if m in mappings]
    except CycleError as e:
        raise ProjectError([*sorted(found), "mappings in a circle: " + " -> ".join(e.args[1])]) from e
    fields: dict[str, list[D.Field]] = {}
    for r in sorted(project.fields.collect(), key=lambda r: (r["mapping_id"], r["field_key"])):
        fields.setdefault(r["mapping_id"], []).append(
            D.Field(r["source_column"], r["target_property"], r["target_type"], r["included"], r["is_primary_key"], r["null_excluded"])
        )
    keys: dict[str, list] = {}
    for r in project.foreign_keys.collect():
        keys.setdefault(r["foreign_key"], []).append(r)
    links = {}
    for m in order:
        r = mappings[m]
        if r["kind"] != D.NEW_DOCUMENT and above[m] and above[m][0] in mappings and r["foreign_key"] in keys:
            links[m] = _link(r, mappings[above[m][0]], keys[r["foreign_key"]], found)
    roots: dict[str, list[str]] = {}
    for m in order:
        if mappings[m]["kind"] == D.NEW_DOCUMENT:
            roots.setdefault(mappings[m]["collection"], []).append(m)
    found += [f"{c}: several roots" for c, ms in roots.items() if len(ms) > 1]
    if found:
        raise ProjectError(sorted(found))

    done: dict[str, D.TableMapping] = {}
    below: dict[str, list[tuple[int, str]]] = {}
    for m in order:
        for p in mappings[m]["parents"] or []:
            below.setdefault(p["parent_id"], []).append((p["position"], m))
    for m in reversed(order):  # children before their parents
        r = mappings[m]
        children = tuple(done[c] for _, c in sorted(below.get(m, [])))
        done[m] = D.TableMapping(r["kind"], r["source_table"], tuple(fields.get(m, ())), r["path"], links.get(m), children)
    return {c: done[ms[0]] for c, ms in roots.items()}


def _link(child, parent, key: Sequence, problems: list[str]) -> tuple | None:
    """Columns of the parent and of the child: an object is referred to by its parent, the elements of an array refer to it."""
    ends = {"table": "column_name", "referred_table": "referred_column"}
    sides = ("referred_table", "table") if child["kind"] == D.EMBEDDED_ARRAY else ("table", "referred_table")
    both = [r for r in key if (r[sides[0]], r[sides[1]]) == (parent["source_table"], child["source_table"])]
    if not both:
        problems.append(f"{child['mapping_id']}: foreign key {child['foreign_key']} does not join {parent['source_table']} and {child['source_table']}")
        return None
    pairs = [(r[ends[sides[0]]], r[ends[sides[1]]]) for r in sorted(both, key=lambda r: (r["position"] or 0, r["column_name"]))]
    return pairs[0] if len(pairs) == 1 else tuple(pairs)


def build_project(project: Project, tables: Mapping[str, DataFrame], **bounds: int) -> dict[str, D.Collection]:
    """Every collection of a project from the tables it names."""
    return {name: D.build_collection(name, root, tables, **bounds) for name, root in compile_project(project).items()}


# --- documents as text ----------------------------------------------------


def document_text(mapping: D.TableMapping, generate_id: bool = True) -> Column:
    """A document of ``mapping`` as JSON text; a null field is left out where its mapping says so, else written as null."""
    head = [_member(F.col("_id"), "_id", False)] if generate_id else []
    return _object(mapping, lambda name: F.col(f"`{name}`"), head)


def _member(value: Column, name: str, null_excluded: bool) -> Column:
    """``"name":value`` as text; null where it is left out."""
    text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    text = F.substr(text, F.lit(2), F.char_length(text) - 2)
    return F.when(value.isNotNull(), text) if null_excluded else text


def _object(mapping: D.TableMapping, get, head: Sequence[Column] = ()) -> Column:
    members = [*head, *[_member(get(f.target), f.target, f.null_excluded) for f in mapping.fields if f.included]]
    for child in mapping.children:
        name = F.to_json(F.array(F.lit(child.path)))
        name = F.concat(F.substr(name, F.lit(2), F.char_length(name) - 2), F.lit(":"))
        value = get(child.path)
        if child.kind == D.EMBEDDED:
            members.append(F.concat(name, F.when(value.isNull(), F.lit("null")).otherwise(_object(child, lambda n, v=value: v[n]))))
        else:
            members.append(_member(get(child.path + D.PARTS), child.path + D.PARTS, False))
            members.append(F.concat(name, F.lit("["), F.array_join(F.transform(value, _element(child)), ","), F.lit("]")))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def _element(child: D.TableMapping):
    return lambda x: _object(child, lambda n: x[n])
