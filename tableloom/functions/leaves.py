"""JSON values of any form as leaves with one canonical text each, without a schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOT = "$"
_NODE = "struct<key: string, path: string, listed: boolean, size: int, kind: int, text: string>"
_AHEAD = "struct<key: string, path: string, listed: boolean, value: variant>"
_SCALAR, _OBJECT, _LIST = 0, 1, 2
# Numbers that JSON has no form for, as some writers put them.
_BARE = r'(?<=[\[:,\s])(-?Infinity|NaN)(?=\s*[,\]}])'


def parse(text: Column) -> Column:
    """JSON text as a variant; null if it is broken. Bare NaN and Infinity are read as those texts."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, _BARE, '"$1"')))


def once(value: Column) -> Column:
    """``value``, worked out once for each row.

    The condition always holds, but not for the optimizer, which would
    otherwise copy a long expression into every place that reads its column,
    functions over elements included.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; in a function over elements a column is written out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, _ROOT, kind)


def unpacked(value: Column) -> Column:
    """A text that holds a JSON object or list as that value, anything else as it is."""
    inner = parse(_as(value, "string"))
    nested = _as(inner, "map<string,variant>").isNotNull() | _as(inner, "array<variant>").isNotNull()
    return F.when(nested, inner).otherwise(value)


def _escaped(key: Column) -> Column:
    """A member name as a part of a path; the separator inside it is marked."""
    return F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))


def member_path(*names: str) -> str:
    """The path of nested members."""
    return ".".join(n.replace("\\", "\\\\").replace(".", "\\.") for n in names)


def _scalar(value: Column) -> Column:
    """Numbers at three decimals, half up; a text that reads as JSON itself is quoted, so that it is no number."""

    def written(quoted: Column) -> Column:
        number = F.coalesce(_as(value, "decimal(38,3)").cast("string"), _as(value, "double").cast("string"), quoted)
        plain = _let(_as(value, "string"), lambda text: F.when(F.try_parse_json(text).isNotNull(), quoted).otherwise(text))
        return F.when(F.startswith(quoted, F.lit('"')), plain).when(quoted.isin("true", "false"), quoted).otherwise(number)

    return F.when(F.is_variant_null(value), "null").otherwise(_let(F.to_json(value), written))


def _opened(declared: Sequence[str]):
    """A value as its node and the values directly below it."""

    def opened(node: Column) -> Column:
        def member(e: Column) -> Column:
            def at(name: Column) -> Column:
                path = F.when(node["path"].isNull(), name).otherwise(F.concat_ws(".", node["path"], name))
                return F.struct(e["key"].alias("key"), path.alias("path"), node["listed"].alias("listed"), e["value"].alias("value"))

            return _let(_escaped(e["key"]), at)

        def item(x: Column) -> Column:
            return F.struct(F.lit(None).cast("string").alias("key"), node["path"].alias("path"), F.lit(True).alias("listed"), x.alias("value"))

        def made(kind: int, below: Column, text: Column) -> Column:
            n = F.struct(node["key"].alias("key"), node["path"].alias("path"), node["listed"].alias("listed"), F.size(below).alias("size"), F.lit(kind).alias("kind"), text.alias("text"))
            return F.struct(n.cast(_NODE).alias("node"), below.alias("below"))

        def of_object(members: Column) -> Column:
            below = F.transform(F.map_entries(members), member)
            if declared:
                below = F.filter(below, lambda m: m["listed"] | ~m["path"].isin(list(declared)))
            return _let(below.cast(f"array<{_AHEAD}>"), lambda x: made(_OBJECT, x, F.lit(None).cast("string")))

        def of_list(items: Column) -> Column:
            return _let(F.transform(items, item).cast(f"array<{_AHEAD}>"), lambda x: made(_LIST, x, F.lit(None).cast("string")))

        scalar = made(_SCALAR, F.array().cast(f"array<{_AHEAD}>"), _scalar(node["value"]))
        listed = _let(_as(node["value"], "array<variant>"), lambda items: F.when(items.isNotNull(), of_list(items)).otherwise(scalar))
        return _let(_as(node["value"], "map<string,variant>"), lambda members: F.when(members.isNotNull(), of_object(members)).otherwise(listed))

    return opened


def _nodes(value: Column, declared: Sequence[str]) -> Column:
    """Every value inside one, level by level, each with the number of values directly below it."""
    opened = _opened(declared)
    root = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("listed"), value.alias("value"))
    first = F.array(root).cast(f"array<{_AHEAD}>")
    # Every level but the last opens an object or a list.
    levels = F.regexp_count(F.to_json(value), F.lit(r"[\[{]")) + 1

    def down(state: Column, _: Column) -> Column:
        def gone(level: Column) -> Column:
            found = F.concat(state["found"], F.transform(level, lambda o: o["node"]))
            return F.struct(found.alias("found"), F.flatten(F.transform(level, lambda o: o["below"])).alias("ahead"))

        return F.when(F.size(state["ahead"]) == 0, state).otherwise(_let(F.transform(state["ahead"], opened), gone))

    start = F.struct(F.array().cast(f"array<{_NODE}>").alias("found"), first.alias("ahead"))
    return F.aggregate(F.sequence(F.lit(1), levels), start, down, lambda s: s["found"])


def _folded(nodes: Column) -> Column:
    """The leaves, from the last value up: a value takes those directly below it from the front of the row of finished ones."""
    done = "array<struct<key: string, text: string>>"
    leaf = "array<struct<path: string, text: string>>"

    def up(state: Column, n: Column) -> Column:
        row = state["done"]
        below = F.slice(row, F.lit(1), n["size"])
        listed = F.concat(F.lit("["), F.array_join(F.sort_array(F.transform(below, lambda b: b["text"])), ","), F.lit("]"))
        members = F.transform(F.sort_array(below), lambda b: F.concat(F.to_json(b["key"].cast("variant")), F.lit(":"), b["text"]))
        whole = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
        # The text of an object is read inside a list, and where the object is empty.
        text = F.when(n["kind"] == _SCALAR, n["text"]).when(n["kind"] == _LIST, listed).when(n["listed"] | (n["size"] == 0), whole)
        rest = F.slice(row, n["size"] + 1, F.greatest(F.size(row) - n["size"], F.lit(0)))
        stands = ~n["listed"] & ((n["kind"] != _OBJECT) | ((n["size"] == 0) & n["path"].isNotNull()))

        def taken(text: Column) -> Column:
            own = F.array(F.struct(n["key"].alias("key"), text.alias("text"))).cast(done)
            found = F.array(F.struct(F.coalesce(n["path"], F.lit("")).alias("path"), text.alias("text"))).cast(leaf)
            return F.struct(F.concat(rest, own).alias("done"), F.when(stands, F.concat(state["leaves"], found)).otherwise(state["leaves"]).alias("leaves"))

        return _let(text, taken)

    start = F.struct(F.array().cast(done).alias("done"), F.array().cast(leaf).alias("leaves"))
    return F.aggregate(F.reverse(nodes), start, up, lambda s: s["leaves"])


def leaves(value: Column, declared: Sequence[str] = ()) -> Column:
    """A variant as a map from path to canonical text; null has no leaves.

    Objects lead to their members. A list is one leaf, whatever is in it: the
    sorted texts of its elements, copies kept, built from the inside out, so
    lists within lists have no order either. An empty object is a leaf, and a
    value that is no object is the leaf of the empty path. Paths in
    ``declared`` are left out with all that is below them.
    """
    found = F.map_from_entries(_folded(_nodes(value, declared)))
    return F.when(value.isNull() | F.is_variant_null(value), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(found)
