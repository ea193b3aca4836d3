"""Rows of a child table as arrays of a parent (1:N, N:M, optional, multi-branch).

An array can only grow to what one row may hold, so each function returns a
:class:`Nested`: ``rows`` with one row per key, and ``continuations`` with the
further parts of arrays that pass ``max_items``. Nothing is dropped; where no
key is that heavy, ``continuations`` is ``None`` and ``rows`` is the whole
result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.operators.skew import HotKeys, hot_keys
from tableloom.session import materialise

MAX_ITEMS = 100_000


@dataclass(frozen=True)
class Nested:
    """``rows``: key columns, other parent columns and the array ``name``.

    ``continuations``: key columns, ``part`` (from 1) and the array ``name``.
    """

    rows: DataFrame
    continuations: DataFrame | None
    keys: tuple[str, ...]
    name: str

    def all_parts(self) -> DataFrame:
        """Key columns and array of every part: the whole content."""
        first = self.rows.select(*self.keys, self.name)
        if self.continuations is None:
            return first
        return first.unionByName(self.continuations.select(*self.keys, self.name))

    def reduced(self, **values: tuple[Column, str]) -> DataFrame:
        """Parent columns and values of the array, merged over its parts.

        Each value is an expression on the array and how parts merge: ``sum``,
        ``min`` or ``max``. The array itself is left out.
        """
        plain = [c for c in self.rows.columns if c != self.name]
        columns = [column.alias(name) for name, (column, _) in values.items()]
        first = self.rows.select(*plain, *columns)
        if self.continuations is None:
            return first
        merges = {"sum": F.sum, "min": F.min, "max": F.max}
        more = (
            self.continuations.select(*[F.col(k).alias(f"_{k}") for k in self.keys], *columns)
            .groupBy(*[f"_{k}" for k in self.keys])
            .agg(*[merges[how](name).alias(f"_{name}") for name, (_, how) in values.items()])
        )
        joined = first.join(more, [F.col(k) == F.col(f"_{k}") for k in self.keys], "left")
        both = {
            "sum": lambda n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)),
            "min": lambda n: F.least(n, f"_{n}"),
            "max": lambda n: F.greatest(n, f"_{n}"),
        }
        return joined.select(*plain, *[both[how](name).alias(name) for name, (_, how) in values.items()])

    def exploded(self) -> DataFrame:
        """Key columns and one row per element."""
        return self.all_parts().select(*self.keys, F.explode(self.name).alias("item")).select(*self.keys, "item.*")


def _item(fields: Sequence[str], order: Sequence[str], source: Column | None = None) -> Column:
    """Element struct whose leading fields are the sort order, so that arrays sort as they are."""
    names = list(dict.fromkeys([*order, *fields]))
    return F.struct(*[F.col(c) if source is None else source[c].alias(c) for c in names])


def _sorted(items: Column, fields: Sequence[str], order: Sequence[str]) -> Column:
    """Sorted elements with exactly ``fields``, in that sequence.

    ``sort_array`` compares structs in generated code; a comparator lambda
    would be interpreted for every comparison.
    """
    ordered = F.sort_array(items)
    if list(dict.fromkeys([*order, *fields])) == list(fields):
        return ordered
    return F.transform(ordered, lambda x: F.struct(*[x[c].alias(c) for c in fields]))


def collect_children(
    child: DataFrame,
    keys: Sequence[str],
    name: str,
    fields: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    max_items: int = MAX_ITEMS,
    hot: HotKeys | None = None,
) -> Nested:
    """Group ``child`` by ``keys`` into arrays of structs sorted by ``order``.

    Keys with at most ``max_items`` rows are grouped in one shuffle. Rows of a
    heavier key are first collapsed to distinct rows with a count, cut into
    blocks, and dealt to as many parts as the key needs, so neither a hot key
    nor a hot group of copies reaches one task. Part sizes are hash-dealt:
    ``max_items`` is the aim per part, not a cut-off. Elements are sorted
    inside a part.

    ``hot`` gives the heavy keys where they can be counted on a smaller table
    than ``child``, such as the one that holds the foreign key.
    """
    keys = tuple(keys)
    fields = [c for c in child.columns if c not in keys] if fields is None else list(fields)
    order = list(order) if order else fields
    child = child.select(*dict.fromkeys([*keys, *fields, *order]))
    for key in keys:
        child = child.filter(F.col(key).isNotNull())
    hot = hot or hot_keys(child, keys, max_items)
    item = _item(fields, order)

    def group(df: DataFrame) -> DataFrame:
        # Collecting on the map side first would sort every row there and shrink nothing.
        return df.repartition(*keys).groupBy(*keys).agg(_sorted(F.collect_list(item), fields, order).alias(name))

    if hot.empty:
        return Nested(group(child), None, keys, name)

    marked = hot.marked()
    cold = group(child.join(marked, list(keys), "left_anti"))
    block = max(1, max_items // 16)
    columns = list(child.columns)
    copies = child.join(marked, list(keys)).groupBy(*columns, "_n").agg(F.count(F.lit(1)).alias("_copies"))
    blocks = copies.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {block}")))
    ).withColumn("_times", F.least(F.col("_copies") - F.col("_block") * block, F.lit(block)).cast("int"))
    parts = F.ceil(F.col("_n") * 2 / F.lit(max_items)).cast("long")
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64(*columns, "_block"), parts))
    grouped = dealt.groupBy(*keys, "part").agg(
        F.collect_list(F.struct(*order, *[c for c in fields if c not in order], "_times")).alias("_items")
    )
    # Expand the copies inside the part and sort there.
    expanded = F.flatten(F.transform("_items", lambda x: F.array_repeat(_item(fields, order, x), x["_times"])))
    # Made once, as the leading part, the first parts and the rest all read it.
    heavy = materialise(grouped.select(*keys, "part", _sorted(expanded, fields, order).alias(name)), "parts")
    # Hash dealing may leave part 0 empty: the lowest part present leads.
    lead = heavy.groupBy(*keys).agg(F.min("part").alias("_lead"))
    lead = F.broadcast(lead) if hot.small else lead
    heavy = heavy.join(lead, list(keys))
    first = heavy.filter(F.col("part") == F.col("_lead")).select(*keys, name)
    rest = heavy.filter(F.col("part") > F.col("_lead")).select(*keys, "part", name)
    return Nested(cold.unionByName(first), rest, keys, name)


def attach(parent: DataFrame, nested: Nested, on: dict[str, str] | None = None, keep_all: bool = True) -> Nested:
    """Join collected arrays to their parents; parents without a child get an empty array.

    Both sides hold one row per key, so the join cannot skew. ``on`` maps a
    parent column to a key column of ``nested`` where the names differ.
    """
    on = on or {k: k for k in nested.keys}
    by_key = {v: k for k, v in on.items()}
    pairs = [F.col(f"p.{p}") == F.col(f"c.{c}") for p, c in on.items()]
    joined = parent.alias("p").join(nested.rows.alias("c"), pairs, "left" if keep_all else "inner")
    empty = F.array().cast(nested.rows.schema[nested.name].dataType)
    rows = joined.select("p.*", F.coalesce(F.col(f"c.{nested.name}"), empty).alias(nested.name))
    rest = nested.continuations
    if rest is not None:
        rest = rest.withColumnsRenamed({c: p for c, p in by_key.items() if c != p})
        owned = [by_key[k] for k in nested.keys]
        rest = rest.join(parent.select(*owned).distinct(), owned, "left_semi").select(*owned, "part", nested.name)
    return Nested(rows, rest, tuple(by_key[k] for k in nested.keys), nested.name)


def include_many(
    parent: DataFrame,
    child: DataFrame,
    on: dict[str, str],
    name: str,
    fields: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    keep_all: bool = True,
    max_items: int = MAX_ITEMS,
    hot: HotKeys | None = None,
) -> Nested:
    """Parent rows with their children as an array (JOI2, JOI4, JOI6)."""
    nested = collect_children(child, list(on.values()), name, fields, order, max_items, hot)
    return attach(parent, nested, on, keep_all)


def include_through_link(
    left: DataFrame,
    link: DataFrame,
    right: DataFrame,
    left_on: dict[str, str],
    right_on: dict[str, str],
    name: str,
    fields: Sequence[str],
    order: Sequence[str] | None = None,
    max_items: int = MAX_ITEMS,
) -> Nested:
    """N:M through a link table, seen from the ``left`` side (JOI3).

    ``left_on`` maps a left column to a link column, ``right_on`` a right
    column to a link column. Swap the sides for the other direction.
    """
    pairs = [F.col(f"r.{r}") == F.col(f"k.{k}") for r, k in right_on.items()]
    reached = (
        link.alias("k")
        .join(right.alias("r"), pairs)
        .select(*[F.col(f"k.{k}") for k in left_on.values()], *[F.col(f"r.{c}") for c in fields])
    )
    # The link table alone tells how many rows a key has.
    hot = hot_keys(link, list(left_on.values()), max_items)
    return include_many(left, reached, left_on, name, fields, order, max_items=max_items, hot=hot)


def include_branches(
    parent: DataFrame, branches: Sequence[tuple[DataFrame, dict[str, str], str, Sequence[str] | None, Sequence[str] | None]], max_items: int = MAX_ITEMS
) -> list[Nested]:
    """Several 1:N branches of one parent (JOI5).

    Each branch is collected on its own key before it meets the parent, so two
    branches never multiply. Returns one :class:`Nested` per branch; the last
    one's ``rows`` hold every array.
    """
    done: list[Nested] = []
    rows = parent
    for child, on, name, fields, order in branches:
        step = include_many(rows, child, on, name, fields, order, max_items=max_items)
        rows = step.rows
        done.append(step)
    return [Nested(rows, s.continuations, s.keys, s.name) for s in done]
