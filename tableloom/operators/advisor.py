"""Which framework for which query: least weighted cost under limits on frameworks and memory.

Inputs are long tables, so any number of workloads is solved in one plan:
``(workload, query, framework, cost, memory, weight)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableloom.session import materialise

# Sums of cost are decimals: the same in any order, so ties are ties on every run.
COST = "decimal(38,6)"

# Fixed status codes: solved, no assignment within the limits.
SOLVED, INFEASIBLE = 0, -1

# Price steps of the memory bound per pass.
PRICES = 16


def cost_matrix(measurements: DataFrame, weights: DataFrame) -> DataFrame:
    """Measurements with the weight of their query, at least 1."""
    w = weights.select("workload", "query", F.greatest(F.col("weight"), F.lit(1)).alias("weight"))
    return measurements.join(w, ["workload", "query"]).select("workload", "query", "framework", "cost", "memory", "weight")


def candidates(requested: Column, known: Sequence[str], supported: Sequence[str]) -> Column:
    """Requested frameworks, or all known ones if none are, that are supported, each once."""
    wanted = F.when(F.size(requested) > 0, requested).otherwise(F.array(*[F.lit(f) for f in known]))
    return F.array_intersect(F.array_distinct(wanted), F.array(*[F.lit(f) for f in supported]))


def memory_bound(requested: Column) -> Column:
    """Null, that is unlimited, for a bound of zero or less."""
    return F.when(requested > 0, requested)


def framework_subsets(frameworks: Sequence[str], most: int) -> list[list[str]]:
    """Every choice of at most ``most`` frameworks, small ones first, then by name.

    Their number grows with the frameworks only, never with the data.
    """
    names = sorted(set(frameworks))
    return [list(c) for k in range(1, min(most, len(names)) + 1) for c in combinations(names, k)]


def _options(matrix: DataFrame) -> DataFrame:
    """One row per query with its measured frameworks as an array, at most one entry per framework."""
    option = F.struct(F.col("cost").cast(COST).alias("cost"), F.col("memory").cast("bigint").alias("memory"), F.col("framework").alias("framework"))
    return matrix.groupBy("workload", "query").agg(F.max("weight").alias("weight"), F.collect_list(option).alias("options"))


def _with_subsets(options: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    """One row per query and subset, with the options of that subset; ``subset`` is its position."""
    literal = F.array(*[F.array(*[F.lit(f) for f in s]) for s in framework_subsets(frameworks, most)])
    exploded = options.select("*", F.posexplode(literal).alias("subset", "members"))
    return exploded.select("workload", "query", "weight", "subset", _usable("options", "members").alias("options"))


def _members(frameworks: Sequence[str], most: int) -> Column:
    literal = F.array(*[F.array(*[F.lit(f) for f in s]) for s in framework_subsets(frameworks, most)])
    return F.get(literal, F.col("subset"))


def _usable(options: str, members: str) -> Column:
    return F.filter(options, lambda o: F.array_contains(F.col(members), o.framework))


def _ranked(options: Column | str, price: Column) -> Column:
    """Options with their cost ``p`` at a memory price, weighted cost ``c``, memory ``m`` and framework ``f``."""
    return F.transform(
        options,
        lambda o: F.struct(
            ((F.col("weight") * o.cost).cast("double") + price * o.memory.cast("double")).alias("p"),
            (F.col("weight") * o.cost).cast(COST).alias("c"),
            o.memory.alias("m"),
            o.framework.alias("f"),
        ),
    )


def _kept(gap: Column) -> Column:
    """Options of ``ranked`` within ``gap`` of the best one."""
    return F.sort_array(F.filter("ranked", lambda x: x.p - F.array_min("ranked")["p"] <= gap))


def _class_key(kept: str) -> Column:
    return F.sha2(F.to_json(F.col(kept)), 256)


def subset_totals(matrix: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    """Per workload and subset the least total cost and its memory; subsets that miss a query are left out.

    Each query takes its cheapest framework of the subset, the lighter one on
    a tie. Sums combine on the map side, so a workload of any size is fine.
    """
    return _subset_totals(_options(matrix), frameworks, most)


def _subset_totals(options: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    rows = _with_subsets(options, frameworks, most)
    rows = rows.withColumn("best", F.array_min("options"))
    totals = rows.groupBy("workload", "subset").agg(
        F.sum((F.col("weight") * F.col("best.cost")).cast(COST)).cast(COST).alias("objective"),
        F.sum("best.memory").alias("memory"),
        F.count(F.lit(1)).alias("queries"),
        F.count("best").alias("covered"),
    )
    covered = totals.filter(F.col("queries") == F.col("covered")).drop("queries", "covered")
    return covered.withColumn("members", _members(frameworks, most))


def best_subsets(matrix: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    """The cheapest subset per workload without a memory bound.

    Among equals the smallest subset wins, then the first by name.
    """
    return _best_subsets(_options(matrix), frameworks, most)


def _best_subsets(options: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    totals = _subset_totals(options, frameworks, most)
    row = F.struct("subset", "members", "objective", "memory")
    picked = totals.groupBy("workload").agg(F.min_by(row, F.struct("objective", "subset")).alias("r"))
    return picked.select("workload", "r.*")


def trade_off(matrix: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    """The best objective for every number of frameworks up to ``most``."""
    totals = subset_totals(matrix, frameworks, most)
    each = totals.select("workload", "objective", F.explode(F.sequence(F.size("members"), F.lit(most))).alias("max_frameworks"))
    return each.groupBy("workload", "max_frameworks").agg(F.min("objective").alias("objective"))


def memory_trade_off(matrix: DataFrame, frameworks: Sequence[str], most: int, bounds: Sequence[int]) -> DataFrame:
    """The best objective for every memory bound of a short grid."""
    options = materialise(_options(matrix), "options")
    best = materialise(_best_subsets(options, frameworks, most), "subsets")
    # The sums at every price are the same for all bounds.
    tight = min((b for b in bounds if b > 0), default=None)
    sums = None
    if tight is not None:
        heavy = options.join(best.filter(F.col("memory") > tight).select("workload"), "workload", "left_semi")
        sums = materialise(_priced_sums(materialise(heavy, "heavy"), frameworks, most), "sums")
    parts = [
        _advise(options, best, frameworks, most, b, sums).select("workload", F.lit(b).alias("max_memory"), "status", "objective") for b in bounds
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- with a memory bound --------------------------------------------------


_PICKS = "array<struct<class_key:string,framework:string,upto:bigint>>"


def advise(matrix: DataFrame, frameworks: Sequence[str], most: int, max_memory: int) -> DataFrame:
    """The best assignment per workload.

    Columns: ``workload, status, members, objective, objective_floor, memory``
    and, for :func:`assignments`, ``price, gap, picks``. Workloads within the
    bound are done after one aggregation; the others go to :func:`bounded`.
    Options and advice are written to the scratch folder, since each is read
    several times.
    """
    options = materialise(_options(matrix), "options")
    best = materialise(_best_subsets(options, frameworks, most), "subsets")
    return materialise(_advise(options, best, frameworks, most, max_memory), "advice")


def _advise(
    options: DataFrame, best: DataFrame, frameworks: Sequence[str], most: int, max_memory: int, sums: DataFrame | None = None
) -> DataFrame:
    plain = best.select(
        "workload",
        "members",
        "objective",
        "memory",
        F.lit(0.0).alias("price"),
        F.lit(None).cast("double").alias("gap"),
        F.array().cast(_PICKS).alias("picks"),
    )
    solved = plain
    if max_memory > 0:
        over = best.filter(F.col("memory") > max_memory).select("workload")
        heavy = materialise(options.join(over, "workload", "left_semi"), "heavy")
        solved = plain.filter(F.col("memory") <= max_memory).unionByName(_bounded(heavy, frameworks, most, max_memory, sums))
    return (
        options.select("workload")
        .distinct()
        .join(solved, "workload", "left")
        .select(
            "workload",
            F.when(F.col("objective").isNull(), INFEASIBLE).otherwise(SOLVED).alias("status"),
            "members",
            "objective",
            F.floor("objective").cast("bigint").alias("objective_floor"),
            "memory",
            "price",
            "gap",
            "picks",
        )
    )


def assignments(matrix: DataFrame, advice: DataFrame, buckets: int = 1024) -> DataFrame:
    """``(workload, query, framework)`` of a solved advice.

    Queries with the same options are dealt in query order by hash bucket, so
    a large group of them is not ranked in one task.
    """
    rows = _options(matrix).join(advice.filter(F.col("status") == SOLVED), "workload")
    rows = rows.withColumn("ranked", _ranked(_usable("options", "members"), F.col("price")))
    rows = rows.withColumn("kept", F.when(F.col("gap").isNotNull(), _kept(F.col("gap")))).withColumn("class_key", _class_key("kept"))
    open_ = F.coalesce(F.size("kept") > 1, F.lit(False))
    decided = rows.filter(~open_).select("workload", "query", F.array_min("ranked")["f"].alias("framework"))

    core = rows.filter(open_).select(
        "workload",
        "query",
        "class_key",
        F.filter("picks", lambda x: x.class_key == F.col("class_key")).alias("picks"),
        F.pmod(F.xxhash64("query"), F.lit(buckets)).alias("bucket"),
    )
    counts = core.groupBy("workload", "class_key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("workload", "class_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("workload", "class_key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("workload", "class_key", "bucket").orderBy("query")
    placed = core.join(counts, ["workload", "class_key", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside) - 1
    )
    dealt = placed.select(
        "workload", "query", F.get(F.filter("picks", lambda x: x.upto > F.col("rank")), F.lit(0))["framework"].alias("framework")
    )
    return decided.unionByName(dealt)


def bounded(matrix: DataFrame, frameworks: Sequence[str], most: int, max_memory: int) -> DataFrame:
    """The exact optimum of workloads whose cheapest assignment needs too much memory.

    The bound is priced: with a price on memory each query decides alone, and
    a distributed sum gives a lower bound on the optimum and, where the result
    fits, an upper bound. Options whose extra priced cost passes the gap
    between the two cannot be part of an optimum and are dropped, which
    decides nearly all queries. What is left of a workload, its core, is
    solved exactly in one row; queries with the same options enter it as one
    row with a count.
    """
    return _bounded(materialise(_options(matrix), "options"), frameworks, most, max_memory)


def _priced_sums(options: DataFrame, frameworks: Sequence[str], most: int) -> DataFrame:
    """Priced cost ``p``, cost ``c`` and memory ``m`` of every workload, subset and price, each query deciding alone; subsets that miss a query are left out."""
    # The prices of a workload: zero, and powers of two down from its steepest exchange of cost for memory.
    spread = (F.col("weight") * (F.array_max("options")["cost"] - F.array_min("options")["cost"])).cast("double")
    factors = [0.0] + [2.0**-k for k in range(PRICES)]
    prices = (
        options.groupBy("workload")
        .agg(F.greatest(F.max(spread), F.lit(1e-6)).alias("top"), F.count(F.lit(1)).alias("queries"))
        .select("workload", "queries", F.transform(F.array(*[F.lit(f) for f in factors]), lambda f: f * F.col("top")).alias("prices"))
    )
    rows = _with_subsets(options, frameworks, most).filter(F.size("options") > 0)
    choice = F.array_min(_ranked("options", F.col("price")))
    sums = (
        rows.join(prices, "workload")
        .select("workload", "subset", "weight", "options", "queries", F.explode("prices").alias("price"))
        .select("workload", "subset", "queries", "price", choice.alias("b"))
        .groupBy("workload", "subset", "queries", "price")
        .agg(F.sum("b.p").alias("p"), F.sum("b.c").cast(COST).alias("c"), F.sum("b.m").alias("m"), F.count(F.lit(1)).alias("n"))
    )
    return sums.filter(F.col("n") == F.col("queries")).drop("queries", "n")


def _bounded(options: DataFrame, frameworks: Sequence[str], most: int, max_memory: int, sums: DataFrame | None = None) -> DataFrame:
    """``sums`` may be given, and may hold more workloads than ``options``."""
    rows = _with_subsets(options, frameworks, most).filter(F.size("options") > 0)
    if sums is None:
        sums = _priced_sums(options, frameworks, most)
    sums = sums.withColumn("bound", F.col("p") - F.col("price") * max_memory)
    per_subset = sums.groupBy("workload", "subset").agg(
        F.max_by(F.struct("price", "bound"), F.struct("bound", "price")).alias("best"),
        F.min(F.when(F.col("m") <= max_memory, F.col("c"))).alias("upper"),
    )
    # An upper bound of one subset holds for the whole workload.
    upper = per_subset.groupBy("workload").agg(F.min("upper").cast("double").alias("upper"))
    slack = 1e-6 * (1 + F.abs(F.coalesce("upper", "bound")))
    live = (
        per_subset.select("workload", "subset", F.col("best.price").alias("price"), F.col("best.bound").alias("bound"))
        .join(upper, "workload")
        # Without an upper bound every option stays.
        .withColumn("gap", F.coalesce(F.col("upper") - F.col("bound"), F.lit(float("inf"))) + slack)
        .filter(F.col("gap") >= 0)
        .select("workload", "subset", "price", "gap")
    )
    keys = ["workload", "subset", "price", "gap"]
    kept = (
        rows.join(live, ["workload", "subset"])
        .withColumn("ranked", _ranked("options", F.col("price")))
        .withColumn("kept", _kept(F.col("gap")))
    )
    classes = kept.groupBy(*keys, "kept").agg(F.count(F.lit(1)).alias("copies"))
    decided = F.size("kept") == 1
    only = F.get("kept", F.lit(0))
    core = F.struct(
        _class_key("kept").alias("class_key"),
        "copies",
        F.transform("kept", lambda x: x.c.cast("string")).alias("costs"),
        F.transform("kept", lambda x: x.m).alias("memories"),
        F.transform("kept", lambda x: x.f).alias("names"),
    )
    cores = classes.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(decided, (only["c"] * F.col("copies")).cast(COST))), F.lit(0)).cast(COST).cast("string").alias("base_cost"),
        F.coalesce(F.sum(F.when(decided, only["m"] * F.col("copies"))), F.lit(0)).alias("base_memory"),
        F.sort_array(F.collect_list(F.when(~decided, core))).alias("core"),
    )
    # A batch of rows holds many cores: a call of its own for each would cost more than most of them.
    solve = F.pandas_udf(_core_solver(max_memory), f"objective decimal(38,6), memory bigint, picks {_PICKS}")
    solved = cores.select(*keys, solve("base_cost", "base_memory", "core").alias("s")).select(*keys, "s.*")
    row = F.struct(_members(frameworks, most).alias("members"), "objective", "memory", "price", "gap", "picks")
    picked = solved.filter(F.col("objective").isNotNull()).groupBy("workload").agg(
        F.min_by(row, F.struct("objective", "subset")).alias("r")
    )
    return picked.select("workload", "r.*")


def _core_solver(max_memory: int):
    """Solve one core: states are (memory, cost, choices), pruned to the undominated ones within the bound."""

    def one(base_cost: str, base_memory: int, core) -> tuple:
        front = _frontier([(int(base_memory), _micro(base_cost), ())], max_memory)
        classes = []
        for r in core:
            options = [(int(m), _micro(c)) for m, c in zip(r["memories"], r["costs"])]
            classes.append((r["class_key"], list(r["names"])))
            repeated = _repeat(options, int(r["copies"]), max_memory)
            # Choices are linked backwards: (earlier choices, counts per option of this class).
            front = _combine(front, repeated, max_memory, lambda earlier, counts: (earlier, counts))
        best = min(front, key=lambda s: (s[1], s[0])) if front else None
        picks = []
        if best:
            chain, link = [], best[2]
            while link:
                link, counts = link
                chain.append(counts)
            for (key, names), counts in zip(classes, reversed(chain)):
                upto = 0
                for name, n in zip(names, counts):
                    upto += n
                    picks.append({"class_key": key, "framework": name, "upto": upto})
        return (Decimal(best[1]).scaleb(-6), best[0], picks) if best else (None, None, picks)

    def solve(base_cost: pd.Series, base_memory: pd.Series, core: pd.Series) -> pd.DataFrame:
        found = [one(*row) for row in zip(base_cost, base_memory, core)]
        objective, memory, picks = zip(*found) if found else ((), (), ())
        return pd.DataFrame(
            {"objective": pd.Series(objective, dtype="object"), "memory": pd.array(memory, dtype="Int64"), "picks": pd.Series(picks, dtype="object")}
        )

    return solve


def _micro(cost: str) -> int:
    return int(Decimal(cost).scaleb(6))


def _frontier(states: list[tuple], max_memory: int) -> list[tuple]:
    """States that no other one beats in both memory and cost, within the bound."""
    out: list[tuple] = []
    for s in sorted(states, key=lambda s: (s[0], s[1])):
        if s[0] <= max_memory and (not out or s[1] < out[-1][1]):
            out.append(s)
    return out


def _combine(a: list[tuple], b: list[tuple], max_memory: int, join) -> list[tuple]:
    pairs = [(x[0] + y[0], x[1] + y[1], join(x[2], y[2])) for x in a for y in b if x[0] + y[0] <= max_memory]
    return _frontier(pairs, max_memory)


def _repeat(options: list[tuple], times: int, max_memory: int) -> list[tuple]:
    """The frontier of ``times`` queries with the same options, with counts per option, by doubling."""

    def add(x, y):
        return tuple(i + j for i, j in zip(x, y))

    unit = [(m, c, tuple(int(i == k) for k in range(len(options)))) for i, (m, c) in enumerate(options)]
    result, power = [(0, 0, (0,) * len(options))], _frontier(unit, max_memory)
    while times:
        if times & 1:
            result = _combine(result, power, max_memory, add)
        times >>= 1
        if times:
            power = _combine(power, power, max_memory, add)
    return result
