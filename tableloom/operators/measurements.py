"""Analysis of benchmark iterations and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableloom.functions.units import nanoseconds, size_bytes

METHOD, JOB, PARAMS = "Target_Method", "Job_Id", "Params"
STAGE, LAUNCH, ITERATION, VALUE = (
    "Measurement_IterationStage",
    "Measurement_LaunchIndex",
    "Measurement_IterationIndex",
    "Measurement_Value",
)

# Fixed ladder of time units, each 1000 of the one before.
TIME_UNITS = ["ns", "us", "ms", "sec"]


def measured(iterations: DataFrame) -> DataFrame:
    """Only the iterations that count (M1)."""
    return iterations.filter(F.col(STAGE) == "Result")


def label_jobs(iterations: DataFrame) -> DataFrame:
    """Missing jobs as empty text; jobs carry their parameters if every row has some (M2)."""
    every = iterations.agg((F.count_if(F.col(PARAMS).isNull()) == 0)).scalar()
    job = F.coalesce(F.col(JOB), F.lit(""))
    labelled = F.when(every, F.trim(F.concat_ws(" ", job, F.col(PARAMS)))).otherwise(job)
    return iterations.withColumn(JOB, labelled).withColumn(PARAMS, F.coalesce(F.col(PARAMS), F.lit("")))


def choose_unit(iterations: DataFrame) -> DataFrame:
    """Scale values to the largest unit in which the smallest one still passes 1000 of the unit below (M3).

    Adds ``unit``. The minimum is a scalar subquery.
    """
    low = F.min(VALUE)
    steps = sum(F.when(low > F.lit(1000.0) ** i, 1).otherwise(0) for i in (1, 2, 3))
    step = F.col("_step")
    return (
        iterations.withColumn("_step", iterations.agg(steps).scalar())
        .withColumn("unit", F.element_at(F.array(*[F.lit(u) for u in TIME_UNITS]), step + 1))
        .withColumn(VALUE, F.col(VALUE) / F.pow(F.lit(1000.0), step))
        .drop("_step")
    )


def mean_and_error(iterations: DataFrame, keys: Sequence[str] = (METHOD, JOB), value: str = VALUE) -> DataFrame:
    """Mean and standard error per group (M4)."""
    return iterations.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("standard_error"),
    )


def cumulative_mean(
    iterations: DataFrame,
    keys: Sequence[str] = (METHOD, JOB, LAUNCH),
    order: str = ITERATION,
    value: str = VALUE,
    block: int = 1_000_000,
) -> DataFrame:
    """Add ``cumulative_mean`` per group in iteration order (M5).

    A group is cut into ranges of ``block`` iteration numbers. Range totals
    are summed up first (one small row per range), so no task sees more than
    one range of a group, however large the group is.
    """
    rows = iterations.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    totals = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block", F.sum("_sum").over(before).alias("_sum_before"), F.sum("_count").over(before).alias("_count_before")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_block"]]
    joined = rows.alias("a").join(offsets.alias("b"), same).select("a.*", "b._sum_before", "b._count_before")
    return joined.withColumn(
        "cumulative_mean",
        (F.coalesce(F.col("_sum_before"), F.lit(0)) + F.sum(value).over(inside)).cast("double")
        / (F.coalesce(F.col("_count_before"), F.lit(0)) + F.count(value).over(inside)),
    ).drop("_block", "_sum_before", "_count_before")


def five_numbers(
    iterations: DataFrame, keys: Sequence[str] = (METHOD, JOB), value: str = VALUE, bins: int = 32
) -> DataFrame:
    """Minimum, quartiles and maximum per group, exact, linear between ranks (M6).

    Approximate quantiles of each group, kept on the map side in a sketch, are
    the edges of its bins (``bins`` of them), so a bin follows where the values
    are, outliers or not. Distinct values with their counts meet the edges of
    their group; counts per bin tell which bins hold a wanted rank, and only
    those are ranked value by value. Nothing is written and nothing runs while
    the plan is built.
    """
    q = (0.0, 0.25, 0.5, 0.75, 1.0)
    known = iterations.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = known.groupBy(*keys).agg(F.percentile_approx("_v", [k / bins for k in range(1, bins)], 10 * bins).alias("_edges"))
    values = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # Hot groups are split by the join; a bin is the number of edges below the value.
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    values = values.alias("a").join(edges.alias("b"), same).select("a.*", F.size(F.filter("b._edges", lambda e: e < F.col("a._v"))).alias("_bin"))
    counts = values.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(whole))
    # Wanted zero-based ranks: floor and ceiling of p * (n - 1).
    wanted = ranked.select(
        *keys,
        "_bin",
        (F.col("_upto") - F.col("_n")).alias("_before"),
        "_upto",
        "_total",
        F.explode(F.array(*[F.lit(p) * (F.col("_total") - 1) for p in q])).alias("_pos"),
    )
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"))
    wanted = wanted.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto")))
    bins_needed = wanted.groupBy(*keys, "_bin").agg(F.first("_before").alias("_before"), F.collect_set("_rank").alias("_ranks"))
    # At most ten bins per group are needed.
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._bin") == F.col("b._bin")]
    values = values.alias("a").join(bins_needed.alias("b"), same).select("a.*", "b._before", "b._ranks")
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v")
    placed = values.withColumn("_end", F.col("_before") + F.sum("_n").over(inner))
    hits = placed.select(
        *keys,
        "_v",
        F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n")))).alias("_rank"),
    )
    at_rank = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = at_rank.alias("a").join(sizes.alias("b"), same).select("a.*", "b.n")

    def at(p: float) -> Column:
        pos = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.element_at("_at", F.floor(pos)), F.element_at("_at", F.ceil(pos))
        return lo + (hi - lo) * (pos - F.floor(pos))

    names = ("minimum", "lower_quartile", "median", "upper_quartile", "maximum")
    return both.select(*keys, "n", *[at(p).alias(name) for p, name in zip(q, names)])


def density(iterations: DataFrame, keys: Sequence[str], bins: int, low: float, high: float, value: str = VALUE) -> DataFrame:
    """Counts in equal bins between ``low`` and ``high`` per group, outliers in bins 0 and ``bins`` + 1 (M7)."""
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return iterations.groupBy(*keys, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def timeline(iterations: DataFrame) -> DataFrame:
    """Values in iteration order per method, job and launch (M8)."""
    return iterations.select(METHOD, JOB, LAUNCH, ITERATION, VALUE).orderBy(METHOD, JOB, LAUNCH, ITERATION)


def parse_report(lines: DataFrame, text: str = "value") -> DataFrame:
    """``|``-separated report lines as typed rows (M9).

    The columns are namespace, type, method, mean, error, standard deviation
    and allocation. Blank separator rows, the header and its rule are left
    out; ``NA`` gives null numbers.
    """
    cells = F.transform(F.split(F.trim(F.col(text)), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("_c", cells).filter((F.size("_c") >= 9) & (F.get("_c", F.lit(3)) != ""))
    rows = rows.filter((F.get("_c", F.lit(3)) != "Method") & ~F.get("_c", F.lit(3)).rlike("^[-:]+$"))

    def cell(i):
        return F.get("_c", F.lit(i))

    return rows.select(
        *[c for c in lines.columns if c != text],
        cell(1).alias("namespace"),
        cell(2).alias("type"),
        cell(3).alias("method"),
        nanoseconds(cell(4)).cast("double").alias("mean_ns"),
        nanoseconds(cell(5)).cast("double").alias("error_ns"),
        nanoseconds(cell(6)).cast("double").alias("stddev_ns"),
        size_bytes(cell(7)).cast("double").alias("allocated_bytes"),
    )


def compare_frameworks(means: DataFrame, method: str, framework: str, value: str, frameworks: Sequence[str]) -> DataFrame:
    """One row per method with a column per framework and its ratio to the best one.

    Beside a best value of zero the ratio is infinite, that of zero to itself NaN.
    """
    wide = means.groupBy(method).agg(
        *[F.min(F.when(F.col(framework) == f, F.col(value))).alias(f) for f in frameworks]
    )
    best = F.array_min(F.array(*[F.col(f) for f in frameworks]))
    ratios = [F.when(best == 0, F.col(f) * F.lit(float("inf"))).otherwise(F.col(f) / best).alias(f"{f}_ratio") for f in frameworks]
    return wide.select(method, *frameworks, *ratios)
