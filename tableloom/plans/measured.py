"""Benchmark measurements, reports and the assignment advisor over data derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableloom.operators import advisor as A
from tableloom.operators import measurements as M
from tableloom.plans.registry import query
from tableloom.session import scratch_dir
from tableloom.sources import files

# --- iterations -----------------------------------------------------------

FRAMEWORKS = ["click", "error", "purchase", "signup", "view"]


def iterations(t):
    """Events as benchmark iterations: the kind is the method, the user gives job and launch."""
    return t("events").select(
        F.col("event_type").alias(M.METHOD),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("Job-"), (F.col("user_id") % 3).cast("string"))).alias(M.JOB),
        F.when(F.col("user_id") % 2 == 0, F.lit("n=1")).alias(M.PARAMS),
        F.when(F.col("value") < 1, "Warmup").otherwise("Result").alias(M.STAGE),
        (F.col("user_id") % 4).cast("int").alias(M.LAUNCH),
        F.col("event_id").alias(M.ITERATION),
        F.col("value").alias(M.VALUE),
    )


def labelled(t):
    return M.label_jobs(M.measured(iterations(t)))


ITER = """it AS (SELECT event_type AS method, CASE WHEN user_id % 3 > 0 THEN 'Job-' || (user_id % 3) ELSE '' END AS job,
                 CAST(user_id % 4 AS INTEGER) AS launch, event_id AS i, value AS v,
                 CASE WHEN user_id % 2 = 0 THEN 'n=1' ELSE '' END AS params
          FROM events WHERE value >= 1)"""


@query(
    "src6_measurement_file",
    """SELECT event_type AS "Target_Method", CASE WHEN user_id % 3 > 0 THEN 'Job-' || (user_id % 3) ELSE '' END AS "Job_Id",
              CASE WHEN user_id % 2 = 0 THEN 'n=1' ELSE '' END AS "Params",
              CASE WHEN value < 1 THEN 'Warmup' ELSE 'Result' END AS "Measurement_IterationStage",
              CAST(user_id % 4 AS INTEGER) AS "Measurement_LaunchIndex", event_id AS "Measurement_IterationIndex",
              value AS "Measurement_Value" FROM events""",
)
def src6(t):
    path = scratch_dir(t.spark, "measurements")
    iterations(t).write.option("sep", ";").option("header", "true").csv(path)
    read = files.read_measurements(t.spark, path)
    return read.withColumn(M.JOB, F.coalesce(M.JOB, F.lit(""))).withColumn(M.PARAMS, F.coalesce(M.PARAMS, F.lit("")))


@query("m1_measured_iterations", f"WITH {ITER} SELECT method, i, v FROM it")
def m1(t):
    return M.measured(iterations(t)).select(
        F.col(M.METHOD).alias("method"), F.col(M.ITERATION).cast("bigint").alias("i"), F.col(M.VALUE).alias("v")
    )


@query(
    "m2_job_labels",
    f"""WITH {ITER} SELECT 'some' AS kind, job, count(*) AS n FROM it GROUP BY job
        UNION ALL SELECT 'every', trim(job || ' n=1'), count(*) FROM it WHERE params <> '' GROUP BY job""",
    grouping=True,
)
def m2(t):
    some = labelled(t)
    every = M.label_jobs(M.measured(iterations(t)).filter(F.col(M.PARAMS).isNotNull()))

    def counted(df, kind):
        return df.groupBy(F.col(M.JOB).alias("job")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))

    return counted(some, "some").unionByName(counted(every, "every"))


@query(
    "m3_time_unit",
    f"""WITH {ITER}, m AS (SELECT min(v) AS lo FROM it)
        SELECT i, v * 1 / 1.0 AS raw, CASE WHEN lo > 1e9 THEN 'sec' WHEN lo > 1e6 THEN 'ms' WHEN lo > 1e3 THEN 'us' ELSE 'ns' END AS unit,
               (v * 1000000.0::DOUBLE + 2000000.0::DOUBLE) / 1000000.0::DOUBLE AS scaled, 'ms' AS big_unit FROM it, m""",
)
def m3(t):
    raw = M.choose_unit(labelled(t)).select(
        F.col(M.ITERATION).cast("bigint").alias("i"), F.col(M.VALUE).alias("raw"), "unit"
    )
    big = labelled(t).withColumn(M.VALUE, F.col(M.VALUE) * 1000000.0 + 2000000.0)
    scaled = M.choose_unit(big).select(
        F.col(M.ITERATION).cast("bigint").alias("i"), F.col(M.VALUE).alias("scaled"), F.col("unit").alias("big_unit")
    )
    return raw.join(scaled, "i")


@query(
    "m4_mean_and_error",
    f"""WITH {ITER} SELECT method, job, count(*) AS n,
              CAST(round(sum(CAST(v AS DECIMAL(18,2))) / count(*), 6) AS DOUBLE) AS mean,
              round(stddev_samp(v) / sqrt(count(*)), 6) AS standard_error FROM it GROUP BY method, job""",
    grouping=True,
)
def m4(t):
    found = M.mean_and_error(labelled(t))
    return found.select(
        F.col(M.METHOD).alias("method"),
        F.col(M.JOB).alias("job"),
        "n",
        F.round("mean", 6).alias("mean"),
        F.round("standard_error", 6).alias("standard_error"),
    )


@query(
    "m5_cumulative_mean",
    f"""WITH {ITER} SELECT i, CAST(sum(CAST(v AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w AS cumulative_mean FROM it
        WINDOW w AS (PARTITION BY method, job, launch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def m5(t):
    exact = labelled(t).withColumn(M.VALUE, F.col(M.VALUE).cast("decimal(18,2)"))
    # Blocks of 1000 iterations, so that the range totals are at work on the small tables too.
    return M.cumulative_mean(exact, block=1000).select(F.col(M.ITERATION).cast("bigint").alias("i"), "cumulative_mean")


@query(
    "m6_five_numbers",
    f"""WITH {ITER} SELECT method, job, count(*) AS n, min(v) AS minimum, round(quantile_cont(v, 0.25), 9) AS lower_quartile,
              round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.75), 9) AS upper_quartile, max(v) AS maximum
        FROM it GROUP BY method, job""",
    grouping=True,
)
def m6(t):
    found = M.five_numbers(labelled(t))
    inner = ("lower_quartile", "median", "upper_quartile")
    return found.select(
        F.col(M.METHOD).alias("method"), F.col(M.JOB).alias("job"), "n", "minimum", "maximum", *[F.round(c, 9).alias(c) for c in inner]
    )


@query(
    "m7_density_bins",
    f"""WITH {ITER} SELECT method, job, CASE WHEN v < 0 THEN 0 WHEN v >= 100 THEN 51 ELSE CAST(floor(50 * v / 100) AS BIGINT) + 1 END AS bin,
              count(*) AS count FROM it GROUP BY ALL""",
    grouping=True,
)
def m7(t):
    found = M.density(labelled(t), [M.METHOD, M.JOB], bins=50, low=0.0, high=100.0)
    return found.select(F.col(M.METHOD).alias("method"), F.col(M.JOB).alias("job"), F.col("bin").cast("bigint").alias("bin"), "count")


@query("m8_timeline", f"WITH {ITER} SELECT method, job, launch, i, v FROM it")
def m8(t):
    line = M.timeline(labelled(t))
    return line.select(
        F.col(M.METHOD).alias("method"),
        F.col(M.JOB).alias("job"),
        F.col(M.LAUNCH).alias("launch"),
        F.col(M.ITERATION).cast("bigint").alias("i"),
        F.col(M.VALUE).alias("v"),
    )


# --- reports --------------------------------------------------------------


@query(
    "m9_report_rows",
    """SELECT event_id, 'ns' || (user_id % 5) AS namespace, 'Type' || (user_id % 7) AS type, event_type AS method,
              CASE WHEN event_type = 'error' THEN -1 ELSE CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS DOUBLE) END AS mean_ns,
              CASE WHEN event_type = 'error' THEN -1 ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS error_ns,
              CASE WHEN event_type = 'error' THEN -1 ELSE 1500.0 END AS stddev_ns,
              CASE WHEN event_type = 'error' THEN -1 ELSE CAST(CAST(value AS DECIMAL(18,2)) * 1024 AS DOUBLE) END AS allocated_bytes
       FROM events WHERE event_type <> 'view'""",
)
def m9(t):
    amount = F.format_number(F.col("value").cast("decimal(18,2)"), 2)
    na = F.col("event_type") == "error"

    def cell(unit):
        return F.when(na, "NA").otherwise(F.concat_ws(" ", amount, F.lit(unit)))

    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.concat(F.lit("ns"), (F.col("user_id") % 5).cast("string")),
            F.concat(F.lit("Type"), (F.col("user_id") % 7).cast("string")),
            F.col("event_type"),
            cell("μs"),
            cell("ns"),
            F.when(na, "NA").otherwise("1,500.0 ns"),
            cell("KB"),
        ),
        F.lit(" |"),
    )
    # One kind of event stands for the blank separator rows of a report.
    text = F.when(F.col("event_type") == "view", "|  |  |  |  |  |  |  |").otherwise(line)
    rows = M.parse_report(t("events").select("event_id", text.alias("value")))
    numbers = ("mean_ns", "error_ns", "stddev_ns", "allocated_bytes")
    return rows.select("event_id", "namespace", "type", "method", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in numbers])


@query(
    "m10_frameworks_side_by_side",
    "WITH w AS (SELECT user_id, "
    + ", ".join(f"min(value) FILTER (WHERE event_type = '{f}') AS {f}" for f in FRAMEWORKS)
    + " FROM events GROUP BY user_id) SELECT user_id, "
    + ", ".join(f"coalesce({f}, -1) AS {f}, coalesce({f} / least({', '.join(FRAMEWORKS)}), -1) AS {f}_ratio" for f in FRAMEWORKS)
    + " FROM w",
    grouping=True,
)
def m10(t):
    wide = M.compare_frameworks(t("events"), "user_id", "event_type", "value", FRAMEWORKS)
    return wide.select("user_id", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in wide.columns if c != "user_id"])


# --- assignment advisor ---------------------------------------------------

MAX_MEMORY = 11
MAX_FRAMEWORKS = 2


def matrix(t):
    """Users as workloads, five queries each, event kinds as frameworks: mean value as cost, events as memory."""
    measured = (
        t("events")
        .groupBy(F.col("user_id").alias("workload"), (F.col("event_id") % 5).alias("query"), F.col("event_type").alias("framework"))
        .agg(
            F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 4).cast("decimal(18,4)").alias("cost"),
            F.count(F.lit(1)).alias("memory"),
        )
    )
    weights = (
        t("events")
        .groupBy(F.col("user_id").alias("workload"), (F.col("event_id") % 5).alias("query"))
        .agg((F.count(F.lit(1)) - 10).alias("weight"))
    )
    return A.cost_matrix(measured, weights)


MATRIX = """m AS (SELECT user_id AS workload, event_id % 5 AS query, event_type AS framework,
                  CAST(round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS DECIMAL(18,4)) AS cost, count(*) AS memory
           FROM events GROUP BY ALL),
      z AS (SELECT user_id AS workload, event_id % 5 AS query, greatest(count(*) - 10, 1) AS weight FROM events GROUP BY ALL),
      x AS (SELECT workload, query, framework, weight, cost, memory FROM m JOIN z USING (workload, query))"""

# Every subset of the five kinds with at most two, as a table of members.
SUBSETS = """s AS (SELECT a AS f1, b AS f2, CASE WHEN a = b THEN 1 ELSE 2 END AS size
                FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS u(a),
                     (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS v(b) WHERE a <= b),
       best AS (SELECT workload, query, any_value(weight) AS weight, f1, f2, size,
                       min(cost) FILTER (WHERE framework IN (f1, f2)) AS c FROM x, s GROUP BY workload, query, f1, f2, size),
       total AS (SELECT workload, f1, f2, size, sum(weight * c) AS total FROM best GROUP BY workload, f1, f2, size HAVING count(*) = count(c))"""


@query("a1a_cost_matrix", f"WITH {MATRIX} SELECT workload, query, framework, CAST(cost AS DOUBLE) AS cost, memory, weight FROM x")
def a1a(t):
    return matrix(t).withColumn("cost", F.col("cost").cast("double"))


@query(
    "a2a_candidate_frameworks",
    """SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS candidates
       FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')) GROUP BY user_id""",
    grouping=True,
)
def a2a(t):
    requested = t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("requested"))
    found = A.candidates(F.col("requested"), FRAMEWORKS, ["view", "purchase", "click"])
    return requested.select("user_id", F.concat_ws(",", found).alias("candidates")).filter(F.col("candidates") != "")


@query(
    "a3a_memory_bound",
    """SELECT user_id, CASE WHEN count(*) - 60 <= 0 THEN -1 ELSE count(*) - 60 END AS bound FROM events GROUP BY user_id""",
    grouping=True,
)
def a3a(t):
    rows = t("events").groupBy("user_id").agg((F.count(F.lit(1)) - 60).alias("requested"))
    return rows.select("user_id", F.coalesce(A.memory_bound(F.col("requested")), F.lit(-1)).alias("bound"))


@query(
    "a4a_best_assignment",
    f"""WITH {MATRIX}, {SUBSETS}
        SELECT workload, CAST(min(total) AS DOUBLE) AS objective FROM total GROUP BY workload""",
    grouping=True,
)
def a4a(t):
    return A.best_subsets(matrix(t), FRAMEWORKS, MAX_FRAMEWORKS).select("workload", F.col("objective").cast("double").alias("objective"))


# Every assignment of the five queries of a workload, by enumeration.
_BRUTE = f"""WITH {MATRIX}, w AS (SELECT DISTINCT workload FROM x),
       q AS (SELECT workload, count(DISTINCT query) AS n FROM x GROUP BY workload),
       p0 AS (SELECT * FROM x WHERE query = 0), p1 AS (SELECT * FROM x WHERE query = 1), p2 AS (SELECT * FROM x WHERE query = 2),
       p3 AS (SELECT * FROM x WHERE query = 3), p4 AS (SELECT * FROM x WHERE query = 4),
       e AS (SELECT w.workload,
                 coalesce(p0.weight * p0.cost, 0) + coalesce(p1.weight * p1.cost, 0) + coalesce(p2.weight * p2.cost, 0) + coalesce(p3.weight * p3.cost, 0) + coalesce(p4.weight * p4.cost, 0) AS total,
                 coalesce(p0.memory, 0) + coalesce(p1.memory, 0) + coalesce(p2.memory, 0) + coalesce(p3.memory, 0) + coalesce(p4.memory, 0) AS memory,
                 len(list_distinct([p0.framework, p1.framework, p2.framework, p3.framework, p4.framework])) AS size
             FROM w LEFT JOIN p0 USING (workload) LEFT JOIN p1 USING (workload) LEFT JOIN p2 USING (workload) LEFT JOIN p3 USING (workload) LEFT JOIN p4 USING (workload)),
       r AS (SELECT workload, min(total) AS total FROM e WHERE memory <= {MAX_MEMORY} AND size <= {MAX_FRAMEWORKS} GROUP BY workload)"""


@query(
    "a5a_memory_bounded_assignment",
    _BRUTE
    + """ SELECT w.workload, CASE WHEN total IS NULL THEN -1 ELSE 0 END AS status, CAST(coalesce(total, -1) AS DOUBLE) AS objective
          FROM w LEFT JOIN r USING (workload)""",
    grouping=True,
)
def a5a(t):
    found = A.advise(matrix(t), FRAMEWORKS, MAX_FRAMEWORKS, MAX_MEMORY)
    return found.select("workload", "status", F.coalesce(F.col("objective").cast("double"), F.lit(-1.0)).alias("objective"))


@query(
    "a6a_assignment_rows",
    f"""WITH {MATRIX}, {SUBSETS},
        o AS (SELECT workload, arg_min({{'f1': f1, 'f2': f2, 'total': total}}, lpad(CAST(total AS VARCHAR), 40, '0') || size || f1 || f2) AS o FROM total GROUP BY workload)
        SELECT x.workload, x.query, arg_min(x.framework, {{'c': x.cost, 'm': x.memory, 'f': x.framework}}) AS framework,
               any_value(CAST(floor(o.o.total) AS BIGINT)) AS objective_floor
        FROM x JOIN o USING (workload) WHERE x.framework IN (o.o.f1, o.o.f2) GROUP BY x.workload, x.query""",
)
def a6a(t):
    # No memory bound: every assignment comes from the subset totals.
    found = A.advise(matrix(t), FRAMEWORKS, MAX_FRAMEWORKS, 0)
    rows = A.assignments(matrix(t), found)
    return rows.join(found.select("workload", "objective_floor"), "workload").select("workload", "query", "framework", "objective_floor")


@query(
    "a6a_bounded_assignment_rows",
    _BRUTE
    + """ SELECT workload, CAST(total AS DOUBLE) AS objective, true AS within_bounds,
                 (SELECT count(DISTINCT query) FROM x WHERE x.workload = r.workload) AS queries FROM r""",
    grouping=True,
)
def a6a_bounded(t):
    # The assigned rows priced again: they must cost the objective and keep both limits.
    found = A.advise(matrix(t), FRAMEWORKS, MAX_FRAMEWORKS, MAX_MEMORY)
    rows = A.assignments(matrix(t), found).join(matrix(t), ["workload", "query", "framework"])
    return rows.groupBy("workload").agg(
        F.sum(F.col("weight") * F.col("cost")).cast("double").alias("objective"),
        ((F.sum("memory") <= MAX_MEMORY) & (F.count_distinct("framework") <= MAX_FRAMEWORKS)).alias("within_bounds"),
        F.count(F.lit(1)).alias("queries"),
    )


@query(
    "a7a_memory_grid",
    _BRUTE.rsplit(",\n       r AS", 1)[0]
    + f""", g AS (SELECT CAST(unnest([{MAX_MEMORY} // 2, {MAX_MEMORY}, {MAX_MEMORY} * 2]) AS BIGINT) AS max_memory),
       r AS (SELECT workload, max_memory, min(total) AS total FROM e, g WHERE memory <= max_memory AND size <= {MAX_FRAMEWORKS} GROUP BY workload, max_memory)
       SELECT w.workload, max_memory, CASE WHEN total IS NULL THEN -1 ELSE 0 END AS status, CAST(coalesce(total, -1) AS DOUBLE) AS objective
       FROM (SELECT * FROM w, g) w LEFT JOIN r USING (workload, max_memory)""",
    grouping=True,
)
def a7a_grid(t):
    """The best objective of every workload under three memory bounds."""
    found = A.memory_trade_off(matrix(t), FRAMEWORKS, MAX_FRAMEWORKS, [MAX_MEMORY // 2, MAX_MEMORY, MAX_MEMORY * 2])
    return found.select("workload", F.col("max_memory").cast("bigint").alias("max_memory"), "status", F.coalesce(F.col("objective").cast("double"), F.lit(-1.0)).alias("objective"))


@query(
    "a7a_trade_off",
    f"""WITH {MATRIX}, {SUBSETS}
        SELECT workload, n AS max_frameworks, CAST(min(total) AS DOUBLE) AS objective FROM total, (VALUES (1), (2)) AS g(n)
        WHERE size <= n GROUP BY workload, n""",
    grouping=True,
)
def a7a(t):
    return A.trade_off(matrix(t), FRAMEWORKS, MAX_FRAMEWORKS).withColumn("objective", F.col("objective").cast("double"))
