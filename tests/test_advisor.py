import itertools
import random

import pytest
from pyspark.sql import functions as F

from tableloom.operators import advisor as A

SCHEMA = "workload int, query bigint, framework string, cost double, memory bigint, weight bigint"

# A worked instance: three queries, three frameworks, at most two of them, memory bound 200 000.
MEMORY = [(989, 3048, 819), (1169, 3472, 979), (40924, 144094, 175866)]
COSTS = [(30, 21, 21), (748, 745, 743), (182, 557, 2474)]
WEIGHTS = [1, 10_000_000, 1]


def worked(workload=1):
    return [
        (workload, q, f"f{f}", float(COSTS[q][f]), MEMORY[q][f], WEIGHTS[q]) for q in range(3) for f in range(3)
    ]


def brute(rows, most, bound):
    queries = sorted({r[1] for r in rows})
    options = [[r for r in rows if r[1] == q] for q in queries]
    best = None
    for pick in itertools.product(*options):
        if len({r[2] for r in pick}) <= most and (bound <= 0 or sum(r[4] for r in pick) <= bound):
            total = sum(r[3] * r[5] for r in pick)
            best = total if best is None or total < best else best
    return best


def test_worked_instance(frame):
    matrix = frame(worked(), SCHEMA)
    row = A.advise(matrix, ["f0", "f1", "f2"], 2, 200_000).collect()[0]
    assert (row["status"], float(row["objective"]), row["objective_floor"], row["memory"]) == (0, 7430000203.0, 7430000203, 42722)
    assert row["members"] == ["f0", "f2"]
    got = {r["query"]: r["framework"] for r in A.assignments(matrix, A.advise(matrix, ["f0", "f1", "f2"], 2, 200_000)).collect()}
    assert got == {0: "f2", 1: "f2", 2: "f0"}


def test_unneeded_frameworks_are_left_out(frame):
    rows = [(1, q, f, c, 1, 1) for q in range(3) for f, c in (("a", 1.0), ("b", 1.0), ("c", 2.0))]
    row = A.advise(frame(rows, SCHEMA), ["a", "b", "c"], 3, 0).collect()[0]
    assert row["members"] == ["a"] and float(row["objective"]) == 3.0


def test_infeasible_workloads_are_reported(frame):
    rows = worked(1) + [(2, 0, "f0", 1.0, 10**9, 1)] + [(3, 0, "f0", 1.0, 1, 1), (3, 1, "f1", 1.0, 1, 1)]
    got = {r["workload"]: r["status"] for r in A.advise(frame(rows, SCHEMA), ["f0", "f1", "f2"], 1, 300_000).collect()}
    # One framework: 1 fits with f0 or f2, 2 is too large, 3 has no common framework.
    assert got == {1: 0, 2: -1, 3: -1}


def check_against_brute(frame, rows, most, bound):
    names = sorted({r[2] for r in rows})
    matrix = frame(rows, SCHEMA)
    advice = A.advise(matrix, names, most, bound)
    found = {r["workload"]: r for r in advice.collect()}
    assigned = A.assignments(matrix, advice).join(matrix, ["workload", "query", "framework"])
    priced = {
        r["workload"]: r
        for r in assigned.groupBy("workload")
        .agg(F.sum(F.col("weight") * F.col("cost")).alias("cost"), F.sum("memory").alias("memory"), F.count(F.lit(1)).alias("n"), F.count_distinct("framework").alias("f"))
        .collect()
    }
    for w in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == w]
        best = brute(mine, most, bound)
        if best is None:
            assert found[w]["status"] == -1
            continue
        assert found[w]["status"] == 0 and float(found[w]["objective"]) == pytest.approx(best)
        p = priced[w]
        assert p["cost"] == pytest.approx(best) and p["n"] == len({r[1] for r in mine}) and p["f"] <= most
        assert bound <= 0 or p["memory"] <= bound


def test_against_enumeration(frame):
    rng = random.Random(11)
    rows = []
    for w in range(25):
        for q in range(4):
            weight = rng.randint(1, 3)
            for f in "abcd":
                if rng.random() < 0.85:
                    rows.append((w, q, f, float(rng.randint(1, 30)), rng.randint(1, 20), weight))
    check_against_brute(frame, rows, 2, 22)


def test_queries_with_equal_options_share_a_bound(frame):
    # Eight equal queries: some must take the dear but light framework.
    rows = [(1, q, f, c, m, 1) for q in range(8) for f, c, m in (("a", 1.0, 10), ("b", 3.0, 1))]
    check_against_brute(frame, rows, 2, 40)


def test_trade_offs(frame):
    matrix = frame(worked(), SCHEMA)
    got = {r["max_frameworks"]: float(r["objective"]) for r in A.trade_off(matrix, ["f0", "f1", "f2"], 3).collect()}
    assert got == {n: brute(worked(), n, 0) for n in (1, 2, 3)}
    grid = A.memory_trade_off(matrix, ["f0", "f1", "f2"], 2, [10, 50_000]).collect()
    assert {r["max_memory"]: r["status"] for r in grid} == {10: -1, 50_000: 0}


def test_weights_and_candidates(spark, frame):
    cost = frame([(1, 1, "a", 2.0, 5)], "workload int, query bigint, framework string, cost double, memory bigint")
    weights = frame([(1, 1, -4)], "workload int, query bigint, weight bigint")
    assert A.cost_matrix(cost, weights).collect()[0]["weight"] == 1
    df = frame([(["x", "b", "a", "b"],), ([],)], "r array<string>")
    got = [r[0] for r in df.select(A.candidates(F.col("r"), ["a", "c"], ["a", "b", "c"])).collect()]
    assert got == [["b", "a"], ["a", "c"]]
    assert frame([(0,), (-1,), (7,)], "m int").select(A.memory_bound(F.col("m"))).collect() == [(None,), (None,), (7,)]


def test_a_grid_of_bounds_reads_its_options_once(frame, monkeypatch):
    rows = [(w, q, f, c, m, 1) for w in (1, 2) for q in (1, 2) for f, c, m in (("a", 1, 4), ("b", 2, 1))]
    df = frame(rows, "workload int, query int, framework string, cost int, memory int, weight int")
    written = []
    monkeypatch.setattr(A, "materialise", lambda d, purpose: written.append(purpose) or d)
    grid = A.memory_trade_off(df, ["a", "b"], 2, [1, 2, 5, 8])
    assert written.count("options") == 1 and written.count("sums") == 1
    assert "FlatMapGroupsInPandas" not in grid._jdf.queryExecution().executedPlan().toString()
    got = {(r["workload"], r["max_memory"]): (r["status"], r["objective"]) for r in grid.collect()}
    want = {1: (-1, None), 2: (0, 4), 5: (0, 3), 8: (0, 2)}
    assert got == {(w, b): x for w in (1, 2) for b, x in want.items()}
