import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.operators import measurements as M
from tableloom.operators import profiling as D
from tableloom.sources import files

SCHEMA = files.MEASUREMENT_SCHEMA


def test_jobs_keep_their_name_if_some_row_has_no_params(frame):
    df = frame([("m", None, None, "Result", 1, 1, 5.0), ("m", "J", "n=1", "Result", 1, 2, 6.0)], SCHEMA)
    assert [r[M.JOB] for r in M.label_jobs(df).orderBy(M.ITERATION).collect()] == ["", "J"]


def test_jobs_take_params_if_every_row_has_them(frame):
    df = frame([("m", None, "n=2", "Result", 1, 1, 5.0), ("m", "J", "n=1", "Result", 1, 2, 6.0)], SCHEMA)
    assert [r[M.JOB] for r in M.label_jobs(df).orderBy(M.ITERATION).collect()] == ["n=2", "J n=1"]


@pytest.mark.parametrize("low, unit, scaled", [(999.0, "ns", 999.0), (1000.0, "ns", 1000.0), (1500.0, "us", 1.5), (2.5e6, "ms", 2.5), (3e9, "sec", 3.0)])
def test_unit_ladder(frame, low, unit, scaled):
    df = frame([("m", "J", "", "Result", 1, 1, low), ("m", "J", "", "Result", 1, 2, low * 4)], SCHEMA)
    rows = M.choose_unit(df).orderBy(M.ITERATION).collect()
    assert {r["unit"] for r in rows} == {unit} and rows[0][M.VALUE] == pytest.approx(scaled)


def test_cumulative_mean_crosses_blocks(frame):
    values = [float(i * i % 17) for i in range(1, 101)]
    df = frame([("m", "J", "", "Result", launch, i, values[i - 1]) for launch in (1, 2) for i in range(1, 101)], SCHEMA)
    for block in (7, 1000):
        rows = M.cumulative_mean(df, block=block).filter(F.col(M.LAUNCH) == 2).orderBy(M.ITERATION).collect()
        want = np.cumsum(values) / np.arange(1, 101)
        assert [r["cumulative_mean"] for r in rows] == pytest.approx(list(want))


@pytest.mark.parametrize("kind", ["plain", "copies", "heavy tail", "one value", "tiny"])
def test_five_numbers_match_linear_quantiles(frame, kind):
    rng = random.Random(3)
    make = {
        "plain": lambda: [rng.uniform(0, 1000) for _ in range(501)],
        "copies": lambda: [float(rng.randint(0, 3)) for _ in range(400)],
        "heavy tail": lambda: [10 ** rng.uniform(0, 9) for _ in range(300)],
        "one value": lambda: [4.25] * 50,
        "tiny": lambda: [3.0, 1.0],
    }[kind]
    groups = {g: make() for g in ("a", "b")}
    df = frame([(g, "J", "", "Result", 1, i, v) for g, vs in groups.items() for i, v in enumerate(vs)], SCHEMA)
    for r in M.five_numbers(df, bins=16).collect():
        got = [r[c] for c in ("minimum", "lower_quartile", "median", "upper_quartile", "maximum")]
        assert got == pytest.approx(list(np.quantile(groups[r[M.METHOD]], [0, 0.25, 0.5, 0.75, 1])))
        assert r["n"] == len(groups[r[M.METHOD]])


def test_report_lines(frame):
    lines = [
        "| Namespace | Type | Method | Mean | Error | StdDev | Allocated |",
        "|---------- |----- |------- |-----:|------:|-------:|----------:|",
        "| ns.a | A | Q1 | 690.0 ns | 1.1 ns | 2.0 ns | 1104 B |",
        "| ns.a | B | Q1 | 15,994.2 μs | NA | NA | 10.5 KB |",
        "|  |  |  |  |  |  |  |",
        "| ns.a | C | Q2 | NA | NA | NA | NA |",
    ]
    rows = M.parse_report(frame([(x,) for x in lines], "value string")).orderBy("type").collect()
    assert [(r["type"], r["method"], r["mean_ns"], r["allocated_bytes"]) for r in rows] == [
        ("A", "Q1", 690.0, 1104.0), ("B", "Q1", 15994200.0, 10752.0), ("C", "Q2", None, None)
    ]


def test_frameworks_side_by_side(frame):
    df = frame([("Q1", "A", 2.0), ("Q1", "B", 3.0), ("Q2", "A", 5.0)], "m string, f string, v double")
    rows = {r["m"]: r for r in M.compare_frameworks(df, "m", "f", "v", ["A", "B"]).collect()}
    assert (rows["Q1"]["A_ratio"], rows["Q1"]["B_ratio"]) == (1.0, 1.5)
    assert rows["Q2"]["B"] is None and rows["Q2"]["A_ratio"] == 1.0


def test_profiles(spark, frame):
    df = frame([(1, "a"), (2, None), (2, "c")], "k int, s string")
    rows = {r["column_name"]: r for r in D.table_profile(df).collect()}
    assert (rows["s"]["nulls"], rows["s"]["lowest"], rows["s"]["highest"]) == (1, "a", "c")
    assert rows["k"]["distinct_values"] == 2
    assert D.estimated_rows(df) == 3
    assert {(r["row_count"], r["is_grouping"]) for r in D.output_profile(df, True).collect()} == {(3, True)}
    empty = D.output_profile(df.filter("k > 9"), exact=True).collect()
    assert {r["row_count"] for r in empty} == {1}


def test_synthetic_rows_differ_only_when_asked(spark):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("a int, b boolean, c date, d string, e binary, f decimal(10,2), g timestamp_ntz, h tinyint")
    assert D.synthetic_table(spark, schema, 40).distinct().count() == 1
    rows = D.synthetic_table(spark, schema, 300, distinct=True)
    assert rows.select("a").distinct().count() == 300 and rows.select("d").distinct().count() == 300
    assert rows.schema.simpleString() == schema.simpleString()


def test_delimited_files_keep_quotes_and_line_breaks(spark, frame, tmp_path):
    df = frame([(1, 'say "hi"\nand, bye'), (2, "plain"), (3, None)], "k int, v string")
    files.export_delimited(df, str(tmp_path / "x"))
    back = files.declared_nulls(files.read_delimited(spark, str(tmp_path / "x"), df.schema))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_measurement_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "Target_Method;Job_Id;Params;Measurement_IterationStage;Measurement_LaunchIndex;Measurement_IterationIndex;Measurement_Value\n"
        "A1;;;Pilot;1;1;100.5\nA1;Dry;n=1;Result;1;2;200.25\n"
    )
    rows = M.measured(files.read_measurements(spark, str(tmp_path / "m.csv"))).collect()
    assert [tuple(r) for r in rows] == [("A1", "Dry", "n=1", "Result", 1, 2, 200.25)]


def test_ratio_to_a_best_value_of_zero(frame):
    df = frame([("m", "A", 0.0), ("m", "B", 5.0), ("k", "A", 2.0), ("k", "B", 5.0), ("one", "A", 0.0)], "m string, f string, v double")
    rows = {r["m"]: r for r in M.compare_frameworks(df, "m", "f", "v", ["A", "B"]).collect()}
    assert math.isnan(rows["m"]["A_ratio"]) and rows["m"]["B_ratio"] == math.inf
    assert (rows["k"]["A_ratio"], rows["k"]["B_ratio"]) == (1.0, 2.5)
    assert math.isnan(rows["one"]["A_ratio"]) and rows["one"]["B_ratio"] is None


def test_delimited_files_are_gzip(frame, tmp_path):
    files.export_delimited(frame([(1, "a")], "k int, v string"), str(tmp_path / "x"))
    assert list((tmp_path / "x").glob("*.csv.gz")) and not list((tmp_path / "x").glob("*.csv"))
