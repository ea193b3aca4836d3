"""Deep pages, differences by digests, streamed pairs, profiles that merge and pruned text search."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableloom.functions.canonical import row_hash
from tableloom.operators import digests, paging, sketches
from tableloom.operators.equivalence import keyed_difference
from tableloom.plans import structures
from tableloom.sources import textindex
from tableloom.streaming import pairs as SP


def numbers(frame, n, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, 1.0, 2.0, 3.0, float(k)]), f"t{k % 7}") for k in range(n)]
    return rows, frame(rows, "k bigint, x double, t string").repartition(5)


@pytest.mark.parametrize("order", [("k",), (("x", "desc"), "k"), ("t", ("x", "asc"), ("k", "desc"))])
def test_pages_of_any_depth(frame, order):
    rows, df = numbers(frame, 700)
    pages = paging.paged(df, *order, ranges=9)
    whole = [tuple(r) for r in df.orderBy(*paging.order_terms(order)).collect()]
    assert len(pages) == 700 and len(pages.counts) > 4
    for skip, take in [(0, 10), (345, 20), (690, 50), (699, 1), (700, 5), (0, 700), (10, 0), *paging.fill(pages, 250)]:
        assert [tuple(r) for r in pages.page(skip, take).collect()] == whole[skip : skip + take], (skip, take)


def test_a_page_reads_its_ranges_only(frame):
    _, df = numbers(frame, 900)
    pages = paging.paged(df, "k", ranges=9)
    page = pages.page(450, 20)
    wanted, before = pages.ranges(450, 20)
    assert 1 <= len(wanted) <= 2 and 0 <= before < max(n for _, n in pages.counts)
    assert all(any(f"_range={r}" in f for r in wanted) for f in page.inputFiles()) or len(page.inputFiles()) >= len(pages.counts)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pages_of_no_rows(frame):
    pages = paging.paged(frame([], "k bigint"), "k")
    assert len(pages) == 0 and pages.page(0, 10).collect() == []


def changed(frame, n=2000):
    left = [(k, f"v{k}", float(k)) for k in range(n)]
    right = [(k, "other" if k in (5, 1500) else v, x) for k, v, x in left if k != 77] + [(9999, "new", None), (300, "v300", 300.0)]
    schema = "k bigint, v string, x double"
    return frame(left, schema).repartition(4), frame(right, schema).repartition(3)


@pytest.mark.parametrize("buckets, finer", [(1, 1), (64, 16), (1024, 64)])
def test_digests_find_the_differences_of_a_full_comparison(frame, buckets, finer):
    left, right = changed(frame)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(digests.difference(left, right, ["k"], buckets, finer)) == rows(keyed_difference(left, right, ["k"]))
    assert rows(digests.difference(left, left, ["k"], buckets, finer)) == []


def test_rows_that_travel_follow_the_differing_buckets(frame):
    left, right = changed(frame)
    both = digests.suspects(left, right, ["k"], 256, 64)
    assert sum(df.count() for df in both) <= 2 * 5 * 3
    none = digests.suspects(left, left, ["k"], 256, 64)
    assert sum(df.count() for df in none) == 0


def test_equal_copies_do_not_cancel(frame):
    a = frame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    b = frame([(1, "c"), (1, "c"), (2, "b")], "k int, v string")
    assert {r["k"] for r in digests.difference(a, b, ["k"]).collect()} == {1}
    assert a.select(row_hash(a).alias("h")).distinct().count() == 2


def test_keys_of_other_types_meet(frame):
    a, b = frame([(1, "a"), (2, "b")], "k int, v string"), frame([(1, "a"), (2, "c")], "k bigint, v string")
    assert [(r["k"], r["kind"]) for r in digests.difference(a, b, ["k"]).collect()] == [(2, "changed")]


def at(day, hour=0):
    return dt.datetime(2020, 1, day, hour)


def streamed(spark, folder, batches, schema):
    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{n}")
        os.utime(f"{folder}/f{n}", (1e9 + n, 1e9 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


HEAD, LINE = "h bigint, ht timestamp_ntz", "l bigint, n int, lt timestamp_ntz"


def test_pairs_arrive_with_their_later_change(spark, tmp_path):
    heads = streamed(spark, str(tmp_path / "h"), [[(1, at(1)), (2, at(2))], [(3, at(4)), (1, at(6))]], HEAD)
    lines = streamed(spark, str(tmp_path / "l"), [[(1, 1, at(2)), (3, 1, at(3))], [(2, 1, at(9)), (1, 2, at(5))]], LINE)
    week = dt.timedelta(days=7)
    pairs = SP.stream_pairs(heads, lines, ("h", "l"), ("ht", "lt"), week, week, at(2), at(8))
    SP.write_pairs(pairs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r["h"], r["ht"].day, r["n"], r["lt"].day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # Head 1 changed twice, so its lines pair with both versions; the pair of days 1 and 2 is not after the cut-off.
    assert got == [(1, 1, 2, 5), (1, 6, 1, 2), (1, 6, 2, 5), (3, 4, 1, 3)]


def test_state_of_pairs_expires(spark, tmp_path):
    days = [[(k, at(1))] for k in range(3)] + [[(9, at(25))]] + [[(10, at(28))]]
    heads = streamed(spark, str(tmp_path / "h"), days, HEAD)
    lines = streamed(spark, str(tmp_path / "l"), [[(k, 1, at(1, 5))] for k in range(3)] + [[(9, 1, at(25))]] + [[(10, 1, at(28))]], LINE)
    day = dt.timedelta(days=1)
    query = SP.write_pairs(SP.stream_pairs(heads, lines, ("h", "l"), ("ht", "lt"), day, day), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 6 and kept[-1] <= 4


def test_merged_profiles_are_those_of_the_whole(frame):
    rng = random.Random(4)
    rows = [(k % 9, rng.gauss(50, 10), f"u{rng.randrange(500)}", at(1 + k % 28, k % 24)) for k in range(6000)] + [(None, None, None, None)] * 30
    df = frame(rows, "part int, x double, u string, t timestamp_ntz").repartition(4)
    parts = sketches.profile_parts(df, F.coalesce("part", F.lit(-1)))
    assert parts.select("part").distinct().count() == 10
    merged = {r["column_name"]: r for r in sketches.estimates(sketches.merge_parts(parts)).collect()}
    xs = sorted(r[1] for r in rows if r[1] is not None)
    assert merged["x"]["rows"] == 6030 and merged["x"]["nulls"] == 30 and merged["x"]["lowest"] == xs[0]
    assert abs(merged["u"]["distinct_values"] - 500) < 15 and merged["u"]["quantiles"] is None
    for q, r in zip(merged["x"]["quantiles"], (0.25, 0.5, 0.75), strict=True):
        assert abs(sum(v <= q for v in xs) / len(xs) - r) < 0.015
    profile = sketches.merge_parts(parts)
    assert abs(sketches.estimated_groups(profile, "part").first()[0] - 10) <= 1
    low, high = 45.0, 60.0
    assert abs(sketches.estimated_range(profile, "x", low, high).first()[0] - sum(low < v <= high for v in xs)) < 100
    assert sketches.estimated_range(profile, "x").first()[0] == 6000


def test_made_rows_follow_the_profile(spark, frame):
    rng = random.Random(6)
    rows = [(int(rng.expovariate(0.1)), at(1 + rng.randrange(28), rng.randrange(8, 18)), "s" if k % 4 else None) for k in range(4000)]
    df = frame(rows, "n int, t timestamp_ntz, s string")
    made = sketches.synthetic_like(spark, sketches.merge_parts(sketches.profile_parts(df, F.lit(1))), 4000)
    assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in df.schema]
    got = made.collect()
    for k in (0.1, 0.5, 0.9):
        q = sorted(r[0] for r in rows)[int(4000 * k)]
        assert abs(sum(r["n"] <= q for r in got) - sum(r[0] <= q for r in rows)) < 200
    assert 800 < sum(r["s"] is None for r in got) < 1200 and len({r["t"].time() for r in got}) > 100
    assert sketches.merge_parts(sketches.profile_parts(df.limit(0), F.lit(1))).count() == 0


def test_text_search_opens_the_files_that_can_match(spark, frame, tmp_path):
    rows = [(k, f"common words and item{k // 10}x of file") for k in range(400)] + [(400, None), (401, ""), (402, "ab"), (403, "Größe É 🙂 MiXed")]
    path = str(tmp_path / "texts")
    frame(rows, "id bigint, text string").repartitionByRange(20, "id").write.parquet(path)
    index = textindex.write_index(textindex.index_text(spark, path, "text"), str(tmp_path / "index"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(index.search("item25x")) == list(range(250, 260)) and len(index.files("item25x")) <= 3
    assert ids(index.search("common")) == list(range(400)) and len(index.files("common")) == 20
    assert ids(index.search("ab")) == [402] and index.files("ab") is None
    assert ids(index.search("nowhere at all")) == [] and index.files("nowhere at all") == []
    assert ids(index.search("mixed")) == [] and ids(index.search("mixed", ignore_case=True)) == [403]
    assert ids(index.search("Größe É 🙂")) == [403]


class Made:
    """Tables made in the test, by name."""

    def __init__(self, spark, **frames):
        self.spark, self.frames = spark, frames

    def __call__(self, name):
        return self.frames[name]


def test_stream_files_are_written_by_tasks_of_bounded_size(spark, frame):
    t = Made(spark, events=frame([(k,) for k in range(2000)], "event_id bigint"))
    for stream, batches in ((structures._event_stream(t, rows=50), 4), (structures._files_as_stream(t, "events", "event_id", rows=50), 3)):
        seen = []

        def keep(batch, n, seen=seen):
            sizes = batch.groupBy("file").count().collect()
            seen.append((len(sizes), max(r["count"] for r in sizes), sum(r["count"] for r in sizes)))

        stream.withColumn("file", F.col("_metadata.file_path")).writeStream.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        assert len(seen) <= batches and sum(n for _, _, n in seen) == 2000 and max(n for _, n, _ in seen) < 250


def test_trigrams_are_marked_without_a_row_for_each(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "_TOGETHER", 5)
    texts = ["abcdef", None, "", "gh", "iÄj", "xyzxyz"]
    path = str(tmp_path / "texts")
    frame(list(enumerate(texts)), "id int, text string").coalesce(1).write.parquet(path)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 6), pa.array([t and t.lower().encode() for t in texts], pa.binary())], names=["file", "text"])
    marked = list(textindex._marks([batch.slice(0, 2), batch.slice(2)], 1 << 18))
    want = {t.lower().encode()[k : k + 3] for t in texts if t for k in range(len(t.lower().encode()) - 2)}
    bits = np.unpackbits(np.frombuffer(b"".join(b for m in marked for b in m.column(2).to_pylist()), np.uint8), bitorder="little")
    assert bits.sum() == len({p for w in want for p in textindex._places(textindex._numbers(np.frombuffer(w, np.uint8)), 1 << 18).tolist()})
    index = textindex.index_text(spark, path, "text")
    assert "Generate" not in index.filters._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in index.search("IÄ", ignore_case=True).collect()] == [4] and index.files("efg") == []
