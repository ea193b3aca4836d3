"""Rows told apart by marked keys: the two halves are whole, and few rows without a marked key are met."""

from pyspark.sql import functions as F

from tableloom.operators import marks as M


def test_both_halves_are_whole_and_every_marked_key_is_met(frame):
    rows = frame([(k % 1000, f"v{k}", 0) for k in range(3000)] + [(None, "n", 0)] * 2, "k int, v string, _marks int")
    found = M.mark(rows.where("k < 50 OR k IS NULL").select(M.key_hash(["k"])))
    met, others = found.met(rows, ["k"]), found.others(rows, ["k"])
    assert met.columns == others.columns == rows.columns
    assert sorted(map(str, met.unionByName(others).collect())) == sorted(map(str, rows.collect()))
    assert others.where("k < 50 OR k IS NULL").count() == 0
    assert met.where("k >= 50").count() < 300


def test_no_marks(frame):
    rows = frame([(1, "a"), (None, "b")], "k int, v string")
    found = M.mark(rows.where(F.lit(False)).select(M.key_hash(["k"])))
    assert found.empty and found.met(rows, ["k"]).count() == 0 and found.others(rows, ["k"]).count() == 2
