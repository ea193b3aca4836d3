import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from llm_cases import nothing, odd  # noqa: F401

from tableloom.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def expected(docs, min_docs, keep_first):
    """The kept text of each row, row by row."""
    found = defaultdict(set)
    places = defaultdict(list)
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if key_of(line):
                found[key_of(line)].add(i)
                places[key_of(line)].append((i is not None, i or 0, t, p))
    out = []
    for i, t in docs:
        kept = []
        for p, line in enumerate((t or "").split("\n")):
            k = key_of(line)
            drop = k and len(found[k]) >= min_docs
            if drop and keep_first and places[k] and (i is not None, i or 0, p) == min((a, b, q) for a, b, _, q in places[k]):
                drop = False
            if not drop:
                kept.append(line)
        out.append((i, "\n".join(kept), len((t or "").split("\n"))))
    return sorted(out, key=str)


DOCS = [(i, f"Shared line\n own {i}\n\n shared LINE \nÉtÉ {i % 2}") for i in range(6)] + [(None, "shared line"), (9, None), (10, "")]


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_against_brute_force(spark, frame, keep_first):
    docs = frame(DOCS, "doc_id bigint, text string")
    got = lines.apply(docs, lines.find(docs, min_docs=3, keep_first=keep_first))
    rows = sorted(((r.doc_id, r.text or "", r.n_lines) for r in got.collect()), key=str)
    assert rows == expected(DOCS, 3, keep_first)
    dropped = {r.doc_id: r.n_dropped for r in got.collect()}
    assert dropped[3] == 3 and dropped[None] == (0 if keep_first else 1)


def test_hot_lines_take_the_same_decisions(spark, frame, monkeypatch):
    docs = frame(DOCS, "doc_id bigint, text string")
    plain = {str(r) for r in lines.apply(docs, lines.find(docs, 3, True)).collect()}
    monkeypatch.setattr(lines, "_hot", lambda rows: [])
    assert {str(r) for r in lines.apply(docs, lines.find(docs, 3, True)).collect()} == plain


def test_bitmaps_over_more_than_one_bucket(frame):
    text = "\n".join(["x" if k % 3 else f"line {k}" for k in range(70_000)])
    docs = frame([(1, text), (2, "x"), (3, "x\ny")], "doc_id bigint, text string")
    found = lines.find(docs, min_docs=3)
    row = {r.doc_id: r for r in found.collect()}
    assert sorted(row[1].keep) == [1, 2, 3] and row[1].n_lines == 70_000
    assert len(row[1].keep[1]) == 4096 and len(row[1].keep[3]) == (70_000 - 65_536 + 7) // 8
    kept = {r.doc_id: r.text for r in lines.apply(docs, found).collect()}
    assert kept == {1: "\n".join(f"line {k}" for k in range(0, 70_000, 3)), 2: "", 3: "y"}


def test_odd_rows_pass(odd, nothing):
    out = lines.apply(odd, lines.find(odd, min_docs=2))
    assert out.count() == odd.count() and {"version", "keep", "_keep"} <= set(out.columns)
    texts = [r.text for r in out.where("doc_id = 5").collect()]
    assert sorted(texts) == ["", "", "the same id with another text"]
    assert lines.apply(nothing, lines.find(nothing)).count() == 0


def test_plan_has_no_python(spark, frame):
    docs = frame(DOCS, "doc_id bigint, text string")
    out = lines.apply(docs, lines.find(docs)).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning(h1" in plan
    assert {r.h for r in out.where("doc_id = 10").collect()} == {hashlib.sha256(b"").hexdigest()}
