"""Decontamination, revisits, the named queries and the pipeline."""

from collections import Counter

import duckdb
import pytest
from check_queries import compare_frame
from llm_cases import DATA, nothing, odd  # noqa: F401

import corpus_pipeline
from tableloom.llm import decontaminate, queries, warc
from tableloom.plans.registry import SCHEMAS

ITEM = " ".join(f"item{k}" for k in range(60))


def grams(words, k=5):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, it in items:
            iw = (it or "").lower().split()
            want = Counter(grams(iw))
            k = min(5, len(iw))
            best = 0
            for s in range(max(1, len(w) - len(iw) + 1)) if iw else []:
                got = Counter(grams(w[s : s + len(iw)], k)) if len(w[s : s + len(iw)]) >= k else Counter()
                both = sum((got & want).values())
                best = max(best, both / (sum(got.values()) + sum(want.values()) - both)) if got else best
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def edited(n, at):
    words = ITEM.split()
    for k in at:
        words[k] = "changed"
    return " ".join(words[:n])


DOCS = [
    (1, "before " + ITEM + " after"),
    (2, ITEM.upper().replace(" ", " \n\t")),
    (3, "x " + edited(60, [30]) + " y"),
    (4, "x " + edited(60, [10, 25, 40]) + " y"),
    (5, "x " + " ".join(ITEM.split()[:30] + ["more"] + ITEM.split()[30:]) + " y"),
    (6, edited(52, [])),
    (7, None),
    (8, ""),
    (9, "short item here and nothing else"),
    (None, ITEM),
    (10, "la la la la la la la la la la"),
]
ITEMS = [(100, ITEM), (101, "Short ITEM here"), (102, None), (103, " "), (104, ITEM), (105, "la la la la la la la la")]


@pytest.mark.parametrize("rows", [400_000, 0])
def test_leaks_against_brute_force(frame, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)  # 0: the way without a broadcast
    docs = frame([(d, t, "1") for d, t in DOCS + [DOCS[0]]], "doc_id bigint, text string, item string")
    bench = frame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, region string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == brute_leaks(DOCS, ITEMS)
    assert {d for d, i in got if i == 100} == {1, 2, 3, 5, 6, None}


def test_leaks_with_a_run_of_words_put_in(frame):
    items, docs = [], []
    for k in range(30):
        words = [f"i{k}w{j}" for j in range(204)]
        passage = words[:12] + [f"new{k}x{j}" for j in range(18)] + words[12:186]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join(passage + [f"after{k}x{j}" for j in range(60)])))
    found = decontaminate.leaks(frame(docs, "doc_id bigint, text string"), frame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(30)]
    assert all(abs(r.similarity - 178 / 222) < 1e-9 for r in found)


def test_leaks_of_empty_tables(frame, odd, nothing):
    bench = frame(ITEMS, "item_id bigint, text string")
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd, bench).count() == 0


CAPTURES = "record_id bigint, url string, time bigint, full boolean, headers map<string,string>, range string"


def captures(frame, rows):
    spark = frame([(1,)], "x int").sparkSession
    return spark.createDataFrame([(*r, "clash") for r in rows], CAPTURES)


def test_revisits(frame):
    u = "http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top"
    rows = [
        (1, "https://example.com/a?a=1&b=2", 10, True, {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}),
        (2, u, 20, True, {"etag": 'W/"2"', "Last-Modified": "mon"}),
        (3, u, 20, True, {"etag": '"3"', "last-modified": "tue"}),
        (10, u, 20, None, {"etag": '"1"', "content-type": "none", "x": "new"}),
        (11, u, 21, False, {"ETag": 'W/"3"', "Content-Length": "0"}),
        (12, u, 21, False, {"etag": '"2"'}),
        (13, u, 5, False, {}),
        (14, u, 30, False, {"last-modified": "tue"}),
        (15, u, 30, False, {"last-modified": "wed"}),
        (16, u, 30, False, None),
        (17, None, 30, False, {}),
        (18, u, None, False, {}),
        (18, u, None, False, {}),
    ]
    got = {}
    for r in warc.resolve(captures(frame, rows)).collect():
        got.setdefault(r.record_id, []).append(r)
    assert len(got[18]) == 2
    found = {k: (v[0].response_id, v[0].outcome) for k, v in got.items()}
    assert found == {
        10: (1, warc.RESOLVED), 11: (3, warc.RESOLVED), 12: (None, warc.CHANGED_TAG), 13: (None, warc.MISSING), 14: (3, warc.RESOLVED),
        15: (None, warc.CHANGED_DATE), 16: (3, warc.UNCHECKED), 17: (None, warc.MISSING), 18: (None, warc.MISSING),
    }
    assert got[10][0].headers == {"etag": '"1"', "content-type": "text/html", "x": "new"}
    assert got[10][0].canonical_url == "example.com/a?a=1&b=2"
    assert warc.resolve(captures(frame, [])).count() == 0


def test_header_names_that_differ_in_case(frame):
    u = "http://a.example/"
    rows = [
        (1, u, 10, True, {"ETag": '"1"', "X-A": "b", "x-a": "c", "X-a": None}),
        (2, u, 20, False, {"ETag": '"1"', "Vary": "x", "vary": "y", "VARY": "z", "none": None}),
        (3, u, 30, False, {"ETag": '"1"', "etag": '"2"'}),
    ]
    got = {r.record_id: r for r in warc.resolve(captures(frame, rows)).collect()}
    assert got[2].response_id == 1 and got[2].headers == {"etag": '"1"', "x-a": "b, c", "vary": "z, x, y", "none": None}
    assert got[3].outcome == warc.CHANGED_TAG and got[3].headers == {"etag": '"1", "2"'}


def test_one_address_over_many_ranges(frame, spark):
    rows = [(k, "http://hot.example/x", k, k % 50 == 0, {"etag": f"{k // 50}"}) for k in range(2000)]
    got = warc.resolve(captures(frame, rows).repartition(8)).collect()
    assert len(got) == 1960 and all(r.response_id == r.record_id // 50 * 50 and r.outcome == warc.RESOLVED for r in got)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    class Case:
        sql = queries.SQL[name]

    ok, note = compare_frame(queries.QUERIES[name](spark, DATA), Case, con)
    assert ok, note


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_near_all_held_out_languages_are_found(spark):
    rows = queries.QUERIES["op4_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held_out = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held_out) > 30 and sum(held_out) > 0.95 * len(held_out)


def test_pipeline_against_its_rules(spark):
    """Each stage against a plain version over its own input."""
    from test_llm_lines import expected
    from test_llm_simhash import brute_print

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], DATA).cache())
    assert all(f.columns == columns for f in frames[:-1])
    before, judged, lined, single, clean = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(labels.get(d, 1) for d in judged) and sum(1 for d in before if labels.get(d) and d not in judged) <= 0.05 * len(before)

    want = {d: t for d, t, _ in expected(sorted(judged.items()), 10, True)}
    assert lined == {d: t for d, t in want.items() if t == judged[d] or t.strip()}

    prints = {d: brute_print(t, corpus_pipeline.NEAR_WORDS) for d, t in lined.items()}
    group = {d: d for d in lined}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= corpus_pipeline.NEAR_BITS:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert set(single) == {find(d) for d in lined}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute_leaks([(d, t) for d, t in single.items() if any(g in t.lower() for g in [" ".join(i[1].lower().split()[:3]) for i in items])], items)}
    assert leaking <= set(single) - set(clean)
    packed = frames[-1].toPandas()
    assert set(packed.doc_id) == set(clean) and packed.groupby("sequence_id").length.sum().max() <= corpus_pipeline.WINDOW
