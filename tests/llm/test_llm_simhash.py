import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import nothing, odd  # noqa: F401

from tableloom.llm import components, simhash


def brute_print(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or [" ".join(w)]
    n = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def smallest(nodes, close):
    """The smallest node that each one reaches."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if close(a, b) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB éÉ\n\t\x0b", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_print(text)


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63 - 1, 60)
    near = values ^ (np.int64(1) << rng.integers(0, 63, 60)) ^ (np.int64(1) << rng.integers(0, 63, 60))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(values, near)], "a bigint, b bigint")
    for r in rows.select("a", "b", simhash.embedding(rows.a).alias("u"), simhash.embedding(rows.b).alias("v")).collect():
        counts = [[(x >> 2 * k & 1) + (x >> 2 * k + 1 & 1) for k in range(32)] for x in (r.a, r.b)]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert bin((r.u ^ r.v) & (1 << 64) - 1).count("1") == manhattan <= bin((r.a ^ r.b) & (1 << 64) - 1).count("1")


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    out = set()
    for center in rng.integers(-(2**62), 2**62, 6).tolist():
        for _ in range(n):
            x = center
            for b in rng.integers(0, 63, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_links_connect_all_close_pairs(spark, frame):
    for n, block in ((12, 50_000), (60, 50_000), (60, 16)):
        nodes = clusters(n, n)
        got = components.connected(simhash.links(frame([(x,) for x in nodes], "fp bigint"), radius=4, block=block))
        roots = {x: x for x in nodes} | {r.node: r.root for r in got.collect()}
        arr = np.array(nodes).view(np.uint64)
        near = {(a, b) for k, a in enumerate(nodes) for b in np.array(nodes)[np.bitwise_count(arr ^ arr[k]) <= 4].tolist()}
        parent = {x: x for x in nodes}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in near:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert roots == {x: find(x) for x in nodes}


def test_every_grid_finds_the_same(spark, frame):
    nodes = frame([(x,) for x in clusters(20, 7)], "fp bigint")
    results = []
    for agree in (1, 2, 3, 4):
        got = components.connected(simhash.links(nodes, radius=4, agree=agree))
        results.append(sorted((r.node, r.root) for r in got.collect()))
    assert results[0] and all(r == results[0] for r in results)


def test_components_of_chains_and_stars(spark, frame):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected(frame(edges, "a bigint, b bigint")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components.connected(frame([], "a bigint, b bigint")).count() == 0


def test_odd_rows_pass(odd, nothing):
    rows = simhash.components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.fp == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in rows if r.doc_id == 6} == {5}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.components(nothing).count() == 0
    assert len(simhash.representatives(simhash.components(odd)).collect()) == len({r.root for r in rows})


def test_cells_stay_whole_in_a_stream_of_batches():
    import numpy as np
    import pyarrow as pa

    from tableloom.llm import simhash

    rng = np.random.default_rng(2)
    cell = np.sort(rng.integers(0, 60, 3000))
    table = pa.table({"grid": np.zeros(3000, np.int32), "cell": cell, "pair": np.zeros(3000, np.int32), "fp": np.arange(3000)})
    parts = list(simhash._whole_cells(iter(table.to_batches(max_chunksize=70)), least=200))
    assert len(parts) > 5 and pa.concat_tables(parts).equals(table)
    seen = [set(p["cell"].to_pylist()) for p in parts]
    assert all(not a & b for k, a in enumerate(seen) for b in seen[:k])
    one = pa.table({"grid": [0] * 500, "cell": [7] * 500, "pair": [0] * 500, "fp": list(range(500))})
    assert [p.num_rows for p in simhash._whole_cells(iter(one.to_batches(max_chunksize=50)), least=100)] == [500]
    assert list(simhash._whole_cells(iter([]))) == []
