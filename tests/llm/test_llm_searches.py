"""Clustering, repeated substrings and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import LONG, nothing, odd  # noqa: F401

from tableloom.llm import centroids, ranked, substrings

VECTORS = "vec_id bigint, embedding array<double>, cluster string, v int, label int"


def plain_clusters(rows, k, rounds, dims=4):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centers = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, n) in zip(kept, assign(), strict=True):
            groups.setdefault(n, []).append(v)
        for n, g in groups.items():
            centers[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = assign()
    inertia = Counter()
    for d, n in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, found, strict=True))


@pytest.mark.parametrize("k", [1, 3, 7])
def test_clusters_against_all_distances(frame, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)] + [(3, rows[3][1]), (None, [0.5] * 4), (5, [0.1] * 4)]
    rows += [(2000, None), (2001, [1.0] * 3), (2002, [1.0] * 5), (2003, [1.0, None, 1.0, 1.0]), (2004, [1.0, math.nan, 0.0, 0.0]), (2005, [math.inf, 0.0, 0.0, 0.0]), (2006, [])]
    df = frame([(i, v, "c", 1, 2) for i, v in rows], VECTORS)
    got = centroids.cluster(df.repartition(5), k=k, rounds=3, dims=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain_clusters(rows, k, 3)


def test_clusters_of_few_and_of_no_vectors(frame):
    equal = [(i, [2.0] * 4) for i in range(20)]
    got = centroids.cluster(frame([(i, v, "c", 1, 2) for i, v in equal], VECTORS), k=16, dims=4).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    large = frame([(1, [1e300, -1e300, 0.0, 0.0], "c", 1, 2), (2, [0.0] * 4, "c", 1, 2)], VECTORS)
    assert sorted(r.distance for r in centroids.cluster(large, k=1, rounds=0, dims=4).collect()) == [0, 2 * centroids.LARGEST**2]
    empty = centroids.cluster(frame([], VECTORS), k=16, dims=4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(1)
    centers = rng.integers(-500, 500, (16, 64))
    vectors = centers[rng.integers(0, 16, 3000)] + rng.integers(-30, 30, (3000, 64))
    simplex = centroids.Simplex(centers, 12)
    assert np.allclose(np.linalg.norm(simplex.apexes(simplex.pivots)[:, None] - simplex.apexes(simplex.pivots)[None], axis=2) ** 2, centroids._squared(simplex.pivots, simplex.pivots))
    best, distance, compared = centroids.nearest(vectors, simplex.apexes(vectors), centers, simplex.apexes(centers))
    exact = centroids._squared(vectors, centers)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared < 3 * len(vectors)


def plain_removal(docs, n=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(df).collect())


@pytest.mark.parametrize("together", [400_000, 300])
def test_removal_against_all_windows(frame, monkeypatch, together):
    monkeypatch.setattr(substrings, "WORDS", together)
    rng = random.Random(7)

    def some(n, kinds=10**6):
        return [f"w{rng.randrange(kinds)}" for _ in range(n)]

    docs = []
    for n in (34, 35, 36, 37, 40, 48, 60, 90, 200, 700):
        passage = some(n)
        for k in range(2 + (n == 60) * 10):
            docs.append(some(rng.randrange(0, 40)) + passage + some(rng.randrange(0, 40)))
        docs.append(passage[:])
        docs.append(some(20) + passage[n // 4 : n - n // 5] + some(5))
    docs += [["a"] * n for n in (34, 35, 36, 100)] + [["a", "b"] * 30 + some(30), some(9) + ["a", "b"] * 20, ["x", "y", "z"] * 12, ["x", "y", "z"] * 12 + ["x"]]
    docs += [some(300, 2) for _ in range(4)] + [some(30) + ["a"] * 33 + some(3, 5), some(3, 5) + ["a"] * 40]
    base = some(900)
    for _ in range(6):
        copy = base[:]
        for _ in range(12):
            copy[rng.randrange(900)] = "edit"
        docs.append(copy)
    texts = [(k, "\t ".join(w)) for k, w in enumerate(docs)]
    texts += [texts[60], (texts[3][0], "another text"), (None, texts[12][1]), (9001, None), (9002, " \n"), (9003, texts[20][1].replace("w", "W"))]
    df = frame([(d, t, 1, 2) for d, t in texts], "doc_id bigint, text string, version int, at bigint")
    assert removed(df.repartition(3)) == plain_removal(texts)


def test_removal_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert removed(odd) == plain_removal(rows)
    assert substrings.remove(nothing).count() == 0
    assert [r.text for r in substrings.remove(odd.where("doc_id = 7"), with_text=True).collect()] == [" ".join(rows[-1][1].split(" ")).strip()]


def test_borders_depend_on_the_words_around_them():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    words[700:740] = words[700]

    def borders(w):
        low, _ = substrings.symbols(substrings.Names(w, substrings._BASES[0]), np.array([len(w)]), len(w))
        return set(low.tolist())

    whole = borders(words)
    for start in range(0, 4800, 37):
        part = borders(words[start : start + 120])
        inside = range(substrings.REACH, 120 - substrings.REACH + 1)
        assert {p for p in part if p in inside} == {p - start for p in whole if p - start in inside}
    sizes = np.diff(sorted(whole))
    assert 3.2 < sizes.mean() < 6


def plain_ranking(docs, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({c: chr(c + 32) for c in range(65, 91)})))

    rows = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for i, text in items:
        own = []
        for d, c, n in rows:
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                own.append((-score, d is None, d))
        out += [(str(i), rank, str(d), -s) for rank, (s, _, d) in enumerate(sorted(own, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


def searched(docs, items, **options):
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in ranked.search(docs, items, **options).collect())


ITEMS = [(1, "Alpha beta; GAMMA alpha"), (2, "Größe née beta"), (3, None), (4, "..."), (5, "common"), (None, "beta delta w7"), (1, "Alpha beta; GAMMA alpha"), (6, " ".join(f"w{k}" for k in range(80)))]


@pytest.mark.parametrize("rounds, shard, sent, at_a_time", [(ranked.ROUNDS, 20_000, 200_000, 500_000), ((0.2, 0.5), 40, 0, 20), ((), 1, 3, 500_000)])
def test_ranking_against_all_scores(frame, monkeypatch, rounds, shard, sent, at_a_time):
    monkeypatch.setattr(ranked, "SENT_TERMS", sent)
    monkeypatch.setattr(ranked, "SENT_ROWS", at_a_time)
    rng = random.Random(3)
    names = ["alpha", "beta", "gamma", "delta", "Größe", "née", "COMMON"] + [f"w{k}" for k in range(90)]
    docs = [(k, " ".join(["common", *rng.choices(names, k=rng.randrange(1, 60)), "filler" * (k % 3)])) for k in range(250)]
    docs += [(1000 + k, "alpha beta same tie") for k in range(15)] + [docs[4], (None, docs[7][1]), (7, "gamma-beta_alpha\x0bW3"), (2000, None), (2001, "!?"), (2002, "common " * 3000)]
    df = frame([(d, t, 1, 2, "s") for d, t in docs], "doc_id bigint, text string, row bigint, score int, item string")
    items = frame([(i, t, 1, "x") for i, t in ITEMS], "item_id bigint, text string, row int, term string")
    assert searched(df.repartition(3), items, k=10, rounds=rounds, shard=shard) == plain_ranking(docs, ITEMS, 10)


def test_reading_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    n, read = 5000, []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(len(range(*key.indices(len(self)))))
            return super().__getitem__(key)

    lists = []
    for t in range(6):
        rows = rng.permutation(n)[: 800 * (t + 1)]
        impacts = np.sort(rng.integers(1, 1000, len(rows)))[::-1] * (7 - t)
        impacts[:12] = 10_000 * (7 - t)
        rows = np.concatenate([np.arange(12), rows[rows >= 12]])[: len(impacts)]
        lists.append((rows, impacts[: len(rows)].view(Counted)))
    found, score = ranked.best_rows(lists, n, 10)
    every = np.zeros(n, dtype=np.int64)
    for rows, impacts in lists:
        every[rows] += np.asarray(impacts)
    assert set(found) == set(np.flatnonzero(every >= np.sort(every)[-10])) and (score == every[found]).all()
    assert sum(read) < sum(len(r) for r, _ in lists) / 2


def test_ranking_of_odd_and_no_rows(frame, odd, nothing):
    items = frame([(1, "same WORDS w5"), (2, "amp")], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert LONG in {t for _, t in rows}
    assert searched(odd, items) == plain_ranking(rows, [(1, "same WORDS w5"), (2, "amp")], 10)
    assert ranked.search(nothing, items).count() == 0 and ranked.search(odd, items.limit(0)).count() == 0
