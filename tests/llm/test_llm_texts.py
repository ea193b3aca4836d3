"""Language, licenses, quality rules and main text of pages."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import nothing, odd  # noqa: F401

from tableloom.llm import htmltext, language, licenses, quality

EN = "the quick brown fox jumps over the lazy dog and the cat sat on the mat with them when it was there"
DE = "der schnelle braune fuchs springt über den faulen hund und die katze saß auf der matte als sie dort war"


def gram_counts(frame, texts):
    counts = Counter()
    for name, text in texts:
        counts.update((name, g) for g in language.grams(language.symbols(text)).astype(np.int64).tolist())
    return frame([(name, g, n) for (name, g), n in counts.items()], "language string, gram bigint, n bigint")


def test_probabilities_sum_to_one(frame, tmp_path):
    model = language.build(gram_counts(frame, [("en", EN), ("de", DE)]), str(tmp_path))
    letters = sorted(set(language.symbols(EN + " " + DE).tolist()))
    shift = np.uint64(language.BITS)
    for context in ([1, 1, ord("t")], [ord("t"), ord("h"), ord("e")], [5, 6, 7]):
        high = np.uint64(0)
        for c in context:
            high = high << shift | np.uint64(c)
        total = np.exp(model.log_probabilities((high << shift) | np.array(letters, dtype=np.uint64))).sum(axis=0)
        assert np.all(total <= 1.001) and np.all(total > 0.9)


def kneser_ney(text, order=4):
    """A plain model of one language: a function from a tuple of characters to its log probability, given the number of letters."""
    s = language.symbols(text).tolist()
    padded = [language.GAP] * (order - 2) + s
    tables = {order: Counter(tuple(padded[k : k + order]) for k in range(len(padded) - order + 1))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def p(gram, letters):
        if not gram:
            return 1 / letters
        table = tables[len(gram)]
        once, twice = (sum(n == x for n in table.values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        behind = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not behind:
            return p(gram[1:], letters)
        total = sum(behind.values())
        return max(behind.get(gram, 0) - d, 0) / total + d * len(behind) / total * p(gram[1:], letters)

    return p


@pytest.fixture
def small_parts(spark):
    """Exchanges keep all their partitions, so a model has several files."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_entropies_against_a_plain_model(frame, tmp_path, monkeypatch, small_parts):
    monkeypatch.setattr(language, "TOGETHER", 1)
    texts = {"en": EN * 2 + " some more of it", "de": DE, "el": "η γρήγορη αλεπού πηδάει"}
    model = language.build(gram_counts(frame, texts.items()), str(tmp_path))
    assert model.languages == sorted(texts) and sum(len(p) > 1 for p in model.grams) >= 2
    letters = len({c for t in texts.values() for c in language.symbols(t).tolist()}) + 1
    plain = [kneser_ney(texts[name]) for name in model.languages]
    tests = ["the fox and die katze", "αλεπού 漢字", None, "1 2", EN + DE]
    for text, got in zip(tests, model.entropies(tests), strict=True):
        s = language.symbols(text or "").tolist()
        if not s:
            assert got is None
            continue
        padded = [language.GAP] * 2 + s
        grams = [tuple(padded[k : k + 4]) for k in range(len(padded) - 3)]
        want = [-sum(np.log(p(g, letters)) for g in grams) / len(grams) for p in plain]
        assert np.allclose(got, want, rtol=1e-5)


def test_rare_language_keeps_all_its_grams(frame, small_parts):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3000)]
    docs = [(k, " ".join(rng.choice(words, 12)), "xx") for k in range(2000)] + [(5000 + k, t, "pl") for k, t in enumerate(["szybki brązowy lis przeskakuje", "nad leniwym psem i kotem"])]
    model = language.train(frame(docs, "doc_id bigint, text string, lang string"))
    assert model.languages == ["pl", "xx"] and sum(map(len, model.grams)) > 8
    got = language.predict(frame([(1, "szybki lis i kotem"), (2, words[0])], "doc_id bigint, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["pl", "xx"]


def test_languages_are_told_apart(frame, odd, nothing):
    docs = frame([(k, t, n, "s") for k, (t, n) in enumerate([(EN, "en"), (DE, "de")] * 5 + [("x", None), (None, "en")])], "doc_id bigint, text string, lang string, score string")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    tests = frame([(1, "the dog sat there"), (2, "die Katze springt über"), (3, "12 !"), (4, None), (5, ""), (6, "ЖЖЖ 漢字 " * 50)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language.predict(tests, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de")
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    assert got[6].rejected and not got[1].rejected and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(odd, model).count() == odd.count()
    assert language.train(nothing.selectExpr("doc_id", "text", "score AS lang")) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_counts_do_not_depend_on_the_batches(frame, monkeypatch):
    docs = frame([(k, EN if k % 2 else DE, "x") for k in range(6)], "doc_id bigint, text string, lang string")
    got = {r.gram: r.n for r in language.count(docs).collect()}
    want = Counter()
    for t in (EN, DE):
        for g in language.grams(language.symbols(t)).astype(np.int64).tolist():
            want[g] += 3
    assert got == want


def brute_statistics(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k : k + 8])].append(k)
    covered = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(8)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "\n", "é#", " |", "  ", "A B"]), max_size=60).map(" ".join))
def test_statistics_against_brute_force(text):
    assert quality._one(text)[:5] == brute_statistics(text)


def test_trees_learn_and_keep_their_directions():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.2 * rng.standard_normal(3000) < 0.5) & (x[:, 1] > 0.2)).astype(float)
    model = quality.fit(x, y, [-1, 1, 0], trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85  # the noise leaves about one in eight open
    grid = np.linspace(0, 1, 50)
    for f, sign in ((0, -1), (1, 1)):
        for _ in range(20):
            rows = np.repeat(rng.random((1, 3)), 50, axis=0)
            rows[:, f] = grid
            assert np.all(sign * np.diff(model.score(rows)) >= -1e-12)


def test_rules_on_odd_rows(frame, odd, nothing):
    labels = frame([], "doc_id bigint, quality int, toxic int")
    assert quality.train(odd, labels) is None
    rows = quality.score(odd, None).collect()
    assert len(rows) == odd.count()
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] is False and kept[2] is False
    assert quality.score(nothing, None).count() == 0
    long = next(r for r in rows if r.doc_id == 4)
    assert long.n_words == 30_000 and long.base_failed


def test_trees_from_labels(frame):
    good = [(k, f"plain words number {k} " + EN, 1) for k in range(60)]
    bad = [(k, "##### %%%% !!! " * 20 + f" {k}", 0) for k in range(100, 160)]
    docs = frame([(k, t) for k, t, _ in good + bad], "doc_id bigint, text string")
    labels = frame([(k, q, 0) for k, _, q in good + bad] + [(None, 1, 0), (5, None, 0), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    judged = {r.doc_id: r.kept for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all(judged[k] for k, _, _ in good) and not any(judged[k] for k, _, _ in bad)


INDEX = licenses.Index(licenses.TEMPLATES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("x Released under the MIT License. y", [("MIT", 1.0, "Released under the MIT License")]),
        ("Released, under the the MIT  license", [("MIT", 1.0, "Released, under the the MIT  license")]),
        ("All rights reserved. all RIGHTS reserved!", [("all-rights-reserved", 1.0, "All rights reserved"), ("all-rights-reserved", 1.0, "all RIGHTS reserved")]),
        ("é 🙂 Licensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", 1.0, "Licensed under CC BY-NC 4.0")]),
        ("the license of all rights", []),
        ("", []),
    ],
)
def test_license_spans(text, want):
    assert [(n, round(c, 2), text[a:b]) for n, c, _, a, b in licenses.matches(text, INDEX)] == want


def longest_common(a, b):
    """The longest common subsequence: no alignment matches more words."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b, 1):
            row[k] = last[k - 1] + 1 if x == y else max(row[k - 1], last[k])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31))
def test_alignment_of_edited_notices(seed):
    rng = np.random.default_rng(seed)
    words = licenses.TEMPLATES["GPL-3.0-notice"].split()
    words.pop(int(rng.integers(10, 30)))
    words[int(rng.integers(0, len(words)))] = "other"
    text = "before it " + " ".join(words) + " and after it"
    found = [m for m in licenses.matches(text, INDEX) if m[0] == "GPL-3.0-notice"]
    most = longest_common(INDEX.templates["GPL-3.0-notice"].tolist(), [INDEX.numbers.get(w, 0) for w in licenses.words_of(text)])
    assert len(found) == 1 and most - 2 <= found[0][2] <= most
    assert text[found[0][3] : found[0][4]] in " ".join(words)


def test_license_scan_of_odd_rows(frame, odd, nothing):
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0
    docs = frame([(None, "All rights reserved."), (1, "All rights reserved."), (1, "All rights reserved.")], "doc_id bigint, text string")
    assert sorted(((r.doc_id or 0, r.start, r.end) for r in licenses.scan(docs).collect())) == [(0, 0, 19), (1, 0, 19), (1, 0, 19)]


BODY = "A first paragraph of the article that is long enough to be text."
PAGES = [
    (None, []),
    ("", []),
    (f"<nav><a href=x>menu</a></nav><article><h1>Title &amp; more</h1><p>{BODY}<p>Short.</article><footer>foot</footer>", ["Title & more", BODY, "Short."]),
    (f"<body><div class='ad'>buy</div><main><p>{BODY}</p><div class='comments'><p>first!</p></div></main></body>", [BODY]),
    (f"<div id=sidebar>side</div><h2>Head</h2><p>{BODY}</p><p>{BODY} again</p><ul><li><a>one</a></li><li><a>two</a></li></ul>", ["Head", BODY, BODY + " again"]),
    (f"<article><p>a<br>b&nbsp; c</p><script>var x='<p>no</p>'</script><style>p{{}}</style><form>name</form><p>{BODY}</p></article>", ["a b c", BODY]),
    ("<article><table><tr><td>x<td>y<tr><td>z</table></article>", ["x y", "z"]),
    ("plain &lt;text&gt;", ["plain <text>"]),
    ("<p>broken <b>markup", ["broken markup"]),
]


def test_main_text(frame, nothing):
    for html, want in PAGES:
        assert htmltext.main_blocks(html) == want, html
    rows = frame([(k, h, "old", 5) for k, (h, _) in enumerate(PAGES)], "page_id bigint, html string, text string, _main int")
    got = {r.page_id: r.text for r in htmltext.extract(rows).collect()}
    assert got == {k: "\n".join(w) for k, (_, w) in enumerate(PAGES)}
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_no_page_is_lost_on_legal_markup():
    article = f"<article><p>{BODY}</p></article>"
    for html, want in (
        (f"<html><head><title>t</title><meta charset=utf-8><body><p>{BODY}</p></body>", [BODY]),
        (f"<head><title>t</title><style>p{{}}</style>{article}", [BODY]),
        (f"<head><title>t</title>{BODY}", [BODY]),
        (f"<head><noscript><p>no</p></noscript></head><p>{BODY}</p>", [BODY]),
        (f"<body><form action=x><div>{article}</div></form></body>", [BODY]),
        (f"<body><div><nav><a href=x>menu</a>{article}</div>", [BODY]),
        (f"<aside><article><p>other {BODY}</p></article></aside>{article}", [BODY]),
        (f"<article><p>{BODY}</p><aside><article>other</article></aside><p>end</p></article>", [BODY, "end"]),
        (f"<article><p>{BODY}</p><![x[ foo ]]><p>tail</p></article>", [BODY, "tail"]),
        (f"<article><p>{BODY}</p><![ x ]><p>tail</p></article>", [BODY, "tail"]),
        (f"<article><p>{BODY}</p><![CDATA[ foo ><p>tail</p></article>", [BODY, "tail"]),
    ):
        assert htmltext.main_blocks(html) == want, html


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div", " class=", "'ad'", ">", "<!--", "-->", "<![CDATA[", "]]>", "<article>", "</article>", "text ", "&am", "<script>", "</"]), max_size=30).map("".join))
def test_any_markup_is_survived(html):
    htmltext.main_blocks(html)


SENTENCE = "Some long sentence of the article that goes on and on with many words in it."


@pytest.mark.parametrize(
    "html, n",
    [
        ('<nav><a href=x>Menu</a></nav><article class="post hentry category-social tag-search"><p>%s</p></article>', 1),
        ('<div class="menu"><a>x</a></div><div class="layout no-sidebar"><p>%s</p><p>%s</p></div>', 2),
        ('<form id="aspnetForm"><div id="menu"><a>x</a></div><div><p>%s</p><p>%s</p></div></form>', 2),
        ("<article><p>%s</p><p>%s</p><article><p>Reply by a reader</p></article></article>", 2),
        ("<article><p>%s</p><p>%s</p><section><h3>3 Comments</h3><p>Nice one</p></section></article>", 2),
        ('<div class="comments"><p>%s</p></div>', 1),
        ("<article><article><p>%s</p></article></article>", 1),
        ('<form><input><p>Subscribe now</p></form><p>%s</p><div class="cookie-banner">We use cookies</div><div class="siteFooter">foot</div>', 1),
        ("<p>%s</p><p>%s</p><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>", 2),
    ],
)
def test_pages_whose_names_or_frames_mislead(html, n):
    assert htmltext.main_blocks("<html><body>" + html.replace("%s", SENTENCE) + "</body></html>") == [SENTENCE] * n


@pytest.mark.parametrize("token, want", [("no-sidebar", False), ("category-social", False), ("tag-search", False), ("has_ads", False), ("sidebar", True), ("site-footer", True), ("newsletterBox", True), ("comment-list", True), ("hentry", False), ("", False), ("shared-memory", False)])
def test_marks_of_class_names(token, want):
    assert htmltext.marks(token) is want


def test_very_long_page():
    html = "<html><body><nav>x</nav><article>" + "".join(f"<p>{SENTENCE} {k}</p>" for k in range(20_000)) + "</article></body></html>"
    assert htmltext.main_blocks(html) == [f"{SENTENCE} {k}" for k in range(20_000)]
    assert htmltext.main_blocks("<div>" * 3000 + SENTENCE) == [SENTENCE]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_whole_license_texts(name):
    text = "Copyright (c) 2020 Some One\n\n" + licenses.TEMPLATES[name].replace(". ", ".\n\n * ") + "\n\nint main() {}"
    found = licenses.matches(text, INDEX)
    assert [(n, c) for n, c, *_ in found] == [(name, 1.0)]
    n, _, words, a, b = found[0]
    assert words == len(INDEX.templates[name]) and licenses.words_of(text[a:b])[0] == licenses.words_of(licenses.TEMPLATES[name])[0]
    assert licenses.words_of(text[a:b])[-1] == licenses.words_of(licenses.TEMPLATES[name])[-1]


def test_opening_words_are_no_license():
    opening = " ".join(licenses.TEMPLATES["BSD-2-Clause"].split()[:20])
    assert licenses.matches(opening, INDEX) == [] and licenses.matches(" ".join(licenses.TEMPLATES["MIT-text"].split()[:60]), INDEX) == []


def whole_alignment(template, words):
    """Matched words of the best alignment without a band: plain cells."""
    last, best = [(0, 0)] * (len(words) + 1), (0, 0)
    for w in template.tolist():
        row = [(0, 0)]
        for k, x in enumerate(words, 1):
            points, matched = last[k - 1]
            diagonal = (points + licenses.MATCH, matched + 1) if x == w else (points + licenses.OTHER, matched)
            row.append(max(diagonal, (last[k][0] + licenses.GAP, last[k][1]), (row[k - 1][0] + licenses.GAP, row[k - 1][1]), (0, 0)))
        best = max(best, max(row))
        last = row
    return best[1]


def test_candidates_against_alignment_with_every_template():
    rng = np.random.default_rng(11)
    names = ["ISC", "MPL-2.0", "GPL-3.0-notice", "Zlib", "CC-BY-4.0", "0BSD"]
    for k in range(12):
        words = [w.decode() for w in licenses.words_of(licenses.TEMPLATES[names[k % 6]])]
        for at in rng.choice(len(words), len(words) // 9, replace=False):
            words[at] = ["other", "", "two words"][rng.integers(3)]
        text = "some words before " + " ".join(words) + " and after"
        numbers = [INDEX.numbers.get(w, 0) for w in licenses.words_of(text)]
        want = {n for n in names if whole_alignment(INDEX.templates[n], numbers) >= licenses.COVERAGE * len(INDEX.templates[n])}
        got = {m[0]: m for m in licenses.matches(text, INDEX)}
        assert names[k % 6] in want and set(got) <= want
        # What is left out lies under a match that covers the same words better.
        for n in want - set(got):
            share = whole_alignment(INDEX.templates[n], numbers) / len(INDEX.templates[n])
            assert any(m[1] >= share - licenses.NEARLY for m in got.values())


def test_very_long_text_with_a_license():
    text = "word " * 200_000 + licenses.TEMPLATES["ISC"] + " word" * 200_000
    assert [(n, c, a) for n, c, _, a, _ in licenses.matches(text, INDEX)] == [("ISC", 1.0, 1_000_000)]


def test_calibration_looks_at_every_labelled_text(frame):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(["und", "der", "das", "ein"] if k % 2 else ["the", "and", "of", "a"], 6)), "de" if k % 2 else "en") for k in range(2500)]
    # Hard texts that a bounded choice by the hash of the id may pass over: here all but 2,000 are.
    docs = frame(rows + [(9000 + k, "xq zv" + "jk" * k, "en") for k in range(6)], "doc_id bigint, text string, lang string")
    model = language.train(docs)
    e = np.array([x.min() for x in model.entropies([r["text"] for r in docs.collect()])])
    assert model.limit == pytest.approx(max(np.quantile(e, 1 - language.REJECTED) * 1.25, -0.9 * model.floor))
    for n in (1, 2, 3, 10, 1999, 2506):
        part = frame([(float(x),) for x in e[:n]], "e double").repartition(3)
        assert language._quantile(part, n, 0.999) == pytest.approx(np.quantile(e[:n], 0.999), abs=1e-12)
