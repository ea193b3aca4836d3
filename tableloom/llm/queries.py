"""The named queries of this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm import centroids, decontaminate, htmltext, language, licenses, lines, packing, quality, ranked, simhash, substrings, tokenfiles, warc
from tableloom.plans.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op9_html_main_text")
def op9(t: Tables) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(t("pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


@query("op7_quality_rules")
def op7(t: Tables) -> DataFrame:
    """The statistics of every document and whether the rules keep it."""
    docs = t("documents").select("doc_id", "text")
    judged = quality.score(docs, quality.train(docs, t("labels")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


@query(
    "op3_line_dedup",
    r"""
    WITH line AS (
        SELECT doc_id, p AS pos, s[p] AS line,
            translate(trim(s[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS p
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
    gone AS (SELECT k FROM line WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
    SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
        sha256(coalesce(string_agg(CASE WHEN g.k IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
    FROM line l LEFT JOIN gone g ON l.k = g.k
    GROUP BY l.doc_id
    """,
)
def op3(t: Tables) -> DataFrame:
    """What every document keeps when lines of ten or more documents go."""
    docs = t("documents").select("doc_id", "text")
    kept = lines.apply(docs, lines.find(docs, min_docs=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op5_simhash_near_dedup")
def op5(t: Tables) -> DataFrame:
    """The fingerprint and the component of every document."""
    found = simhash.components(t("documents"), radius=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_sequence_packing")
def op10(t: Tables) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 ids."""
    return packing.pack(t("documents"), window=1024)


@query("op1_token_files")
def op1(t: Tables) -> DataFrame:
    """Every document as read back from token files."""
    return tokenfiles.round_trip(t("documents"))


@query("op6_benchmark_decontamination")
def op6(t: Tables) -> DataFrame:
    """Every document and benchmark item that it holds a passage of."""
    found = decontaminate.leaks(t("documents"), t("benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


@query("op4_language_id")
def op4(t: Tables) -> DataFrame:
    """The language of every document; one third of the documents, by the checksum of the id, is held out."""
    docs = t("documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.train(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op2_license_scan")
def op2(t: Tables) -> DataFrame:
    """Every license text in every document, with its coverage and span."""
    return licenses.scan(t("documents"))


@query(
    "op8_warc_revisits",
    r"""
    WITH parts AS (
        SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS plain FROM pages),
    cut AS (
        SELECT page_id, html, regexp_extract(plain, '^([^?]*)', 1) AS place,
            list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)'))) AS query
        FROM parts),
    page AS (
        SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(place, '^(?:[^/@]*@)?([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '')
            || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS u,
            '"' || md5(html) || '"' AS tag, 'day ' || CAST(CAST(floor(page_id / 100) AS BIGINT) AS VARCHAR) AS day
        FROM cut),
    again AS (
        SELECT page_id * 2 + 1 AS record_id, u, day,
            CASE WHEN page_id % 17 = 0 THEN page_id - 1000000000 ELSE page_id + 5000 END AS t,
            CASE WHEN page_id % 13 <> 0 AND page_id % 19 <> 0 THEN CASE WHEN page_id % 11 = 0 THEN '"other"' ELSE tag END END AS tag,
            page_id % 7 = 0 AND page_id % 11 <> 0 AS weak, page_id % 19 <> 0 AS dated
        FROM page),
    best AS (
        SELECT a.record_id, max(p.page_id) AS page_id FROM again a LEFT JOIN page p ON p.u = a.u AND p.page_id < a.t AND p.html IS NOT NULL
        GROUP BY a.record_id),
    known AS (
        SELECT a.*, b.page_id AS found,
            CASE WHEN b.page_id IS NULL THEN 'no_earlier_response'
                WHEN a.tag IS NOT NULL THEN CASE WHEN a.tag = p.tag THEN 'resolved' ELSE 'etag_differs' END
                WHEN a.dated THEN CASE WHEN a.day = p.day THEN 'resolved' ELSE 'last_modified_differs' END
                ELSE 'resolved_without_validator' END AS outcome, p.tag AS stored_tag, p.day AS stored_day, octet_length(encode(p.html)) AS size
        FROM again a JOIN best b ON a.record_id = b.record_id LEFT JOIN page p ON p.page_id = b.page_id)
    SELECT record_id, u AS canonical_url, CASE WHEN outcome LIKE 'resolved%' THEN found * 2 END AS response_id, outcome,
        CASE WHEN outcome LIKE 'resolved%' THEN
            'cache-control: max-age=600' || chr(10) || 'content-length: ' || CAST(size AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10)
            || 'etag: ' || CASE WHEN tag IS NULL THEN stored_tag WHEN weak THEN 'W/' || tag ELSE tag END || chr(10)
            || 'last-modified: ' || CASE WHEN dated THEN day ELSE stored_day END
        ELSE
            'cache-control: max-age=600' || chr(10) || 'content-length: 0'
            || CASE WHEN tag IS NOT NULL THEN chr(10) || 'etag: ' || CASE WHEN weak THEN 'W/' ELSE '' END || tag ELSE '' END
            || CASE WHEN dated THEN chr(10) || 'last-modified: ' || day ELSE '' END
        END AS headers
    FROM known
    """,
)
def op8(t: Tables) -> DataFrame:
    """The revisits of every page with the response they confirm and the headers that hold after them."""
    found = warc.resolve(warc.captures_of(t("pages"))).where(F.col("record_id") % 2 == 1)
    lines_of = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines_of, "\n"))


def _cluster_sql() -> str:
    """Three rounds and the last assignment, one after the other."""
    steps = [
        r"""kept AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (
        SELECT row_number() OVER (ORDER BY digest, v) - 1 AS cluster, v AS c
        FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS digest, v FROM kept ORDER BY ALL LIMIT 16))"""
    ]
    for k in range(4):
        steps.append(f"""a{k} AS (
        SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(({{'distance': distance, 'cluster': cluster}})) AS best
        FROM (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
              FROM kept, c{k}) GROUP BY r)""")
        if k < 3:
            steps.append(f"""m{k} AS (
        SELECT cluster, list(m ORDER BY p) AS c
        FROM (SELECT best.cluster AS cluster, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
              FROM (SELECT best, unnest(v) AS x, unnest(generate_series(1, 64)) AS p FROM a{k}) GROUP BY ALL) GROUP BY cluster),
    c{k + 1} AS (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return "WITH " + ",\n    ".join(steps) + """
    SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
        CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a3 JOIN c3 ON best.cluster = c3.cluster
    """


@query("op11_centroid_clustering", _cluster_sql())
def op11(t: Tables) -> DataFrame:
    """The cluster of every vector of 64 finite components, after three rounds from 16 first centroids."""
    return centroids.cluster(t("embeddings"), k=16, rounds=3)


@query(
    "op12_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (
        SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35)),
    rep AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
    word AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM w)),
    judged AS (
        SELECT word.doc_id, p, word, max(i) OVER (PARTITION BY word.doc_id ORDER BY p) AS last
        FROM word LEFT JOIN rep ON word.doc_id = rep.doc_id AND p = i),
    kept AS (
        SELECT doc_id, count(*) FILTER (WHERE last >= p - 34) AS n_removed, string_agg(CASE WHEN last >= p - 34 THEN NULL ELSE word END, ' ' ORDER BY p) AS kept
        FROM judged GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
)
def op12(t: Tables) -> DataFrame:
    """What every document keeps when words in repeated windows of 35 words go."""
    return substrings.remove(t("documents"))


@query(
    "op13_ranked_search",
    r"""
    WITH tok AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents WHERE text IS NOT NULL),
    size AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM tok WHERE len(w) > 0),
    q AS (
        SELECT DISTINCT item_id,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark),
    tf AS (
        SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tok)
        WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
    weight AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
    hit AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS score
        FROM tf JOIN weight USING (term) JOIN q USING (term), size GROUP BY item_id, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
    """,
)
def op13(t: Tables) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return ranked.search(t("documents"), t("benchmark"), k=10)
