"""Not-modified revisits of a web archive, resolved to the full response they confirm.

A revisit takes the latest earlier full response of its canonical URL, an as-of
join. Captures are dealt to ranges of URL and time, so the captures of one URL
may fill many tasks; each range hands its last response on to the ranges after
it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.session import materialise

# Headers of a 304 response that may not replace the stored ones,
# as they describe the missing body or the connection.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
# Query parameters that name a campaign, not a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)"

RESOLVED = "resolved"
UNCHECKED = "resolved_without_validator"
MISSING = "no_earlier_response"
CHANGED_TAG = "etag_differs"
CHANGED_DATE = "last_modified_differs"


def canonical_url(url: Column) -> Column:
    """One form for the addresses of a page.

    Without scheme, user, ``www.``, default port, fragment, tracking parameters
    and closing slash; the host in lower case, the parameters sorted.
    """
    plain = F.regexp_replace(F.trim(url.cast("string")), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    place = F.regexp_extract(plain, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(place, r"^(?:[^/@]*@)?([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&", -1), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def lowered(headers: Column) -> Column:
    """Headers with names in lower case; values of names that differ in case only are joined by a comma, in the order of the names."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))

    def whole(name: Column) -> Column:
        values = F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"])
        some = F.array_compact(values)
        return F.struct(name.alias("key"), F.when(F.size(some) > 0, F.array_join(some, ", ")).alias("value"))

    return F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))), whole))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, replaced by those of the revisit that may replace them; names are in lower case."""
    allowed = F.map_filter(lowered(fresh), lambda k, _: ~k.isin(NOT_MERGED))
    kept = F.map_filter(lowered(stored), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve(captures: DataFrame) -> DataFrame:
    """Every revisit with the response it stands for.

    ``captures``: ``record_id bigint, url string, time bigint, full boolean,
    headers map<string, string>``; see :func:`lowered` for names that differ in
    case only.
    ``full`` says that the capture has a body; others are revisits (null too).
    Only responses at an earlier time count; of several at one time the largest
    id. Result: ``record_id, canonical_url, response_id, outcome, headers``.

    A revisit with an entity tag is held against that of the response (weak
    comparison), else its last-modified; a difference, or no earlier response,
    gives a null ``response_id`` and its own headers. A null url or time
    matches nothing; repeated captures give repeated rows; an empty table gives
    none; other columns are not read.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "time", F.coalesce("full", F.lit(False)).alias("full"), lowered(F.col("headers")).alias("headers"))
    lost = F.col("canonical_url").isNull() | F.col("time").isNull()
    # Revisits come before responses of the same time, which are not earlier.
    dealt = rows.repartitionByRange("canonical_url", "time", "full", "record_id").withColumn("range", F.spark_partition_id())
    dealt = materialise(dealt, "captures")

    response = F.when(
        F.col("full") & ~lost,
        F.struct("time", "record_id", F.array_sort(F.map_entries("headers")).alias("headers")),
    )
    known = dealt.withColumn("response", response)
    before = Window.partitionBy("canonical_url", "range").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = known.withColumn("here", F.last("response", ignorenulls=True).over(before)).where(~F.col("full"))
    ranges = known.groupBy("canonical_url", "range").agg(F.max("response").alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("canonical_url", "range", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    ranges = ranges.where(F.col("carried").isNotNull())
    found = here.join(ranges, ["canonical_url", "range"], "left")
    found = found.withColumn("of", F.when(~lost, F.coalesce("here", "carried")))

    stored = F.map_from_entries("of.headers")
    tags = [_tag(F.element_at(m, "etag")) for m in (F.col("headers"), stored)]
    dates = [F.element_at(m, "last-modified") for m in (F.col("headers"), stored)]
    outcome = (
        F.when(F.col("of").isNull(), MISSING)
        .when(tags[0].isNotNull(), F.when(tags[0].eqNullSafe(tags[1]), RESOLVED).otherwise(CHANGED_TAG))
        .when(dates[0].isNotNull(), F.when(dates[0].eqNullSafe(dates[1]), RESOLVED).otherwise(CHANGED_DATE))
        .otherwise(UNCHECKED)
    )
    found = found.withColumn("outcome", outcome)
    ok = F.col("outcome").isin(RESOLVED, UNCHECKED)
    return found.select(
        "record_id",
        "canonical_url",
        F.when(ok, F.col("of.record_id")).alias("response_id"),
        "outcome",
        F.when(ok, merged_headers(stored, F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures made from a table of pages: each page is fetched once and asked for again later.

    The page's id is the time of its response. The second request comes 5 000
    later, for each 17th page long before; each 11th sees another entity tag,
    each 13th sends a date only, each 7th a weak tag, each 19th no validator.
    """
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    date = F.concat(F.lit("day "), F.floor(page / 100).cast("string"))
    size = F.octet_length("html").cast("string")

    def headers(*pairs: tuple[str, Column]) -> Column:
        entries = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    first = headers(
        ("Content-Type", F.lit("text/html")), ("Content-Length", size), ("ETag", tag), ("Last-Modified", date), ("Cache-Control", F.lit("max-age=60"))
    )
    asked = F.when(page % 11 == 0, F.lit('"other"')).when(page % 7 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    asked = F.when((page % 13 != 0) & (page % 19 != 0), asked)
    later = headers(
        ("etag", asked), ("last-modified", F.when(page % 19 != 0, date)), ("cache-control", F.lit("max-age=600")), ("content-length", F.lit("0"))
    )
    time = F.when(page % 17 == 0, page - 1_000_000_000).otherwise(page + 5_000)
    responses = pages.select((page * 2).alias("record_id"), "url", page.alias("time"), F.col("html").isNotNull().alias("full"), first.alias("headers"))
    again = pages.select((page * 2 + 1).alias("record_id"), "url", time.alias("time"), F.lit(False).alias("full"), later.alias("headers"))
    return responses.unionByName(again)
