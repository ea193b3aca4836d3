"""JSON columns, names and units, canonical rows, conformance, equivalence, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions import canonical as K
from tableloom.functions import jsontext as J
from tableloom.functions import names as N
from tableloom.functions import units as U
from tableloom.operators import conformance as C
from tableloom.operators import digests
from tableloom.operators import equivalence as E
from tableloom.operators import profiling as D
from tableloom.operators import relational as R
from tableloom.operators import sketches
from tableloom.operators import summary as S
from tableloom.plans.registry import query
from tableloom.session import scratch_dir

# --- JSON in text columns -------------------------------------------------


@query(
    "sca1_json_member",
    """SELECT event_id, user_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '69'""",
)
def sca1(t):
    return t("events").filter(J.member(F.col("props"), "k") == "69").select("event_id", "user_id", "event_type").orderBy("event_id")


@query("sca2_json_object", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def sca2(t):
    return t("events").select("event_id", J.parse_object(F.col("props"), "k int").alias("p")).select("event_id", "p.k")


def user_types(t):
    """Per user: the kinds of its events as a JSON array in a text column."""
    return t("events").groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_set("event_type"))).alias("types"))


@query(
    "sca3_json_array_rows",
    "SELECT DISTINCT user_id, event_type FROM events",
    grouping=True,
)
def sca3(t):
    return user_types(t).select("user_id", F.explode(J.parse_array(F.col("types"))).alias("event_type"))


@query(
    "joi7_exists_in_json_array",
    """SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id
       HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0""",
    grouping=True,
)
def joi7(t):
    has = user_types(t).filter(J.array_has(F.col("types"), "purchase"))
    return has.select("user_id", F.size(J.parse_array(F.col("types"))).cast("bigint").alias("n_types"))


@query(
    "sca4_blank_json_is_null",
    """SELECT event_id, event_type IN ('error', 'view') AS is_null FROM events""",
)
def sca4(t):
    blank = (
        F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "view", "  ")
        .otherwise(F.col("props"))
    )
    return t("events").select("event_id", J.parse_object(blank, "k int").isNull().alias("is_null"))


@query(
    "sca5_clean_column_names",
    'SELECT o_orderkey AS "OrderID", o_totalprice AS "UnitPrice", o_orderpriority AS "Priority" FROM orders',
)
def sca5(t):
    named = t("orders").select(
        F.col("o_orderkey").alias("WWI Order ID"), F.col("o_totalprice").alias("Unit Price"), F.col("o_orderpriority").alias("Priority")
    )
    return N.clean_columns(named, "WWI")


@query(
    "sca6_camel_case_names",
    """SELECT c_custkey AS "customerId", c_name AS "customerName", 'http://x/' || c_custkey AS "websiteUrl",
              c_nationkey AS "nationId", c_acctbal AS "acctBalance" FROM customer""",
)
def sca6(t):
    pascal = t("customer").select(
        F.col("c_custkey").alias("CustomerID"),
        F.col("c_name").alias("CustomerName"),
        F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")).alias("WebsiteURL"),
        F.struct(F.col("c_nationkey").alias("NationID"), F.col("c_acctbal").alias("AcctBalance")).alias("Details"),
    )
    return N.rename_deep(pascal).select("customerId", "customerName", "websiteUrl", "details.nationId", "details.acctBalance")


@query(
    "sca7_singular_names",
    """SELECT w AS word, CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN left(w, -3) || 'y'
                      WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 1 THEN left(w, -1) ELSE w END AS singular
       FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)""",
    grouping=True,
)
def sca7(t):
    words = t("documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", N.singular(F.col("word")).alias("singular"))


@query(
    "sca8_timestamp_texts",
    """SELECT event_id, event_id % 3 = 0 AS is_timestamp, event_id % 3 = 1 AS is_date,
              CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END AS as_timestamp,
              CASE WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS as_date FROM events""",
)
def sca8(t):
    kind = F.col("event_id") % 3
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.col("props"))
    )
    rows = t("events").select("event_id", text.alias("text"))
    stamp, day = U.text_to_timestamp(F.col("text")), U.text_to_date(F.col("text"))
    return rows.select(
        "event_id",
        stamp.isNotNull().alias("is_timestamp"),
        day.isNotNull().alias("is_date"),
        F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("as_timestamp"),
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")).alias("as_date"),
    )


@query(
    "sca9_quantities_with_units",
    """SELECT event_id,
         CASE WHEN event_type = 'error' THEN -1 ELSE CAST(CAST(value AS DECIMAL(18,2)) * (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000
              WHEN 2 THEN 1000000 ELSE 1000000000 END) AS DOUBLE) END AS ns,
         CASE WHEN event_type = 'error' THEN -1 ELSE CAST(CAST(value AS DECIMAL(18,2)) * (CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END) AS DOUBLE) END AS bytes
       FROM events""",
)
def sca9(t):
    amount = F.format_number(F.col("value").cast("decimal(18,2)"), 2)
    time_unit = F.element_at(F.array(*[F.lit(u) for u in ("ns", "μs", "ms", "s")]), (F.col("event_id") % 4 + 1).cast("int"))
    size_unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB")]), (F.col("event_id") % 3 + 1).cast("int"))
    error = F.col("event_type") == "error"
    rows = t("events").select(
        "event_id",
        F.when(error, "NA").otherwise(F.concat_ws(" ", amount, time_unit)).alias("duration"),
        F.when(error, "NA").otherwise(F.concat_ws(" ", amount, size_unit)).alias("size"),
    )
    return rows.select(
        "event_id",
        F.coalesce(U.nanoseconds(F.col("duration")).cast("double"), F.lit(-1.0)).alias("ns"),
        F.coalesce(U.size_bytes(F.col("size")).cast("double"), F.lit(-1.0)).alias("bytes"),
    )


# --- canonical values -----------------------------------------------------


@query(
    "c1c_three_decimals",
    """SELECT l_orderkey, l_linenumber,
         CAST(CAST(CAST(CAST(l_quantity * 1.0005::DOUBLE AS VARCHAR) AS DECIMAL(38,20)) AS DECIMAL(38,3)) AS VARCHAR) AS quantity,
         printf('%.3f', CAST(l_extendedprice AS DECIMAL(18,3))) AS price FROM lineitem""",
)
def c1c(t):
    scaled = F.col("l_quantity") * F.lit(1.0005)
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        K.canonical_number(scaled).cast("string").alias("quantity"),
        K.canonical_number(F.col("l_extendedprice")).cast("string").alias("price"),
    )


@query(
    "c2c_iso_timestamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, strftime(ts, '%Y-%m-%dT00:00:00.000Z') AS day FROM events""",
)
def c2c(t):
    return t("events").select(
        "event_id", K.canonical_time(F.col("ts")).alias("at"), K.canonical_time(F.col("ts").cast("date")).alias("day")
    )


@query(
    "c3c_canonical_rows",
    """SELECT o_orderkey, '{"custId":' || o_custkey || ',"orderDate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')
         || '","orderId":' || o_orderkey || ',"price":{"status":"' || o_orderstatus || '","total":' || printf('%.3f', o_totalprice)
         || '},"remark":null}' AS doc FROM orders""",
)
def c3c(t):
    rows = t("orders").select(
        F.col("o_orderkey").alias("OrderID"),
        F.col("o_custkey").alias("CustID"),
        F.col("o_orderdate").alias("OrderDate"),
        F.struct(F.col("o_totalprice").alias("Total"), F.col("o_orderstatus").alias("Status")).alias("Price"),
        F.lit(None).cast("string").alias("Remark"),
    )
    return rows.select(F.col("OrderID").alias("o_orderkey"), K.canonical_json(rows).alias("doc"))


@query(
    "c4c_store_ids_dropped",
    """SELECT '{"name":"' || s_name || '","nation":' || s_nationkey || '}' AS doc FROM supplier""",
)
def c4c(t):
    rows = t("supplier").select(
        F.md5(F.col("s_suppkey").cast("string")).alias("_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return rows.select(K.canonical_json(rows, drop=("_id",)).alias("doc"))


RULES = [
    C.TableRule(
        "lineitem",
        (
            C.ColumnRule("l_orderkey", "int", required=True),
            C.ColumnRule("l_quantity", "decimal(3,1)"),
            C.ColumnRule("l_extendedprice", "decimal(6,2)"),
            C.ColumnRule("l_returnflag", required=True, max_length=1),
        ),
        key=("l_orderkey", "l_linenumber"),
        foreign_keys={"l_orderkey": ("closed", "o_orderkey"), "l_partkey": ("part", "p_partkey")},
    ),
    C.TableRule("documents", (C.ColumnRule("text", required=True, max_length=1000), C.ColumnRule("source", "int")), key=("doc_id",)),
]


@query(
    "c5_table_conformance",
    """SELECT 'lineitem' AS "table", 'required' AS rule, 'l_orderkey' AS "column", count(*) FILTER (WHERE l_orderkey IS NULL) AS violations FROM lineitem
       UNION ALL SELECT 'lineitem', 'type', 'l_orderkey', 0
       UNION ALL SELECT 'lineitem', 'type', 'l_quantity', count(*) FILTER (WHERE l_quantity > 99.9) FROM lineitem
       UNION ALL SELECT 'lineitem', 'type', 'l_extendedprice', count(*) FILTER (WHERE l_extendedprice > 9999.99) FROM lineitem
       UNION ALL SELECT 'lineitem', 'required', 'l_returnflag', 0
       UNION ALL SELECT 'lineitem', 'length', 'l_returnflag', count(*) FILTER (WHERE length(l_returnflag) > 1) FROM lineitem
       UNION ALL SELECT 'lineitem', 'unique', 'l_orderkey,l_linenumber', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
       UNION ALL SELECT 'lineitem', 'foreign key', 'l_orderkey', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
       UNION ALL SELECT 'lineitem', 'foreign key', 'l_partkey', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
       UNION ALL SELECT 'documents', 'required', 'text', 0
       UNION ALL SELECT 'documents', 'length', 'text', count(*) FILTER (WHERE length(text) > 1000) FROM documents
       UNION ALL SELECT 'documents', 'type', 'source', count(*) FILTER (WHERE TRY_CAST(source AS INTEGER) IS NULL) FROM documents
       UNION ALL SELECT 'documents', 'unique', 'doc_id', count(*) - count(DISTINCT doc_id) FROM documents""",
)
def c5(t):
    frames = {n: t(n) for n in ("lineitem", "documents", "part")}
    frames["closed"] = t("orders").filter(F.col("o_orderstatus") != "P")
    return C.conformance(frames, RULES)


def results(t, price_step: float = 0.0):
    """Four result sets with their unique keys; ``price_step`` shifts a price."""
    orders = t("orders").select(
        F.col("o_orderkey").alias("key"), (F.col("o_totalprice") + F.lit(price_step)).alias("amount"), F.col("o_orderpriority").alias("name")
    )
    return {
        "all": (orders, "key"),
        "range": (orders.filter((F.col("amount") > 1000) & (F.col("amount") < 90000)), "key"),
        "groups": (orders.groupBy(F.col("name")).agg(F.count(F.lit(1)).alias("key"), F.max("amount").alias("amount")).select("key", "amount", "name"), "name"),
        "none": (orders.filter(F.col("key") < 0), "key"),
    }


@query(
    "c6_result_summaries",
    """WITH o AS (SELECT o_orderkey AS key, o_totalprice AS amount, o_orderpriority AS name FROM orders),
       r AS (SELECT 'all' AS query_id, *, key AS k FROM o
             UNION ALL SELECT 'range', *, key FROM o WHERE amount > 1000 AND amount < 90000),
       j AS (SELECT query_id, k, '{"amount":' || printf('%.3f', amount) || ',"key":' || key || ',"name":"' || name || '"}' AS doc FROM r),
       s AS (SELECT query_id, count(*) AS count, arg_min(doc, k) AS first_sample, arg_max(doc, k) AS last_sample FROM j GROUP BY query_id),
       g AS (SELECT name, count(*) AS key, max(amount) AS amount FROM o GROUP BY name),
       gj AS (SELECT name AS k, '{"amount":' || printf('%.3f', amount) || ',"key":' || key || ',"name":"' || name || '"}' AS doc FROM g)
       SELECT query_id, count, first_sample, last_sample, '' AS error FROM s
       UNION ALL SELECT 'groups', count(*), arg_min(doc, k), arg_max(doc, k), '' FROM gj
       UNION ALL SELECT 'none', 0, '', '', ''""",
)
def c6(t):
    texts = ("first_sample", "last_sample", "error")
    return S.summarise_all(results(t)).select("query_id", "count", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


@query(
    "c6_failing_query",
    """SELECT 'all' AS query_id, count(*) AS count, '' AS error FROM orders
       UNION ALL SELECT 'no_column', -1, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'
       UNION ALL SELECT 'division', -1, CASE WHEN count(*) > 0 THEN 'DIVIDE_BY_ZERO' ELSE '' END FROM orders""",
)
def c6_failing(t):
    divided = t("orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") / F.lit(0)).alias("x"))
    queries = {
        "all": lambda: results(t)["all"],
        "no_column": lambda: (t("orders").select("o_orderkey", "nothing"), "o_orderkey"),
        "division": lambda: (divided, "key"),
    }
    found = S.run_all(t.spark, queries)
    return found.select("query_id", F.coalesce("count", F.lit(-1).cast("bigint")).alias("count"), F.coalesce("error", F.lit("")).alias("error"))


# --- equivalence ----------------------------------------------------------

SAMPLE = "amount decimal(38,3), key bigint, name string"


def _payloads(t, price_step=0.0):
    return S.payloads(S.summarise_all(results(t, price_step)))


@query(
    "e1e_compared_summaries",
    """SELECT 'all' AS query_id, 'Equivalent' AS status, count(*) AS count_old, count(*) AS count_new, 0 AS n_diffs FROM orders
       UNION ALL SELECT 'range', 'Equivalent', count(*) FILTER (WHERE o_totalprice > 1000 AND o_totalprice < 90000), count(*) FILTER (WHERE o_totalprice > 1000 AND o_totalprice < 90000), 0 FROM orders
       UNION ALL SELECT 'groups', 'Equivalent', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority), 0 FROM orders
       UNION ALL SELECT 'none', 'Equivalent', 0, 0, 0""",
)
def e1e(t):
    # A shift below the third decimal is no difference.
    found = E.compare_summaries(_payloads(t), _payloads(t, 0.0001), SAMPLE)
    return found.select(
        "query_id", "status", "count_old", "count_new", (F.size("first_diffs") + F.size("last_diffs")).cast("int").alias("n_diffs")
    )


@query(
    "e1e_no_common_query",
    """SELECT 'No matching query keys found between source and target.' AS error""",
)
def e1e_none(t):
    other = _payloads(t).withColumn("query_id", F.concat(F.lit("x"), F.col("query_id")))
    return E.compare_summaries(_payloads(t), other, SAMPLE).select("error")


@query(
    "e2e_payload_not_an_object",
    """SELECT * FROM (VALUES ('all', 'Query payload is not an object.', ''), ('range', '', 'Equivalent'),
       ('groups', '', 'Equivalent'), ('none', '', 'Equivalent')) AS v(query_id, error, status)""",
)
def e2e(t):
    broken = _payloads(t).withColumn("payload", F.when(F.col("query_id") == "all", F.lit("[1]")).otherwise(F.col("payload")))
    found = E.compare_summaries(_payloads(t), broken, SAMPLE)
    return found.select("query_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("status", F.lit("")).alias("status"))


@query(
    "e2e_broken_and_failed_sides",
    """WITH p AS (SELECT o_orderkey % 4 AS k, o_orderkey AS i FROM orders)
       SELECT CAST(i AS VARCHAR) AS query_id,
              CASE k WHEN 0 THEN 'Query payload is not an object.' WHEN 1 THEN 'Source query failed: no table ' || i
                     WHEN 2 THEN 'Target query failed: timeout' ELSE '' END AS error,
              CASE WHEN k = 3 THEN 'Equivalent' ELSE '' END AS status FROM p""",
)
def e2e_broken(t):
    # A payload for each order: broken JSON, a failure on both sides, on one side, and none.
    kind = F.col("o_orderkey") % 4
    good = F.to_json(F.struct(F.lit(1).alias("count"), F.struct(F.col("o_totalprice").alias("price")).alias("firstSample")))

    def side(broken, failed_1, failed_2):
        body = F.when(kind == 0, F.lit(broken)).when(kind == 1, failed_1).when(kind == 2, failed_2).otherwise(good)
        return t("orders").select(F.col("o_orderkey").cast("string").alias("query_id"), body.alias("payload"))

    def failure(text):
        return F.to_json(F.struct(text.alias("error")))

    missing = failure(F.concat(F.lit("no table "), F.col("o_orderkey").cast("string")))
    source, target = side("{broken", missing, good), side("{other junk", failure(F.lit("other")), failure(F.lit("timeout")))
    found = E.compare_summaries(source, target)
    return found.select("query_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("status", F.lit("")).alias("status"))


@query(
    "e6e_undeclared_fields",
    """SELECT CAST(o_orderkey AS VARCHAR) AS query_id, 'buyer.id' AS path, o_custkey || '.000' AS old, (o_custkey + 1) || '.000' AS new
       FROM orders WHERE o_orderkey % 3 = 1
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus, NULL FROM orders WHERE o_orderkey % 3 = 2""",
)
def e6e_undeclared(t):
    # Declared is the price alone; the buyer changes in a third of the orders, the status is missing in another.
    case = F.col("o_orderkey") % 3

    def side(buyer, status):
        sample = F.struct(F.col("o_totalprice").alias("price"), F.struct(buyer.alias("id")).alias("buyer"), status.alias("status"))
        body = F.to_json(F.struct(F.lit(1).alias("count"), sample.alias("firstSample")))
        return t("orders").select(F.col("o_orderkey").cast("string").alias("query_id"), body.alias("payload"))

    source = side(F.col("o_custkey"), F.col("o_orderstatus"))
    target = side(F.when(case == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), F.when(case != 2, F.col("o_orderstatus")))
    found = E.compare_summaries(source, target, "price decimal(38,3)")
    return found.select("query_id", F.explode("first_diffs").alias("d")).select("query_id", "d.path", "d.old", "d.new")


@query(
    "e3e_count_difference",
    """SELECT 'all' AS query_id, count(*) AS count_old, count(*) FILTER (WHERE o_orderstatus <> 'P' OR o_orderkey = (SELECT max(o_orderkey) FROM orders)) AS count_new,
              'Differences Found' AS status FROM orders
       UNION ALL SELECT 'none', 0, 0, 'Equivalent'""",
)
def e3e(t):
    rows = results(t)["all"][0]
    last = rows.agg(F.max("key")).scalar()
    finished = t("orders").filter((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") == last))
    thinned = finished.select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("name")
    )
    none = results(t)["none"]
    found = E.compare_summaries(
        S.payloads(S.summarise_all({"all": (rows, "key"), "none": none})),
        S.payloads(S.summarise_all({"all": (thinned, "key"), "none": none})),
        SAMPLE,
    )
    return found.select("query_id", "count_old", "count_new", "status")


@query(
    "e4e_nested_lists_order_free",
    """SELECT o_orderkey, o_totalprice <> o_orderkey AS reordered, 0.0::DOUBLE AS distance, true AS same,
              2.0 / 2 AS copy_distance FROM orders""",
)
def e4e(t):
    # One JSON document per order with a list of three numbers, in another order on the other side;
    # the third document repeats one element.
    price, key = F.col("o_totalprice"), F.col("o_orderkey").cast("double")

    def doc(*items):
        return F.to_json(F.struct(F.array(*items).alias("prices"), F.array(*items).alias("again")))

    rows = t("orders").select(
        "o_orderkey",
        doc(price, key, price).alias("a"),
        doc(key, price, price).alias("b"),
        doc(key, price).alias("c"),
    )
    schema = "prices array<decimal(38,3)>, again array<decimal(38,3)>"
    a, b, c = (E.sample_leaves(F.col(n), schema) for n in "abc")
    return rows.select(
        "o_orderkey",
        (F.col("a") != F.col("b")).alias("reordered"),
        E.distance(a, b).alias("distance"),
        (F.size(E.differing(a, b)) == 0).alias("same"),
        E.distance(a, c).alias("copy_distance"),
    )


def _swapped(t, allow_swap):
    straight = _payloads(t)
    body = F.from_json("payload", E._PAYLOAD)
    turned = straight.select(
        "query_id",
        F.to_json(
            F.struct(
                body["count"].alias("count"), body["lastSample"].alias("firstSample"), body["firstSample"].alias("lastSample")
            )
        ).alias("payload"),
    )
    found = E.compare_summaries(straight, turned, SAMPLE, allow_swap)
    return found.select("query_id", "status")


@query(
    "e5e_swapped_samples",
    """SELECT 'all' AS query_id, 'Equivalent' AS status UNION ALL SELECT 'range', 'Equivalent' UNION ALL SELECT 'groups', 'Equivalent' UNION ALL SELECT 'none', 'Equivalent'""",
)
def e5e(t):
    return _swapped(t, True)


@query(
    "e5e_swap_not_allowed",
    """SELECT 'all' AS query_id, 'Differences Found' AS status UNION ALL SELECT 'range', 'Differences Found' UNION ALL SELECT 'groups', 'Differences Found' UNION ALL SELECT 'none', 'Equivalent'""",
)
def e5e_strict(t):
    return _swapped(t, False)


@query(
    "e6e_sample_differences",
    """WITH o AS (SELECT 'all' AS query_id, * FROM orders UNION ALL SELECT 'range', * FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 90000),
         n AS (SELECT query_id, arg_min(o_totalprice, o_orderkey) AS f, arg_max(o_totalprice, o_orderkey) AS l FROM o GROUP BY query_id)
       SELECT query_id, 'first' AS sample, 'amount' AS path, printf('%.3f', f) AS old, printf('%.3f', f + 0.25) AS new FROM n WHERE query_id = 'all'
       UNION ALL SELECT query_id, 'last', 'amount', printf('%.3f', l), printf('%.3f', l + 0.25) FROM n WHERE query_id = 'all'""",
)
def e6e(t):
    old, new = results(t), results(t, 0.25)
    one = S.payloads(S.summarise_all({k: old[k] for k in ("all", "none")}))
    other = S.payloads(S.summarise_all({k: new[k] for k in ("all", "none")}))
    found = E.compare_summaries(one, other, SAMPLE)
    first = found.select("query_id", F.lit("first").alias("sample"), F.explode("first_diffs").alias("d"))
    last = found.select("query_id", F.lit("last").alias("sample"), F.explode("last_diffs").alias("d"))
    return first.unionByName(last).select("query_id", "sample", "d.path", "d.old", "d.new")


def _moved(t):
    """Lines with one changed column value for some rows."""
    return t("lineitem").withColumn(
        "l_quantity", F.when(F.col("l_linenumber") == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    )


@query(
    "e7e_dataset_equivalence",
    """SELECT 'same' AS check_name, 'Equivalent' AS status, 0 AS only_left, 0 AS only_right
       UNION ALL
       SELECT 'moved', 'Differences Found',
              (SELECT count(*) FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem)),
              (SELECT count(*) FROM (SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem EXCEPT ALL SELECT * FROM lineitem))""",
)
def e7e(t):
    same = E.equivalence(t("lineitem"), t("lineitem")).withColumn("check_name", F.lit("same"))
    moved = E.equivalence(t("lineitem"), _moved(t)).withColumn("check_name", F.lit("moved"))
    return same.unionByName(moved)


@query(
    "e8e_keyed_difference",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'changed' END AS kind,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'o_totalprice' END AS "column",
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE printf('%.3f', o_totalprice) END AS old,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE printf('%.3f', o_totalprice + 1) END AS new
       FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'
       UNION ALL SELECT -1, 'added', '', '', ''""",
)
def e8e(t):
    left = t("orders")
    right = left.filter(F.col("o_orderstatus") != "P").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    extra = left.orderBy("o_orderkey").limit(1).withColumn("o_orderkey", F.lit(-1).cast("bigint"))
    found = E.keyed_difference(left, right.unionByName(extra), ["o_orderkey"])
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("column", "old", "new")]
    return found.select("o_orderkey", "kind", *blank)


@query(
    "e8e_difference_by_digests",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS kind,
              CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'o_totalprice' END AS "column",
              CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE printf('%.3f', o_totalprice) END AS old,
              CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE printf('%.3f', o_totalprice + 1) END AS new
       FROM orders WHERE o_orderkey % 97 = 0""",
)
def e8e_digests(t):
    """Few keys differ; only rows of buckets whose digests differ are shuffled."""
    left, case = t("orders"), F.col("o_orderkey") % 97 == 0
    right = left.filter(~(case & (F.col("o_orderkey") % 5 == 0))).withColumn("o_totalprice", F.when(case, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    found = digests.difference(left, right, ["o_orderkey"])
    return found.select("o_orderkey", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("column", "old", "new")])


@query(
    "e8e_difference_counts",
    """SELECT 'removed' AS kind, '' AS "column", count(*) AS cells FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
       UNION ALL SELECT 'changed', 'o_totalprice', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW'""",
    grouping=True,
)
def e8e_counts(t):
    left = t("orders")
    right = left.filter(F.col("o_orderstatus") != "P").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    found = E.difference_counts(E.keyed_difference(left, right, ["o_orderkey"]), ["o_orderkey"])
    return found.select("kind", F.coalesce("column", F.lit("")).alias("column"), "cells")


@query(
    "e9e_deep_distance",
    """SELECT o_orderkey, ((o_orderpriority = '5-LOW')::INT + (o_orderstatus = 'F')::INT) / 3.0::DOUBLE AS distance FROM orders""",
)
def e9e(t):
    old = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("name"))
    new = F.struct(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "f").otherwise(F.col("o_orderstatus")).alias("name"),
    )
    rows = t("orders").select("o_orderkey", F.to_json(old).alias("a"), F.to_json(new).alias("b"))
    return rows.select("o_orderkey", E.distance(E.sample_leaves(F.col("a"), SAMPLE), E.sample_leaves(F.col("b"), SAMPLE)).alias("distance"))


@query(
    "e6e_samples_of_any_form",
    """WITH o AS (SELECT *, o_orderkey % 4 AS k, o_orderkey || '.000' AS n FROM orders WHERE o_orderstatus = 'F')
       SELECT CAST(o_orderkey AS VARCHAR) AS query_id, 'Differences Found' AS status,
              CASE k WHEN 2 THEN 'a\\.b|lines' ELSE '' END AS paths,
              CASE k WHEN 0 THEN o_orderpriority WHEN 1 THEN '[' || n || ',' || n || ',x]'
                     WHEN 2 THEN '1.000|[{"n":1.000,"t":[a,b]},{"n":' || n || ',"t":[[' || least(n, '7.000') || ',' || greatest(n, '7.000') || '],[]]}]'
                     ELSE printf('%.3f', o_totalprice) END AS old,
              CASE k WHEN 0 THEN o_orderpriority || '!' WHEN 1 THEN '[' || n || ',x]'
                     WHEN 2 THEN '"1"|[{"n":1.000,"t":[a,b]},{"n":' || n || ',"t":[[' || n || ',' || n || '],[]]}]'
                     ELSE printf('%.3f', CAST(o_totalprice AS DECIMAL(18,2)) + 1) END AS new
       FROM o
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Equivalent', '', '', '' FROM orders WHERE o_orderstatus <> 'F'""",
)
def e6e_forms(t):
    """Samples that are a text, a list, an object with lists in lists, or a number; they differ where the order is finished."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)")

    def side(text, listed, nested, number):
        kind = F.col("o_orderkey") % 4
        sample = F.when(kind == 0, text).when(kind == 1, listed).when(kind == 2, nested).otherwise(number)
        body = F.concat(F.lit('{"count": 1, "firstSample": '), sample, F.lit("}"))
        return t("orders").select(F.col("o_orderkey").cast("string").alias("query_id"), body.alias("payload"))

    def changed(new, old):
        return F.when(F.col("o_orderstatus") == "F", new).otherwise(old)

    priority = F.col("o_orderpriority")
    source = side(
        F.to_json(F.array(priority)).substr(F.lit(2), F.length(priority) + 2),
        F.format_string('[%s, "x", %s]', key, key),
        F.format_string('{"lines": [{"n": 1, "t": ["b", "a"]}, {"t": [[7, %s], []], "n": %s}], "a.b": 1, "a": {"b": 2}}', key, key),
        price.cast("string"),
    )
    other = changed(F.concat(priority, F.lit("!")), priority)
    target = side(
        F.format_string('"%s"', other),
        changed(F.format_string('["x", %s]', key), F.format_string('["x", %s, %s]', key, key)),
        F.format_string('{"a": {"b": 2.0}, "a.b": %s, "lines": [{"n": %s.0001, "t": [[], [%s, %s]]}, {"t": ["a", "b"], "n": 1}]}', changed(F.lit('"1"'), F.lit("1.0")), key, key, changed(key, F.lit("7"))),
        (price + changed(F.lit(1), F.lit(0)) + F.lit(0.0001).cast("decimal(5,4)")).cast("string"),
    )
    found = E.compare_summaries(source, target)
    diffs = F.array_sort("first_diffs")
    joined = {c: F.array_join(diffs[c], "|") for c in ("path", "old", "new")}
    return found.select("query_id", "status", joined["path"].alias("paths"), joined["old"].alias("old"), joined["new"].alias("new"))


@query(
    "e9e_undeclared_distance",
    """SELECT o_orderkey, ((o_orderpriority = '5-LOW')::INT + (o_orderstatus = 'F')::INT + (o_orderkey % 3 = 0)::INT) / (4.0::DOUBLE + (o_orderkey % 3 = 0)::INT) AS distance FROM orders""",
)
def e9e_undeclared(t):
    """Of four leaves one is declared; the status inside an object, the elements of a list and a leaf that one side lacks count too."""

    def sample(amount, name, *more):
        return F.struct(amount.alias("amount"), F.struct(name.alias("name"), F.col("o_orderkey").alias("key")).alias("inner"), F.array("o_custkey", "o_orderkey").alias("list"), *more)

    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    old = sample(price, status)
    new = sample(F.when(F.col("o_orderpriority") == "5-LOW", price + 1).otherwise(price), F.when(status == "F", "f").otherwise(status), F.when(F.col("o_orderkey") % 3 == 0, F.lit("late")).alias("more"))
    rows = t.dealt("orders", "o_orderkey").select("o_orderkey", F.parse_json(F.to_json(old)).alias("a"), F.parse_json(F.to_json(new)).alias("b"))
    return E.with_distance(rows, "a", "b", "amount decimal(38,3)").select("o_orderkey", "distance")


@query(
    "e10_latest_outcome",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN contains(text, 'an') THEN 'passed' WHEN contains(text, 'e') THEN 'failed' END AS o FROM conversations)
       SELECT conv_id, coalesce(arg_max(o, turn) FILTER (WHERE o IS NOT NULL), 'missing') AS outcome FROM m GROUP BY conv_id""",
    grouping=True,
)
def e10(t):
    return E.latest_outcome(t("conversations"), "conv_id", "turn", "text", passed="an", failed="e")


TOKENS = ("tion", "the", "que", "sch")


@query(
    "e11_new_tokens",
    """SELECT a.doc_id, """
    + " || ".join(
        f"CASE WHEN trim(a.text) <> '' AND contains(lower(b.text), '{k}') AND NOT contains(lower(a.text), '{k}') THEN '{k},' ELSE '' END"
        for k in TOKENS
    )
    + """ AS tokens FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""",
)
def e11(t):
    # Texts are reduced to their tokens before the join.
    present = E.present_tokens(F.col("text"), TOKENS)
    a = t("documents").select("doc_id", present.alias("old"))
    b = t("documents").select((F.col("doc_id") - 1).alias("doc_id"), present.alias("new"))
    found = E.new_tokens(F.col("old"), F.col("new"))
    return a.join(b, "doc_id").select("doc_id", F.concat_ws("", F.transform(found, lambda x: F.concat(x, F.lit(",")))).alias("tokens"))


@query(
    "e12_correctness_rate",
    """SELECT o_orderpriority AS source, o_orderstatus AS target, count(*) AS translations,
              count(*) FILTER (WHERE o_totalprice < 200000) / count(*) AS rate FROM orders GROUP BY ALL""",
    grouping=True,
)
def e12(t):
    outcomes = t("orders").select(
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("target"),
        F.when(F.col("o_totalprice") < 200000, E.EQUIVALENT).when(F.col("o_totalprice") < 300000, E.DIFFERENT).alias("status"),
    )
    return E.correctness_rate(outcomes, ["source", "target"])


@query(
    "e13_run_metrics",
    """SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error') / count(*) AS exception_rate,
              max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS retry_chain,
              count(*) FILTER (WHERE event_type = 'click') AS tool_calls FROM events GROUP BY user_id""",
    grouping=True,
)
def e13(t):
    retry = J.member(F.col("props"), "k").cast("int")
    kind = F.col("event_type")
    return E.run_metrics(t("events"), "user_id", kind == "error", retry, kind == "click")


# --- profiles -------------------------------------------------------------


@query(
    "d1d_output_profile",
    """SELECT 'counts' AS query_id, v.column_name, v.ordinal, v.data_type, true AS is_grouping, (SELECT count(DISTINCT l_tax) FROM lineitem) AS row_count
         FROM (VALUES ('l_tax', 0, 'double'), ('count', 1, 'bigint')) AS v(column_name, ordinal, data_type)
       UNION ALL
       SELECT 'range', v.column_name, v.ordinal, v.data_type, false, (SELECT count(*) FROM orders WHERE o_totalprice > 1000)
         FROM (VALUES ('o_orderkey', 0, 'bigint'), ('o_orderdate', 1, 'timestamp_ntz')) AS v(column_name, ordinal, data_type)""",
)
def d1d(t):
    counts = D.output_profile(R.count_by(t("lineitem"), "l_tax"), grouping=True, exact=True)
    plain = t("orders").filter(F.col("o_totalprice") > 1000).select("o_orderkey", "o_orderdate")
    return counts.withColumn("query_id", F.lit("counts")).unionByName(
        D.output_profile(plain, exact=True).withColumn("query_id", F.lit("range"))
    )


@query(
    "d2d_grouping_flag",
    """SELECT 'agg1_count_by_rate' AS query_id, true AS is_grouping, count(DISTINCT l_tax) AS row_count FROM lineitem
       UNION ALL SELECT 'agg8_distinct_values', true, count(DISTINCT o_orderpriority) FROM orders
       UNION ALL SELECT 'prj5_two_columns', false, count(*) FROM lineitem""",
)
def d2d(t):
    from tableloom.plans import load

    known = load()
    parts = None
    for name in ("agg1_count_by_rate", "agg8_distinct_values", "prj5_two_columns"):
        q = known[name]
        one = q.run(t).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("query_id"), F.lit(q.grouping).alias("is_grouping"), "row_count"
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(
    "d3d_synthetic_constant",
    """SELECT CAST(1 AS BIGINT) AS o_orderkey, CAST(1 AS DOUBLE) AS o_totalprice, TIMESTAMP '2000-01-01' AS o_orderdate, 'null' AS o_orderpriority FROM orders""",
)
def d3d(t):
    profiled = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return D.synthetic_table(t.spark, profiled.schema, t("orders").count())


@query(
    "d4d_synthetic_distinct",
    """SELECT CAST(i + 1 AS BIGINT) AS k, CAST(1 + i % 254 AS SMALLINT) AS small, i + 1.0::DOUBLE AS amount, i % 2 = 0 AS flag,
              CAST(DATE '2000-01-01' + CAST(i AS INTEGER) AS DATE) AS day, '"' || i || '"' AS label
       FROM range((SELECT count(*) FROM orders)) AS r(i)""",
    grouping=True,
)
def d4d(t):
    schema = T.StructType.fromDDL("k bigint, small smallint, amount double, flag boolean, day date, label string")
    return D.synthetic_table(t.spark, schema, t("orders").count(), distinct=True)


@query(
    "d4d_small_types_start_again",
    """SELECT CAST(1 + i % 126 AS TINYINT) AS tiny, CAST(1 + i % 99 AS DECIMAL(3,1)) AS two, CAST(1 + i % 9 AS DECIMAL(3,2)) AS one,
              CAST((1 + i % 999) / 1000.0 AS DECIMAL(3,3)) AS none
       FROM range((SELECT count(*) FROM orders)) AS r(i)""",
    grouping=True,
)
def d4d_small(t):
    schema = T.StructType.fromDDL("tiny tinyint, two decimal(3,1), one decimal(3,2), none decimal(3,3)")
    return D.synthetic_table(t.spark, schema, t("orders").count(), distinct=True)


def _order_profile(t):
    """The profile of all orders, merged from one stored profile for each year."""
    path = scratch_dir(t.spark, "profiles")
    sketches.profile_parts(t("orders"), F.year("o_orderdate")).write.parquet(path)
    return sketches.merge_parts(t.spark.read.parquet(path))


def _near(estimate, exact, share):
    return F.abs(estimate - exact) <= F.greatest(exact * share, F.lit(1))


@query(
    "d6d_merged_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, true AS distinct_near, true AS quartiles_near FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def d6d_merged(t):
    """Distinct counts within 5 %, and quartiles whose share of smaller values is off by 2 % at most."""
    rows = t("orders")
    found = sketches.estimates(_order_profile(t))
    quartiles = {r["column_name"]: r["quantiles"] for r in found.collect()}
    exact = [F.count_distinct(c).alias(f"{c}_n") for c in rows.columns]
    for c in rows.columns:
        value = F.unix_micros(F.col(c).cast("timestamp")) if c == "o_orderdate" else F.col(c)
        steps = quartiles[c] or []
        inside = [(F.count_if(value < q) / F.count(c) <= r + 0.02) & (F.count_if(value <= q) / F.count(c) >= r - 0.02) for q, r in zip(steps, (0.25, 0.5, 0.75))]
        every = F.lit(True)
        for x in inside:
            every = every & x
        exact.append(every.alias(f"{c}_q"))
    one = rows.agg(*exact)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_q").alias("quartiles_near")) for c in rows.columns])
    held = one.select(F.explode(cells).alias("x")).select("x.*")
    both = found.join(held, "column_name")
    return both.select("column_name", "rows", "nulls", _near(F.col("distinct_values"), F.col("n"), 0.05).alias("distinct_near"), "quartiles_near")


@query(
    "d1d_estimated_rows",
    """SELECT 'groups' AS plan, true AS near, count(DISTINCT o_orderpriority) AS exact FROM orders
       UNION ALL SELECT 'range', true, count(*) FILTER (WHERE o_totalprice > 100000 AND o_totalprice <= 300000) FROM orders
       UNION ALL SELECT 'plan', true, count(*) FROM orders""",
    grouping=True,
)
def d1d_estimated(t):
    """Row estimates that run no query on the table: a grouping and a range from stored sketches, a scan from the plan."""
    profile = _order_profile(t)
    rows = t("orders")
    cases = [
        ("groups", sketches.estimated_groups(profile, "o_orderpriority"), rows.agg(F.count_distinct("o_orderpriority").alias("exact")), 0.05),
        ("range", sketches.estimated_range(profile, "o_totalprice", 100_000, 300_000), rows.filter((F.col("o_totalprice") > 100_000) & (F.col("o_totalprice") <= 300_000)).agg(F.count(F.lit(1)).alias("exact")), 0.05),
        # The optimizer only knows the size of the files; held to a factor of ten.
        ("plan", rows.limit(1).agg(F.lit(D.estimated_rows(rows)).cast("bigint").alias("row_count")), rows.agg(F.count(F.lit(1)).alias("exact")), 9.0),
    ]
    out = None
    for name, estimate, exact, share in cases:
        rows_found = F.lit(exact.first()[0])
        one = estimate.select(F.lit(name).alias("plan"), _near(F.col("row_count"), rows_found, share).alias("near"), rows_found.cast("bigint").alias("exact"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "d4d_like_a_profile",
    """SELECT 'amount' AS "column", count(*) AS rows, true AS quartiles_near, true AS has_time FROM events
       UNION ALL SELECT 'at', count(*), true, true FROM events""",
    grouping=True,
)
def d4d_profile(t):
    """As many made rows as events, whose values and times of day follow the merged profile of the days."""
    events = t("events").select(F.col("ts").alias("at"), F.col("value").alias("amount"))
    profile = sketches.merge_parts(sketches.profile_parts(events, F.to_date("at")))
    made = sketches.synthetic_like(t.spark, profile, events.count())
    names = {"amount": "amount", "at": F.unix_micros(F.col("at").cast("timestamp")).cast("double")}
    out = None
    for name, value in names.items():
        value = F.col(value) if isinstance(value, str) else value
        quartiles = events.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        near = [F.abs(F.count_if(value <= q) / F.count(value) - r) <= 0.03 for q, r in zip(quartiles, (0.25, 0.5, 0.75))]
        timed = F.count_distinct(F.date_format("at", "HH:mm:ss")) > 1
        one = made.agg(F.lit(name).alias("column"), F.count(F.lit(1)).alias("rows"), (near[0] & near[1] & near[2]).alias("quartiles_near"), timed.alias("has_time"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "d5d_ordinal_column_names",
    """SELECT a.l_orderkey AS "0__key", b.o_orderkey AS "1__key", b.o_totalprice AS "2__amount" FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey""",
)
def d5d(t):
    joined = R.equi_join(t("lineitem"), t("orders"), ("l_orderkey", "o_orderkey")).select(
        F.col("l_orderkey").alias("key"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount")
    )
    return N.ordinal_columns(joined)


def _profile_sql(column, kind, text):
    return (
        f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) FILTER (WHERE {column} IS NULL) AS nulls, "
        f"min({text}) AS lowest, max({text}) AS highest, true AS near FROM orders"
    )


@query(
    "d6d_table_profile",
    " UNION ALL ".join(
        [
            _profile_sql("o_orderkey", "bigint", "o_orderkey").replace("AS lowest", "::VARCHAR AS lowest").replace("AS highest", "::VARCHAR AS highest"),
            _profile_sql("o_custkey", "bigint", "o_custkey").replace("AS lowest", "::VARCHAR AS lowest").replace("AS highest", "::VARCHAR AS highest"),
            _profile_sql("o_orderstatus", "string", "o_orderstatus"),
            _profile_sql("o_totalprice", "double", "o_totalprice").replace("min(o_totalprice)", "printf('%.2f', min(o_totalprice))").replace(
                "max(o_totalprice)", "printf('%.2f', max(o_totalprice))"
            ),
            _profile_sql("o_orderdate", "timestamp_ntz", "o_orderdate").replace("min(o_orderdate)", "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')").replace(
                "max(o_orderdate)", "strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')"
            ),
            _profile_sql("o_orderpriority", "string", "o_orderpriority"),
        ]
    ),
)
def d6d(t):
    rows = t("orders")
    # The distinct counts are estimates; they are held against the exact ones.
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in rows.columns])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in rows.columns])).alias("x"))
    exact = exact.select(F.col("x.name").alias("column_name"), F.col("x.n").alias("exact"))
    found = D.table_profile(rows).join(F.broadcast(exact), "column_name")  # one row for each column
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= 1 + 0.2 * F.col("exact")

    def price(c):
        return F.when(F.col("column_name") == "o_totalprice", F.format_string("%.2f", F.when(F.col("column_name") == "o_totalprice", F.col(c)).cast("double"))).otherwise(F.col(c))

    return found.select("column_name", "data_type", "nulls", price("lowest").alias("lowest"), price("highest").alias("highest"), near.alias("near"))


@query(
    "d6d_sample_rows",
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS row
       FROM orders ORDER BY o_orderkey LIMIT 3""",
)
def d6d_rows(t):
    return D.sample_rows(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 3)
