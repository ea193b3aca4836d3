"""Document collections, property graphs and change feeds over the local tables."""

from __future__ import annotations

import datetime as dt
import json
import math

from pyspark.sql import functions as F

from tableloom.operators import documents as D
from tableloom.operators import graph as G
from tableloom.operators import projects as P
from tableloom.operators import relational as R
from tableloom.plans.registry import query
from tableloom.session import scratch_dir
from tableloom.sources import files
from tableloom.streaming import buckets as B
from tableloom.streaming import changes as S
from tableloom.streaming import pairs as SP

MONEY = "decimal(18,2)"


# --- mappings of the local tables -----------------------------------------


def field(source: str, target: str, type_: str | None = None, key: bool = False, included: bool = True) -> D.Field:
    return D.Field(source, target, type_, included, key)


ORDER_FIELDS = (
    field("o_orderkey", "orderId", "LONG", key=True),
    field("o_custkey", "customerId", "LONG"),
    field("o_orderdate", "orderDate", "DATE"),
    field("o_orderpriority", "priority", "STRING"),
    field("o_totalprice", "total", "DOUBLE"),
    field("o_orderstatus", "status", "STRING", included=False),
)
TRANSACTION_FIELDS = (
    field("o_orderkey", "transactionId", "LONG", key=True),
    field("o_orderdate", "transactionDate", "DATE"),
    field("o_totalprice", "amount"),
)
CUSTOMER_FIELDS = (
    field("c_custkey", "customerId", "LONG", key=True),
    field("c_name", "customerName", "STRING"),
    field("c_acctbal", "creditLimit"),
)
LINE_FIELDS = (
    field("l_orderkey", "orderId", "LONG", key=True),
    field("l_linenumber", "lineNumber", "INTEGER", key=True),
    field("l_partkey", "stockItemId", "LONG"),
    field("l_suppkey", "supplierId", "LONG"),
    field("l_quantity", "quantity", "INTEGER"),
    field("l_extendedprice", "unitPrice"),
)
PART_FIELDS = (field("p_partkey", "stockItemId", "LONG", key=True), field("p_name", "stockItemName"), field("p_brand", "brand"))
LINK_FIELDS = (field("l_partkey", "stockItemId", "LONG", key=True), field("l_suppkey", "stockGroupId", "LONG", key=True))
SUPPLIER_FIELDS = (field("s_suppkey", "supplierId", "LONG", key=True), field("s_name", "supplierName"))
NATION_FIELDS = (field("n_nationkey", "personId", "INTEGER", key=True), field("n_name", "fullName"))
EVENT_FIELDS = (field("event_id", "eventId", "LONG", key=True), field("event_type", "kind"))

ORDERS = D.TableMapping(
    D.NEW_DOCUMENT,
    "orders",
    ORDER_FIELDS,
    children=(
        D.TableMapping(
            D.EMBEDDED,
            "customer",
            CUSTOMER_FIELDS,
            "customer",
            ("o_custkey", "c_custkey"),
            children=(
                D.TableMapping(D.EMBEDDED_ARRAY, "closed", TRANSACTION_FIELDS, "customerTransactions", ("c_custkey", "o_custkey")),
            ),
        ),
    ),
)
ORDER_LINES = D.TableMapping(
    D.NEW_DOCUMENT,
    "lineitem",
    LINE_FIELDS,
    children=(
        D.TableMapping(
            D.EMBEDDED,
            "part",
            PART_FIELDS,
            "stockItem",
            ("l_partkey", "p_partkey"),
            children=(D.TableMapping(D.EMBEDDED_ARRAY, "link", LINK_FIELDS, "stockItemStockGroups", ("p_partkey", "l_partkey")),),
        ),
    ),
)
SUPPLIERS = D.TableMapping(
    D.NEW_DOCUMENT,
    "supplier",
    SUPPLIER_FIELDS,
    children=(
        D.TableMapping(D.EMBEDDED_ARRAY, "link", LINK_FIELDS, "stockItems", ("s_suppkey", "l_suppkey")),
        D.TableMapping(D.EMBEDDED_ARRAY, "lineitem", LINE_FIELDS, "purchaseOrders", ("s_suppkey", "l_suppkey")),
    ),
)
PEOPLE = D.TableMapping(
    D.NEW_DOCUMENT,
    "nation",
    NATION_FIELDS,
    children=tuple(
        D.TableMapping(D.EMBEDDED_ARRAY, table, fields, path, ("n_nationkey", "editor"))
        for table, fields, path in (
            ("edited_supplier", SUPPLIER_FIELDS, "stockGroups"),
            ("edited_part", PART_FIELDS, "stockItems"),
            ("edited_orders", ORDER_FIELDS, "purchaseOrders"),
            ("edited_customer", CUSTOMER_FIELDS, "customers"),
            ("edited_events", EVENT_FIELDS, "stockItemStockGroups"),
            ("edited_closed", TRANSACTION_FIELDS, "customerTransactions"),
        )
    ),
)


def sources(t):
    """The tables the mappings name; every order is a transaction, and the last editor of a row is derived from its key."""

    def edited(df, key):
        return df.withColumn("editor", (F.col(key) % 25).cast("int"))

    return {
        "orders": t("orders"),
        "customer": t("customer"),
        "closed": t("orders"),
        "lineitem": t("lineitem"),
        "part": t("part"),
        "supplier": t("supplier"),
        "nation": t("nation"),
        "link": t("lineitem").select("l_partkey", "l_suppkey").distinct(),
        "edited_supplier": edited(t("supplier"), "s_suppkey"),
        "edited_part": edited(t("part"), "p_partkey"),
        "edited_orders": edited(t("orders"), "o_custkey"),
        "edited_customer": edited(t("customer"), "c_custkey"),
        "edited_events": edited(t("events"), "user_id"),
        "edited_closed": edited(t("orders"), "o_custkey"),
    }


def sizes(collection: D.Collection, key: str, owner: str, path: str, value: str, alias: str):
    """Per owner: number of elements of an array and the sum of one field, over all parts."""
    array = path.rpartition(".")[2]

    def digest(df, key_column, column):
        total = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x[value].cast("bigint"))
        return df.select(F.col(key_column).alias(key), F.size(column).cast("bigint").alias(f"n_{alias}"), total.alias(f"sum_{alias}"))

    rows = digest(collection.documents, key, path)
    if path in collection.continuations:
        rows = rows.unionByName(digest(collection.continuations[path], owner, array))
        rows = rows.groupBy(key).agg(F.sum(f"n_{alias}").alias(f"n_{alias}"), F.sum(f"sum_{alias}").alias(f"sum_{alias}"))
    return rows


def with_kept_once(rows, collection: D.Collection):
    """Add transactions that are kept once per customer ``c`` to ``n_tx`` of each of its orders."""
    path = "customer.customerTransactions"
    if path not in collection.continuations:
        return rows.drop("c")
    more = collection.continuations[path].groupBy(F.col("o_custkey").alias("c")).agg(
        F.sum(F.size("customerTransactions")).alias("more")
    )
    return rows.join(more, "c", "left").withColumn("n_tx", F.col("n_tx") + F.coalesce("more", F.lit(0))).drop("c", "more")


# --- documents ------------------------------------------------------------


@query("t1_root_documents", 'SELECT s_suppkey AS "supplierId", s_name AS "supplierName" FROM supplier')
def t1(t):
    root = D.TableMapping(D.NEW_DOCUMENT, "supplier", SUPPLIER_FIELDS)
    return D.build_collection("suppliers", root, sources(t), generate_id=False).documents


@query(
    "t2_embedded_object",
    """SELECT o_orderkey AS "orderId", c_custkey AS "customerId", c_name AS "customerName", c_acctbal AS "creditLimit"
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def t2(t):
    customer = D.TableMapping(D.EMBEDDED, "customer", CUSTOMER_FIELDS, "customer", ("o_custkey", "c_custkey"))
    root = D.TableMapping(D.NEW_DOCUMENT, "orders", ORDER_FIELDS, children=(customer,))
    return D.build_collection("orders", root, sources(t)).documents.select("orderId", "customer.*")


@query(
    "t3_embedded_array",
    """SELECT c_custkey AS "customerId", count(o_orderkey) AS n_tx, coalesce(sum(o_orderkey), 0)::BIGINT AS sum_tx
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def t3(t):
    orders = D.TableMapping(D.EMBEDDED_ARRAY, "orders", TRANSACTION_FIELDS, "transactions", ("c_custkey", "o_custkey"))
    root = D.TableMapping(D.NEW_DOCUMENT, "customer", CUSTOMER_FIELDS, children=(orders,))
    built = D.build_collection("customers", root, sources(t))
    return sizes(built, "customerId", "o_custkey", "transactions", "transactionId", "tx")


@query(
    "t4_nested_embedding",
    f"""SELECT c_custkey AS "customerId", n_nationkey AS "nationId", n_tx, sum_tx FROM nation JOIN customer ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n_tx, sum(o_orderkey)::BIGINT AS sum_tx FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey
        WHERE n_tx > 0""",
)
def t4(t):
    # An array inside the elements of an array, taken apart again to its owners.
    transactions = D.TableMapping(D.EMBEDDED_ARRAY, "closed", TRANSACTION_FIELDS, "transactions", ("c_custkey", "o_custkey"))
    customers = D.TableMapping(
        D.EMBEDDED_ARRAY, "customer", CUSTOMER_FIELDS, "customers", ("n_nationkey", "c_nationkey"), children=(transactions,)
    )
    root = D.TableMapping(
        D.NEW_DOCUMENT, "nation", (field("n_nationkey", "nationId", "INTEGER", key=True),), children=(customers,)
    )
    built = D.build_collection("nations", root, sources(t))
    inner = built.documents.select("nationId", F.explode("customers").alias("c"))
    if "customers" in built.continuations:
        more = built.continuations["customers"].select(F.col("c_nationkey").alias("nationId"), F.explode("customers").alias("c"))
        inner = inner.unionByName(more)
    # Whatever part of the transactions a customer carries is in ``c``; longer ones are continued by customer.
    x = F.col("c.transactions")
    total = F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y["transactionId"])
    rows = inner.select("nationId", F.col("c.customerId").alias("customerId"), F.size(x).cast("bigint").alias("n_tx"), total.alias("sum_tx"))
    if "customers.transactions" in built.continuations:
        more = built.continuations["customers.transactions"].select(
            F.col("o_custkey").alias("customerId"), F.explode("transactions").alias("y")
        )
        owner = rows.select("nationId", "customerId")
        more = more.groupBy("customerId").agg(F.count(F.lit(1)).alias("n_tx"), F.sum("y.transactionId").alias("sum_tx")).join(owner, "customerId")
        rows = rows.unionByName(more).groupBy("nationId", "customerId").agg(F.sum("n_tx").alias("n_tx"), F.sum("sum_tx").alias("sum_tx"))
    return rows.filter(F.col("n_tx") > 0)


@query(
    "t5_field_mapping",
    """SELECT l_orderkey AS "orderId", l_linenumber AS "lineNumber", l_partkey AS "stockItemId", l_suppkey AS "supplierId",
              CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS "unitPrice" FROM lineitem""",
)
def t5(t):
    root = D.TableMapping(D.NEW_DOCUMENT, "lineitem", (*LINE_FIELDS, field("l_tax", "taxRate", included=False)))
    return D.build_collection("orderLines", root, sources(t), generate_id=False).documents


@query(
    "t6_nulls_excluded",
    """SELECT 'kept' AS form, count(*) AS documents, count(*) AS with_field FROM customer
       UNION ALL SELECT 'excluded', count(*), count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') FROM customer""",
)
def t6(t):
    rows = t("customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment")
    )
    parts = []
    for form, exclude in (("kept", False), ("excluded", True)):
        path = scratch_dir(t.spark, "collection")
        files.write_documents(rows, path, exclude_nulls=exclude)
        lines = t.spark.read.text(path)
        parts.append(
            lines.agg(
                F.lit(form).alias("form"),
                F.count(F.lit(1)).alias("documents"),
                F.count_if(F.col("value").contains('"segment"')).alias("with_field"),
            )
        )
    return parts[0].unionByName(parts[1])


ROUND_TRIP = f"""SELECT o_orderkey AS "orderId", o_orderdate AS "orderDate", c_name AS "customerName",
            (SELECT count(*) FROM orders x WHERE x.o_custkey = orders.o_custkey) AS n_tx
        FROM orders JOIN customer ON c_custkey = o_custkey"""


def _round_trip(t, **bounds):
    path = scratch_dir(t.spark, "collection")
    files.write_collection(D.build_collection("orders", ORDERS, sources(t), **bounds), path)
    # From here on only what was written is read.
    back = files.read_collection(t.spark, path)
    rows = back.documents.select(
        "orderId",
        "orderDate",
        F.col("customer.customerId").alias("c"),
        "customer.customerName",
        F.size("customer.customerTransactions").cast("bigint").alias("n_tx"),
    )
    return with_kept_once(rows, back)


@query("src4_document_round_trip", ROUND_TRIP)
def src4(t):
    return _round_trip(t)


@query("src4_document_round_trip_in_parts", ROUND_TRIP)
def src4_parts(t):
    return _round_trip(t, max_items=4, repeat_items=2)


@query(
    "src4_parts_are_marked",
    f"""SELECT o_orderkey AS "orderId", (SELECT count(*) FROM orders x WHERE x.o_custkey = orders.o_custkey) <= 2 AS whole
        FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def src4_marked(t):
    path = scratch_dir(t.spark, "collection")
    files.write_collection(D.build_collection("orders", ORDERS, sources(t), max_items=4, repeat_items=2), path)
    back = files.read_collection(t.spark, path)
    return back.documents.select("orderId", (F.col("customer.customerTransactionsParts") == 1).alias("whole"))


@query(
    "t7_document_ids",
    """SELECT left(sha256('lines:' || l_orderkey || ':' || l_linenumber), 24) AS _id, l_orderkey AS "orderId", l_linenumber AS "lineNumber" FROM lineitem""",
)
def t7(t):
    root = D.TableMapping(D.NEW_DOCUMENT, "lineitem", LINE_FIELDS[:2])
    return D.build_collection("lines", root, sources(t)).documents


@query(
    "t8_orders_collection",
    f"""SELECT o_orderkey AS "orderId", o_orderpriority AS priority, c_name AS "customerName",
               coalesce(n_tx, 0) AS n_tx, coalesce(sum_tx, 0) AS sum_tx
        FROM orders JOIN customer ON c_custkey = o_custkey
        LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_tx, sum(o_orderkey)::BIGINT AS sum_tx FROM orders GROUP BY o_custkey) x ON k = o_custkey""",
)
def t8(t):
    built = D.build_collection("orders", ORDERS, sources(t))
    path = "customer.customerTransactions"
    total = F.aggregate(path, F.lit(0).cast("bigint"), lambda a, x: a + x["transactionId"])
    rows = built.documents.select(
        "orderId", "priority", F.col("customer.customerId").alias("c"), "customer.customerName", F.size(path).cast("bigint").alias("n_tx"), total.alias("sum_tx")
    )
    if path in built.continuations:
        # Transactions kept once per customer count for each of its orders.
        more = built.continuations[path].select(F.col("o_custkey").alias("c"), F.explode("customerTransactions").alias("x"))
        more = more.groupBy("c").agg(F.count(F.lit(1)).alias("n2"), F.sum("x.transactionId").alias("s2"))
        rows = rows.join(more, "c", "left").withColumn("n_tx", F.col("n_tx") + F.coalesce("n2", F.lit(0)))
        rows = rows.withColumn("sum_tx", F.col("sum_tx") + F.coalesce("s2", F.lit(0)))
    return rows.select("orderId", "priority", "customerName", "n_tx", "sum_tx")


def placed(rows, key, path, names):
    """Every element of an array in documents with its place and fields."""
    rows = rows.select(F.col(key).alias("owner"), F.posexplode(path).alias("at", "x"))
    return rows.select("owner", "at", *[F.col(f"x.{n}").alias(n) for n in names])


@query(
    "t3_transactions_in_full",
    """SELECT o_custkey AS owner, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS at, o_orderkey AS "transactionId",
              o_orderdate AS "transactionDate", o_totalprice AS amount FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def t3_full(t):
    orders = D.TableMapping(D.EMBEDDED_ARRAY, "orders", TRANSACTION_FIELDS, "transactions", ("c_custkey", "o_custkey"))
    root = D.TableMapping(D.NEW_DOCUMENT, "customer", CUSTOMER_FIELDS, children=(orders,))
    built = D.build_collection("customers", root, sources(t))
    return placed(built.documents, "customerId", "transactions", ["transactionId", "transactionDate", "amount"])


@query(
    "t8_transactions_in_full",
    """SELECT o_orderkey AS "orderId", texts FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN (SELECT o_custkey AS k, string_agg(o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':' || printf('%.2f', o_totalprice), ',' ORDER BY o_orderkey) AS texts
             FROM orders GROUP BY o_custkey) ON k = o_custkey""",
)
def t8_full(t):
    built = D.build_collection("orders", ORDERS, sources(t))
    # Each customer's elements become text once, then meet its documents.
    text = F.transform(
        "customer.customerTransactions",
        lambda x: F.concat_ws(":", x["transactionId"].cast("string"), F.date_format(x["transactionDate"], "yyyy-MM-dd"), F.format_string("%.2f", x["amount"])),
    )
    return built.documents.select("orderId", F.array_join(text, ",").alias("texts"))


@query(
    "t9_groups_in_full",
    """SELECT l_orderkey AS "orderId", l_linenumber AS "lineNumber", texts FROM lineitem JOIN part ON p_partkey = l_partkey
       JOIN (SELECT l_partkey AS k, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_suppkey) AS texts
             FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey) ON k = l_partkey""",
)
def t9_full(t):
    built = D.build_collection("orderLines", ORDER_LINES, sources(t))
    text = F.transform("stockItem.stockItemStockGroups", lambda x: F.concat_ws(":", x["stockItemId"].cast("string"), x["stockGroupId"].cast("string")))
    return built.documents.select("orderId", "lineNumber", F.array_join(text, ",").alias("texts"))


@query(
    "t10_purchases_in_full",
    """SELECT l_suppkey AS owner, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER), l_extendedprice) - 1 AS INTEGER) AS at,
              l_orderkey AS "orderId", l_linenumber AS "lineNumber", l_partkey AS "stockItemId", CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS "unitPrice"
       FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)""",
)
def t10_full(t):
    built = D.build_collection("suppliers", SUPPLIERS, sources(t))
    return placed(built.documents, "supplierId", "purchaseOrders", ["orderId", "lineNumber", "stockItemId", "quantity", "unitPrice"])


@query(
    "t10_purchases_in_parts",
    """SELECT l_suppkey AS owner, l_orderkey AS "orderId", l_linenumber AS "lineNumber", l_partkey AS "stockItemId", count(*) AS n
       FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 1) GROUP BY ALL""",
    grouping=True,
)
def t10_parts(t):
    # A small bound cuts every array; the busy supplier 1 has lines but no document, so its parts go too.
    tables = sources(t) | {"supplier": t("supplier").filter("s_suppkey > 1")}
    built = D.build_collection("suppliers", SUPPLIERS, tables, max_items=16)
    path = "purchaseOrders"
    rows = built.documents.select(F.col("supplierId").alias("owner"), F.explode(path).alias("x"))
    if path in built.continuations:
        rows = rows.unionAll(built.continuations[path].select(F.col("l_suppkey").alias("owner"), F.explode(path).alias("x")))
    return rows.groupBy("owner", "x.orderId", "x.lineNumber", "x.stockItemId").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t9_order_lines_collection",
    """SELECT l_orderkey AS "orderId", l_linenumber AS "lineNumber", CAST(l_quantity AS INTEGER) AS quantity, p_name AS "stockItemName", n_groups
       FROM lineitem JOIN part ON p_partkey = l_partkey
       JOIN (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY l_partkey) x ON k = l_partkey""",
)
def t9(t):
    built = D.build_collection("orderLines", ORDER_LINES, sources(t))
    path = "stockItem.stockItemStockGroups"
    rows = built.documents.select(
        "orderId", "lineNumber", "quantity", F.col("stockItem.stockItemId").alias("k"), "stockItem.stockItemName", F.size(path).cast("bigint").alias("n_groups")
    )
    if path in built.continuations:
        more = built.continuations[path].groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.size("stockItemStockGroups")).alias("n2"))
        rows = rows.join(more, "k", "left").withColumn("n_groups", F.col("n_groups") + F.coalesce("n2", F.lit(0)))
    return rows.drop("k", "n2")


@query(
    "t10_suppliers_collection",
    """SELECT s_suppkey AS "supplierId", n_items, sum_items, n_orders, sum_orders FROM supplier
       JOIN (SELECT l_suppkey, count(*) AS n_items, sum(l_partkey)::BIGINT AS sum_items FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey) a ON a.l_suppkey = s_suppkey
       JOIN (SELECT l_suppkey, count(*) AS n_orders, sum(l_orderkey)::BIGINT AS sum_orders FROM lineitem GROUP BY l_suppkey) b ON b.l_suppkey = s_suppkey""",
)
def t10(t):
    built = D.build_collection("suppliers", SUPPLIERS, sources(t))
    items = sizes(built, "supplierId", "l_suppkey", "stockItems", "stockItemId", "items")
    orders = sizes(built, "supplierId", "l_suppkey", "purchaseOrders", "orderId", "orders")
    return items.join(orders, "supplierId")


_EDITED = (
    ("stockGroups", "supplierId", "s_suppkey", "supplier", "s_suppkey"),
    ("stockItems", "stockItemId", "p_partkey", "part", "p_partkey"),
    ("purchaseOrders", "orderId", "o_orderkey", "orders", "o_custkey"),
    ("customers", "customerId", "c_custkey", "customer", "c_custkey"),
    ("stockItemStockGroups", "eventId", "event_id", "events", "user_id"),
    ("customerTransactions", "transactionId", "o_orderkey", "orders", "o_custkey"),
)


@query(
    "t11_people_collection",
    " UNION ALL ".join(
        f"""SELECT '{path}' AS path, n_nationkey AS "personId", count(k) AS n, coalesce(sum(k), 0)::BIGINT AS total
            FROM nation LEFT JOIN (SELECT {value} AS k, {editor} % 25 AS e FROM {table}) ON e = n_nationkey GROUP BY n_nationkey"""
        for path, _, value, table, editor in _EDITED
    ),
    grouping=True,
)
def t11(t):
    built = D.build_collection("people", PEOPLE, sources(t))

    def total(path, value):
        return F.aggregate(path, F.lit(0).cast("bigint"), lambda a, x: a + x[value].cast("bigint"))

    def branches(df, key, names):
        """One row per branch and document, in one pass over the documents."""
        every = [
            F.struct(F.lit(path).alias("path"), F.size(path).cast("bigint").alias("n"), total(path, value).alias("total"))
            for path, value in names
        ]
        return df.select(F.col(key).alias("personId"), F.explode(F.array(*every)).alias("b")).select("b.path", "personId", "b.n", "b.total")

    rows = branches(built.documents, "personId", [(p, v) for p, v, *_ in _EDITED])
    for path, value, *_ in _EDITED:
        if path in built.continuations:
            rows = rows.unionByName(branches(built.continuations[path], "editor", [(path, value)]))
    if built.continuations:
        rows = rows.groupBy("path", "personId").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return rows


def projects(t):
    """One mapping project per part as JSON text, its names and flags taken from the row."""
    s = F.struct

    def entry(target, included, target_type, source, sql_type, key):
        return s(
            s(F.lit(target).alias("name") if isinstance(target, str) else target.alias("name"), included.alias("included"), F.lit(target_type).alias("type")).alias("target"),
            s(F.lit(source).alias("name") if isinstance(source, str) else source.alias("name"), F.lit(sql_type).alias("databaseSpecificType"), F.lit(key).alias("isPrimaryKey")).alias("source"),
        )

    yes = F.lit(True)
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    fields = s(
        entry("partId", yes, "integer", "PartID", "INT", True).alias("PartID"),
        entry("_id", yes, "OBJECT_ID", "_id", "NONE", False).alias("_id"),
        entry(noun, F.col("p_size") > 10, "string", noun, "nvarchar", False).alias("Noun"),
        entry("brand", yes, "STRING", "Brand", "nvarchar", False).alias("brand"),
        entry("Brand", yes, "STRING", "BRAND", "varchar", False).alias("BRAND_2"),
        entry("  ", yes, "STRING", "Blank", "nvarchar", False).alias("Blank"),
    )
    content = s(
        s(s(F.col("p_type").alias("name")).alias("c1")).alias("collections"),
        s(s(s(F.lit("db").alias("database"), F.col("p_brand").alias("schema"), F.initcap(noun).alias("table")).alias("path")).alias("t1")).alias("tables"),
        s(
            s(
                s(F.when(F.col("p_size") % 2 == 0, "embedded_document").otherwise("NEW_DOCUMENT").alias("type"), F.lit("part").alias("embeddedPath")).alias("settings"),
                fields.alias("fields"),
                F.lit("c1").alias("collectionId"),
                F.lit("t1").alias("table"),
            ).alias("m1")
        ).alias("mappings"),
    )
    return t.dealt("part", "p_partkey").select("p_partkey", F.to_json(s(s(content.alias("content")).alias("project"))).alias("text"))


@query(
    "t12_mapping_table",
    """WITH p AS (SELECT *, split_part(p_name, ' ', 2) AS noun FROM part),
       f AS (SELECT p.*, 'PartID' AS source_column, 'int' AS sql_type, true AS is_primary_key, 'partId' AS target_property, 'INTEGER' AS target_type FROM p
             UNION ALL SELECT p.*, noun, 'nvarchar', false, noun, 'STRING' FROM p WHERE p_size > 10
             UNION ALL SELECT p.*, 'Brand', 'nvarchar', false, 'brand', 'STRING' FROM p)
       SELECT p_partkey, p_type AS collection, CASE WHEN p_size % 2 = 0 THEN 'EMBEDDED_DOCUMENT' ELSE 'NEW_DOCUMENT' END AS mapping_type,
              'db.' || p_brand AS source_schema, upper(left(noun, 1)) || substr(noun, 2) AS source_table,
              CASE WHEN p_size % 2 = 0 THEN 'part' ELSE '' END AS embedded_path, source_column, sql_type, is_primary_key, target_property, target_type FROM f""",
)
def t12(t):
    rows = D.mapping_rows(projects(t), "text", ["p_partkey"])
    return rows.drop("mapping_id").withColumn("embedded_path", F.coalesce("embedded_path", F.lit("")))


# --- a mapping project for the local tables ---------------------------------

DATABASE = "local.main"
# Mapping id: collection, kind, table, path, foreign key, (source, target, type, key, excluded, null left out), children.
LOCAL_MAPPINGS = {
    "order": ("orders", D.NEW_DOCUMENT, "orders", None, None, ORDER_FIELDS, ["order-customer"]),
    "order-customer": ("orders", D.EMBEDDED, "customer", "customer", "fk_orders_customer", CUSTOMER_FIELDS, ["order-customer-tx"]),
    "order-customer-tx": ("orders", D.EMBEDDED_ARRAY, "closed", "customerTransactions", "fk_closed_customer", TRANSACTION_FIELDS, []),
    "supplier": ("suppliers", D.NEW_DOCUMENT, "supplier", None, None, SUPPLIER_FIELDS, ["supplier-items", "supplier-orders"]),
    "supplier-items": ("suppliers", D.EMBEDDED_ARRAY, "link", "stockItems", "fk_link_supplier", LINK_FIELDS, []),
    "supplier-orders": ("suppliers", D.EMBEDDED_ARRAY, "lineitem", "purchaseOrders", "fk_lineitem_supplier", LINE_FIELDS, []),
}
LOCAL_KEYS = (
    ("fk_orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("fk_closed_customer", "closed", "o_custkey", "customer", "c_custkey"),
    ("fk_link_supplier", "link", "l_suppkey", "supplier", "s_suppkey"),
    ("fk_lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
)


def project_text(mappings=None, keys=LOCAL_KEYS, names=("orders", "suppliers")):
    """A mapping project over the local tables as its JSON text."""
    mappings = mappings or LOCAL_MAPPINGS
    database, schema = DATABASE.split(".")
    tables = sorted({m[2] for m in mappings.values()})

    def entry(f):
        target = {"name": f.target, "included": f.included, "isNullExcluded": f.null_excluded, "type": f.type}
        return {"target": target, "source": {"name": f.source, "databaseSpecificType": "int", "isPrimaryKey": f.primary_key}}

    def mapping(collection, kind, table, path, key, fields, _):
        settings = {"type": kind} | ({"embeddedPath": path, "foreignKeyName": key} if path else {})
        # The names of the members give the order of the fields.
        return {"settings": settings, "fields": {f"{k:02}": entry(f) for k, f in enumerate(fields)}, "collectionId": collection, "table": table}

    columns = {}
    for name, table, column, other, referred in keys:
        columns.setdefault(table, {})[column] = {"foreignKey": {"name": name, "schema": schema, "table": other, "column": referred}}
    content = {
        "collections": {n: {"name": n} for n in names},
        "tables": {t: {"path": {"database": database, "schema": schema, "table": t}} for t in tables},
        "mappings": {k: mapping(*m) for k, m in mappings.items()},
        "relationships": {"mappings": {k: {"children": m[6]} for k, m in mappings.items()}},
    }
    catalog = {"full": {"databases": {database: {"schemas": {schema: {"tables": {t: {"columns": c} for t, c in columns.items()}}}}}}}
    return json.dumps({"project": {"content": content}, "schema": catalog})


def local_project(t, text=None):
    return P.read_projects(t.spark.sql("SELECT :text AS text", args={"text": text or project_text()}), "text")


def project_tables(t):
    """The tables by their full names."""
    return {f"{DATABASE}.{name}": df for name, df in sources(t).items()}


@query(
    "t12_project_builds_orders",
    """SELECT o_orderkey AS "orderId", o_custkey AS "customerId", o_orderpriority AS priority, c_name AS "customerName", n_tx, sum_tx
        FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN (SELECT o_custkey AS k, count(*) AS n_tx, sum(o_orderkey)::BIGINT AS sum_tx FROM orders GROUP BY o_custkey) x ON k = o_custkey""",
)
def t12_orders(t):
    built = P.build_project(local_project(t), project_tables(t))["orders"]
    path = "customer.customerTransactions"
    total = F.aggregate(path, F.lit(0).cast("bigint"), lambda a, x: a + x["transactionId"])
    rows = built.documents.select(
        "orderId", "customerId", "priority", F.col("customer.customerName"), F.size(path).cast("bigint").alias("n_tx"), total.alias("sum_tx")
    )
    if path in built.continuations:
        more = built.continuations[path].select(F.col("o_custkey").alias("c"), F.explode("customerTransactions").alias("x"))
        more = more.groupBy("c").agg(F.count(F.lit(1)).alias("n2"), F.sum("x.transactionId").alias("s2"))
        rows = rows.join(more, F.col("customerId") == F.col("c"), "left").withColumn("n_tx", F.col("n_tx") + F.coalesce("n2", F.lit(0)))
        rows = rows.withColumn("sum_tx", F.col("sum_tx") + F.coalesce("s2", F.lit(0))).drop("c", "n2", "s2")
    return rows


@query(
    "t12_project_builds_suppliers",
    """SELECT s_suppkey AS "supplierId", n_items, sum_items, n_orders, sum_orders FROM supplier
       JOIN (SELECT l_suppkey, count(*) AS n_items, sum(l_partkey)::BIGINT AS sum_items FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey) a ON a.l_suppkey = s_suppkey
       JOIN (SELECT l_suppkey, count(*) AS n_orders, sum(l_orderkey)::BIGINT AS sum_orders FROM lineitem GROUP BY l_suppkey) b ON b.l_suppkey = s_suppkey""",
)
def t12_suppliers(t):
    built = P.build_project(local_project(t), project_tables(t))["suppliers"]
    items = sizes(built, "supplierId", "l_suppkey", "stockItems", "stockItemId", "items")
    orders = sizes(built, "supplierId", "l_suppkey", "purchaseOrders", "orderId", "orders")
    return items.join(orders, "supplierId")


@query(
    "t12_project_fields",
    "SELECT * FROM (VALUES " + ", ".join(
        f"('{m}', '{f.source}', '{f.target}', '{f.type or ''}', {f.primary_key}, {f.included}, {n}::BIGINT)"
        for m, (_, _, table, _, _, fields, _) in LOCAL_MAPPINGS.items()
        for f in fields
        for n in (f"(SELECT count(*) FROM {'lineitem' if table == 'link' else 'orders' if table == 'closed' else table})",)
    ) + ") AS f(mapping_id, source_column, target_property, target_type, is_primary_key, included, n_rows)",
)
def t12_fields(t):
    """The mapped columns of a project with the rows of the table that each is read from."""
    project = local_project(t)
    counts = None
    for table, df in {"orders": t("orders"), "closed": t("orders"), "customer": t("customer"), "supplier": t("supplier"), "lineitem": t("lineitem"), "link": t("lineitem")}.items():
        one = df.agg(F.lit(f"{DATABASE}.{table}").alias("source_table"), F.count(F.lit(1)).alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    rows = project.fields.join(project.mappings.select("mapping_id", "source_table"), "mapping_id").join(counts, "source_table")
    return rows.select("mapping_id", "source_column", "target_property", F.coalesce("target_type", F.lit("")).alias("target_type"), "is_primary_key", "included", "n_rows")


def null_flags(excluded):
    """The customer mapping with two fields that may be null, one of them left out where it is."""
    fields = (
        field("c_custkey", "customerId", "LONG", key=True),
        field("segment", "segment", "STRING"),
        D.Field("region", "region", "STRING", null_excluded=excluded),
    )
    order = (field("o_orderkey", "orderId", "LONG", key=True), D.Field("late", "late", "LONG", null_excluded=excluded))
    mappings = {
        "customer": ("customers", D.NEW_DOCUMENT, "shown_customer", None, None, fields, ["customer-orders"]),
        "customer-orders": ("customers", D.EMBEDDED_ARRAY, "shown_orders", "orders", "fk_orders_customer", order, []),
    }
    keys = (("fk_orders_customer", "shown_orders", "o_custkey", "shown_customer", "c_custkey"),)
    return project_text(mappings, keys, ("customers",))


@query(
    "t6_null_flags_per_field",
    """WITH o AS (
           SELECT o_custkey, count(*) AS n, string_agg('{"orderId":' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ',"late":' || o_orderkey ELSE '' END || '}', ',' ORDER BY o_orderkey) AS items
           FROM orders GROUP BY o_custkey)
       SELECT c_custkey AS "customerId", '{"customerId":' || c_custkey
           || ',"segment":' || CASE WHEN c_mktsegment <> 'BUILDING' THEN '"' || c_mktsegment || '"' ELSE 'null' END
           || CASE WHEN c_nationkey % 2 = 0 THEN ',"region":"' || c_nationkey || '"' ELSE '' END
           || ',"ordersParts":1,"orders":[' || coalesce(items, '') || ']}' AS document
       FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def t6_flags(t):
    """Documents as text: the nulls of one field stay, those of two others are left out, as the project says."""
    tables = {
        f"{DATABASE}.shown_customer": t("customer").select(
            "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("region")
        ),
        f"{DATABASE}.shown_orders": t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("late")),
    }
    root = P.compile_project(local_project(t, null_flags(True)))["customers"]
    built = D.build_collection("customers", root, tables, generate_id=False)
    return built.documents.select("customerId", P.document_text(root, generate_id=False).alias("document"))


@query(
    "t13_document_reads",
    f"""WITH x AS (SELECT o_orderkey, o_orderdate, c_custkey, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey
                   WHERE c_acctbal > 5000 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31')
        SELECT c_custkey AS "customerId", count(*) AS n, min(o_orderkey) AS first_order FROM x GROUP BY c_custkey""",
    grouping=True,
)
def t13(t):
    docs = D.build_collection("orders", ORDERS, sources(t)).documents
    kept = docs.filter(
        (F.col("customer.creditLimit") > 5000)
        & R.between(F.col("orderDate"), dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31))
    )
    return kept.groupBy(F.col("customer.customerId").alias("customerId")).agg(
        F.count(F.lit(1)).alias("n"), F.min("orderId").alias("first_order")
    )


@query(
    "t14_unnested_rows",
    f"""SELECT DISTINCT o_orderkey AS "transactionId", o_orderdate AS "transactionDate", o_totalprice AS amount FROM orders
        WHERE o_custkey IN (SELECT o_custkey FROM orders)""",
)
def t14(t):
    built = D.build_collection("orders", ORDERS, sources(t))
    path = "customer.customerTransactions"
    # One document of each customer has all there is; the customer's number tells them apart.
    rows = D.unnest(built.documents, path, owner="customer.customerId")
    if path in built.continuations:
        rows = rows.unionByName(D.unnest(built.continuations[path], "customerTransactions")).distinct()
    return rows


# --- graph ----------------------------------------------------------------

NODES = [
    G.NodeMapping("Order", "orders", ("o_orderkey",), {"o_orderkey": "orderId", "o_orderdate": "orderDate", "o_totalprice": "total"}, "Sales.Orders"),
    G.NodeMapping("Customer", "customer", ("c_custkey",), {"c_custkey": "customerId", "c_name": "customerName", "c_acctbal": "creditLimit"}, "Sales.Customers"),
    G.NodeMapping("OrderLine", "numbered", ("row_key",), {"row_key": "orderLineId", "l_quantity": "quantity", "l_tax": "taxRate", "l_shipdate": "pickingCompletedWhen"}, "Sales.OrderLines"),
    G.NodeMapping("CustomerTransaction", "closed", ("o_orderkey",), {"o_orderkey": "customerTransactionId", "o_totalprice": "transactionAmount"}, "Sales.CustomerTransactions"),
]
EDGES = [
    G.EdgeMapping("customers", "orders", ("Sales.Orders", ("o_orderkey",)), ("Sales.Customers", ("o_custkey",))),
    G.EdgeMapping("orders", "numbered", ("Sales.OrderLines", ("row_key",)), ("Sales.Orders", ("l_orderkey",)), {"l_quantity": "quantity"}),
    G.EdgeMapping("customers", "closed", ("Sales.CustomerTransactions", ("o_orderkey",)), ("Sales.Customers", ("o_custkey",))),
]
_ROW_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || epoch(l_shipdate)::BIGINT"


def graph_sources(t):
    lines = t("lineitem").withColumn(
        "row_key",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")),
    )
    return {"orders": t("orders"), "customer": t("customer"), "closed": t("orders"), "numbered": lines}


@query(
    "g1n_node_table",
    """SELECT 'Sales.Customers:' || c_custkey AS id, 'Customer' AS label, c_custkey AS "customerId", c_name AS "customerName", c_acctbal AS "creditLimit" FROM customer""",
)
def g1n(t):
    return G.build_nodes(graph_sources(t), NODES)["Customer"]


@query(
    "g3n_merged_label",
    """SELECT 'Party:C' || c_custkey AS id, 'Party' AS label, c_name AS name, c_mktsegment AS segment, -1.0::DOUBLE AS balance FROM customer
       UNION ALL SELECT 'Party:S' || s_suppkey, 'Party', s_name, '', s_acctbal FROM supplier""",
)
def g3n(t):
    tables = {
        "c": t("customer").withColumn("k", F.concat(F.lit("C"), F.col("c_custkey").cast("string"))),
        "s": t("supplier").withColumn("k", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))),
    }
    party = G.build_nodes(
        tables,
        [
            G.NodeMapping("Party", "c", ("k",), {"c_name": "name", "c_mktsegment": "segment"}),
            G.NodeMapping("Party", "s", ("k",), {"s_name": "name", "s_acctbal": "balance"}),
        ],
    )["Party"]
    return party.select("id", "label", "name", F.coalesce("segment", F.lit("")).alias("segment"), F.coalesce("balance", F.lit(-1.0)).alias("balance"))


@query(
    "g4n_edge_table",
    """SELECT 'Sales.Orders:' || o_orderkey AS src, 'Sales.Customers:' || o_custkey AS dst, 'CUSTOMERS' AS type FROM orders""",
)
def g4n(t):
    return G.build_edges(graph_sources(t), EDGES)[("CUSTOMERS", "Sales.Orders", "Sales.Customers")]


@query(
    "g5n_edge_properties",
    f"""SELECT 'Sales.OrderLines:' || {_ROW_KEY} AS src, 'Sales.Orders:' || l_orderkey AS dst, 'ORDERS' AS type, l_quantity AS quantity FROM lineitem""",
)
def g5n(t):
    return G.build_edges(graph_sources(t), EDGES)[("ORDERS", "Sales.OrderLines", "Sales.Orders")]


@query(
    "g7n_repaired_types",
    """SELECT event_id, epoch_us(ts) AS at_us, date_trunc('day', ts)::DATE AS day, event_type AS kind,
              CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE event_type END AS mixed FROM events""",
)
def g7n(t):
    exported = t("events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type")).alias("mixed"),
    )
    return G.repair_types(exported).select("event_id", F.unix_micros("at").alias("at_us"), "day", "kind", "mixed")


@query(
    "g7n_repair_report",
    """SELECT 'day' AS property, count(*) AS known, 0 AS timestamps, count(*) AS dates FROM events
       UNION ALL SELECT 'kind', count(*), 0, 0 FROM events
       UNION ALL SELECT 'mixed', count(*), 0, count(*) FILTER (WHERE event_type = 'view') FROM events""",
)
def g7n_report(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    exported = t("events").select(
        day.alias("day"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "view", day).otherwise(F.col("event_type")).alias("mixed")
    )
    return G.repair_report(exported)


@query(
    "g8n_edge_direction",
    """SELECT 'CUSTOMERS' AS type, 'Order' AS child, count(*) AS edges, count(DISTINCT o_custkey) AS parents FROM orders
       UNION ALL SELECT 'ORDERS', 'OrderLine', count(*), count(DISTINCT l_orderkey) FROM lineitem
       UNION ALL SELECT 'CUSTOMERS', 'CustomerTransaction', count(*), count(DISTINCT o_custkey) FROM orders""",
    grouping=True,
)
def g8n(t):
    parts = None
    names = {"Sales.Orders": "Order", "Sales.OrderLines": "OrderLine", "Sales.CustomerTransactions": "CustomerTransaction"}
    for (kind, start, _), df in G.build_edges(graph_sources(t), EDGES).items():
        per_parent = df.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        one = per_parent.agg(
            F.lit(kind).alias("type"), F.lit(names[start]).alias("child"), F.sum("n").alias("edges"), F.count(F.lit(1)).alias("parents")
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(
    "g9n_pattern_with_branches",
    f"""WITH l AS (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY l_orderkey),
             x AS (SELECT o_custkey AS k, count(*) AS n_tx, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY o_custkey)
        SELECT o_orderkey AS "orderId", c_name AS "customerName", n_lines, quantity, n_tx, CAST(amount AS DOUBLE) AS amount
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey JOIN x ON k = o_custkey""",
)
def g9n(t):
    nodes, edges = G.build_nodes(graph_sources(t), NODES), G.build_edges(graph_sources(t), EDGES)
    paid = G.collect_incoming(
        nodes["Customer"],
        edges[("CUSTOMERS", "Sales.CustomerTransactions", "Sales.Customers")],
        nodes["CustomerTransaction"],
        "transactions",
        ["customerTransactionId", "transactionAmount"],
        keep_all=False,
    )
    amount = F.aggregate("transactions", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x["transactionAmount"].cast(MONEY)).cast("decimal(38,2)"))
    # Reduced to what is read, before it is repeated per order.
    paid = paid.reduced(n_tx=(F.size("transactions").cast("bigint"), "sum"), amount=(amount, "sum"))
    paid = paid.select("id", "customerName", "n_tx", F.col("amount").cast("double").alias("amount"))
    lined = G.collect_incoming(
        nodes["Order"], edges[("ORDERS", "Sales.OrderLines", "Sales.Orders")], nodes["OrderLine"], "lines", ["orderLineId", "quantity"], keep_all=False
    )
    quantity = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"].cast("bigint"))
    lined = lined.reduced(n_lines=(F.size("lines").cast("bigint"), "sum"), quantity=(quantity, "sum"))
    lined = lined.select("id", "orderId", "n_lines", "quantity")
    matched = G.follow(lined, edges[("CUSTOMERS", "Sales.Orders", "Sales.Customers")], paid, name="c")
    return matched.select("orderId", "c.customerName", "n_lines", "quantity", "c.n_tx", "c.amount")


@query(
    "g10n_node_range",
    f"""SELECT {_ROW_KEY} AS "orderLineId", l_quantity AS quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-12-20' AND TIMESTAMP '1996-12-31'""",
)
def g10n(t):
    lines = G.build_nodes(graph_sources(t), NODES)["OrderLine"]
    return lines.filter(R.between(F.col("pickingCompletedWhen"), dt.datetime(1996, 12, 20), dt.datetime(1996, 12, 31))).select("orderLineId", "quantity")


@query("g10n_node_group_count", 'SELECT l_tax AS "taxRate", count(*) AS count FROM lineitem GROUP BY l_tax', grouping=True)
def g10n_count(t):
    return R.count_by(G.build_nodes(graph_sources(t), NODES)["OrderLine"], "taxRate")


@query(
    "g10n_node_top",
    f"""SELECT *, row_number() OVER (ORDER BY quantity DESC, "orderLineId") AS position
        FROM (SELECT {_ROW_KEY} AS "orderLineId", l_quantity AS quantity FROM lineitem ORDER BY 2 DESC, 1 LIMIT 50)""",
)
def g10n_top(t):
    lines = G.build_nodes(graph_sources(t), NODES)["OrderLine"].select("orderLineId", "quantity")
    order = [("quantity", "desc"), "orderLineId"]
    return R.numbered(R.top(lines, 50, *order), *order)


@query(
    "g11n_decimals_as_doubles",
    """SELECT 'Order:' || o_orderkey AS id, 'Order' AS label, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM orders""",
)
def g11n(t):
    tables = {"o": t("orders").withColumn("price", F.col("o_totalprice").cast(MONEY))}
    return G.build_nodes(tables, [G.NodeMapping("Order", "o", ("o_orderkey",), {"price": "total"})])["Order"]


@query(
    "src5_graph_round_trip",
    """SELECT 'node' AS kind, 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'node', 'Order', count(*) FROM orders
       UNION ALL SELECT 'edge', 'CUSTOMERS', count(*) FROM orders""",
)
def src5(t):
    nodes, edges = G.build_nodes(graph_sources(t), NODES), G.build_edges(graph_sources(t), EDGES)
    name = ("CUSTOMERS", "Sales.Orders", "Sales.Customers")
    path = scratch_dir(t.spark, "graph")
    files.write_graph({k: nodes[k] for k in ("Customer", "Order")}, {name: edges[name]}, path)

    def counted(folder, kind, label):
        return t.spark.read.parquet(folder).agg(F.lit(kind).alias("kind"), F.lit(label).alias("name"), F.count(F.lit(1)).alias("n"))

    return (
        counted(f"{path}/nodes/Customer", "node", "Customer")
        .unionByName(counted(f"{path}/nodes/Order", "node", "Order"))
        .unionByName(counted(f"{path}/edges/{'/'.join([name[0], '-'.join(name[1:])])}", "edge", "CUSTOMERS"))
    )


def _graph_sql():
    ids = {
        "Order": ("orders", "'Sales.Orders:' || o_orderkey"),
        "Customer": ("customer", "'Sales.Customers:' || c_custkey"),
        "OrderLine": ("lineitem", f"'Sales.OrderLines:' || {_ROW_KEY}"),
        "CustomerTransaction": ("orders", "'Sales.CustomerTransactions:' || o_orderkey"),
    }
    parts = [f"SELECT 'node' AS kind, '{label}' AS name, {id_} AS a, '' AS b FROM {table}" for label, (table, id_) in ids.items()]
    parts += [
        "SELECT 'edge', 'CUSTOMERS', 'Sales.Orders:' || o_orderkey, 'Sales.Customers:' || o_custkey FROM orders",
        f"SELECT 'edge', 'ORDERS', 'Sales.OrderLines:' || {_ROW_KEY}, 'Sales.Orders:' || l_orderkey FROM lineitem",
        f"SELECT 'edge', 'CUSTOMERS', 'Sales.CustomerTransactions:' || o_orderkey, 'Sales.Customers:' || o_custkey FROM orders",
    ]
    return " UNION ALL ".join(parts)


@query("src5_graph_in_full", _graph_sql())
def src5_full(t):
    nodes, edges = G.build_nodes(graph_sources(t), NODES), G.build_edges(graph_sources(t), EDGES)
    path = scratch_dir(t.spark, "graph")
    files.write_graph(nodes, edges, path)
    out = []
    for label in nodes:
        out.append(t.spark.read.parquet(f"{path}/nodes/{label}").select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.col("id").alias("a"), F.lit("").alias("b")))
    for kind, start, end in edges:
        read = t.spark.read.parquet(f"{path}/edges/{kind}/{start}-{end}")
        out.append(read.select(F.lit("edge").alias("kind"), F.col("type").alias("name"), F.col("src").alias("a"), F.col("dst").alias("b")))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionAll(part)
    return rows


@query("src5_graph_as_csv", _graph_sql())
def src5_csv(t):
    nodes, edges = G.build_nodes(graph_sources(t), NODES), G.build_edges(graph_sources(t), EDGES)
    path = scratch_dir(t.spark, "graph")
    files.write_graph_csv(nodes, edges, path, {"Order": "Sales.Orders"})
    read = t.spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
    out = []
    for label in nodes:
        df = read.csv(f"{path}/nodes/{label}")
        out.append(df.select(F.lit("node").alias("kind"), F.col("`:LABEL`").alias("name"), F.col(f"`{df.columns[0]}`").alias("a"), F.lit("").alias("b")))
    for kind, start, end in edges:
        df = read.csv(f"{path}/edges/{kind}/{start}-{end}")
        ends = {c.split("(")[0]: c for c in df.columns}
        out.append(df.select(F.lit("edge").alias("kind"), F.col("`:TYPE`").alias("name"), F.col(f"`{ends[':START_ID']}`").alias("a"), F.col(f"`{ends[':END_ID']}`").alias("b")))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionAll(part)
    return rows


# --- graph mapping files --------------------------------------------------


def graph_files(t):
    """One graph mapping file per part as JSON text: two node objects of one label and two relationships."""
    s = F.struct
    noun = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    table = F.concat(noun, F.when(F.col("p_size") % 2 == 0, "s").otherwise("ies"))

    def text(v):
        return F.lit(v) if v is None or isinstance(v, str) else v

    def entry(kind, column, name=None, space=None, type_=None, sql=None, table_=None):
        return s(
            s(text(kind).alias("type"), text(name).cast("string").alias("name"), text(space).cast("string").alias("id-space"), text(type_).cast("string").alias("neo4j-data-type")).alias("field"),
            s(text(column).alias("name"), text(table_).cast("string").alias("table"), text(sql).cast("string").alias("sql-data-type")).alias("column"),
        )

    def obj(kind, *entries):
        return s(F.lit(kind).alias("graph-object-type"), F.col("p_brand").alias("schema"), F.array(*entries).alias("mappings"))

    space = F.concat(F.lit("db."), table)
    known = obj(
        "Node",
        entry("Id", "ItemID", space=space, table_=table),
        entry("Data", "ItemID", "itemId", type_="int", sql="INT", table_=table),
        entry("Data", "Name", "name", type_="string", sql="nvarchar", table_=table),
        entry("Data", "NAME", "Name", type_="string", sql="text", table_=table),
    )
    again = obj(
        "Node",
        entry("Id", "OtherID", table_=table),
        entry("Data", "Name", "name", type_="string", sql=F.col("p_type"), table_=table),
        entry("Data", "Size", "size", type_="int", sql="int", table_=table),
    )
    linked = obj(
        "Relationship",
        entry("StartId", "ItemID", space=F.lower(space), table_="Links"),
        entry("EndId", "PersonID", space="app.Authorities", table_="Links"),
        entry("RelationshipType", F.lower(noun)),
        entry("Data", "Since", "since", type_="date", sql="date"),
    )
    broken = obj("Relationship", entry("StartId", "ItemID", space=space, table_="Links"), entry("RelationshipType", "x"))
    return t.dealt("part", "p_partkey").select("p_partkey", F.to_json(F.array(known, again, linked, broken)).alias("text"))


_GRAPH = """g AS (SELECT *, upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS noun FROM part),
      h AS (SELECT *, noun || CASE WHEN p_size % 2 = 0 THEN 's' ELSE 'ies' END AS tab,
                   CASE WHEN p_size % 2 = 0 THEN noun ELSE noun || 'y' END AS label FROM g)"""


@query("g2n_node_labels", f"WITH {_GRAPH} SELECT p_partkey, object_no, tab AS source_table, label FROM h, (VALUES (0), (1)) AS v(object_no)")
def g2n(t):
    heads = G.object_heads(G.mapping_entries(graph_files(t), "text", ["p_partkey"]), ["p_partkey"])
    return heads.filter(F.col("object_type") == "Node").select("p_partkey", "object_no", "source_table", "label")


@query(
    "g3n_merged_properties",
    f"""WITH {_GRAPH}, v AS (SELECT p_partkey, label, 'ItemID' AS source_column, 'INT' AS sql_type, true AS is_primary_key, 'itemId' AS target_property, 'int' AS target_type, p_brand, tab FROM h
              UNION ALL SELECT p_partkey, label, 'Name', p_type, false, 'name', 'string', p_brand, tab FROM h
              UNION ALL SELECT p_partkey, label, 'Size', 'int', false, 'size', 'int', p_brand, tab FROM h)
        SELECT p_partkey, label, p_brand AS source_schema, tab AS source_table, source_column, sql_type, is_primary_key, target_property, target_type FROM v""",
)
def g3n_rows(t):
    return G.node_mapping_rows(G.mapping_entries(graph_files(t), "text", ["p_partkey"]), ["p_partkey"])


@query(
    "g6n_endpoint_labels",
    f"""WITH {_GRAPH} SELECT p_partkey, 2 AS object_no, upper(noun) AS relationship_type, p_brand AS source_schema, 'Links' AS source_table,
              'ItemID' AS start_column, label AS start_entity, 'PersonID' AS end_column, 'Authority' AS end_entity FROM h""",
)
def g6n(t):
    return G.relationship_mapping_rows(G.mapping_entries(graph_files(t), "text", ["p_partkey"]), ["p_partkey"])


@query(
    "g5n_relationship_properties",
    f"""WITH {_GRAPH} SELECT p_partkey, 2 AS object_no, upper(noun) AS relationship_type, 'Since' AS source_column, 'date' AS sql_type, 'since' AS target_property, 'date' AS target_type FROM h""",
)
def g5n_rows(t):
    return G.relationship_property_rows(G.mapping_entries(graph_files(t), "text", ["p_partkey"]), ["p_partkey"])


def deep_files(t):
    """One mapping file per part: the key columns stand four levels deep, below parts and references."""
    low = F.lower("p_brand")
    text = F.format_string(
        """[{"graph-object-type": "Node", "schema": "%s", "mappings": [
            {"field": {"type": "Id", "id-space": "db.%s"}, "column": {
                "columns": [
                    {"name": "A%d", "columns": [{"name": "B", "referenced-column": {"columns": [{"name": "C"}, {"name": "A%d"}], "table": "%s"}}, {"name": "D"}]},
                    {"referenced-column": {"name": "E", "columns": [7, {"name": " "}, {"name": "F"}]}, "columns": [{"name": "G"}]}],
                "referenced-column": {"name": "H", "table": "Later"}}},
            {"field": {"type": "Data", "name": "a"}, "column": {"name": "A%d", "sql-data-type": "int"}},
            {"field": {"type": "Data", "name": "none"}}]}]""",
        "p_brand", low, F.col("p_size").cast("int"), F.col("p_size").cast("int"), low, F.col("p_size").cast("int"),
    )
    return t.dealt("part", "p_partkey").select("p_partkey", text.alias("text"))


@query(
    "g2n_columns_at_any_depth",
    """SELECT p_partkey, 'Id' AS field_type, 0 AS entry_no, 'A' || p_size || ',B,C,D,G,E,F,H' AS columns, lower(p_brand) AS source_table FROM part
       UNION ALL SELECT p_partkey, 'Data', 1, 'A' || p_size, '' FROM part UNION ALL SELECT p_partkey, 'Data', 2, '', '' FROM part""",
)
def g2n_deep(t):
    entries = G.mapping_entries(deep_files(t), "text", ["p_partkey"])
    return entries.select("p_partkey", "field_type", "entry_no", F.array_join("columns", ",").alias("columns"), F.coalesce("source_table", F.lit("")).alias("source_table"))


def graph_text(nodes=None, edges=None):
    """A mapping file over the local tables as its JSON text."""

    def entry(kind, columns, table=None, name=None, space=None):
        column = {"name": columns[0], "table": table} if len(columns) == 1 else {"table": table, "columns": [{"name": c} for c in columns]}
        typed = {"sql-data-type": "int"} if name else {}
        return {"field": {"type": kind, "name": name, "id-space": space, "neo4j-data-type": "int" if name else None}, "column": column | typed}

    out = []
    for m in NODES if nodes is None else nodes:
        data = [entry("Data", [c], m.table, p) for c, p in m.properties.items()]
        out.append({"graph-object-type": "Node", "schema": "local", "mappings": [entry("Id", m.key, m.table, space=m.space), entry("Label", [f"{m.label}s"]), *data]})
    for m in EDGES if edges is None else edges:
        ends = [entry(kind, key, m.table, space=space) for kind, (space, key) in (("StartId", m.start), ("EndId", m.end))]
        data = [entry("Data", [c], m.table, p) for c, p in m.properties.items()]
        out.append({"graph-object-type": "Relationship", "schema": "local", "mappings": [*ends, entry("RelationshipType", [m.type]), *data]})
    return json.dumps(out)


@query(
    "g1n_graph_from_mapping_file",
    f"""SELECT 'Order' AS kind, 'Sales.Orders:' || o_orderkey AS a, '' AS b, CAST(o_totalprice AS DOUBLE) AS value FROM orders
        UNION ALL SELECT 'Customer', 'Sales.Customers:' || c_custkey, '', c_acctbal FROM customer
        UNION ALL SELECT 'OrderLine', 'Sales.OrderLines:' || {_ROW_KEY}, '', l_quantity FROM lineitem
        UNION ALL SELECT 'CustomerTransaction', 'Sales.CustomerTransactions:' || o_orderkey, '', o_totalprice FROM orders
        UNION ALL SELECT 'CUSTOMERS', 'Sales.Orders:' || o_orderkey, 'Sales.Customers:' || o_custkey, 0 FROM orders
        UNION ALL SELECT 'ORDERS', 'Sales.OrderLines:' || {_ROW_KEY}, 'Sales.Orders:' || l_orderkey, l_quantity FROM lineitem
        UNION ALL SELECT 'CUSTOMERS', 'Sales.CustomerTransactions:' || o_orderkey, 'Sales.Customers:' || o_custkey, 0 FROM orders""",
)
def g1n_compiled(t):
    """Every node and edge of the local tables, as a mapping file says."""
    files_ = t.spark.sql("SELECT :text AS text", args={"text": graph_text()})
    nodes, edges = G.compile_graph(G.mapping_entries(files_, "text", []))
    tables = {f"local.{name}": df for name, df in graph_sources(t).items()}
    value = {"Order": "total", "Customer": "creditLimit", "OrderLine": "quantity", "CustomerTransaction": "transactionAmount"}
    rows = [df.select(F.lit(n).alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col(value[n]).cast("double").alias("value")) for n, df in G.build_nodes(tables, nodes).items()]
    for df in G.build_edges(tables, edges).values():
        number = F.col("quantity").cast("double") if "quantity" in df.columns else F.lit(0.0)
        rows.append(df.select(F.col("type").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), number.alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


# --- change feeds ---------------------------------------------------------


@query(
    "s1_incremental_extract",
    """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
              CAST(CAST(l_quantity AS DECIMAL(9,0)) * CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS total_including_tax
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE greatest(o_orderdate, l_shipdate) > TIMESTAMP '1998-01-01' AND greatest(o_orderdate, l_shipdate) <= TIMESTAMP '1999-01-01'""",
)
def s1(t):
    changed = S.incremental_extract(
        t("orders"), t("lineitem"), ("o_orderkey", "l_orderkey"), ("o_orderdate", "l_shipdate"), dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1)
    )
    total = F.col("l_quantity").cast("decimal(9,0)") * F.col("l_extendedprice").cast(MONEY) * (1 + F.col("l_tax").cast("decimal(4,2)"))
    return changed.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", total.cast("double").alias("total_including_tax"))


def _files_as_stream(t, name, column, n=3, rows=500_000):
    """A table in files of about ``rows`` rows by time, in ``n`` micro-batches; a file is written by one task."""
    path = scratch_dir(t.spark, f"{name}-files")
    per_batch = max(1, math.ceil(t(name).count() / (n * rows)))
    t(name).repartitionByRange(n * per_batch, column).write.parquet(path)
    return t.spark.readStream.schema(t(name).schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@query(
    "s1_streamed_extract",
    """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE greatest(o_orderdate, l_shipdate) > TIMESTAMP '1998-01-01' AND greatest(o_orderdate, l_shipdate) <= TIMESTAMP '1999-01-01'""",
)
def s1_stream(t):
    """The extract from two streams of several files; a pair may lie as far apart as the tables reach."""
    century = dt.timedelta(days=36_500)
    pairs = SP.stream_pairs(
        _files_as_stream(t, "orders", "o_orderdate"), _files_as_stream(t, "lineitem", "l_shipdate"),
        ("o_orderkey", "l_orderkey"), ("o_orderdate", "l_shipdate"), century, century, dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1),
    )
    pairs = pairs.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    path = scratch_dir(t.spark, "pairs")
    SP.write_pairs(pairs, path, scratch_dir(t.spark, "offsets")).awaitTermination()
    return t.spark.read.schema(pairs.schema).parquet(path)


def feed(events):
    """Events as changes of a user table: errors delete, everything else writes."""
    return events.select(
        F.col("user_id"),
        F.col("event_type").alias("last_kind"),
        F.col("value").alias("last_value"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        "ts",
        "event_id",
    )


def base(t):
    """The table before the feed: one row per customer number."""
    return t("customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("none").alias("last_kind"), F.col("c_acctbal").alias("last_value")
    )


_FED = """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
   SELECT user_id, event_type AS last_kind, value AS last_value FROM l WHERE event_type <> 'error'
   UNION ALL SELECT c_custkey, 'none', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)"""


@query("s2_apply_changes", _FED)
def s2(t):
    return S.apply_changes(base(t), feed(t("events")), ["user_id"], ["ts", "event_id"])


def _event_stream(t, n=4, rows=500_000):
    """The events in files of mixed times, of about ``rows`` rows, in ``n`` micro-batches; a file is written by one task."""
    path = scratch_dir(t.spark, "event-files")
    per_batch = max(1, math.ceil(t("events").count() / (n * rows)))
    t("events").repartition(n * per_batch, F.xxhash64("event_id")).write.parquet(path)
    return t.spark.readStream.schema(t("events").schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@query("s2_stream_changes", _FED)
def s2_stream(t):
    path = scratch_dir(t.spark, "changes")
    running = S.stream_changes(feed(_event_stream(t)), path, scratch_dir(t.spark, "offsets"), ["user_id"], ["ts", "event_id"])
    running.awaitTermination()
    return S.current_rows(base(t), path, ["user_id"], ["ts", "event_id"])


@query("s2_stream_into_table", _FED)
def s2_table(t):
    path = scratch_dir(t.spark, "table")
    start = base(t)
    running = S.stream_into_table(
        feed(_event_stream(t)), path, scratch_dir(t.spark, "offsets"), start, ["user_id"], ["ts", "event_id"]
    )
    running.awaitTermination()
    last = running.lastProgress["batchId"] if running.lastProgress else 0
    return t.spark.read.schema(start.schema).parquet(f"{path}/version={last}")


@query(
    "s3_refreshed_documents",
    f"""SELECT o_orderkey AS "orderId", o_totalprice AS total, c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN ' *' ELSE '' END AS "customerName", coalesce(n_tx, 0) AS n_tx
        FROM orders JOIN customer ON c_custkey = o_custkey
        LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_tx FROM orders GROUP BY o_custkey) x ON k = o_custkey""",
)
def s3(t):
    before = sources(t)
    documents = D.build_collection("orders", ORDERS, before)
    building = F.col("c_mktsegment") == "BUILDING"
    renamed = t("customer").withColumn("c_name", F.when(building, F.concat("c_name", F.lit(" *"))).otherwise(F.col("c_name")))
    after = {**before, "customer": renamed}
    changed = {"customer": t("customer").filter(building).select("c_custkey")}
    touched = S.touched_roots(ORDERS, after, changed)
    fresh = S.refresh_collection("orders", ORDERS, documents, after, touched)
    rows = fresh.documents.select(
        "orderId",
        "total",
        F.col("customer.customerId").alias("c"),
        "customer.customerName",
        F.size("customer.customerTransactions").cast("bigint").alias("n_tx"),
    )
    return with_kept_once(rows, fresh)


@query("s2_stream_into_buckets", _FED)
def s2_buckets(t):
    """A table in hash buckets, kept current by several micro-batches whose times overlap."""
    start, first = base(t), dt.datetime(1900, 1, 1)
    table = B.BucketTable(t.spark, scratch_dir(t.spark, "buckets"), start.schema, ("user_id",), ("ts", "event_id"), ("timestamp_ntz", "bigint"), 16)
    oldest = start.withColumns({"op": F.lit(B.UPSERT), "ts": F.lit(first).cast("timestamp_ntz"), "event_id": F.lit(-1).cast("bigint")})
    changes = feed(_event_stream(t)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    B.stream_into_buckets(changes.unionByName(_once(t, oldest)), table, scratch_dir(t.spark, "offsets")).awaitTermination()
    return table.read()


def _once(t, rows):
    """Rows as a stream of one micro-batch."""
    path = scratch_dir(t.spark, "start")
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


@query(
    "s3_bucketed_documents",
    """SELECT o_orderkey AS "orderId", CAST(o_totalprice AS DOUBLE) AS total, c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN ' *' ELSE '' END AS "customerName", n_tx
        FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN (SELECT o_custkey AS k, count(*) AS n_tx FROM orders GROUP BY o_custkey) x ON k = o_custkey
        WHERE o_orderkey % 7 <> 0 OR c_mktsegment <> 'BUILDING'""",
)
def s3_buckets(t):
    """Documents of all orders; customers are renamed in one batch, and in the next some of their orders go."""
    before = sources(t)
    built = D.build_collection("orders", ORDERS, before)
    table = B.document_table(t.spark, scratch_dir(t.spark, "documents"), built.documents, 16)
    B.store_documents(table, built)
    building = F.col("c_mktsegment") == "BUILDING"
    after = {**before, "customer": t("customer").withColumn("c_name", F.when(building, F.concat("c_name", F.lit(" *"))).otherwise(F.col("c_name")))}
    renamed = t("customer").filter(building).select("c_custkey")
    B.refresh_documents(table, "orders", ORDERS, after, S.touched_roots(ORDERS, after, {"customer": renamed}), 1)
    gone = t("orders").join(renamed, F.col("o_custkey") == F.col("c_custkey"), "left_semi").filter("o_orderkey % 7 = 0").select("o_orderkey")
    left = {**after, "orders": t("orders").join(gone, "o_orderkey", "left_anti")}
    B.refresh_documents(table, "orders", ORDERS, left, gone, 2)
    whole = table.collection()
    rows = whole.documents.select(
        "orderId",
        "total",
        F.col("customer.customerId").alias("c"),
        "customer.customerName",
        F.size("customer.customerTransactions").cast("bigint").alias("n_tx"),
    )
    return with_kept_once(rows, whole)
