"""Relational query shapes over the local tables (sources, projection, predicates, joins, aggregates, sorts, sets)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tableloom.functions import names as N
from tableloom.operators import nesting, paging
from tableloom.operators import relational as R
from tableloom.plans.registry import SCHEMAS, query
from tableloom.session import scratch_dir
from tableloom.sources import files, tables, textindex
from tableloom.streaming.changes import incremental_extract

LINE_COLUMNS = [c.split()[0] for c in SCHEMAS["lineitem"].split(", ")]
LINE_ORDER = ["l_linenumber", *[c for c in LINE_COLUMNS if c not in ("l_orderkey", "l_linenumber")]]
ALL_LINE = ", ".join(LINE_COLUMNS)
LINE_SORT = ", ".join(LINE_ORDER)

MONEY = "decimal(18,2)"


# --- sources --------------------------------------------------------------


@query("src1_table_scan", "SELECT o.o_orderkey, o.o_custkey, o.o_orderdate FROM orders o")
def src1(t):
    return t("orders").alias("o").select("o.o_orderkey", "o.o_custkey", "o.o_orderdate")


@query("src2_whole_rows", "SELECT * FROM orders")
def src2(t):
    return t("orders").select("*")


@query("src3_delimited_round_trip", "SELECT * FROM documents")
def src3(t):
    df = t("documents")
    path = scratch_dir(t.spark, "export")
    files.export_delimited(df, path)
    return files.read_delimited(t.spark, path, df.schema)


@query(
    "src7_column_catalog",
    " UNION ALL ".join(
        f"SELECT 'sales' AS table_schema, '{name}' AS table_name, '{column.split()[0]}' AS column_name, "
        f"{i} AS ordinal, '{column.split()[1]}' AS data_type, true AS is_nullable, "
        f"(SELECT count({column.split()[0]}) FROM {name}) AS known_values"
        for name in ("orders", "lineitem", "customer")
        for i, column in enumerate(SCHEMAS[name].split(", "), start=1)
    ),
)
def src7(t):
    frames = {n: t(n) for n in ("orders", "lineitem", "customer")}
    catalog = tables.column_catalog(t.spark, {f"sales.{n}": df for n, df in frames.items()})
    # Known values per column: one aggregate row per table, turned into rows.
    counts = None
    for name, df in frames.items():
        one = df.agg(*[F.count(c).alias(c) for c in df.columns])
        rows = one.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("known_values")) for c in df.columns])).alias("r")
        ).select(F.lit(name).alias("table_name"), "r.*")
        counts = rows if counts is None else counts.unionByName(rows)
    return catalog.join(counts, ["table_name", "column_name"])


@query(
    "src7_column_type",
    "SELECT 'double' AS data_type, count(DISTINCT l_quantity) AS distinct_values FROM lineitem",
)
def src7_type(t):
    catalog = tables.column_catalog(t.spark, {"sales.lineitem": t("lineitem")})
    found = tables.column_type(catalog, "sales", "lineitem", "l_quantity")
    values = t("lineitem").select("l_quantity").distinct().agg(F.count("l_quantity")).scalar()
    return found.withColumn("distinct_values", values)


@query(
    "src8_routine_source",
    """SELECT o_orderkey AS "OrderKey", l_partkey AS "PartKey", l_quantity AS "Quantity",
              CAST(l_quantity * l_extendedprice * (1 + l_tax) AS DOUBLE) AS "TotalIncludingTax"
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE greatest(o_orderdate, l_shipdate) > TIMESTAMP '1997-01-01'
         AND greatest(o_orderdate, l_shipdate) <= TIMESTAMP '1998-01-01'""",
)
def src8(t):
    return N.clean_columns(order_updates(t, dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1)), "WWI")


def order_updates(t, last_cutoff: dt.datetime, new_cutoff: dt.datetime):
    """The routine: changed lines of an interval, under its public column names."""
    changed = incremental_extract(
        t("orders"), t("lineitem"), ("o_orderkey", "l_orderkey"), ("o_orderdate", "l_shipdate"), last_cutoff, new_cutoff
    )
    return changed.select(
        F.col("o_orderkey").alias("WWI Order Key"),
        F.col("l_partkey").alias("WWI Part Key"),
        F.col("l_quantity").alias("Quantity"),
        (F.col("l_quantity") * F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("Total Including Tax"),
    )


@query(
    "src9_resolve_names",
    """WITH cat AS (
         SELECT DISTINCT CASE WHEN p_brand = 'Brand#1' THEN 'dbo' ELSE p_brand END AS s,
                CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) || 's' END AS n
         FROM part WHERE p_type <> 'ECONOMY'),
       best AS (SELECT n, arg_min(s, (CASE WHEN s = 'dbo' THEN '0' ELSE '1' END) || s) AS s FROM cat GROUP BY n),
       nm AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1)
                WHEN p_size % 5 = 0 THEN p_name || '.x' ELSE split_part(p_name, ' ', 2) END AS name FROM part)
       SELECT p_partkey, name,
         CASE WHEN name LIKE '%.%' OR trim(name) = '' THEN name
              ELSE coalesce((SELECT s || '.' || n FROM best WHERE best.n = nm.name),
                            (SELECT s || '.' || n FROM best WHERE best.n = CASE WHEN lower(nm.name) LIKE '%s' THEN left(nm.name, -1) ELSE nm.name || 's' END),
                            name) END AS resolved
       FROM nm""",
)
def src9(t):
    part = t("part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    catalog = (
        part.filter(F.col("p_type") != "ECONOMY")
        .select(
            F.when(F.col("p_brand") == "Brand#1", "dbo").otherwise(F.col("p_brand")).alias("table_schema"),
            F.when(F.col("p_size") % 2 == 0, noun).otherwise(F.concat(noun, F.lit("s"))).alias("table_name"),
        )
        .distinct()
    )
    name = (
        F.when(F.col("p_size") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1)))
        .when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(".x")))
        .otherwise(noun)
    )
    wanted = part.select("p_partkey", name.alias("name"))
    return tables.resolve_names(wanted, catalog).select("p_partkey", "name", "resolved")


# --- projection -----------------------------------------------------------


@query("prj1_columns_with_alias", "SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer")
def prj1(t):
    return R.project(t("customer"), ("c_custkey", "id"), ("c_name", "name"), "c_mktsegment")


@query("prj2_point_read", "SELECT * FROM orders WHERE o_orderkey = 25")
def prj2(t):
    return R.single(t("orders").filter(R.compare(F.col("o_orderkey"), "=", 25)), "order")


@query("prj3_narrow_projection", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 5")
def prj3(t):
    return R.project(t("supplier").filter(F.col("s_suppkey") == 5), "s_suppkey", "s_name", "s_acctbal")


@query(
    "prj4_two_objects_per_row",
    """SELECT s_suppkey AS contact_key, s_name AS contact_name, s_nationkey AS contact_nation,
              s_suppkey AS account_key, s_acctbal AS account_balance FROM supplier""",
)
def prj4(t):
    both = R.split_row(t("supplier"), contact=["s_suppkey", "s_name", "s_nationkey"], account=["s_suppkey", "s_acctbal"])
    return both.select(
        F.col("contact.s_suppkey").alias("contact_key"),
        F.col("contact.s_name").alias("contact_name"),
        F.col("contact.s_nationkey").alias("contact_nation"),
        F.col("account.s_suppkey").alias("account_key"),
        F.col("account.s_acctbal").alias("account_balance"),
    )


@query("prj5_two_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def prj5(t):
    return R.project(t("lineitem"), "l_orderkey", "l_quantity")


@query(
    "prj6_renamed_aggregates",
    """SELECT o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS highest
       FROM orders GROUP BY o_orderpriority""",
    grouping=True,
)
def prj6(t):
    grouped = t("orders").groupBy("o_orderpriority").agg(
        R.aggregate("COUNT", "*").alias("n"), R.aggregate("MAX", "o_totalprice").alias("highest")
    )
    return R.project(grouped, ("o_orderpriority", "priority"), "n", "highest")


@query(
    "prj7_line_total",
    """SELECT l_orderkey, l_linenumber,
              CAST(CAST(l_quantity AS DECIMAL(9,0)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS line_total
       FROM lineitem""",
)
def prj7(t):
    total = R.product(F.col("l_quantity").cast("decimal(9,0)"), F.col("l_extendedprice").cast(MONEY), "decimal(28,2)")
    return R.project(t("lineitem"), "l_orderkey", "l_linenumber", (total.cast("double"), "line_total"))


@query(
    "par1_named_parameters",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderpriority = '5-LOW' AND o_totalprice > 1000.5""",
)
def par1(t):
    return R.run_sql(
        t.spark,
        "SELECT o_orderkey, o_totalprice FROM {orders} "
        "WHERE o_orderdate >= :since AND o_orderpriority = :priority AND o_totalprice > :price",
        {"since": dt.datetime(1996, 3, 1), "priority": "5-LOW", "price": Decimal("1000.5")},
        orders=t("orders"),
    )


# --- predicates -----------------------------------------------------------


@query("pre1_key_equality", f"SELECT {ALL_LINE} FROM lineitem WHERE l_orderkey = 10")
def pre1(t):
    return t("lineitem").filter(R.compare(F.col("l_orderkey"), "=", 10))


@query("pre2_decimal_equality", f"SELECT {ALL_LINE} FROM lineitem WHERE CAST(l_discount AS DECIMAL(18,2)) = 0.05")
def pre2(t):
    # The doubles that round to 0.05 reach the scan as a range; the decimals then decide.
    near = (F.col("l_discount") >= 0.045) & (F.col("l_discount") < 0.055)
    return t("lineitem").filter(near & R.compare(F.col("l_discount").cast(MONEY), "=", Decimal("0.05")))


@query(
    "pre3_closed_range",
    f"SELECT {ALL_LINE} FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-12-20' AND TIMESTAMP '1996-12-31'",
)
def pre3(t):
    return t("lineitem").filter(R.between(F.col("l_shipdate"), dt.datetime(1996, 12, 20), dt.datetime(1996, 12, 31)))


@query("pre4_value_list", f"SELECT {ALL_LINE} FROM lineitem WHERE l_orderkey IN (1, 10, 100, 1000, 10000)")
def pre4(t):
    return R.in_list(t("lineitem"), "l_orderkey", [1, 10, 100, 1000, 10000])


@query(
    "pre4_long_value_list",
    f"SELECT {ALL_LINE} FROM lineitem WHERE l_orderkey IN (SELECT i / 2.0 FROM range(3001) AS r(i))",
)
def pre4_long(t):
    # Half of the values are no whole number, so no key may match them.
    return R.in_list(t("lineitem"), "l_orderkey", [i / 2 for i in range(3001)] + [None])


@query("pre5_text_search", "SELECT doc_id, lang, n_chars FROM documents WHERE contains(text, 'tion')")
def pre5(t):
    return t("documents").filter(R.contains_text(F.col("text"), "tion")).select("doc_id", "lang", "n_chars")


def _text_files(t):
    """The documents in files of neighbouring ids, and an index of their trigrams."""
    path, folder = scratch_dir(t.spark, "texts"), scratch_dir(t.spark, "trigrams")
    t("documents").repartitionByRange(16, "doc_id").write.parquet(path)
    return textindex.write_index(textindex.index_text(t.spark, path, "text"), folder)


@query("pre5_pruned_text_search", "SELECT doc_id, lang, n_chars FROM documents WHERE contains(text, (SELECT text[20:60] FROM documents WHERE length(text) > 100 ORDER BY doc_id LIMIT 1))")
def pre5_pruned(t):
    """A rare text, searched for in the files whose trigrams can make it up."""
    needle = t("documents").filter("char_length(text) > 100").orderBy("doc_id").limit(1).select(F.substring("text", 20, 41)).first()[0]
    return _text_files(t).search(needle).select("doc_id", "lang", "n_chars")


@query(
    "pre5_text_search_ignoring_case",
    "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'the')",
)
def pre5_ci(t):
    return t("documents").filter(R.contains_text(F.col("text"), "THE", ignore_case=True)).select("doc_id", "lang", "n_chars")


@query(
    "pre6_comparisons",
    """SELECT l_orderkey, l_linenumber, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity > 10 AS gt,
              l_quantity >= 10 AS ge, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_partkey < l_suppkey AS below
       FROM lineitem""",
)
def pre6(t):
    q = F.col("l_quantity")
    named = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
    return R.project(
        t("lineitem"),
        "l_orderkey",
        "l_linenumber",
        *[(R.compare(q, op, 10.0), alias) for alias, op in named.items()],
        (R.compare(F.col("l_partkey"), "<", F.col("l_suppkey")), "below"),
    )


@query(
    "pre7_like_patterns",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_type NOT LIKE 'ECO%'",
)
def pre7(t):
    return R.all_of(
        t("part"), R.compare(F.col("p_name"), "like", "%ring"), R.compare(F.col("p_type"), "not like", "ECO%")
    ).select("p_partkey", "p_name")


@query(
    "pre8_in_and_not_in",
    """SELECT o_orderkey FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')""",
)
def pre8(t):
    kept = R.in_list(t("orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])
    return R.not_in_list(kept, "o_orderstatus", ["P"]).select("o_orderkey")


@query(
    "pre8_long_not_in",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT i + 0.5 FROM range(2000) AS r(i))
       AND o_custkey NOT IN (SELECT CAST(i AS DECIMAL(12,2)) FROM range(1200) AS r(i))""",
)
def pre8_long(t):
    kept = R.not_in_list(t("orders"), "o_orderkey", [i + 0.5 for i in range(2000)])
    return R.not_in_list(kept, "o_custkey", [Decimal(i).quantize(Decimal("0.01")) for i in range(1200)]).select("o_orderkey")


@query(
    "pre9_conjunction",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_tax > 0.02""",
)
def pre9(t):
    q = F.col("l_quantity")
    return R.all_of(t("lineitem"), q >= 10, q < 20, F.col("l_returnflag") == "R", F.col("l_tax") > 0.02).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


@query("pre10_text_constant", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'it''s \"quoted\"'")
def pre10(t):
    return t("customer").filter(R.compare(F.col("c_mktsegment"), "<>", "it's \"quoted\"")).select("c_custkey")


# --- joins ----------------------------------------------------------------


@query(
    "joi1_inner_join",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
def joi1(t):
    return R.equi_join(t("orders"), t("customer"), ("o_custkey", "c_custkey"), "inner", "c").select("o_orderkey", "c.c_name")


@query(
    "joi1_outer_joins",
    """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)
       SELECT 'left' AS kind, count(*) AS n, count(o_orderkey) AS matched FROM customer LEFT JOIN f ON c_custkey = o_custkey
       UNION ALL SELECT 'right', count(*), count(c_custkey) FROM customer RIGHT JOIN f ON c_custkey = o_custkey
       UNION ALL SELECT 'full', count(*), count(o_orderkey) FROM customer FULL JOIN f ON c_custkey = o_custkey""",
    grouping=True,
)
def joi1_outer(t):
    big = t("orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))
    out = None
    for kind, known in (("left", "o_orderkey"), ("right", "c_custkey"), ("full", "o_orderkey")):
        one = R.equi_join(t("customer"), big, ("c_custkey", "o_custkey"), kind).agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count(known).alias("matched")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _line_digest(nested):
    """Count, first and last line number and sum of cents of the lines, over all parts of the array."""
    items = F.col(nested.name)
    cents = F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + F.round(x.l_extendedprice * 100).cast("bigint"))
    got = nested.reduced(
        n_lines=(F.size(items).cast("bigint"), "sum"),
        first_line=(F.get(items, F.lit(0)).l_linenumber, "min"),
        last_line=(F.get(items, F.size(items) - 1).l_linenumber, "max"),
        checksum=(cents, "sum"),
    )
    return got.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("first_line", "last_line")})


_LINES = """d AS (SELECT l_orderkey, count(*) AS n_lines, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line,
                  sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS checksum FROM lineitem GROUP BY l_orderkey)"""


@query(
    "joi2_order_with_lines",
    f"""WITH {_LINES}
        SELECT o_orderkey, o_orderdate, coalesce(n_lines, 0) AS n_lines, coalesce(first_line, -1) AS first_line,
               coalesce(last_line, -1) AS last_line, coalesce(checksum, 0) AS checksum
        FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""",
)
def joi2(t):
    nested = nesting.include_many(
        t("orders").select("o_orderkey", "o_orderdate"), t("lineitem"), {"o_orderkey": "l_orderkey"}, "lines", LINE_ORDER, LINE_ORDER
    )
    return _line_digest(nested)


def elements(nested, fields):
    """Every element of every array with its place and all of its fields."""
    rows = nested.rows.select(*nested.keys, F.posexplode(nested.name).alias("at", "x"))
    return rows.select(*nested.keys, "at", *[F.col(f"x.{c}").alias(c) for c in fields])


@query(
    "joi2_lines_in_full",
    f"""SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SORT}) - 1 AS INTEGER) AS at, {LINE_SORT}
        FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
)
def joi2_full(t):
    nested = nesting.include_many(t("orders").select("o_orderkey"), t("lineitem"), {"o_orderkey": "l_orderkey"}, "lines", LINE_ORDER, LINE_ORDER)
    return elements(nested, LINE_ORDER)


@query(
    "joi3_parts_with_suppliers_in_full",
    """SELECT l_partkey AS p_partkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY s_name, s_suppkey) - 1 AS INTEGER) AS at, s_name, s_suppkey, s_acctbal
       FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""",
)
def joi3_full(t):
    link = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    fields = ["s_name", "s_suppkey", "s_acctbal"]
    nested = nesting.include_through_link(
        t("part").select("p_partkey"), link, t("supplier"), {"p_partkey": "l_partkey"}, {"s_suppkey": "l_suppkey"}, "suppliers", fields
    )
    return elements(nested, fields)


@query(
    "joi4_optional_orders_in_full",
    """SELECT c_custkey, CAST(CASE WHEN o_orderkey IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 END AS INTEGER) AS at,
              o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def joi4_full(t):
    fields = ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    nested = nesting.include_many(t("customer").select("c_custkey"), t("orders"), {"c_custkey": "o_custkey"}, "orders", fields)
    rows = nested.rows.select("c_custkey", F.posexplode_outer("orders").alias("at", "x"))
    return rows.select("c_custkey", F.coalesce("at", F.lit(-1)).alias("at"), *[F.col(f"x.{c}").alias(c) for c in fields])


@query(
    "joi5_both_branches_in_full",
    """SELECT o.o_orderkey, coalesce(c.texts, '') AS siblings, coalesce(l.texts, '') AS lines
       FROM orders o JOIN customer ON c_custkey = o_custkey
       LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS texts FROM orders GROUP BY o_custkey) c ON c.o_custkey = o.o_custkey
       LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS texts
                  FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o.o_orderkey""",
)
def joi5_full(t):
    # All elements of both branches as text; the customer's orders hang off the customer.
    owners = nesting.include_many(t("customer").select("c_custkey"), t("orders"), {"c_custkey": "o_custkey"}, "siblings", ["o_orderkey", "o_orderpriority"])
    lines = nesting.include_many(
        t("orders").select("o_orderkey", "o_custkey"), t("lineitem"), {"o_orderkey": "l_orderkey"}, "lines", ["l_linenumber", "l_partkey", "l_returnflag"]
    )
    rows = R.equi_join(lines.rows, owners.rows, ("o_custkey", "c_custkey"))

    def texts(column, *names):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")

    return rows.select("o_orderkey", texts("siblings", "o_orderkey", "o_orderpriority").alias("siblings"), texts("lines", "l_linenumber", "l_partkey", "l_returnflag").alias("lines"))


@query(
    "joi3_parts_with_suppliers",
    """WITH link AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
            g AS (SELECT l_partkey, count(*) AS n, min(s_name) AS first_name, max(s_name) AS last_name
                  FROM link JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey)
       SELECT p_partkey, coalesce(n, 0) AS n_suppliers, coalesce(first_name, '') AS first_supplier,
              coalesce(last_name, '') AS last_supplier FROM part LEFT JOIN g ON l_partkey = p_partkey""",
)
def joi3_left(t):
    link = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    nested = nesting.include_through_link(
        t("part").select("p_partkey"), link, t("supplier"), {"p_partkey": "l_partkey"}, {"s_suppkey": "l_suppkey"},
        "suppliers", ["s_name", "s_suppkey"],
    )
    s = F.col("suppliers")
    got = nested.reduced(
        n_suppliers=(F.size(s).cast("bigint"), "sum"),
        first_supplier=(F.get(s, F.lit(0)).s_name, "min"),
        last_supplier=(F.get(s, F.size(s) - 1).s_name, "max"),
    )
    return got.withColumns({c: F.coalesce(c, F.lit("")) for c in ("first_supplier", "last_supplier")})


@query(
    "joi3_suppliers_with_parts",
    """SELECT s_suppkey, p_partkey, p_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
       JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
)
def joi3_right(t):
    link = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    nested = nesting.include_through_link(
        t("supplier").select("s_suppkey"), link, t("part"), {"s_suppkey": "l_suppkey"}, {"p_partkey": "l_partkey"},
        "parts", ["p_partkey", "p_name"],
    )
    return nested.exploded()


def closed_orders(t):
    """Finished orders after a date: some customers have none."""
    return t("orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")))


CLOSED = "(SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-01-01')"


@query(
    "joi4_customers_with_optional_orders",
    f"""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, coalesce(min(o_orderkey), -1) AS first_order,
               coalesce(max(o_orderkey), -1) AS last_order
        FROM customer LEFT JOIN {CLOSED} o ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def joi4(t):
    nested = nesting.include_many(
        t("customer").select("c_custkey", "c_name"), closed_orders(t), {"c_custkey": "o_custkey"}, "orders",
        ["o_orderkey", "o_orderdate", "o_totalprice"],
    )
    o = F.col("orders")
    got = nested.reduced(
        n_orders=(F.size(o).cast("bigint"), "sum"),
        first_order=(F.get(o, F.lit(0)).o_orderkey, "min"),
        last_order=(F.get(o, F.size(o) - 1).o_orderkey, "max"),
    )
    return got.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("first_order", "last_order")})


@query(
    "joi5_multi_branch_include",
    f"""WITH {_LINES},
        c AS (SELECT o_custkey, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS orders_total
              FROM orders GROUP BY o_custkey)
        SELECT o_orderkey, c_name, coalesce(n_orders, 0) AS n_orders, CAST(coalesce(orders_total, 0) AS DOUBLE) AS orders_total,
               coalesce(n_lines, 0) AS n_lines, coalesce(first_line, -1) AS first_line,
               coalesce(last_line, -1) AS last_line, coalesce(checksum, 0) AS checksum
        FROM orders o JOIN customer ON c_custkey = o.o_custkey LEFT JOIN c ON c.o_custkey = o.o_custkey
        LEFT JOIN d ON l_orderkey = o_orderkey""",
)
def joi5(t):
    # Branch 1 hangs off the customer, branch 2 off the order; each is collected on its own key.
    customers = nesting.include_many(
        t("customer").select("c_custkey", "c_name"), t("orders"), {"c_custkey": "o_custkey"}, "orders",
        ["o_orderkey", "o_totalprice"],
    )
    total = F.aggregate(
        "orders", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x.o_totalprice.cast(MONEY)).cast("decimal(38,2)")
    )
    # What is needed of a branch is reduced before it is repeated per order.
    customers = customers.reduced(n_orders=(F.size("orders").cast("bigint"), "sum"), orders_total=(total, "sum"))
    customers = customers.withColumn("orders_total", F.col("orders_total").cast("double"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    lines = nesting.include_many(orders, t("lineitem"), {"o_orderkey": "l_orderkey"}, "lines", LINE_ORDER, LINE_ORDER)
    return R.equi_join(_line_digest(lines), customers, ("o_custkey", "c_custkey")).drop("o_custkey", "c_custkey")


@query("joi6_lines_in_line_order", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, true AS in_order FROM lineitem")
def joi6(t):
    nested = nesting.collect_children(t("lineitem"), ["l_orderkey"], "lines", LINE_ORDER, LINE_ORDER)
    # Every element with whether the one before it, in the same array, has no larger line number.
    rows = nested.all_parts().select("l_orderkey", "lines", F.posexplode("lines").alias("pos", "x"))
    before = F.get("lines", F.col("pos") - 1)["l_linenumber"]
    in_order = F.coalesce(before <= F.col("x.l_linenumber"), F.lit(True))
    return rows.select("l_orderkey", "x.l_linenumber", "x.l_partkey", "x.l_suppkey", in_order.alias("in_order"))


@query(
    "joi8_method_join",
    """SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def joi8(t):
    return R.equi_join(t("lineitem"), t("part"), ("l_partkey", "p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


# --- aggregation ----------------------------------------------------------


@query("agg1_count_by_rate", "SELECT l_tax, count(l_tax) AS count FROM lineitem GROUP BY l_tax", grouping=True)
def agg1(t):
    return R.count_by(t("lineitem"), "l_tax", of="l_tax")


@query("agg2_global_max", "SELECT max(l_extendedprice) AS highest FROM lineitem")
def agg2(t):
    return t("lineitem").agg(R.aggregate("MAX", "l_extendedprice").alias("highest"))


@query(
    "agg3_sum_of_product",
    """SELECT CAST(sum(CAST(l_quantity AS DECIMAL(9,0)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM lineitem""",
)
def agg3(t):
    total = R.product(F.col("l_quantity").cast("decimal(9,0)"), F.col("l_extendedprice").cast(MONEY), "decimal(28,2)")
    return t("lineitem").agg(F.sum(total).cast("double").alias("total"))


@query(
    "agg4_count_column_and_rows",
    """SELECT lang, count(*) AS n_rows, count(CASE WHEN n_chars > 500 THEN n_chars END) AS n_known
       FROM documents GROUP BY lang""",
    grouping=True,
)
def agg4(t):
    long = F.when(F.col("n_chars") > 500, F.col("n_chars"))
    return t("documents").groupBy("lang").agg(
        R.aggregate("COUNT", "*").alias("n_rows"), R.aggregate("COUNT", long).alias("n_known")
    )


@query(
    "agg5_aggregates_by_name",
    """SELECT l_returnflag, count(l_quantity) AS c, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s,
              min(l_quantity) AS lo, max(l_quantity) AS hi,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS mean
       FROM lineitem GROUP BY l_returnflag""",
    grouping=True,
)
def agg5(t):
    q = F.col("l_quantity")
    # Quantities are whole numbers, so their double sum is exact in any order.
    return t("lineitem").groupBy("l_returnflag").agg(
        *[R.aggregate(n, q).alias(a) for n, a in (("COUNT", "c"), ("SUM", "s"), ("MIN", "lo"), ("MAX", "hi"), ("AVG", "mean"))]
    )


@query(
    "agg6_group_by_columns",
    "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY l_returnflag, l_linestatus",
    grouping=True,
)
def agg6(t):
    return R.count_by(t("lineitem"), "l_returnflag", "l_linestatus")


@query(
    "agg7_having",
    """SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders GROUP BY o_custkey
       HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 1000000 AND count(*) >= 5""",
    grouping=True,
)
def agg7(t):
    grouped = t("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("total")
    )
    kept = R.having(grouped, F.col("total") > 1000000, F.col("n") >= 5)
    return kept.withColumn("total", F.col("total").cast("double"))


@query("agg8_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders", grouping=True)
def agg8(t):
    return t("orders").select("o_orderpriority").distinct()


@query("agg9_count_of_query", "SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def agg9(t):
    return R.row_count(t("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)))


@query(
    "agg10_first_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
    grouping=True,
)
def agg10(t):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


# --- sorting and paging ---------------------------------------------------


@query("srt1_multi_column_sort", "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders")
def srt1(t):
    rows = t("orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return R.sort(rows, "o_orderpriority", ("o_totalprice", "desc"), "o_orderkey")


@query(
    "srt2_top_by_date",
    """SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position
       FROM (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000)""",
)
def srt2(t):
    rows = R.top(t("orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 1000, "o_orderdate", "o_orderkey")
    return R.numbered(rows, "o_orderdate", "o_orderkey")


@query(
    "srt3_offset_page",
    """SELECT *, row_number() OVER (ORDER BY o_orderkey) AS position
       FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000)""",
)
def srt3(t):
    return R.numbered(R.page(t("orders"), 1000, 50, "o_orderkey"), "o_orderkey")


@query(
    "srt3_deep_page",
    """SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position
       FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET (SELECT count(*) // 2 FROM orders))""",
)
def srt3_deep(t):
    """The page in the middle of the table, read from the range of rows that holds it."""
    order = [("o_totalprice", "desc"), "o_orderkey"]
    pages = paging.paged(t("orders"), *order)
    return R.numbered(pages.page(len(pages) // 2, 50), *order)


@query(
    "srt4_keyset_page",
    """SELECT *, row_number() OVER (ORDER BY o_orderkey) AS position
       FROM (SELECT * FROM orders WHERE o_orderkey > 999 ORDER BY o_orderkey LIMIT 50)""",
)
def srt4(t):
    return R.numbered(R.page_after(t("orders"), "o_orderkey", 999, 50), "o_orderkey")


@query(
    "srt5_top_fifty_with_ties",
    f"""SELECT {ALL_LINE}, row_number() OVER (ORDER BY l_quantity DESC, {ALL_LINE}) AS position
        FROM (SELECT * FROM lineitem ORDER BY l_quantity DESC, {ALL_LINE} LIMIT 50)""",
)
def srt5(t):
    order = [("l_quantity", "desc"), *LINE_COLUMNS]
    return R.numbered(R.top(t("lineitem"), 50, *order), *order)


@query(
    "srt6_first_and_last_row",
    """SELECT min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_price,
              max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders""",
)
def srt6(t):
    both = R.first_and_last(t("orders"), "o_orderkey")
    return both.select(
        F.col("first_row.o_orderkey").alias("first_key"),
        F.col("first_row.o_totalprice").alias("first_price"),
        F.col("last_row.o_orderkey").alias("last_key"),
        F.col("last_row.o_totalprice").alias("last_price"),
    )


# --- set operations -------------------------------------------------------

_LOW = "SELECT l_suppkey FROM lineitem WHERE l_suppkey < 60"
_MID = "SELECT l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 5 AND 90"


def _operands(t):
    keys = t("lineitem").select("l_suppkey")
    return keys.filter(F.col("l_suppkey") < 60), keys.filter(F.col("l_suppkey").between(5, 90))


@query("set1_union", f"{_LOW} UNION {_MID}", grouping=True)
def set1(t):
    return R.union(*_operands(t)).orderBy("l_suppkey")


@query("set2_union_all", f"{_LOW} UNION ALL {_MID}")
def set2(t):
    return R.union_all(*_operands(t))


@query("set3_intersect", f"{_LOW} INTERSECT {_MID}", grouping=True)
def set3(t):
    return R.intersect(*_operands(t)).orderBy("l_suppkey")


@query("set4_except", f"{_LOW} EXCEPT {_MID}", grouping=True)
def set4(t):
    return R.except_distinct(*_operands(t))


@query("set5_except_all", "SELECT l_partkey FROM lineitem EXCEPT ALL SELECT l_suppkey FROM lineitem")
def set5(t):
    lines = t("lineitem")
    return R.except_all(lines.select("l_partkey"), lines.select("l_suppkey"))


@query(
    "set6_sub_select_operands",
    """SELECT c_custkey AS party, c_acctbal AS balance FROM customer WHERE c_acctbal < 0
       UNION SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0""",
    grouping=True,
)
def set6(t):
    customers = t("customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance"))
    suppliers = t("supplier").filter(F.col("s_acctbal") < 0).select("s_suppkey", "s_acctbal")
    return R.union(customers, suppliers)
