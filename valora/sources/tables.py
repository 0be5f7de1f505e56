"""Driver tables and the one-row-per-order "sales" table.

The sales table is ``orders ⋈ customer ⋈ nation`` left-joined to per-order
aggregates of ``lineitem``.  lineitem is aggregated *before* the join (partial
aggregation runs map-side, so a hot order key sends one row per map task).
The dimensions are joined by key without hints: Spark broadcasts a side by its
size in bytes, from file statistics or as measured at run time.  With ``merge``
orders, customers and lines are joined by sort and merge, whose tasks hold a
partition and spill it: a broadcast is chosen by the bytes of compressed files,
and the rows it puts into every task are many times that.

Missing values are injected from the order key (never rows dropped), so Spark
and the SQL oracle see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions.exprs import zero_sign

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Injected missing values, by order key modulus.
NULL_ACCTBAL_MOD = 17
NULL_PRIORITY_MOD = 23
NULL_SEGMENT_MOD = 29


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_aggregates(lineitem: DataFrame) -> DataFrame:
    """Per-order aggregates of lineitem (one row per l_orderkey)."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.sum("l_quantity"), 2).alias("line_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("line_price"),
        F.max(zero_sign(F.col("l_discount"))).alias("max_discount"),
        F.max(zero_sign(F.col("l_tax"))).alias("max_tax"),
        F.max("l_linestatus").alias("line_status"),
        F.max("l_shipdate").alias("last_ship"),
    )


def sales_table(spark: SparkSession, sf_dir: str, merge: bool = False) -> DataFrame:
    """One row per order; target ``o_totalprice``, id ``o_orderkey``."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = line_aggregates(read_table(spark, sf_dir, "lineitem"))

    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
    if merge:
        cust, lines = cust.hint("merge"), lines.hint("merge")
    key = F.col("o_orderkey")
    joined = (
        orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
        .join(lines, key == lines.l_orderkey, "left")
    )
    return joined.select(
        key,
        F.col("o_totalprice"),
        F.col("o_orderstatus"),
        F.when(key % NULL_PRIORITY_MOD == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.year("o_orderdate").cast("int").alias("order_year"),
        F.month("o_orderdate").cast("int").alias("order_month"),
        F.when(key % NULL_ACCTBAL_MOD == 0, F.lit(None)).otherwise(F.col("c_acctbal"))
        .alias("c_acctbal"),
        F.when(key % NULL_SEGMENT_MOD == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
        F.col("n_name"),
        F.col("n_lines").cast("long").alias("n_lines"),
        "line_qty", "line_price", "max_discount", "max_tax", "line_status",
        F.year("last_ship").cast("int").alias("last_ship_year"),
        F.datediff(F.col("last_ship"), F.col("o_orderdate")).cast("int").alias("ship_lag_days"),
    )


# Equivalent SQL (DuckDB dialect) used by the oracle queries.
SALES_SQL = f"""
sales AS (
  WITH line_agg AS (
    SELECT l_orderkey,
           count(*) AS n_lines,
           round(sum(l_quantity), 2) AS line_qty,
           round(sum(l_extendedprice), 2) AS line_price,
           max(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_discount END) AS max_discount,
           max(CASE WHEN l_tax = 0 THEN 0.0 ELSE l_tax END) AS max_tax,
           max(l_linestatus) AS line_status,
           max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_orderkey
  )
  SELECT o.o_orderkey,
         o.o_totalprice,
         o.o_orderstatus,
         CASE WHEN o.o_orderkey % {NULL_PRIORITY_MOD} = 0 THEN NULL ELSE o.o_orderpriority END
           AS o_orderpriority,
         CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
         CAST(month(o.o_orderdate) AS INTEGER) AS order_month,
         CASE WHEN o.o_orderkey % {NULL_ACCTBAL_MOD} = 0 THEN NULL ELSE c.c_acctbal END AS c_acctbal,
         CASE WHEN o.o_orderkey % {NULL_SEGMENT_MOD} = 0 THEN NULL ELSE c.c_mktsegment END
           AS c_mktsegment,
         n.n_name,
         CAST(a.n_lines AS BIGINT) AS n_lines,
         a.line_qty, a.line_price, a.max_discount, a.max_tax, a.line_status,
         CAST(year(a.last_ship) AS INTEGER) AS last_ship_year,
         CAST(datediff('day', o.o_orderdate, a.last_ship) AS INTEGER) AS ship_lag_days
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN line_agg a ON a.l_orderkey = o.o_orderkey
)"""
