"""Adapters: the driver's parquet tables -> the input shapes the operators expect.

The reference works on small subscription CSVs; at scale the same operators
run on columns derived from the TPC-H-like tables.  Dirt (nulls, copies,
messy text) is injected by deterministic modulus so the DuckDB oracle can
reproduce it exactly.  Every adapter is a lazy projection / join / aggregate,
so scans prune to the columns a query actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI transactions: one row per order with its customer's segment.

    ``row_id`` (= order key) is the file order the reference's "first" rules use.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_mktsegment").alias("customer_type"),
        F.col("o_orderpriority").alias("product"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
         .when(F.col("o_orderstatus") == "O", "success")
         .otherwise("failed").alias("payment_status"),
        (F.lit(20) + F.col("o_custkey") % 70).alias("acquisition_cost"),
    )


def _churn(c="c_custkey"):
    return F.when(F.col(c) % 5 == 0, 1).otherwise(0)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_type"),
        F.concat(F.lit("P"), (F.col("c_nationkey") % 3).cast("string")).alias("product"),
        F.col("c_acctbal").alias("revenue"),
        (F.col("c_custkey") % 9).alias("support_tickets"),
        _churn().alias("churn"),
    )


def segment_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_type"),
        (F.col("c_acctbal") * 10).alias("lifetime_value"),
        _churn().alias("churn"),
        (F.col("c_custkey") % 9).alias("support_tickets"),
        (F.col("c_custkey") % 700).alias("retention_days"),
    )


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders")))


def correlation_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    per_customer = o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.sum("o_totalprice").alias("engagement"),
        F.count(F.lit(1)).alias("transactions_per_month"))
    seg = segments(spark, sf_dir).select("customer_id", "support_tickets", "churn")
    return per_customer.join(seg, "customer_id", "inner")


def missing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls injected by order-key modulus; ``o_orderkey`` is the row order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 13 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(k % 11 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 17 == 0, None).otherwise(F.col("o_orderdate").cast("date")).alias("o_orderdate"),
        F.when(k % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def unstandardised_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as messy text, the way a hand-kept CSV arrives."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    price = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2))
    price = (F.when(k % 23 == 0, F.lit("n/a"))
             .when(k % 3 == 0, F.concat(F.lit("  "), price, F.lit(" ")))
             .when(k % 3 == 1, F.concat(F.format_number(F.col("o_totalprice"), 2), F.lit(" USD")))
             .otherwise(price))
    date_txt = (F.when(k % 19 == 0, F.lit("not-a-date"))
                .when(k % 4 == 1, F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                                              F.dayofmonth(d).cast("string")))
                .when(k % 4 == 2, F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" ")))
                .otherwise(F.date_format(d, "yyyy-MM-dd")))
    flag = (F.when(k % 6 == 0, "T").when(k % 6 == 1, "yes").when(k % 6 == 2, "0")
            .when(k % 6 == 3, "maybe").when(k % 6 == 4, " False ").otherwise("n"))
    name = (F.when(k % 3 == 0, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")))
            .when(k % 3 == 1, F.upper("o_orderpriority"))
            .otherwise(F.col("o_orderpriority")))
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        date_txt.alias("order_date"),
        price.alias("total_price"),
        flag.alias("auto_renew"),
        name.alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def duplicated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders plus exact copies (key % 5 = 0) and near copies with a null priority (key % 9 = 0)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    k = F.col("o_orderkey")
    base = o.withColumn("row_id", k * 3)
    exact = o.filter(k % 5 == 0).withColumn("row_id", k * 3 + 1)
    near = (o.filter(k % 9 == 0).withColumn("o_orderpriority", F.lit(None).cast("string"))
            .withColumn("row_id", k * 3 + 2))
    return base.unionByName(exact).unionByName(near)


def sample_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's small intake sample, at scale: one row per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("customer_name"),
        F.col("o_totalprice").alias("transaction_amount"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
    )


def chart_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_shipdate").cast("date").alias("order_date"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("product_line"),
        (F.col("l_extendedprice") / 300).alias("order_amount"),
        (F.col("l_extendedprice") * F.col("l_discount") / 300).alias("marketing_spend"),
    )


def viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewer-style records (data-dictionary column names) derived from orders and customers."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    plan = (F.when(F.col("o_orderpriority") == "1-URGENT", "Premium")
            .when(F.col("o_orderpriority") == "2-HIGH", "Standard")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Basic")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "basic")
            .otherwise(None))
    status = (F.when(F.col("o_orderstatus") == "F", "Cancelled")
              .when(F.col("o_orderstatus") == "O", "Active").otherwise("Paused"))
    return j.select(
        F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("viewer_id"),
        F.col("c_name").alias("user_name"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"),
        plan.alias("subscription_plan"),
        ((F.col("c_acctbal") / 100).cast("double")).alias("monthly_fee"),
        F.concat(F.lit("C"), (k % 97).cast("string")).alias("content_id"),
        F.col("o_orderdate").cast("date").alias("watch_date"),
        F.when(k % 29 == 0, None).otherwise(F.col("o_totalprice") / 1000 - 50).alias("watch_duration_minutes"),
        ((k % 120) / 100.0).alias("completion_rate"),
        (k % 9).alias("viewing_frequency_per_week"),
        status.alias("subscription_status"),
        (F.col("o_custkey") % 5 == 0).cast("int").alias("churn"),
        F.col("o_orderkey").alias("order_ref"),
    )


def events_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON ``props`` text is parsed into a STRUCT (the nested-record fixture)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id",
        F.struct(F.col("event_type").alias("type"), F.col("value").alias("value"),
                 F.from_json("props", "k BIGINT").alias("props"),
                 F.struct(F.col("ts").alias("ts")).alias("time")).alias("event"),
    )
