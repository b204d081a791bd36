"""Subject panels derived from the driver tables (see FIXTURES.md).

``account_panel``: one row per customer with the churn-table shape
(id, binary and multi-level categories, tenure, money as in the
reference, churn flag).  ``shipment_panel``: one row per line item with
(k, t, e, q, p), the large fixture for survival aggregates.

Plan shape: orders are aggregated per customer first (partial aggregate
on the map side, so a hot customer is pre-combined before the shuffle),
then joined to customers on the aggregate's own hash partitioning; the
newest order date is a scalar subquery, not a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.sources.tables import read_table

# Churn rule of the panel (days without an order) and month length.
CHURN_GAP_DAYS = 180
DAYS_PER_MONTH = 30.0


def account_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders",
                        ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])

    t_end = orders.select(F.max("o_orderdate")).scalar()
    o = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("t0"),
        F.max("o_orderdate").alias("t1"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_p"),
    )
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    b = (customer.join(geo, customer.c_nationkey == geo.n_nationkey)
         .join(o, o.o_custkey == customer.c_custkey)
         .withColumn("gap", F.datediff(t_end, F.col("t1")))
         .withColumn("churned", F.col("gap") > CHURN_GAP_DAYS)
         .withColumn("days", F.when(F.col("churned"), F.datediff(F.col("t1"), F.col("t0")))
                     .otherwise(F.datediff(t_end, F.col("t0")))))
    months = F.floor(F.col("days") / F.lit(DAYS_PER_MONTH))
    billed_months = F.when(F.col("days") < 30, F.lit(1)).otherwise(months)
    return b.select(
        F.col("c_custkey").alias("account_id"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("senior"),
        F.when(F.col("n_urgent") > 0, "Yes").otherwise("No").alias("partner"),
        F.when(F.col("n_p") % 2 == 0, "Yes").otherwise("No").alias("dependents"),
        months.cast("int").alias("tenure"),
        F.col("c_mktsegment").alias("payment_method"),
        F.col("r_name").alias("internet_service"),
        F.when(F.col("r_name") == "ASIA", "No internet service")
         .when(F.col("n_f") % 2 == 0, "Yes").otherwise("No").alias("online_security"),
        F.when(F.col("n_orders") < 8, "Month-to-month")
         .when(F.col("n_orders") < 12, "One year").otherwise("Two year").alias("contract"),
        (F.floor(F.col("cents").cast("double") / billed_months.cast("double")).cast("double") / 100.0)
        .alias("monthly_charges"),
        F.when(F.col("days") < 30, F.lit(" "))
         .otherwise(F.floor(F.col("cents") / 100.0).cast("bigint").cast("string")).alias("total_charges"),
        F.when(F.col("churned"), "Yes").otherwise("No").alias("churn"),
    )


def shipment_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, e, q, p) per shipped line; ``k`` is a group key, not an id."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    j = li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("l_shipdate") >= F.col("o_orderdate"))
    return j.select(
        (F.col("o_custkey") * 1000 + F.col("l_linenumber")).alias("k"),
        F.floor(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")) / F.lit(DAYS_PER_MONTH)).cast("int").alias("t"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("e"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("p"),
    )


def clean_panel(panel: DataFrame) -> DataFrame:
    """The reference's cleaning chain on the panel: blank total -> null,
    drop, cast to double (C2, C3, C4)."""
    return (panel.withColumn("total_charges", F.nullif(F.trim("total_charges"), F.lit("")).try_cast("double"))
            .where(F.col("total_charges").isNotNull()))
