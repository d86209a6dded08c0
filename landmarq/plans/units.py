"""Unit tables made of the registered tables: units with groups, weights and features, vectors, panels, predictions, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as units of their nations, weighted by positive balances, with figures of their orders."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("grp"), F.greatest("c_acctbal", F.lit(0.0)).alias("weight"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend"), F.max("o_totalprice").alias("largest"))
    return customers.join(orders, "unit_id", "left")


def plain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit_id, grp, weight, balance`` only: one scan, no join."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("grp"), F.greatest("c_acctbal", F.lit(0.0)).alias("weight"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as units of their labels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("vec"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), F.col("ts").alias("time"), "value", F.col("event_type").alias("grp"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as the truth, 1.7 times the customer's balance plus 100000 as a prediction, by nation and status."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("y_true"), F.col("o_orderstatus").alias("target"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("grp"), (F.col("c_acctbal") * 1.7 + 100000).alias("y_pred"))
    return orders.join(customers, "o_custkey").select("target", "grp", "y_true", "y_pred")


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of labels that stand for truth and prediction."""
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``method, rep, metric, value``: priorities as methods, regions as replicates, three figures of their orders."""
    joined = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed table of 25 rows
    )
    sums = joined.groupBy(F.col("o_orderpriority").alias("method"), F.col("n_regionkey").alias("rep")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("rmse_price"), F.round(F.stddev_pop("o_totalprice"), 4).alias("mae_price"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("double")), 6).alias("accuracy_open")
    )
    return sums.unpivot(["method", "rep"], ["rmse_price", "mae_price", "accuracy_open"], "metric", "value")


def front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidate, f1, f2, f3``: brands with the mean price, the mean size and the negative count of their parts."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("candidate")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("f1"), F.round(F.avg("p_size"), 4).alias("f2"), (-F.count(F.lit(1))).cast("double").alias("f3")
    )
