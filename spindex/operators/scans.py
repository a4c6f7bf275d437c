"""Scans shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, value: Column, order_col: str, out_col: str, span: int = 100_000) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one by a unique integer order, without sorting all rows in one task.

    Rows are cut into spans of the order; sums of spans are added up first (one row a
    span), then rows within each span.
    """
    cut = df.withColumn("_v", value.cast("long")).withColumn("_span", F.floor(F.col(order_col) / F.lit(span)))
    totals = cut.groupBy("_span").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("_v").over(Window.partitionBy("_span").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_w", within).join(totals.select("_span", before.alias("_b")), "_span").withColumn(out_col, F.col("_w") + F.col("_b")).drop("_v", "_span", "_w", "_b")


def running_min_after(df: DataFrame, value: str, order_col: str, out_col: str, span: int = 100_000) -> DataFrame:
    """Adds the least ``value`` among the rows after this one by a unique integer order (null for the last).

    The order is falling, so the frames grow from their first row and each row costs one
    comparison; a frame open at its other end would be scanned anew for every row.
    """
    cut = df.withColumn("_span", F.floor(F.col(order_col) / F.lit(span)))
    totals = cut.groupBy("_span").agg(F.min(value).alias("_t"))
    after = F.min("_t").over(Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1))
    within = F.min(value).over(Window.partitionBy("_span").orderBy(F.desc(order_col)).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_w", within).join(totals.select("_span", after.alias("_a")), "_span").withColumn(out_col, F.least("_w", "_a")).drop("_span", "_w", "_a")
