"""The registry of queries and, where DuckDB can express them, their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register a (spark, sf_dir) -> DataFrame under `name`, with its DuckDB SQL."""

    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark, sf_dir, name, *order):
    """The table as a frame in the order of the named columns."""
    from tessera.operators.frame import Frame

    return Frame(table(spark, sf_dir, name), list(order) or None)


def rounded(c, digits):
    """ROUND of a double as the twins compute it: scaled, to the nearest whole number (half away from zero), scaled back.

    Spark's own rounds the shortest decimal form, which differs where scaling meets a half.
    """
    from tessera.functions import numbers

    y = F.abs(c) * F.lit(10.0**digits)
    low = numbers.floor(y)
    r = F.signum(c) * F.when(y - low >= 0.5, low + 1).otherwise(low) / F.lit(10.0**digits)
    return F.when(F.isnan(r) | (F.abs(r) == float("inf")), c).otherwise(r)


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 4) AS sum_qty,
              ROUND(SUM(l_extendedprice), 4) AS sum_base,
              ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
              ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
       GROUP BY l_returnflag, l_linestatus""",
)
def q1_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 4).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )
