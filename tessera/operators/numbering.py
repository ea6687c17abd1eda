"""Consecutive row numbers in a global order without a single task.

Rows go to buckets along the first sort key, between its approximate quantiles; counts per bucket (at most BUCKETS + 1
rows) give each bucket its first number, and rows are ranked within their bucket. The input is read three times, so it
must give the same rows each time. Rows that agree in the first key share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import semantics as S

BUCKETS = 64
#: Bytes of a text that choose its bucket.
PREFIX = 6


def _image(c: Column, kind: T.DataType) -> Column:
    """A double that never falls where the key rises; null for null. Types without one share a bucket."""
    if isinstance(kind, T.StringType):
        raw = F.encode(c, "UTF-8")
        return F.conv(F.rpad(F.hex(F.substring(raw, 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_date(c.cast("date")).cast("double") if isinstance(kind, T.DateType) else (F.unix_date(c.cast("date")) * 86_400.0 + F.hour(c) * 3_600.0 + F.minute(c) * 60.0 + F.second(c))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if S.is_numeric(kind):
        d = c.cast("double")
        return F.when(F.isnan(d), F.lit(float("inf"))).otherwise(d)
    if isinstance(kind, T.StructType) and kind.fields:
        return _image(c[kind.fields[0].name], kind.fields[0].dataType)
    return F.when(c.isNotNull(), F.lit(0.0))


def numbered(df: DataFrame, keys: list[tuple[Column, bool, bool]], name: str, start: int = 0) -> DataFrame:
    """df with `name` (long): start, start + 1, .. in the order of keys (column, descending, nulls last)."""
    c, descending, nulls_last = keys[0]
    lead = _image(c, df.select(c).schema[0].dataType)
    lead = -lead if descending else lead
    bounds = df.agg(F.percentile_approx(lead, [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).scalar()
    place = F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col("__lead"))), F.lit(0))
    rows = df.withColumn("__lead", lead).withColumn("__bounds", bounds)
    rows = rows.withColumn("__bucket", F.when(F.col("__lead").isNull(), BUCKETS if nulls_last else -1).otherwise(place)).drop("__lead", "__bounds")
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__m"))
    before = F.sum("__m").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__m")
    heads = sizes.select(F.col("__bucket").alias("__b"), before.alias("__before"))
    order = W.partitionBy("__bucket").orderBy(*[S.sort_key(k, d, n) for k, d, n in keys])
    # At most BUCKETS + 1 rows.
    out = rows.withColumn("__inside", F.row_number().over(order)).join(F.broadcast(heads), F.col("__bucket") == F.col("__b"))
    return out.withColumn(name, F.col("__before") + F.col("__inside") + (start - 1)).drop("__bucket", "__b", "__before", "__inside")
