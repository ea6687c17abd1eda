"""Logarithms are rounded right, so that they meet those of the twin where they are scaled to nine places."""

import math
from decimal import Decimal, localcontext

import duckdb
import pytest

from tessera import catalog
from tessera.functions import numbers

#: Of nine million prices with all their digits, the one whose logarithm Spark's own takes to the other side of a half.
PRICES = [(55073553, 228919.73719471684), (2, 1.0)]


def test_math_guarded_has_the_logs_of_its_twin(spark, tmp_path):
    spark.createDataFrame(PRICES, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["l"] for r in catalog.QUERIES["math_guarded"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == {r["o_orderkey"]: r["l"] for r in con.sql(catalog.ORACLES["math_guarded"]).to_arrow_table().to_pylist()}


def test_log_is_the_nearest_double(spark):
    xs = [math.exp(e / 7) for e in range(-4200, 4200, 3)] + [1 + d / 997 for d in range(-400, 400)] + [1.0, 0.5, 2.0, 1 - 2.0**-53, 1 + 2.0**-52]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", numbers.log(df["x"]).alias("y")).collect()
    with localcontext(prec=60):
        assert [r["x"] for r in got if r["y"] != float(Decimal(r["x"]).ln())] == []


@pytest.mark.parametrize("x", [5e-324, 1.7976931348623157e308, math.inf, 0.0, -1.0, math.nan, None])
def test_log_of_edges(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    got = df.select(numbers.log(df["x"])).first()[0]
    want = None if x is None else math.nan if math.isnan(x) or x < 0 else -math.inf if x == 0 else math.log(x)
    assert got == want or math.isnan(got) and math.isnan(want)
