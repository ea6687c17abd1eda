"""Square roots that meet a half when they are scaled to nine places, as the twin rounds them."""

import math

import duckdb
import pytest

from tessera import catalog
from tessera.queries.base import rounded

#: Of nine million prices, three whose root Spark's own rounding takes to the other side.
PRICES = [(3624, 316067.14), (3811258, 73338.75), (4037443, 225409.25), (6, 225409.25), (10, 1.0)]


def test_math_guarded_rounds_as_its_twin(spark, tmp_path):
    spark.createDataFrame(PRICES, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r for r in catalog.QUERIES["math_guarded"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["math_guarded"]).to_arrow_table().to_pylist()
    assert len(want) == len(got) == len(PRICES)
    for r in want:
        for c in ("l", "r"):
            a, b = got[r["o_orderkey"]][c], r[c]
            assert a == b or math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize("x, digits, want", [(2.5, 0, 3.0), (-2.5, 0, -3.0), (0.0, 9, 0.0), (1e300, 9, 1e300), (float("-inf"), 9, float("-inf")), (None, 9, None)])
def test_rounded(spark, x, digits, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(rounded(df["x"], digits)).first()[0] == want
