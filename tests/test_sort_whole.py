"""The whole sorted table: NaN, then prices, then nulls."""

import math
import os

import pytest

from tessera import catalog

SF = "/root/testdata/sf0.01"


def test_whole_sort_reaches_prices_and_nulls(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    got = sorted(catalog.QUERIES["sort_whole"](spark, SF).collect(), key=lambda r: r["row_nr"])
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert [r["row_nr"] for r in got] == list(range(len(got)))
    kinds = ["null" if r["p"] is None else "nan" if math.isnan(r["p"]) else "price" for r in got]
    assert set(kinds) == {"nan", "price", "null"} and kinds == sorted(kinds, key=["nan", "price", "null"].index)
    prices = [r["p"] for r, k in zip(got, kinds) if k == "price"]
    assert prices == sorted(prices, reverse=True)
