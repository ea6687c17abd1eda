"""Right and full joins whose null keys match: every pair once, and not in one task."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins


def brute(left, right, how):
    pairs = [(a, b) for a in left for b in right if a[:2] == b[:2]]
    out = [(a[2], b[2]) for a, b in pairs]
    out += [(None, b[2]) for b in right if not any(a[:2] == b[:2] for a in left)]
    out += [(a[2], None) for a in left if how == "outer" and not any(a[:2] == b[:2] for b in right)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["right", "outer"])
@pytest.mark.parametrize("nl, nr", [(0, 0), (0, 9), (9, 0), (9, 1), (1, 9), (10, 8)])
def test_cells_of_null_keys(spark, monkeypatch, how, nl, nr):
    monkeypatch.setattr(joins, "_CELL", 2, raising=False)
    left = [(1, "x", "a"), (2, None, "b"), (None, "x", "c"), (3, "z", "d")] + [(None, None, f"l{i // 2}") for i in range(nl)]
    right = [(1, "x", "A"), (2, None, "B"), (None, "y", "C")] + [(None, None, f"r{i}") for i in range(nr)]
    l, r = (spark.createDataFrame(x, f"k int, m string, {v} string") for x, v in ((left, "v"), (right, "w")))
    got = joins.join(l, r, ["k", "m"], ["k", "m"], how)
    assert got.columns == ["k", "m", "v", "w"]
    assert sorted(((x["v"], x["w"]) for x in got.collect()), key=repr) == brute(left, right, how)


@pytest.mark.parametrize("how", ["right", "outer"])
def test_null_keys_meet_in_several_tasks(spark, how):
    left = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("w"))
    got = joins.join(left, right, ["k"], ["k"], how).filter("k is null and v is not null and w is not null")
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 15_000 * 20 and max(per_task) < 15_000 * 20
