"""Order that outlives a sort, numbers given in parallel, slices, interval joins, and SQL names."""

import math
import random

import pytest

from tessera.operators.expr import col
from tessera.operators.frame import Frame
from tessera.plans.sql import SqlContext, sql


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice([None, float("nan"), *range(40)]), rng.choice(["a", "b", "", None, "éa"])) for i in range(500)]


@pytest.fixture(scope="module")
def f(spark, rows):
    df = spark.createDataFrame([(i, None if x is None else float(x), s) for i, x, s in rows], "id int, x double, s string").repartition(7)
    return Frame(df, "id")


def by_x(rows, descending=False):
    place = lambda x: (x is None, 0 if x is None else (-1 if descending else 1) * (1e9 if math.isnan(x) else x))
    return sorted(rows, key=lambda r: (place(r[1]), r[0]))


@pytest.mark.parametrize("descending", [False, True])
def test_a_sort_holds_through_later_steps(f, rows, descending):
    want = [r[0] for r in by_x(rows, descending)]
    out = f.sort("x", descending=descending)
    assert [r["id"] for r in out.df.collect()] == want
    assert [r["id"] for r in out.select("id").df.collect()] == want
    assert [r["id"] for r in out.with_columns(y=col("x") * 2).drop("x").rename({"id": "k"}).rename({"k": "id"}).df.collect()] == want
    odd = [i for i in want if i % 2]
    assert [r["id"] for r in out.filter((col("id") % 2).eq(1)).select("id").df.collect()] == odd
    assert [r["id"] for r in out.filter((col("id") % 2).eq(1)).head(9).df.collect()] == odd[:9]
    assert [r["id"] for r in out.with_row_number().select("id", "row_nr").df.collect()] == want
    assert {r["id"]: r["row_nr"] for r in out.with_row_number().df.collect()} == {k: n for n, k in enumerate(want)}


@pytest.mark.parametrize("keys", [("x",), ("s", "id"), ("s", "x"), ("id",)])
def test_numbers_are_consecutive_in_any_order(f, rows, keys):
    at = {"id": lambda r: (False, r[0]), "x": lambda r: (r[1] is None, 0 if r[1] is None else 1e9 if math.isnan(r[1]) else r[1]), "s": lambda r: (r[2] is None, (r[2] or "").encode())}
    want = sorted(rows, key=lambda r: [at[k](r) for k in (*keys, "id")])
    got = sorted((r["n"], r["id"]) for r in f.sort(*keys).with_row_number("n").df.collect())
    assert got == [(n, r[0]) for n, r in enumerate(want)]


def test_hidden_order_stays_hidden(f, rows):
    assert f.select("x").sort("x").df.columns == ["x"] and f.select("x").reverse().df.columns == ["x"]
    last_first = f.select("x").reverse().with_row_number().df.collect()
    assert [r["row_nr"] for r in last_first] == list(range(500))
    assert [repr(r["x"]) for r in last_first] == [repr(None if x is None else float(x)) for _, x, _ in rows[::-1]]


def test_no_rows_to_number(spark):
    none = Frame(spark.createDataFrame([], "id int, x double"), "id")
    assert none.with_row_number().df.count() == 0 and none.sort("x").with_row_number().df.count() == 0
    assert [r[1] for r in none.describe().collect()][0] == 0.0


@pytest.mark.parametrize(("offset", "length"), [(0, 3), (495, 20), (-3, None), (-900, 4), (10, None), (600, 2)])
def test_slices_of_expressions_are_clipped(f, offset, length):
    start = max(0, 500 + offset) if offset < 0 else offset
    want = list(range(500))[start:] if length is None else list(range(500))[start : start + length]
    assert [r[0] for r in f.select(col("id").slice(offset, length)).collect()] == want


def test_slices_must_agree(f):
    with pytest.raises(ValueError):
        f.select(col("id").slice(0, 2), col("x"))


def test_interval_join_is_every_pair(spark):
    rng = random.Random(4)
    spans = [(i, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) for i in range(60)] + [(60, 3.0, 3.0), (61, None, 4.0), (62, float("-inf"), -10.0), (63, 5.0, 2.0), (64, float("nan"), 3.0), (65, -1e300, 1e300), (66, 1.0, float("inf")), (67, 2.0, 2.0 + 2**-40)]
    points = [(i, rng.choice([3.0, 2.0, rng.uniform(-60, 60)])) for i in range(80)] + [(80, None), (81, float("nan")), (82, float("inf")), (83, -1e299)]
    a = Frame(spark.createDataFrame(spans, "i int, low double, high double"), "i")
    b = Frame(spark.createDataFrame(points, "j int, v double"), "j")
    want = sorted((i, j) for i, lo, hi in spans for j, v in points if None not in (lo, hi, v) and lo <= v <= hi)
    assert sorted((r["i"], r["j"]) for r in a.join_range(b, "low", "high", "v").collect()) == want


def test_sql_names(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "id int, x int")
    spark.range(5).createOrReplaceTempView("t")
    try:
        c = SqlContext(spark).register("T", t)
        assert [tuple(r) for r in c.sql("SELECT id, x FROM t ORDER BY id").collect()] == [(1, 10), (2, 20)]
        assert c.sql("SELECT x, id FROM t WHERE x > 10").collect()[0]["id"] == 2
        assert c.sql("SELECT count(*) AS n, id FROM t GROUP BY id").count() == 2
        assert c.sql("SELECT a.id FROM t a, t b WHERE a.id < b.x AND b.x = 20").count() == 2
        # The view of that name is as it was.
        assert spark.table("t").count() == 5
    finally:
        spark.catalog.dropTempView("t")
    assert sql(t, "SELECT id, x FROM self").count() == 2
    assert not spark.catalog.tableExists("self") and not spark.catalog.tableExists("t")
