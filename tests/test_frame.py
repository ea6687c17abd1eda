"""Frames and expressions on small tables with null, NaN, infinities, ties and no rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import expr as E
from tessera.operators import windows as win
from tessera.operators.expr import col, lit, when
from tessera.operators.frame import Frame
from tessera.plans.sql import SqlContext, sql
from tessera.sources import readers, writers

NAN, INF = float("nan"), float("inf")


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))))


def check(got, want):
    assert len(got) == len(want) and all(same(x, y) for x, y in zip(got, want)), (got, want)


@pytest.fixture(scope="module")
def f(spark):
    return Frame.from_dict(spark, {"g": ["a", "b", "a", None, "b", "a"], "x": [1.0, NAN, None, -INF, 0.0, 1.0], "i": [3, 1, 2, 0, None, 3]})


def test_comparisons_and_logic(f):
    x, i = col("x"), col("i")
    got = f.select(x.eq(1.0).alias("eq"), x.ne(None).alias("ne"), (x < 1.0).alias("lt"), (x >= x).alias("ge"), x.is_nan().alias("nan"), ((i > 1) & (x > 0.0)).alias("and_")).to_dict()
    check(got["eq"], [True, False, False, False, False, True])
    check(got["ne"], [True, True, False, True, True, True])
    check(got["lt"], [False, False, None, True, True, False])
    check(got["ge"], [True, False, None, True, True, True])
    check(got["nan"], [False, True, False, False, False, False])
    check(got["and_"], [True, False, None, False, None, True])


def test_division(f):
    got = f.select((col("x") / 0.0).alias("z"), (col("i") / 2).alias("h"), (col("i") / 0).alias("n"), (col("i") % 2).alias("m"), (-col("i") / 2).alias("t")).to_dict()
    check(got["z"], [INF, NAN, None, -INF, NAN, INF])
    check(got["h"], [1, 0, 1, 0, None, 1])
    check(got["n"], [None] * 6)
    check(got["m"], [1, 1, 0, 0, None, 1])
    check(got["t"], [-1, 0, -1, 0, None, -1])


def test_aggregates(f, spark):
    got = f.select(col("x").min().alias("lo"), col("x").max().alias("hi"), col("x").count().alias("n"), col("x").n_unique().alias("u"), col("i").sum().alias("s"), col("i").first().alias("f"), col("i").last().alias("l")).to_dict()
    assert got["lo"] == [-INF] and got["hi"] == [1.0] and got["n"] == [5] and got["u"] == [5] and got["s"] == [9] and got["f"] == [3] and got["l"] == [3]
    none = Frame.empty(spark, "a double, b string")
    assert none.select(col("a").sum().alias("s"), col("a").n_unique().alias("u")).to_dict() == {"s": [None], "u": [0]}
    assert none.with_columns(r=col("a").rank(), c=col("a").cum_sum()).to_dict() == {"a": [], "b": [], "r": [], "c": []}


def test_quantile_modes(spark):
    f = Frame.from_dict(spark, {"v": [4.0, 1.0, None, 3.0, 2.0]})
    got = f.select(*[col("v").quantile(0.4, m).alias(m) for m in ("linear", "lower", "higher", "nearest", "midpoint")]).to_dict()
    assert {k: v[0] for k, v in got.items()} == {"linear": pytest.approx(2.2), "lower": 2.0, "higher": 3.0, "nearest": 2.0, "midpoint": 2.5}
    with pytest.raises(ValueError):
        col("v").quantile(1.5).lower(f._scope())


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_order_does_not_depend_on_partitions(spark, parts):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), None if rng.random() < 0.2 else rng.choice([0.0, -1.5, 2.0, NAN, INF])) for i in range(80)]
    f = Frame(spark.createDataFrame(rows, "k int, g string, v double").repartition(parts), "k")
    got = f.with_columns(s=col("v").shift(2).over("g"), n=E.row_number().over("g"), ff=col("v").fill_forward().over("g"), c=col("v").cum_count().over("g"), r=col("v").rolling_sum(3, 2).over("g")).to_dict()
    for g in "ab":
        at = [i for i in range(80) if rows[i][1] == g]
        v = [rows[i][2] for i in at]
        check([got["s"][i] for i in at], [None, None, *v[:-2]])
        check([got["n"][i] for i in at], list(range(1, len(at) + 1)))
        check([got["c"][i] for i in at], [sum(x is not None for x in v[: j + 1]) for j in range(len(v))])
        last, ff = None, []
        for x in v:
            last = x if x is not None else last
            ff.append(last)
        check([got["ff"][i] for i in at], ff)
        roll = []
        for j in range(len(v)):
            w = [x for x in v[max(0, j - 2) : j + 1] if x is not None]
            roll.append(sum(w) if len(w) >= 2 else None)
        check([got["r"][i] for i in at], roll)


def test_ewm_var_recursion(spark):
    xs = [1.0, None, 3.0, 2.0, 2.0, None, 7.0]
    f = Frame.from_dict(spark, {"v": xs})
    got = f.with_columns(e=col("v").ewm_var(0.3), b=col("v").ewm_var(0.3, bias=True), p=col("v").ewm_var(0.3, ignore_nulls=False), s=col("v").ewm_std(0.3)).to_dict()

    def model(bias, keep):
        out, n, m, var, w, q = [], 0, 0.0, 0.0, 1.0, 1.0
        for x in xs:
            if x is None:
                out.append(var if keep and n >= 2 else None)
                continue
            n += 1
            if n == 1:
                m, var, w, q = x, 0.0, 1.0, 1.0
                out.append(None)
                continue
            nw, nq = 0.3 + 0.7 * w, 0.09 + 0.49 * q
            var = 0.7 * (var + 0.3 * (x - m) ** 2)
            if not bias:
                var *= nw * nw / (nw * nw - nq)
            m, w, q = (0.3 * x + 0.7 * m * w) / nw, nw, nq
            out.append(var)
        return out

    check(got["e"], model(False, True))
    check(got["b"], model(True, True))
    check(got["p"], model(False, False))
    check(got["s"], [None if x is None else math.sqrt(x) for x in model(False, True)])


def test_alpha_conversions():
    assert win.alpha_from_span(3) == 0.5 and win.alpha_from_com(1) == 0.5 and win.alpha_from_halflife(1) == pytest.approx(0.5)
    for bad in (lambda: win.alpha_from_span(0.5), lambda: win.alpha_from_com(-1), lambda: win.alpha_from_halflife(0)):
        with pytest.raises(ValueError):
            bad()


def test_joins_with_null_keys(spark):
    a = Frame.from_dict(spark, {"k": ["x", None, "y", "x"], "v": [1, 2, 3, 4]})
    b = Frame.from_dict(spark, {"k": ["x", None, "z", "x"], "v": [10, 20, 30, 40]})
    rows = lambda fr: sorted(map(str, (tuple(r) for r in fr.collect())))
    inner = [("x", 1, 10), ("x", 1, 40), ("x", 4, 10), ("x", 4, 40), (None, 2, 20)]
    assert rows(a.join(b, "k")) == sorted(map(str, inner)) and a.join(b, "k").columns == ["k", "v", "v_right"]
    assert rows(a.join(b, "k", how="outer")) == sorted(map(str, [*inner, ("y", 3, None), (None, None, 30)]))
    assert rows(a.join(b, "k", how="outer", coalesce_keys=True)) == sorted(map(str, [*inner, ("y", 3, None), ("z", None, 30)]))
    assert a.join(b, "k", how="right").columns == ["k", "v_right", "v"]
    assert rows(a.join(b, "k", how="anti")) == ["('y', 3)"] and len(a.join(b, "k", how="semi").collect()) == 3
    with pytest.raises(ValueError):
        a.join(b, "k", how="sideways")


def test_rows_and_shape(f, spark):
    assert f.head(2).to_dict()["i"] == [3, 1] and f.tail(2).to_dict()["i"] == [None, 3] and f.slice(1, 2).to_dict()["i"] == [1, 2]
    assert f.sort("i", descending=True).to_dict()["i"] == [3, 3, 2, 1, 0, None] and f.sort("i").head(2).to_dict()["i"] == [0, 1]
    check(f.sort("x").to_dict()["x"], [-INF, 0.0, 1.0, 1.0, NAN, None])
    assert f.unique("g").to_dict()["g"] == ["a", "b", None] and f.reverse().to_dict()["i"] == [3, None, 0, 2, 1, 3]
    assert f.take([5, 0, 0]).to_dict()["i"] == [3, 3, 3] and f.drop("x", "nope").columns == ["g", "i"] and f.shape() == (6, 3)
    assert f.vconcat(f).to_dict()["i"] == [3, 1, 2, 0, None, 3] * 2
    assert f.select("g").hconcat(f.select(col("i").alias("j"))).to_dict()["j"] == [3, 1, 2, 0, None, 3]
    assert f.drop_nulls("i").shape()[0] == 5 and f.sample(3, seed=1).shape()[0] == 3
    assert [r["count"] for r in f.value_counts("g").collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        Frame.from_dict(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError):
        f.vconcat(f.select("g"))


def test_groups(f):
    got = {r["g"]: r for r in f.group_by("g").agg(n=E.count(), s=col("i").sum(), first=col("x").first(), u=col("i").n_unique()).collect()}
    assert (got["a"]["n"], got["a"]["s"], got["a"]["first"], got["a"]["u"]) == (3, 8, 1.0, 2) and got[None]["n"] == 1 and got["b"]["u"] == 2
    assert {k: g.shape()[0] for (k,), g in f.group_by("g").groups()} == {"a": 3, "b": 2, None: 1}
    with pytest.raises(ValueError):
        f.group_by("g").agg({"i": ["mode"]})


def test_strings_and_lists(spark):
    f = Frame.from_dict(spark, {"s": ["o'neil-smith ab", "", None, "  pad\t"], "n": ["-7", "12", "123456", None]})
    got = f.select(col("s").str.titlecase().alias("t"), col("s").str.strip().alias("p"), col("n").str.zfill(5).alias("z"), col("s").str.find("a", 1).alias("f"), col("s").str.find_last("a").alias("l"), col("s").str.split("-").list.lengths().alias("k"), col("s").str.substring(-3, 2).alias("b")).to_dict()
    assert got["t"] == ["O'neil-Smith Ab", "", None, "  Pad\t"] and got["p"] == ["o'neil-smith ab", "", None, "pad"]
    assert got["z"] == ["-0007", "00012", "123456", None] and got["f"] == [13, -1, None, 3] and got["l"] == [13, -1, None, 3]
    assert got["k"] == [2, 1, None, 1] and got["b"] == [" a", "", None, "ad"]


def test_when_cast_fill(f):
    got = f.select(when(col("i") > 2).then("big").when(col("i") > 0).then("small").alias("w"), col("i").fill_null(-1).alias("n"), col("x").cast("string").alias("s"), lit("zz").cast("bigint").alias("bad")).to_dict()
    assert got["w"] == ["big", "small", "small", None, None, "big"] and got["n"] == [3, 1, 2, 0, -1, 3]
    assert got["s"][0] == "1" and got["s"][2] is None and got["bad"] == [None] * 6


def test_csv_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d,e,f\n1, 7 ,x,2024-01-02,,0\n0,3000000000,"q,""r""",2024-02-03,,1\n1,NA,null,n/a,,2\n')
    f = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(f.dtypes) == {"a": "boolean", "b": "bigint", "c": "string", "d": "date", "e": "boolean", "f": "int"}
    assert f.to_dict()["c"] == ["x", 'q,"r"', None] and f.to_dict()["b"] == [7, 3000000000, None]
    text = writers.csv_text(Frame.from_dict(spark, {"a": [1.0, NAN], "s": ['x"y', "p,q"]}))
    assert text == 'a,s\n1,"x""y"\n,"p,q"\n'
    assert readers.read_csv_lines(spark, "x;y\n1;u\n2;v\n", separator=";").to_dict() == {"x": [1, 2], "y": ["u", "v"]}
    skipped = readers.read_csv(spark, str(tmp_path / "t.csv"), skip_rows=1, header=False)
    assert skipped.shape()[0] == 3


def test_json(spark, tmp_path):
    f = Frame.from_dict(spark, {"a": [1.0, NAN], "s": ["é", None]})
    assert writers.json_text(f) == '[{"a":1.0,"s":"é"},{"a":null,"s":null}]'
    writers.write_json(f, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j")).select("a", "s").to_dict() == {"a": [1.0, None], "s": ["é", None]}


def test_sql_context(f, spark):
    ctx = SqlContext(spark).register("T", f)
    assert ctx.sql("SELECT count(*) AS n, STD(i) AS s FROM t WHERE g = 'a' OR g = 'from t'").first()["n"] == 3
    assert sql(f, "SELECT max(i) AS m FROM self").first()["m"] == 3
    assert ctx.unregister("t") and not ctx.unregister("t")
    with pytest.raises(ValueError):
        ctx.sql("  ")


def test_asof(spark):
    a = Frame.from_dict(spark, {"k": ["x", "x", "y"], "t": [5, 1, 9]})
    b = Frame.from_dict(spark, {"k": ["x", "x", "y"], "t": [2, 5, 10], "v": [1, 2, 3]})
    assert {(r["k"], r["t"]): r["v"] for r in a.join_asof(b, "t", ["k"]).collect()} == {("x", 5): 2, ("x", 1): None, ("y", 9): None}
    assert {(r["k"], r["t"]): r["v"] for r in a.join_asof(b, "t", ["k"], "forward").collect()} == {("x", 5): 2, ("x", 1): 1, ("y", 9): 3}


def test_filters_reach_the_files(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.col("id").cast("string").alias("s"), F.lit(1).alias("unused")).write.parquet(str(tmp_path / "p"))
    plan = readers.read_parquet(spark, str(tmp_path / "p")).filter((col("id") > 50) & (col("id") < 60)).select("s").explain()
    assert "PushedFilters: [IsNotNull(id)" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
