"""Queries of surveyed rows that no other module exercises: constructors, shortcuts, order and slices."""

from __future__ import annotations

import datetime
import functools

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import nested, strings
from tessera.operators import expr as E
from tessera.operators.expr import col, lit, when
from tessera.operators.frame import Frame
from tessera.plans.sql import SqlContext, sql
from tessera.queries.base import frame, query, table
from tessera.sources import readers
from tessera.streaming import streams

_KINDS = {"sum": "sum(c_acctbal)", "mean": "avg(c_acctbal)", "median": "median(c_acctbal)", "min": "min(c_acctbal)", "max": "max(c_acctbal)", "std": "stddev_samp(c_acctbal)", "var": "var_samp(c_acctbal)"}


@query("group_shortcuts", " UNION ALL ".join(f"SELECT c_mktsegment, '{k}' AS kind, ROUND({s}, 4) AS v FROM customer GROUP BY c_mktsegment" for k, s in _KINDS.items()))
def group_shortcuts(spark, d):
    g = frame(spark, d, "customer", "c_custkey").select("c_mktsegment", "c_acctbal").group_by("c_mktsegment")
    parts = [getattr(g, k)().df.select("c_mktsegment", F.lit(k).alias("kind"), F.round("c_acctbal", 4).alias("v")) for k in _KINDS]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "group_ends",
    """SELECT c_mktsegment, 'first' AS kind, arg_min(c_name, c_custkey) AS v FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'last', arg_max(c_name, c_custkey) FROM customer GROUP BY 1
    UNION ALL SELECT c_mktsegment, 'n_unique', CAST(count(DISTINCT c_name) AS VARCHAR) FROM customer GROUP BY 1 UNION ALL SELECT 'groups', 'n_groups', CAST(count(DISTINCT c_mktsegment) AS VARCHAR) FROM customer""",
)
def group_ends(spark, d):
    g = frame(spark, d, "customer", "c_custkey").select("c_mktsegment", "c_name").group_by("c_mktsegment")
    parts = [getattr(g, k)().df.select("c_mktsegment", F.lit(k).alias("kind"), F.col("c_name").cast("string").alias("v")) for k in ("first", "last", "n_unique")]
    n = spark.range(1).select(F.lit("groups").alias("c_mktsegment"), F.lit("n_groups").alias("kind"), F.lit(str(g.n_groups())).alias("v"))
    return functools.reduce(lambda a, b: a.unionByName(b), [*parts, n])


@query("group_lookup", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def group_lookup(spark, d):
    """One frame per group, each counted by itself."""
    groups = frame(spark, d, "supplier", "s_suppkey").group_by("s_nationkey").groups()
    parts = [f.agg(E.count().alias("n")).df.select(F.lit(k[0]).cast("int").alias("s_nationkey"), "n") for k, f in groups]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("sort_then_steps", "SELECT o_orderkey, t2, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS row_nr FROM (SELECT *, o_totalprice * 2 AS t2 FROM orders WHERE o_totalprice > 1000)")
def sort_then_steps(spark, d):
    """A sort's order outlives filter, with_columns and select: the number of a row is its place in what comes out."""
    f = frame(spark, d, "orders", "o_orderkey").sort("o_totalprice", "o_orderkey", descending=[True, False])
    return f.filter(col("o_totalprice") > 1000.0).with_columns(t2=col("o_totalprice") * 2.0).select("o_orderkey", "t2").with_row_number().df


@query("sort_expression", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal % 100 DESC, s_suppkey) - 1 AS INTEGER) AS row_nr FROM supplier")
def sort_expression(spark, d):
    return frame(spark, d, "supplier", "s_suppkey").sort((col("s_acctbal") % 100.0).sort(descending=True), "s_suppkey").with_row_number().select("s_suppkey", "row_nr").df


@query("reverse_rows", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS INTEGER) AS row_nr FROM nation")
def reverse_rows(spark, d):
    return frame(spark, d, "nation", "n_nationkey").reverse().with_row_number().select("n_name", "row_nr").df


@query("slice_expression", "SELECT n_nationkey AS k, 'front' AS part FROM nation WHERE n_nationkey BETWEEN 3 AND 7 UNION ALL SELECT n_nationkey, 'back' FROM nation WHERE n_nationkey BETWEEN 21 AND 22")
def slice_expression(spark, d):
    f = frame(spark, d, "nation", "n_nationkey")
    front, back = f.select(col("n_nationkey").slice(3, 5).alias("k")).df, f.select(col("n_nationkey").slice(-4, 2).alias("k")).df
    return front.withColumn("part", F.lit("front")).unionByName(back.withColumn("part", F.lit("back")))


@query("arg_sort", "WITH t AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), p AS (SELECT i, row_number() OVER (ORDER BY n_name, i) - 1 AS place FROM t) SELECT t.n_nationkey, CAST(p.i AS BIGINT) AS a FROM t JOIN p ON p.place = t.i")
def arg_sort(spark, d):
    return frame(spark, d, "nation", "n_nationkey").select("n_nationkey", col("n_name").arg_sort().alias("a")).df


@query("arg_extremes", "WITH t AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT CAST(arg_min(i, s_acctbal) AS BIGINT) AS lo, CAST(arg_max(i, s_acctbal) AS BIGINT) AS hi FROM t")
def arg_extremes(spark, d):
    return frame(spark, d, "supplier", "s_suppkey").agg(col("s_acctbal").arg_min().alias("lo"), col("s_acctbal").arg_max().alias("hi")).df


@query("drop_null_rows", "SELECT o_orderkey, s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) WHERE s IS NOT NULL")
def drop_null_rows(spark, d):
    k = col("o_orderkey")
    return frame(spark, d, "orders", "o_orderkey").select(k, when((k % 3).eq(lit(0).cast("bigint"))).then(lit(None).cast("string")).otherwise(col("o_orderstatus")).alias("s")).drop_nulls("s").df


@query("fetch_rows", "SELECT count(*) AS n, max(o_orderkey) AS hi FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500)")
def fetch_rows(spark, d):
    got = frame(spark, d, "orders", "o_orderkey").select("o_orderkey").fetch(500)
    return spark.createDataFrame([(len(got), max(r[0] for r in got))], "n bigint, hi bigint")


@query("range_expression", "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN CAST(10 + n_nationkey * 5 AS INTEGER) END AS r FROM nation")
def range_expression(spark, d):
    return frame(spark, d, "nation", "n_nationkey").select("n_nationkey", E.arange(10, 110, 5).alias("r")).df


@query("constructors", "SELECT i, a, b, CAST(c AS DOUBLE) AS c FROM (VALUES (0, 1, 'x', 2.5), (1, NULL, 'y', NULL), (2, 3, NULL, -1.0)) t(i, a, b, c)")
def constructors(spark, d):
    """Rows from series, a dictionary and Arrow, side by side, and a schema without rows on top."""
    i = Frame.series(spark, "i", [0, 1, 2], "int")
    a = Frame.from_dict(spark, {"a": [1, None, 3]}, "a int")
    b = Frame.from_arrow(spark, pa.table({"b": ["x", "y", None]}))
    c = Frame.series(spark, "c", [2.5, None, -1.0], "double")
    whole = Frame.from_series(i, a, b, c)
    return whole.vconcat(Frame.empty(spark, "i int, a int, b string, c double")).df


@query("list_series", "SELECT i, CAST(s AS DOUBLE) AS s FROM (VALUES (1, 3.0), (2, 9.0), (3, NULL)) t(i, s)")
def list_series(spark, d):
    f = Frame.series(spark, "x", [[1.0, 2.0], [4.0, 5.0], None], "array<double>").with_row_number("i")
    return f._with(f._df.withColumn("s", F.aggregate("x", F.lit(0.0), lambda t, v: t + v)).withColumn("i", F.col("i") + 1)).select("i", "s").df


@query("mask_and_column", "SELECT n_nationkey, n_nationkey * 2 AS twice FROM nation WHERE n_nationkey % 2 = 1")
def mask_and_column(spark, d):
    """A mask and a column given as lists, one value per row."""
    f = frame(spark, d, "nation", "n_nationkey").select("n_nationkey")
    n = f.shape()[0]
    return f.with_column("twice", [i * 2 for i in range(n)]).filter([i % 2 == 1 for i in range(n)]).df.select("n_nationkey", F.col("twice").cast("int").alias("twice"))


@query("ewm_parameters", """WITH RECURSIVE t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id FROM events),
r AS (SELECT user_id, i, event_id, value AS a, value AS b, value AS c FROM t WHERE i = 1
      UNION ALL SELECT t.user_id, t.i, t.event_id, 2 / 9.0 * t.value + 7 / 9.0 * r.a, (1 - pow(0.5, 1 / 3.0)) * t.value + pow(0.5, 1 / 3.0) * r.b, 0.2 * t.value + 0.8 * r.c FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
SELECT event_id, ROUND(a, 6) AS a, ROUND(b, 6) AS b, ROUND(c, 6) AS c FROM r""")
def ewm_parameters(spark, d):
    """span 8, halflife 3 and com 4 are alphas of 2/9, 1 - 2**(-1/3) and 1/5."""
    v = col("value")
    f = Frame(table(spark, d, "events"), ["ts", "event_id"])
    out = f.select("event_id", v.ewm_mean(span=8, adjust=False).over("user_id").alias("a"), v.ewm_mean(halflife=3, adjust=False).over("user_id").alias("b"), v.ewm_mean(com=4, adjust=False).over("user_id").alias("c"))
    return out.df.select("event_id", *[F.round(x, 6).alias(x) for x in "abc"])


@query("ewm_spread", """WITH RECURSIVE t AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id FROM events),
r AS (SELECT user_id, i, event_id, x AS m, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS w FROM t WHERE i = 1
      UNION ALL SELECT t.user_id, t.i, t.event_id, (0.3 * t.x + 0.7 * r.m * r.w) / (0.3 + 0.7 * r.w), 0.7 * (r.v + 0.3 * (t.x - r.m) * (t.x - r.m)), 0.3 + 0.7 * r.w FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
SELECT event_id, CASE WHEN i > 1 THEN ROUND(v, 4) END AS v, CASE WHEN i > 1 THEN ROUND(sqrt(v), 4) END AS s FROM r""")
def ewm_spread(spark, d):
    v = col("value")
    f = Frame(table(spark, d, "events"), ["ts", "event_id"])
    out = f.select("event_id", v.ewm_var(0.3, bias=True).over("user_id").alias("v"), v.ewm_std(0.3, bias=True).over("user_id").alias("s"))
    return out.df.select("event_id", F.round("v", 4).alias("v"), F.round("s", 4).alias("s"))


@query("extract_groups", "SELECT p_partkey, regexp_extract(p_type, '^(\\w+) (\\w+)', 1) AS a, regexp_extract(p_type, '^(\\w+) (\\w+)', 2) AS b FROM part")
def extract_groups(spark, d):
    t = frame(spark, d, "part", "p_partkey").df
    a, b = strings.extract_groups(F.col("p_type"), r"^(\w+) (\w+)")
    return t.select("p_partkey", F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))


@query("floor_and_power", "SELECT o_orderkey, CAST(floor(CAST(-o_orderkey AS DOUBLE) / 7) AS BIGINT) AS q, pow(CAST(o_orderkey % 10 AS DOUBLE), 2) AS p FROM orders")
def floor_and_power(spark, d):
    k = col("o_orderkey")
    return frame(spark, d, "orders", "o_orderkey").select(k, ((k * -1) // 7).alias("q"), ((k % 10).cast("double") ** 2).alias("p")).df


@query("floor_edges", "SELECT v, floor(v) AS f, ceil(v) AS c FROM (VALUES (CAST('NaN' AS DOUBLE)), (CAST('Infinity' AS DOUBLE)), (CAST('-Infinity' AS DOUBLE)), (CAST(1e300 AS DOUBLE)), (CAST(-1e300 AS DOUBLE)), (CAST(2.5 AS DOUBLE)), (CAST(-2.5 AS DOUBLE)), (CAST(NULL AS DOUBLE))) t(v)")
def floor_edges(spark, d):
    f = Frame.from_dict(spark, {"v": [float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 2.5, -2.5, None]}, "v double")
    return f.select("v", col("v").math("floor").alias("f"), col("v").math("ceil").alias("c")).df


@query("epoch_edges", "SELECT i, epoch_us(t) // 1000 AS ms, (epoch_us(t) - (epoch_us(t) % 1000000 + 1000000) % 1000000) // 1000000 AS s FROM (VALUES (1, TIMESTAMP '9999-12-31 23:59:59.999999'), (2, TIMESTAMP '1969-12-31 23:59:59.999000'), (3, TIMESTAMP '1970-01-01 00:00:00')) v(i, t)")
def epoch_edges(spark, d):
    f = Frame.from_dict(spark, {"i": [1, 2, 3], "t": [datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), datetime.datetime(1969, 12, 31, 23, 59, 59, 999000), datetime.datetime(1970, 1, 1)]}, "i int, t timestamp_ntz")
    return f.select("i", col("t").dt.epoch("ms").alias("ms"), col("t").dt.epoch("s").alias("s")).df


@query("integer_division", "SELECT a, b, a // b AS q FROM (VALUES (9223372036854775807, 3), (9007199254740993, 1), (-9007199254740993, 2), (7, -2)) t(a, b)")
def integer_division(spark, d):
    f = Frame.from_dict(spark, {"a": [9223372036854775807, 9007199254740993, -9007199254740993, 7], "b": [3, 1, 2, -2]}, "a bigint, b int")
    return f.select("a", "b", (col("a") / col("b")).alias("q")).df


@query("str_to_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders")
def str_to_date(spark, d):
    text = col("o_orderdate").dt.strftime("%Y-%m-%d %H:%M:%S")
    f = frame(spark, d, "orders", "o_orderkey").with_columns(x=text)
    return f.select("o_orderkey", col("x").str.to_date("%Y-%m-%d %H:%M:%S").alias("d"), col("x").str.to_datetime().alias("t")).df


@query("horizontal_series", "SELECT 'a' AS k, 6 AS n UNION ALL SELECT 'b', 0")
def horizontal_series(spark, d):
    f = Frame.from_dict(spark, {"k": ["a", "a", "a", "b"], "v": [1, 2, 3, None]}, "k string, v int")
    return f.group_by("k").agg(n=col("v").sum()).df.select("k", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


@query("sql_plain_list", "SELECT n_name, n_nationkey FROM nation")
def sql_plain_list(spark, d):
    return sql(table(spark, d, "nation"), "SELECT n_name, n_nationkey FROM self")


@query("sql_column_like_table", "SELECT n_regionkey AS nation, n_name, count(*) AS n FROM nation GROUP BY n_regionkey, n_name")
def sql_column_like_table(spark, d):
    f = frame(spark, d, "nation").rename({"n_regionkey": "nation"})
    return SqlContext(spark).register("nation", f).sql("SELECT nation, n_name, COUNT(*) AS n FROM nation GROUP BY nation, n_name")


@query("sql_extract", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y FROM orders")
def sql_extract(spark, d):
    f = frame(spark, d, "orders").select("o_orderkey", col("o_orderdate").alias("ts"))
    return SqlContext(spark).register("ts", f).sql("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM ts) AS BIGINT) AS y FROM ts")


@query("sql_comma_join", "SELECT n_name, r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
def sql_comma_join(spark, d):
    context = SqlContext(spark).register("nation", frame(spark, d, "nation")).register("region", frame(spark, d, "region"))
    return context.sql("SELECT n_name, r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")


@query("exports", "SELECT n_nationkey, n_name FROM nation")
def exports(spark, d):
    """Out as an Arrow table and in again, out as lists and in again; the plan reads the file."""
    f = frame(spark, d, "nation", "n_nationkey").select("n_nationkey", "n_name")
    if "Scan" not in f.explain():
        raise ValueError("the plan does not read the file")
    columns = Frame.from_arrow(spark, f.to_arrow()).to_dict()
    return Frame.from_dict(spark, columns, "n_nationkey int, n_name string").df


@query("scalar_access", "SELECT n_name AS v, (SELECT count(*) FROM nation) AS height, 4 AS width FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7")
def scalar_access(spark, d):
    f = frame(spark, d, "nation", "n_nationkey").with_columns(one=lit(1))
    return spark.createDataFrame([(f.value(7, "n_name"), *f.shape())], "v string, height bigint, width int")


@query("map_pandas", "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier")
def map_pandas(spark, d):
    def doubled(batches):
        for pdf in batches:
            yield pdf.assign(twice=pdf["s_acctbal"] * 2)[["s_suppkey", "twice"]]

    return frame(spark, d, "supplier").map_pandas(doubled, "s_suppkey bigint, twice double")


@query("group_apply", "SELECT c_mktsegment, max(c_acctbal) AS hi, count(*) AS n FROM customer GROUP BY c_mktsegment")
def group_apply(spark, d):
    import pandas as pd

    def top(pdf):
        return pd.DataFrame({"c_mktsegment": [pdf["c_mktsegment"].iloc[0]], "hi": [pdf["c_acctbal"].max()], "n": [len(pdf)]})

    return frame(spark, d, "customer").group_by("c_mktsegment").apply(top, "c_mktsegment string, hi double, n bigint")


@query("struct_fields", "SELECT 'a' AS name, 0 AS i UNION ALL SELECT 'b', 1")
def struct_fields(spark, d):
    f = Frame.from_dict(spark, {"x": [1], "y": ["z"]}, "x int, y string").with_columns(s=E.struct(a=col("x"), b=col("y")))
    return spark.createDataFrame([(n, i) for i, n in enumerate(nested.field_names(f.df, "s"))], "name string, i int")


@query("utc_times", "SELECT event_id, ts AS u FROM events")
def utc_times(spark, d):
    return frame(spark, d, "events", "event_id").select("event_id", col("ts").dt.to_utc().alias("u")).df


@query("more_math", "SELECT o_orderkey, ROUND(log10(o_totalprice), 9) AS a, ROUND(tan(x), 9) AS b, ROUND(asin(x), 9) AS c, ROUND(cosh(x), 9) AS e, ROUND(tanh(x), 9) AS f FROM (SELECT o_orderkey, o_totalprice, (o_orderkey % 100) / 100.0 AS x FROM orders)")
def more_math(spark, d):
    x = (col("o_orderkey") % 100) / lit(100.0)
    f = frame(spark, d, "orders", "o_orderkey")
    out = f.select("o_orderkey", col("o_totalprice").math("log10").alias("a"), x.math("tan").alias("b"), x.math("asin").alias("c"), x.math("cosh").alias("e"), x.math("tanh").alias("f"))
    return out.df.select("o_orderkey", *[F.round(c, 9).alias(c) for c in "abcef"])


@query("columns_by_name", "SELECT p_name, p_partkey, p_size AS literal_size, 'x' AS repeated FROM part")
def columns_by_name(spark, d):
    f = frame(spark, d, "part", "p_partkey")[["p_name", "p_partkey", "p_size"]]
    r = Frame.repeat(spark, "repeated", "x", f.shape()[0])
    return f.select(*E.cols("p_name", "p_partkey"), col("p_size").as_("literal_size")).hconcat(r).df


@query("transpose_table", "SELECT 'r_regionkey' AS key, 0 AS AFRICA, 1 AS AMERICA, 2 AS ASIA, 3 AS EUROPE, 4 AS \"MIDDLE EAST\"")
def transpose_table(spark, d):
    """Column names come from the data, which must be few; the key column as Spark names it."""
    return frame(spark, d, "region").select("r_name", "r_regionkey").transpose("r_name")


@query("csv_skip_rows", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def csv_skip_rows(spark, d):
    """A folder of two files, each with two lines that do not count and a header of its own."""
    from tessera.queries.supersets import scratch

    path = scratch(spark)
    for name, key, text in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        body = table(spark, d, name).select(F.struct(F.lit(1).alias("i"), F.col(key).alias("k")).alias("o"), F.concat_ws(",", F.col(key).cast("string"), text).alias("value"))
        head = spark.createDataFrame([(0, 0, "a note, with a comma"), (0, 1, "second line"), (0, 2, "k,name")], "i int, k int, value string").select(F.struct("i", "k").alias("o"), "value")
        head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("append").text(path)
    return readers.read_csv(spark, path, skip_rows=2).df


@query("stream_first_rows", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def stream_first_rows(spark, d):
    """One row of each user and type passes a stream that remembers what it has seen."""
    from tessera.queries.supersets import scratch

    source = table(spark, d, "events")
    path = scratch(spark)
    source.repartition(3).write.parquet(f"{path}/in")
    rows = streams.read_stream(spark, f"{path}/in", source.schema, files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    once = streams.dedup(rows, ["user_id", "event_type"], "ts", "36500 days")
    streams.run_to_end(once.select("user_id", "event_type"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, i")
def stream_sessions(spark, d):
    """Sessions of a stream of three files, complete once it has run."""
    from tessera.queries.supersets import scratch

    source = table(spark, d, "events")
    path = scratch(spark)
    source.repartition(3).write.parquet(f"{path}/in")
    rows = streams.read_stream(spark, f"{path}/in", source.schema, files_per_trigger=1)
    agg = streams.sessions(rows, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    got = []

    def keep(batch, number):
        batch.select("user_id", "window_start", "n").write.parquet(f"{path}/out/{number}")
        got.append(number)

    streams.run_batches(agg, keep, f"{path}/checkpoint", mode="complete")
    return spark.read.parquet(f"{path}/out/{max(got)}")


@query("stream_late_rows", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_late_rows(spark, d):
    """Rows of the second file are older than the watermark allows for any window that the first has closed: in append
    mode they leave no trace. What the twin counts is the rows that come in time: those of the first file, all events."""
    from tessera.queries.supersets import scratch

    source = table(spark, d, "events")
    path = scratch(spark)
    source.coalesce(1).write.parquet(f"{path}/in")
    # A watermark needs an instant, not a wall-clock time.
    rows = streams.read_stream(spark, f"{path}/in", source.schema, files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = streams.tumbling(rows, "ts", "10 minutes", ["event_type"], [F.count(F.lit(1)).alias("n")], late="1 hour")
    streams.run_to_end(agg.select("event_type", "window_start", "n"), f"{path}/out", f"{path}/checkpoint")
    # The first batch closes what lies an hour before its last event; then come rows of those windows, and far newer ones that close the rest.
    late = source.orderBy("ts").limit(50)
    newer = source.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")).withColumn("event_type", F.lit("later"))
    late.coalesce(1).write.mode("append").parquet(f"{path}/in")
    streams.run_to_end(agg.select("event_type", "window_start", "n"), f"{path}/out", f"{path}/checkpoint")
    newer.coalesce(1).write.mode("append").parquet(f"{path}/in")
    streams.run_to_end(agg.select("event_type", "window_start", "n"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").filter("event_type <> 'later'").groupBy("event_type").agg(F.sum("n").alias("n"))
