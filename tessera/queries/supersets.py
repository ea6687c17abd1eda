"""Files, SQL, generators, and supersets: as-of joins, pivots, dynamic groups, set operations, streams."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.operators import expr as E
from tessera.operators.expr import col, lit, when
from tessera.operators.frame import Frame
from tessera.plans.sql import SqlContext, sql
from tessera.queries.base import frame, query, table
from tessera.sources import readers, writers
from tessera.streaming import streams


@functools.cache
def _local(app: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-files-")


def scratch(spark) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = "file://" + _local(sc.applicationId) if sc.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/files/{uuid.uuid4().hex}"


_CUST = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


@query("csv_roundtrip", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, d):
    path = scratch(spark)
    writers.write_csv(frame(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return readers.read_csv(spark, path).df


@query("csv_null_tokens", "SELECT CAST(o_orderkey AS INTEGER) AS k, nullif(o_orderstatus, 'F') AS s, o_orderkey % 2 = 0 AS b FROM orders")
def csv_null_tokens(spark, d):
    path = scratch(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus")).alias("s"), (F.col("o_orderkey") % 2 == 0).cast("int").alias("b"))
    writers.write_csv(o, path, separator=";")
    return readers.read_csv(spark, path, separator=";").df


@query("parquet_roundtrip", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 100000")
def parquet_roundtrip(spark, d):
    path = scratch(spark)
    writers.write_parquet(frame(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path)
    return readers.read_parquet(spark, path).filter(col("o_totalprice") > 100000).df


@query("ndjson_roundtrip", _CUST)
def ndjson_roundtrip(spark, d):
    path = scratch(spark)
    writers.write_ndjson(frame(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return readers.read_ndjson(spark, path).df


@query("json_roundtrip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def json_roundtrip(spark, d):
    path = scratch(spark)
    writers.write_json(frame(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return readers.read_json(spark, path).df


@query("json_wrapped_text", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, NULL)) t(a, b)")
def json_wrapped_text(spark, d):
    return readers.read_json_text(spark, '{"data": [{"a": 1, "b": "x"}, {"a": 2, "b": null}]}').df


@query("csv_text", "SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name FROM region")
def csv_text(spark, d):
    text = writers.csv_text(frame(spark, d, "region").select("r_regionkey", "r_name"))
    return readers.read_csv_lines(spark, text).df


@query("sql_group_having", "SELECT o_orderpriority, count(*) AS n, ROUND(avg(o_totalprice), 4) AS m FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING count(*) > 10")
def sql_group_having(spark, d):
    return sql(frame(spark, d, "orders"), "SELECT o_orderpriority, count(*) AS n, ROUND(MEAN(o_totalprice), 4) AS m FROM self WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING count(*) > 10 ORDER BY n DESC")


@query("sql_join_case", "SELECT o_orderkey, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'other' END AS band FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority LIKE '1%'")
def sql_join_case(spark, d):
    ctx = SqlContext(spark).register("Orders", frame(spark, d, "orders")).register("cust", frame(spark, d, "customer"))
    return ctx.sql("SELECT o_orderkey, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'other' END AS band FROM orders o JOIN CUST c ON o.o_custkey = c.c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority LIKE '1%'")


@query("sql_limit_offset", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 20 OFFSET 5")
def sql_limit_offset(spark, d):
    return sql(frame(spark, d, "orders"), "SELECT DISTINCT o_custkey FROM self ORDER BY o_custkey LIMIT 20 OFFSET 5")


@query("sql_derived_table", "SELECT s, sum(n)::BIGINT AS n, ROUND(stddev_samp(m), 6) AS sd FROM (SELECT o_orderstatus AS s, o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1, 2) t GROUP BY s")
def sql_derived_table(spark, d):
    return SqlContext(spark).register("orders", frame(spark, d, "orders")).sql("SELECT s, sum(n) AS n, ROUND(STD(m), 6) AS sd FROM (SELECT o_orderstatus AS s, o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1, 2) t GROUP BY s")


@query("sql_scalar_functions", "SELECT c_custkey, upper(trim(c_name)) AS u, length(c_name) AS n, ROUND(sqrt(abs(c_acctbal)), 6) AS r FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_name IS NOT NULL")
def sql_scalar_functions(spark, d):
    out = sql(frame(spark, d, "customer"), "SELECT c_custkey, UPPER(TRIM(c_name)) AS u, LEN(c_name) AS n, ROUND(SQRT(ABS(c_acctbal)), 6) AS r FROM self WHERE c_acctbal BETWEEN 0 AND 5000 AND c_name IS NOT NULL")
    return out.withColumn("n", F.col("n").cast("bigint"))


@query("generators", "SELECT i, CAST(i AS DOUBLE) * 2 AS x FROM range(0, 20, 3) t(i)")
def generators(spark, d):
    return Frame.int_range(spark, "i", 0, 20, 3).with_columns(x=col("i").cast("double") * 2).df


@query("date_ranges", "SELECT CAST(t AS DATE) AS day FROM range(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-05', INTERVAL 2 DAY) r(t)")
def date_ranges(spark, d):
    return Frame.date_range(spark, "day", "2024-02-27", "2024-03-05", days=2).df


@query("datetime_ranges", "SELECT t FROM range(TIMESTAMP '2024-02-27 00:00:00', TIMESTAMP '2024-02-28 00:00:00', INTERVAL 90 MINUTE) r(t)")
def datetime_ranges(spark, d):
    return Frame.datetime_range(spark, "t", "2024-02-27 00:00:00", "2024-02-28 00:00:00", hours=1, minutes=30).df


@query("frame_literals", "SELECT CAST(7 AS INTEGER) AS a, 1.5::DOUBLE AS b, 'x' AS c, true AS d, DATE '2024-01-02' AS e, i FROM range(3) t(i)")
def frame_literals(spark, d):
    import datetime

    return Frame.int_range(spark, "i", 0, 3).with_columns(a=lit(7), b=lit(1.5), c=lit("x"), d=lit(True), e=lit(datetime.date(2024, 1, 2))).select("a", "b", "c", "d", "e", "i").df


@query("asof_join", "SELECT e.event_id, e.user_id, p.event_id AS event_id_right, p.value AS value_right FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, d):
    f = frame(spark, d, "events", "event_id").select("event_id", "user_id", "ts", "event_type", "value")
    left = f.filter(col("event_type").eq("purchase")).select("event_id", "user_id", "ts")
    right = f.filter(col("event_type").eq("view")).select("event_id", "user_id", "ts", "value")
    out = left.join_asof(right, "ts", ["user_id"]).df
    return out.select("event_id", "user_id", "event_id_right", F.col("value").alias("value_right"))


@query("pivot", "SELECT l_linestatus, ROUND(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 4) AS A, ROUND(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 4) AS N, ROUND(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 4) AS R FROM lineitem GROUP BY l_linestatus")
def pivot(spark, d):
    out = frame(spark, d, "lineitem").pivot(["l_linestatus"], "l_returnflag", "l_quantity", "sum", ["A", "N", "R"]).df
    return out.withColumns({c: F.round(c, 4) for c in "ANR"})


@query("group_dynamic", "SELECT event_type, to_timestamp(epoch_us(ts) // 3600000000 * 3600)::TIMESTAMP AS ts, count(*) AS n, ROUND(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def group_dynamic(spark, d):
    out = frame(spark, d, "events", "event_id").group_dynamic("ts", "1 hour", ["event_type"]).agg(E.count().alias("n"), col("value").sum().alias("s")).df
    return out.withColumn("s", F.round("s", 4))


@query("set_operations", "(SELECT o_custkey AS k, 'both' AS part FROM orders INTERSECT SELECT CASE WHEN c_custkey % 2 = 1 THEN c_custkey + 100000000 ELSE c_custkey END, 'both' FROM customer) UNION ALL (SELECT c_custkey, 'never' FROM customer EXCEPT SELECT o_custkey, 'never' FROM orders)")
def set_operations(spark, d):
    o = frame(spark, d, "orders").select(col("o_custkey").alias("k"))
    c = frame(spark, d, "customer").select(col("c_custkey").alias("k"))
    moved = c.select(when((col("k") % 2).eq(lit(0).cast("bigint"))).then(col("k")).otherwise(col("k") + 100_000_000).alias("k"))
    return o.intersect(moved).df.withColumn("part", F.lit("both")).unionByName(c.except_(o).df.withColumn("part", F.lit("never")))


@query("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return frame(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("cube", "SELECT l_returnflag, l_linestatus, ROUND(sum(l_tax), 4) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return frame(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_tax"), 4).alias("s"))


@query("approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def approx_distinct(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n"))
    # The exact count where the sketch is within five of its standard errors, else the sketch's.
    return g.select("l_returnflag", F.when(F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n"), F.col("n")).otherwise(F.col("a")).alias("n"))


@query("range_join", "SELECT p.p_partkey, count(*) AS n FROM part p JOIN supplier s ON s.s_acctbal BETWEEN p.p_retailprice - 50 AND p.p_retailprice + 50 GROUP BY 1")
def range_join(spark, d):
    p, s = frame(spark, d, "part"), frame(spark, d, "supplier")
    near = p.select("p_partkey", (col("p_retailprice") - 50.0).alias("low"), (col("p_retailprice") + 50.0).alias("high"))
    return near.join_range(s, "low", "high", "s_acctbal").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("udaf_range", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")
def udaf_range(spark, d):
    return frame(spark, d, "customer", "c_custkey").group_by("c_mktsegment").agg_udf("c_acctbal", lambda v: float(v.max() - v.min()), "spread").df


@query("window_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM s GROUP BY user_id, i")
def window_sessions(spark, d):
    out = streams.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.select("user_id", "window_start", "window_end", "n")


@query("stream_windows", "SELECT event_type, to_timestamp(epoch_us(ts) // 600000000 * 600)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """The events file as a stream, grouped per micro-batch into a table that is complete once the stream has run."""
    source = table(spark, d, "events")
    path = scratch(spark)
    source.write.parquet(f"{path}/in")
    rows = streams.read_stream(spark, f"{path}/in", source.schema)
    agg = streams.tumbling(rows, "ts", "10 minutes", ["event_type"], [F.count(F.lit(1)).alias("n")])
    got = []

    def keep(batch, number):
        batch.select("event_type", "window_start", "n").write.parquet(f"{path}/out/{number}")
        got.append(number)

    streams.run_batches(agg, keep, f"{path}/checkpoint", mode="complete")
    return spark.read.parquet(f"{path}/out/{max(got)}")


@query("null_equal_group", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1")
def null_equal_group(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"))
    return Frame(o).group_by("s").size("n").df
