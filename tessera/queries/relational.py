"""Projection, filters, joins, aggregates, sorting and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import expr as E
from tessera.operators.expr import col, lit, when
from tessera.queries.base import frame, query


@query("select_with_columns", "SELECT l_orderkey, l_quantity * 2 + 1 AS a, l_extendedprice - l_tax AS b, -l_discount AS c FROM lineitem")
def select_with_columns(spark, d):
    f = frame(spark, d, "lineitem").with_columns(a=col("l_quantity") * 2 + 1, b=col("l_extendedprice") - col("l_tax"), c=-col("l_discount"))
    return f.select("l_orderkey", "a", "b", "c").df


@query("drop_rename", "SELECT r_regionkey AS key, upper(r_name) AS name FROM region")
def drop_rename(spark, d):
    f = frame(spark, d, "region", "r_regionkey").rename({"r_regionkey": "key", "missing": "x"}).with_columns(name=col("r_name").str.upper())
    return f.drop("r_name", "absent").df


@query("select_if_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_if_numeric(spark, d):
    return frame(spark, d, "lineitem").select_if(lambda f: isinstance(f.dataType, T.NumericType)).df


@query("filter_conjunction", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'")
def filter_conjunction(spark, d):
    f = frame(spark, d, "lineitem")
    day = lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    return f.filter((col("l_quantity") > 30) & (col("l_discount") <= 0.05) & (col("l_shipdate") >= day)).select("l_orderkey", "l_quantity").df


_NULLED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS p FROM orders"


def nulled(spark, d):
    k = col("o_orderkey")
    return frame(spark, d, "orders", "o_orderkey").select(
        k, when(k % 3 == 0).then(lit(None)).otherwise(col("o_orderstatus")).alias("s"),
        when(k % 4 == 0).then(lit(None).cast("double")).when(k % 7 == 0).then(lit(float("nan"))).otherwise(col("o_totalprice")).alias("p"),
    )


@query("filter_eq_nullsafe", f"SELECT o_orderkey, s IS NOT DISTINCT FROM 'F' AS eq, s IS DISTINCT FROM 'F' AS ne, s IS NULL AS isn, s IS NOT NULL AS notn FROM ({_NULLED})")
def filter_eq_nullsafe(spark, d):
    s = col("s")
    return nulled(spark, d).select("o_orderkey", s.eq("F").alias("eq"), s.ne("F").alias("ne"), s.is_null().alias("isn"), s.is_not_null().alias("notn")).df


@query("compare_nan", f"SELECT o_orderkey, CASE WHEN isnan(p) THEN false ELSE p < 100000 END AS lt, CASE WHEN isnan(p) THEN false ELSE p >= 100000 END AS ge, coalesce(isnan(p), false) AS nan FROM ({_NULLED})")
def compare_nan(spark, d):
    p = col("p")
    return nulled(spark, d).select("o_orderkey", (p < 100000.0).alias("lt"), (p >= 100000.0).alias("ge"), p.is_nan().alias("nan")).df


@query(
    "strict_logic",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL ELSE s = 'F' END AS a, o_orderkey % 2 = 0 AS b FROM ({_NULLED}))
    SELECT o_orderkey, CASE WHEN a IS NOT NULL THEN a AND b END AS both_, CASE WHEN a IS NOT NULL THEN a OR b END AS either_, CASE WHEN a IS NOT NULL THEN a <> b END AS one_, NOT a AS not_ FROM t""",
)
def strict_logic(spark, d):
    f = nulled(spark, d).with_columns(a=when(col("s").is_null()).then(lit(None).cast("boolean")).otherwise(col("s").eq("F")), b=(col("o_orderkey") % 2).eq(lit(0).cast("bigint")))
    a, b = col("a"), col("b")
    return f.select("o_orderkey", (a & b).alias("both_"), (a | b).alias("either_"), (a ^ b).alias("one_"), (~a).alias("not_")).df


@query("is_in", f"SELECT o_orderkey, coalesce(s IN ('F', 'P'), false) AS some, coalesce(s IN ('O'), false) OR s IS NULL AS with_null FROM ({_NULLED})")
def is_in(spark, d):
    return nulled(spark, d).select("o_orderkey", col("s").is_in(["F", "P"]).alias("some"), col("s").is_in(["O", None]).alias("with_null")).df


@query("between", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.02 AND l_discount < 0.06")
def between(spark, d):
    return frame(spark, d, "lineitem").filter(col("l_quantity").is_between(10, 20) & col("l_discount").is_between(0.02, 0.06, inclusive=False)).select("l_orderkey", "l_quantity").df


@query("case_when", f"SELECT o_orderkey, CASE WHEN p > 200000 AND NOT isnan(p) THEN 'high' WHEN p > 100000 AND NOT isnan(p) THEN 'mid' ELSE 'low' END AS band, CASE WHEN s = 'F' THEN 1 END AS only FROM ({_NULLED})")
def case_when(spark, d):
    p = col("p")
    band = when(p > 200000.0).then("high").when(p > 100000.0).then("mid").otherwise("low")
    return nulled(spark, d).select("o_orderkey", band.alias("band"), when(col("s").eq("F")).then(1).alias("only")).df


@query("cast_fill_null", f"SELECT o_orderkey, coalesce(s, '?') AS s, coalesce(p, 0.0) AS p, CAST(o_orderkey AS VARCHAR) AS k, TRY_CAST(s AS BIGINT) AS bad FROM ({_NULLED})")
def cast_fill_null(spark, d):
    k = col("o_orderkey")
    return nulled(spark, d).select("o_orderkey", col("s").fill_null("?").alias("s"), col("p").fill_null(0.0).alias("p"), k.cast("string").alias("k"), col("s").cast("bigint").alias("bad")).df


@query("sort_nulls_last", f"SELECT o_orderkey, p FROM ({_NULLED}) ORDER BY p DESC NULLS LAST, o_orderkey")
def sort_nulls_last(spark, d):
    return nulled(spark, d).sort("p", "o_orderkey", descending=[True, False]).select("o_orderkey", "p").df


@query("sort_whole", f"SELECT o_orderkey, p, CAST(row_number() OVER (ORDER BY p DESC NULLS LAST, o_orderkey) - 1 AS INTEGER) AS row_nr FROM ({_NULLED})")
def sort_whole(spark, d):
    return nulled(spark, d).sort("p", "o_orderkey", descending=[True, False]).with_row_number().select("o_orderkey", "p", "row_nr").df


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, d):
    return frame(spark, d, "orders", "o_orderkey").sort("o_totalprice", descending=True).head(100).select("o_orderkey", "o_totalprice").df


@query("slice_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def slice_rows(spark, d):
    return frame(spark, d, "orders", "o_orderkey").slice(100, 50).select("o_orderkey", "o_custkey").df


@query("head_tail", "(SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 7) UNION ALL (SELECT o_orderkey, 'tail' FROM orders ORDER BY o_orderkey DESC LIMIT 7)")
def head_tail(spark, d):
    f = frame(spark, d, "orders", "o_orderkey").select("o_orderkey")
    return f.head(7).df.withColumn("part", F.lit("head")).unionByName(f.tail(7).df.withColumn("part", F.lit("tail")))


@query("take_rows", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey FROM n JOIN (VALUES (5), (0), (5), (99)) v(i) USING (i)")
def take_rows(spark, d):
    return frame(spark, d, "orders", "o_orderkey").select("o_orderkey").take([5, 0, 5, 99]).df


@query("row_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS row_nr FROM orders")
def row_index(spark, d):
    return frame(spark, d, "orders", "o_orderkey").with_row_number().select("o_orderkey", "row_nr").df


@query("distinct_first", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def distinct_first(spark, d):
    return frame(spark, d, "orders", "o_orderkey").unique("o_custkey").select("o_custkey", "o_orderkey", "o_orderstatus").df


@query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(spark, d):
    n, r = frame(spark, d, "nation").select(col("n_name").alias("name")), frame(spark, d, "region").select(col("r_name").alias("name"))
    return n.vconcat(r, r).df


@query("hconcat", "WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), b AS (SELECT n_nationkey * 10 AS k, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) SELECT n_name, CAST(k AS BIGINT) AS k FROM a JOIN b USING (i)")
def hconcat(spark, d):
    f = frame(spark, d, "nation", "n_nationkey")
    return f.select("n_name").hconcat(f.select((col("n_nationkey") * 10).alias("k"))).df


@query("unpivot", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")
def unpivot(spark, d):
    f = frame(spark, d, "part", "p_partkey").select("p_partkey", col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return f.melt(["p_partkey"], ["p_size", "p_retailprice"]).df


#: Keys of odd customers lie elsewhere, so that both sides have rows without a partner; a few keys are null on both sides.
_L = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice AS v FROM orders"
_R = "SELECT CASE WHEN c_custkey % 500 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN c_custkey + 100000000 ELSE c_custkey END AS k, c_name, c_acctbal AS v FROM customer"


def sides(spark, d):
    o, c = col("o_orderkey"), col("c_custkey")
    zero = lit(0).cast("bigint")
    left = frame(spark, d, "orders", "o_orderkey").select(o, when((o % 5).eq(zero)).then(lit(None).cast("bigint")).otherwise(col("o_custkey")).alias("k"), col("o_totalprice").alias("v"))
    key = when((c % 500).eq(zero)).then(lit(None).cast("bigint")).when((c % 2).ne(zero)).then(c + 100_000_000).otherwise(c)
    return left, frame(spark, d, "customer", "c_custkey").select(key.alias("k"), "c_name", col("c_acctbal").alias("v"))


def _join(how, sql):
    @query(f"join_{how}", sql)
    def run(spark, d):
        left, right = sides(spark, d)
        # Null keys match each other; the few null-key customers stay a handful per order.
        out = left.join(right, "k", how=how).df
        return out

    return run


_ON = "l.k IS NOT DISTINCT FROM r.k"
_join("inner", f"SELECT o_orderkey, l.k, l.v, c_name, r.v AS v_right FROM ({_L}) l JOIN ({_R}) r ON {_ON}")
_join("left", f"SELECT o_orderkey, l.k, l.v, c_name, r.v AS v_right FROM ({_L}) l LEFT JOIN ({_R}) r ON {_ON}")
_join("right", f"SELECT o_orderkey, r.k, l.v AS v_right, c_name, r.v FROM ({_L}) l RIGHT JOIN ({_R}) r ON {_ON}")
_join("outer", f"SELECT o_orderkey, l.k, l.v, c_name, r.v AS v_right FROM ({_L}) l FULL JOIN ({_R}) r ON {_ON}")
_join("semi", f"SELECT * FROM ({_L}) l WHERE EXISTS (SELECT 1 FROM ({_R}) r WHERE {_ON})")
_join("anti", f"SELECT * FROM ({_L}) l WHERE NOT EXISTS (SELECT 1 FROM ({_R}) r WHERE {_ON})")


@query("join_cross", "SELECT n_name, r_name FROM nation, region")
def join_cross(spark, d):
    return frame(spark, d, "nation").select("n_name").cross_join(frame(spark, d, "region").select("r_name")).df


@query("join_multi_key", "SELECT l_orderkey, l_linenumber, l_quantity, o.n AS n FROM lineitem l JOIN (SELECT l_orderkey AS ok, l_linenumber AS ln, count(*) AS n FROM lineitem GROUP BY 1, 2) o ON l_orderkey = ok AND l_linenumber = ln")
def join_multi_key(spark, d):
    f = frame(spark, d, "lineitem")
    g = f.group_by("l_orderkey", "l_linenumber").size("n").rename({"l_orderkey": "ok", "l_linenumber": "ln"})
    return f.join(g, left_on=["l_orderkey", "l_linenumber"], right_on=["ok", "ln"]).select("l_orderkey", "l_linenumber", "l_quantity", "n").df


@query(
    "agg_basic",
    """SELECT l_returnflag, ROUND(sum(l_quantity), 4) AS s, ROUND(avg(l_extendedprice), 4) AS m, min(l_discount) AS lo, max(l_tax) AS hi, ROUND(stddev_samp(l_quantity), 6) AS sd,
    ROUND(var_pop(l_quantity), 6) AS vp, count(l_quantity) AS n, median(l_quantity) AS md FROM lineitem GROUP BY l_returnflag""",
)
def agg_basic(spark, d):
    q = col("l_quantity")
    f = frame(spark, d, "lineitem").group_by("l_returnflag").agg(
        s=q.sum(), m=col("l_extendedprice").mean(), lo=col("l_discount").min(), hi=col("l_tax").max(), sd=q.std(), vp=q.var(0), n=q.count(), md=q.median()
    )
    return f.df.withColumns({"s": F.round("s", 4), "m": F.round("m", 4), "sd": F.round("sd", 6), "vp": F.round("vp", 6)})


@query(
    "agg_nan_null",
    f"SELECT s, min(p) FILTER (WHERE NOT isnan(p)) AS lo, max(p) FILTER (WHERE NOT isnan(p)) AS hi, count(p) AS n, count(DISTINCT p) + CAST(max(p IS NULL) AS INTEGER) AS u FROM ({_NULLED}) GROUP BY s",
)
def agg_nan_null(spark, d):
    p = col("p")
    return nulled(spark, d).group_by("s").agg(lo=p.min(), hi=p.max(), n=p.count(), u=p.n_unique()).df


@query(
    "agg_quantiles",
    """SELECT l_linestatus, quantile_cont(l_extendedprice, 0.25) AS lin, quantile_disc(l_quantity, 0.0) AS zero, list_sort(list(l_quantity))[CAST(floor((count(*) - 1) * 0.3) AS BIGINT) + 1] AS low,
    list_sort(list(l_quantity))[CAST(ceil((count(*) - 1) * 0.3) AS BIGINT) + 1] AS high FROM lineitem GROUP BY l_linestatus""",
)
def agg_quantiles(spark, d):
    q = col("l_quantity")
    return frame(spark, d, "lineitem").group_by("l_linestatus").agg(lin=col("l_extendedprice").quantile(0.25), zero=q.quantile(0.0, "lower"), low=q.quantile(0.3, "lower"), high=q.quantile(0.3, "higher")).df


@query("agg_dict", "SELECT c_mktsegment, count(c_acctbal) AS c_acctbal_count, ROUND(avg(c_acctbal), 8) AS c_acctbal_mean, count(DISTINCT c_nationkey) AS c_nationkey_nunique, min(c_nationkey) AS c_nationkey_min FROM customer GROUP BY c_mktsegment")
def agg_dict(spark, d):
    f = frame(spark, d, "customer", "c_custkey").group_by("c_mktsegment").agg({"c_acctbal": ["count", "mean"], "c_nationkey": ["nunique", "min"]})
    return f.df.withColumn("c_acctbal_mean", F.round("c_acctbal_mean", 8))


@query("group_first_last", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def group_first_last(spark, d):
    return frame(spark, d, "orders", "o_orderkey").group_by("o_custkey").agg(first=col("o_orderstatus").first(), last=col("o_totalprice").last()).df


@query("group_all_columns", "SELECT s_nationkey, CAST(sum(s_suppkey) AS DOUBLE) AS s_suppkey, ROUND(sum(s_acctbal), 4) AS s_acctbal FROM supplier GROUP BY s_nationkey")
def group_all_columns(spark, d):
    f = frame(spark, d, "supplier", "s_suppkey").group_by("s_nationkey").sum()
    return f.df.select("s_nationkey", F.col("s_suppkey").cast("double").alias("s_suppkey"), F.round("s_acctbal", 4).alias("s_acctbal"))


@query("group_count", "SELECT o_orderpriority, count(o_orderkey) AS o_orderkey, count(o_clerk) AS o_clerk FROM (SELECT o_orderpriority, o_orderkey, nullif(o_orderstatus, 'F') AS o_clerk FROM orders) GROUP BY o_orderpriority")
def group_count(spark, d):
    f = frame(spark, d, "orders", "o_orderkey").select("o_orderpriority", "o_orderkey", when(col("o_orderstatus").ne("F")).then(col("o_orderstatus")).alias("o_clerk"))
    return f.group_by("o_orderpriority").count().df


@query("agg_whole_frame", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, ROUND(avg(l_tax), 8) AS m, max(l_shipdate) AS last, count(*) AS n, bool_and(l_quantity > 0) AS everything, bool_or(l_tax > 1) AS something FROM lineitem")
def agg_whole_frame(spark, d):
    f = frame(spark, d, "lineitem").agg(col("l_linenumber").sum().alias("s"), col("l_tax").mean().alias("m"), col("l_shipdate").max().alias("last"), E.count().alias("n"), (col("l_quantity") > 0).all().alias("everything"), (col("l_tax") > 1).any().alias("something"))
    return f.df.withColumn("m", F.round("m", 8))


@query("agg_compound", "SELECT l_returnflag, ROUND(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS unit FROM lineitem GROUP BY l_returnflag")
def agg_compound(spark, d):
    f = frame(spark, d, "lineitem").group_by("l_returnflag").agg(unit=(col("l_extendedprice") * (1 - col("l_discount"))).sum() / col("l_quantity").sum())
    return f.df.withColumn("unit", F.round("unit", 6))


@query("agg_product", "SELECT n_regionkey, product(1 + n_nationkey / 100.0) AS p FROM nation GROUP BY n_regionkey")
def agg_product(spark, d):
    f = frame(spark, d, "nation", "n_nationkey").group_by("n_regionkey").agg(p=(col("n_nationkey") / lit(100.0) + 1).product())
    return f.df.withColumn("p", F.round("p", 9))


@query("value_counts", "SELECT p_brand, CAST(count(*) AS INTEGER) AS count FROM part GROUP BY p_brand")
def value_counts(spark, d):
    return frame(spark, d, "part", "p_partkey").value_counts("p_brand").df


@query("describe", "SELECT 'count' AS statistic, CAST(count(s_acctbal) AS DOUBLE) AS s_acctbal FROM supplier UNION ALL SELECT 'mean', ROUND(avg(s_acctbal), 6) FROM supplier UNION ALL SELECT 'std', ROUND(stddev_samp(s_acctbal), 6) FROM supplier UNION ALL SELECT 'min', min(s_acctbal) FROM supplier UNION ALL SELECT '25%', list_sort(list(s_acctbal))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] FROM supplier UNION ALL SELECT '50%', list_sort(list(s_acctbal))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] FROM supplier UNION ALL SELECT '75%', list_sort(list(s_acctbal))[CAST(floor(count(*) * 0.75) AS BIGINT) + 1] FROM supplier UNION ALL SELECT 'max', max(s_acctbal) FROM supplier")
def describe(spark, d):
    out = frame(spark, d, "supplier", "s_suppkey").select("s_acctbal").describe()
    return out.withColumn("s_acctbal", F.when(F.col("statistic").isin("mean", "std"), F.round("s_acctbal", 6)).otherwise(F.col("s_acctbal")))


@query("null_count", f"SELECT 's' AS \"column\", CAST(count(*) - count(s) AS INTEGER) AS null_count FROM ({_NULLED}) UNION ALL SELECT 'p', CAST(count(*) - count(p) AS INTEGER) FROM ({_NULLED}) UNION ALL SELECT 'o_orderkey', 0")
def null_count(spark, d):
    return nulled(spark, d).null_count()


@query("n_unique", f"SELECT 's' AS \"column\", CAST(count(DISTINCT s) + 1 AS INTEGER) AS n_unique FROM ({_NULLED}) UNION ALL SELECT 'o_orderkey', CAST(count(DISTINCT o_orderkey) AS INTEGER) FROM ({_NULLED})")
def n_unique(spark, d):
    return nulled(spark, d).select("s", "o_orderkey").n_unique()


@query("sample_exact", "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS u, CAST(floor(count(*) * 0.1) AS BIGINT) AS share FROM orders")
def sample_exact(spark, d):
    f = frame(spark, d, "orders", "o_orderkey")
    a = f.sample(100, seed=3).df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("u"))
    return a.crossJoin(f.sample(fraction=0.1, seed=1).df.agg(F.count(F.lit(1)).alias("share")))


@query("horizontal", "SELECT o_orderkey, coalesce(a, 0) + b AS total, CASE WHEN a IS NULL THEN b ELSE (a + b) / 2 END AS mean, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders)")
def horizontal(spark, d):
    k = col("o_orderkey")
    f = frame(spark, d, "orders", "o_orderkey").with_columns(a=when((k % 4).eq(lit(0).cast("bigint"))).then(lit(None).cast("double")).otherwise(col("o_totalprice")), b=col("o_custkey").cast("double"))
    return f.select(k, E.sum_horizontal("a", "b").alias("total"), E.mean_horizontal("a", "b").alias("mean"), E.min_horizontal("a", "b").alias("lo"), E.max_horizontal("a", "b").alias("hi")).df
