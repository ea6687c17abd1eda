"""String, date, math, list, struct and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import clock, nested, strings
from tessera.operators import expr as E
from tessera.operators.expr import col, lit, when
from tessera.queries.base import frame, query, rounded

name, cid = col("c_name"), col("c_custkey")


def customers(spark, d):
    return frame(spark, d, "customer", "c_custkey")


@query("str_case", "SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS up, length(c_name) AS n, strlen(c_name) AS b, reverse(c_name) AS rev FROM customer")
def str_case(spark, d):
    f = customers(spark, d).select(cid, col("c_mktsegment").str.lower().alias("lo"), name.str.upper().alias("up"), name.str.length().alias("n"), name.str.byte_length().alias("b"), name.str.reverse().alias("rev"))
    return f.df.withColumns({"n": F.col("n").cast("bigint"), "b": F.col("b").cast("bigint")})


@query("str_strip", "SELECT c_custkey, trim(s) AS both_, ltrim(s) AS l, rtrim(s) AS r, trim(c_name, 'C#') AS chars FROM (SELECT c_custkey, c_name, '  ' || c_mktsegment || '   ' AS s FROM customer)")
def str_strip(spark, d):
    f = customers(spark, d).with_columns(s=E.concat(lit("  "), col("c_mktsegment"), lit("   ")))
    s = col("s").str
    return f.select(cid, s.strip().alias("both_"), s.strip_start().alias("l"), s.strip_end().alias("r"), name.str.strip("C#").alias("chars")).df


@query("str_pad", "SELECT c_custkey, lpad(k, CAST(greatest(3, length(k)) AS INTEGER), '*') AS p, rpad(k, CAST(greatest(3, length(k)) AS INTEGER), '.') AS q, CASE WHEN n < 0 THEN '-' || lpad(substr(CAST(n AS VARCHAR), 2), CAST(greatest(5, length(CAST(n AS VARCHAR)) - 1) AS INTEGER), '0') ELSE lpad(CAST(n AS VARCHAR), CAST(greatest(6, length(CAST(n AS VARCHAR))) AS INTEGER), '0') END AS z FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, CAST(trunc(c_acctbal) AS BIGINT) AS n FROM customer)")
def str_pad(spark, d):
    f = customers(spark, d).with_columns(k=cid.cast("string"), n=col("c_acctbal").cast("bigint").cast("string"))
    k = col("k").str
    return f.select(cid, k.pad_start(3, "*").alias("p"), k.pad_end(3, ".").alias("q"), col("n").str.zfill(6).alias("z")).df


@query("str_slices", "SELECT c_custkey, substr(c_name, 3, 4) AS a, right(c_name, 3) AS b, left(c_name, 5) AS c, c_name[-4:-2] AS e, substr(c_name, 5) AS f FROM customer")
def str_slices(spark, d):
    s = name.str
    return customers(spark, d).select(cid, s.substring(2, 4).alias("a"), s.tail(3).alias("b"), s.head(5).alias("c"), s.slice(-4, -1).alias("e"), s.slice(4).alias("f")).df


@query("str_search", "SELECT c_custkey, contains(c_name, '00') AS c, regexp_matches(c_name, '0+[5-9]$') AS m, starts_with(c_name, 'Cust') AS s, ends_with(c_name, '7') AS e, CAST(instr(c_name, '0') - 1 AS INTEGER) AS f, CAST(CASE WHEN contains(c_name, '0') THEN length(c_name) - instr(reverse(c_name), '0') ELSE -1 END AS INTEGER) AS l, CAST(len(regexp_extract_all(c_name, '0')) AS INTEGER) AS n FROM customer")
def str_search(spark, d):
    s = name.str
    return customers(spark, d).select(cid, s.contains("00").alias("c"), s.matches("0+[5-9]$").alias("m"), s.starts_with("Cust").alias("s"), s.ends_with("7").alias("e"), s.find("0").alias("f"), s.find_last("0").alias("l"), s.count_matches("0").alias("n")).df


@query("str_replace", "SELECT c_custkey, replace(c_name, '0', 'o') AS a, regexp_replace(c_name, '[0-9]+', '<\\0>', 'g') AS b, regexp_replace(c_name, '0', 'X') AS f FROM customer")
def str_replace(spark, d):
    s = name.str
    return customers(spark, d).select(cid, s.replace("0", "o").alias("a"), s.replace("([0-9]+)", "<$1>", literal=False).alias("b"), s.replace_first("0", "X").alias("f")).df


@query("str_extract", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '([A-Za-z]+)#0*([1-9][0-9]*)') THEN regexp_extract(c_name, '([A-Za-z]+)#0*([1-9][0-9]*)', 2) END AS g, CASE WHEN regexp_matches(c_name, '77') THEN '77' END AS miss FROM customer")
def str_extract(spark, d):
    return customers(spark, d).select(cid, name.str.extract("([A-Za-z]+)#0*([1-9][0-9]*)", 2).alias("g"), name.str.extract("77").alias("miss")).df


@query("str_split", "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS n, array_to_string(string_split(p_name, ' '), '/') AS j FROM part")
def str_split(spark, d):
    t = col("p_type").str
    f = frame(spark, d, "part", "p_partkey").select("p_partkey", t.split(" ")._map(lambda c: F.get(c, 0)).alias("a"), t.split(" ")._map(F.size).alias("n"), col("p_name").str.split(" ").list.join("/").alias("j"))
    return f.df


@query("str_codec", "SELECT c_custkey, to_base64(encode(c_name)) AS b, lower(hex(encode(c_name))) AS h, c_name AS back, c_name AS hack FROM customer")
def str_codec(spark, d):
    s = name.str
    return customers(spark, d).select(cid, s.encode_base64().alias("b"), s.encode_hex().alias("h"), s.encode_base64().str.decode_base64().alias("back"), s.encode_hex().str.decode_hex().alias("hack")).df


@query("str_concat_repeat", "SELECT c_custkey, c_name || '-' || c_mktsegment AS c, concat_ws('|', c_mktsegment, nullif(c_mktsegment, 'BUILDING')) AS w, repeat('ab', 3) AS r FROM customer")
def str_concat_repeat(spark, d):
    seg = col("c_mktsegment")
    return customers(spark, d).select(cid, E.concat(name, lit("-"), seg).alias("c"), E.concat_str("|", seg, when(seg.ne("BUILDING")).then(seg)).alias("w"), lit("ab").str.repeat(3).alias("r")).df


@query("str_title", "SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || '-Ab''s Cd' AS t FROM customer")
def str_title(spark, d):
    return customers(spark, d).select(cid, E.concat(col("c_mktsegment"), lit("-aB's CD")).str.titlecase().alias("t")).df


@query("doc_text", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, contains(lower(text), 'the') AS the, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS digits FROM documents")
def doc_text(spark, d):
    t = col("text")
    f = frame(spark, d, "documents", "doc_id").select("doc_id", t.str.length().alias("n"), t.str.lower().str.contains("the").alias("the"), t.str.count_matches("[0-9]+", literal=False).alias("digits"))
    return f.df.withColumns({"n": F.col("n").cast("bigint"), "digits": F.col("digits").cast("bigint")})


ts, eid = col("ts"), col("event_id")


def events(spark, d):
    return frame(spark, d, "events", "event_id")


def _ints(f, *names):
    return f.df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("dt_parts", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, millisecond(ts) % 1000 AS ms, microsecond(ts) % 1000 AS us, dayofweek(ts) AS wd, dayofyear(ts) AS od, weekofyear(ts) AS wk, isoyear(ts) AS iy, quarter(ts) AS q FROM events")
def dt_parts(spark, d):
    parts = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "ms": "millisecond", "us": "microsecond", "wd": "weekday", "od": "ordinal_day", "wk": "iso_week", "iy": "iso_year", "q": "quarter"}
    return _ints(events(spark, d).select(eid, *[getattr(ts.dt, fn)().alias(n) for n, fn in parts.items()]), *parts)


@query("dt_flags", "SELECT o_orderkey, year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0) AS leap, dayofweek(t) IN (0, 6) AS we, day(t) = 1 AS ms, CAST(t AS DATE) = last_day(t) AS me, day(t) = 1 AND month(t) % 3 = 1 AS qs, CAST(t AS DATE) = last_day(t) AND month(t) % 3 = 0 AS qe, dayofyear(t) = 1 AS ys, month(t) = 12 AND day(t) = 31 AS ye FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)")
def dt_flags(spark, d):
    t = col("o_orderdate").dt
    flags = {"leap": t.is_leap_year(), "we": t.is_weekend(), "ms": t.is_month_start(), "me": t.is_month_end(), "qs": t.is_quarter_start(), "qe": t.is_quarter_end(), "ys": t.is_year_start(), "ye": t.is_year_end()}
    return frame(spark, d, "orders", "o_orderkey").select("o_orderkey", *[e.alias(n) for n, e in flags.items()]).df


@query("dt_trunc", "SELECT event_id, CAST(date_trunc('year', ts) AS TIMESTAMP) AS y, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS mi, CAST(date_trunc('second', ts) AS TIMESTAMP) AS s FROM events")
def dt_trunc(spark, d):
    units = {"y": "year", "q": "quarter", "m": "month", "w": "week", "d": "day", "h": "hour", "mi": "minute", "s": "second"}
    return events(spark, d).select(eid, *[ts.dt.truncate(u).alias(n) for n, u in units.items()]).df


@query("dt_grid", "SELECT event_id, make_timestamp(us // 900000000 * 900000000) AS f, make_timestamp((us + 450000000) // 900000000 * 900000000) AS r, make_timestamp((us + 899999999) // 900000000 * 900000000) AS c FROM (SELECT event_id, epoch_us(ts) AS us FROM events)")
def dt_grid(spark, d):
    t = ts.dt
    return events(spark, d).select(eid, t.interval_floor("15m").alias("f"), t.interval_round("15m").alias("r"), t.interval_ceiling("15m").alias("c")).df


@query("dt_add", "SELECT event_id, ts + INTERVAL 3 DAY AS d, ts + INTERVAL 1 MONTH AS m, ts - INTERVAL 2 YEAR AS y, ts + INTERVAL 90 MINUTE AS x FROM events")
def dt_add(spark, d):
    t = ts.dt
    return events(spark, d).select(eid, t.add_days(3).alias("d"), t.add_months(1).alias("m"), t.add_years(-2).alias("y"), t.add(hours=1, minutes=30).alias("x")).df


@query("dt_offset_by", "SELECT o_orderkey, o_orderdate + INTERVAL 14 MONTH + INTERVAL 9 DAY + INTERVAL 4 HOUR AS a, o_orderdate - INTERVAL 1 MONTH - INTERVAL 1 DAY AS b, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS d FROM orders")
def dt_offset_by(spark, d):
    t = col("o_orderdate")
    return frame(spark, d, "orders", "o_orderkey").select("o_orderkey", t.dt.offset_by("1y2mo1w2d4h").alias("a"), t.dt.offset_by("-1mo1d").alias("b"), t.cast("date").dt.offset_by("1mo", date=True).alias("d")).df


@query("dt_bounds", "SELECT event_id, date_trunc('month', ts) AS ms, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS me, date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 MILLISECOND AS qe, date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 MILLISECOND AS ye FROM events")
def dt_bounds(spark, d):
    t = ts.dt
    return events(spark, d).select(eid, t.start_of("month").alias("ms"), t.end_of("month").alias("me"), t.end_of("quarter").alias("qe"), t.end_of("year").alias("ye")).df


@query("dt_epoch", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, epoch_us(ts) AS us, epoch_ns(ts) AS ns FROM events")
def dt_epoch(spark, d):
    t = ts.dt
    return events(spark, d).select(eid, *[t.epoch(u).alias(u) for u in ("s", "ms", "us", "ns")]).df


@query("dt_strftime", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d/%m/%y %j') AS b, strftime(ts, '%A %B') AS c, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS iso FROM events")
def dt_strftime(spark, d):
    t = ts.dt
    return events(spark, d).select(eid, t.strftime("%Y-%m-%d %H:%M:%S").alias("a"), t.strftime("%d/%m/%y %j").alias("b"), t.strftime("%A %B").alias("c"), t.to_iso_string().alias("iso")).df


@query("dt_strptime", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_trunc('second', o_orderdate) AS t, CAST(NULL AS TIMESTAMP) AS bad FROM orders")
def dt_strptime(spark, d):
    t = col("o_orderdate")
    text = t.dt.strftime("%d.%m.%Y %H:%M:%S")
    return frame(spark, d, "orders", "o_orderkey").select("o_orderkey", text.str.strptime("date", "%d.%m.%Y %H:%M:%S").alias("d"), text.str.strptime("datetime", "%d.%m.%Y %H:%M:%S").alias("t"), col("o_orderstatus").str.strptime().alias("bad")).df


@query("dt_zone", "SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS ny FROM events")
def dt_zone(spark, d):
    return events(spark, d).select(eid, ts.dt.convert_time_zone("UTC", "America/New_York").alias("ny")).df


_M = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN -o_totalprice ELSE o_totalprice END AS x FROM orders"


def maths(spark, d):
    k = col("o_orderkey")
    z = lambda n: (k % 5).eq(lit(n).cast("bigint"))
    return frame(spark, d, "orders", "o_orderkey").select(k, when(z(0)).then(0.0).when(z(1)).then(-col("o_totalprice")).otherwise(col("o_totalprice")).alias("x"))


@query("math_guarded", f"SELECT o_orderkey, CASE WHEN x = 0 THEN '-Infinity'::DOUBLE WHEN x < 0 THEN 'NaN'::DOUBLE ELSE ROUND(ln(x), 9) END AS l, CASE WHEN x < 0 THEN 'NaN'::DOUBLE ELSE ROUND(sqrt(x), 9) END AS r, CAST(sign(x) AS INTEGER) AS s, abs(x) AS a, greatest(least(x, 1000), -1000) AS c, CASE WHEN x = 0 THEN 'NaN'::DOUBLE ELSE 1.0 END AS self FROM ({_M})")
def math_guarded(spark, d):
    x = col("x")
    f = maths(spark, d).select("o_orderkey", x.math("log").alias("l"), x.math("sqrt").alias("r"), x.math("sign").alias("s"), x.abs().alias("a"), x.math("clip", -1000, 1000).alias("c"), (x / x).alias("self"))
    return f.df.withColumns({"l": rounded(F.col("l"), 9), "r": rounded(F.col("r"), 9)})


@query("math_trig", "SELECT o_orderkey, ROUND(sin(t), 9) AS a, ROUND(cos(t), 9) AS b, ROUND(atan(t), 9) AS c, ROUND(sinh(t), 9) AS e, ROUND(exp(t), 9) AS f, ROUND(acos(t), 9) AS g FROM (SELECT o_orderkey, o_orderkey % 100 / 100.0 AS t FROM orders)")
def math_trig(spark, d):
    f = frame(spark, d, "orders", "o_orderkey").with_columns(t=(col("o_orderkey") % 100) / lit(100.0))
    t, names = col("t"), {"a": "sin", "b": "cos", "c": "atan", "e": "sinh", "f": "exp", "g": "acos"}
    out = f.select("o_orderkey", *[t.math(fn).alias(n) for n, fn in names.items()])
    return out.df.withColumns({n: F.round(n, 9) for n in names})


@query("math_rounding", "SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round_even(p_retailprice, 0) AS r, CAST(p_size // 4 AS BIGINT) AS q, CAST(p_size % 4 AS BIGINT) AS m, CAST(-p_size // 4 AS BIGINT) AS nq, CAST(-p_size % 4 AS BIGINT) AS nm, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey // (p_size % 5) AS BIGINT) END AS z, CAST(p_size AS DOUBLE) ** 2 AS pw FROM part")
def math_rounding(spark, d):
    x, n = col("p_retailprice"), col("p_size")
    f = frame(spark, d, "part", "p_partkey")
    return f.select("p_partkey", x.math("floor").alias("f"), x.math("ceil").alias("c"), x.math("round").alias("r"), (n / 4).alias("q"), (n % 4).alias("m"), (-n / 4).alias("nq"), (-n % 4).alias("nm"), (col("p_partkey") / (n % 5)).alias("z"), (n.cast("double") ** 2).alias("pw")).df


def vectors(spark, d):
    return frame(spark, d, "embeddings", "vec_id")


@query("list_stats", "SELECT vec_id, CAST(len(e) AS INTEGER) AS n, ROUND(list_sum(e), 5) AS s, ROUND(list_avg(e), 6) AS m, list_min(e) AS lo, list_max(e) AS hi FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def list_stats(spark, d):
    e = col("embedding").list
    f = vectors(spark, d).select("vec_id", e.lengths().alias("n"), e.sum().alias("s"), e.mean().alias("m"), e.min().alias("lo"), e.max().alias("hi"))
    return f.df.withColumns({"s": F.round("s", 5), "m": F.round("m", 6)})


@query("list_get", "SELECT vec_id, embedding[1] AS a, embedding[64] AS z, embedding[63] AS y, CAST(NULL AS FLOAT) AS out_, CAST(len(embedding[3:7]) AS INTEGER) AS n FROM embeddings")
def list_get(spark, d):
    e = col("embedding").list
    return vectors(spark, d).select("vec_id", e.first().alias("a"), e.last().alias("z"), e.get(-2).alias("y"), e.get(500).alias("out_"), e.slice(2, 5).list.lengths().alias("n")).df


@query("list_order", "SELECT p_partkey, array_to_string(list_reverse(w), ' ') AS r, array_to_string(list_sort(w), ' ') AS s, array_to_string(list_reverse(list_sort(w)), ' ') AS sd, CAST(len(list_distinct(w)) AS INTEGER) AS u, list_contains(w, 'red') AS c, array_to_string(w[1:2], ' ') AS h, array_to_string(w[-2:], ' ') AS t FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def list_order(spark, d):
    f = frame(spark, d, "part", "p_partkey").with_columns(w=col("p_name").str.split(" "))
    w = col("w").list
    j = lambda e: e.list.join(" ")
    return f.select("p_partkey", j(w.reverse()).alias("r"), j(w.sort()).alias("s"), j(w.sort(descending=True)).alias("sd"), w.unique().list.lengths().alias("u"), w.contains("red").alias("c"), j(w.head(2)).alias("h"), j(w.tail(2)).alias("t")).df


@query("list_text", "SELECT vec_id, '[' || CAST(label AS VARCHAR) || ', ' || CAST(label + 1 AS VARCHAR) || ']' AS t FROM embeddings")
def list_text(spark, d):
    f = vectors(spark, d)
    return f._with(f._df.withColumn("t", nested.as_text(F.array("label", F.col("label") + 1)))).select("vec_id", "t").df


@query("explode", "SELECT vec_id, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)")
def explode(spark, d):
    return vectors(spark, d).select("vec_id", col("embedding").alias("x")).explode("x").df


@query("explode_two", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, unnest(string_split(p_type, ' ')) AS b FROM part")
def explode_two(spark, d):
    f = frame(spark, d, "part", "p_partkey").select("p_partkey", col("p_name").str.split(" ").alias("a"), col("p_type").str.split(" ").alias("b"))
    return f.explode("a", "b").df


@query("struct_unnest", "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n FROM conversations")
def struct_unnest(spark, d):
    f = frame(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", E.struct(role=col("role"), n=col("text").str.length()).alias("s"))
    return f.unnest("s").df


@query("struct_field_json", "SELECT conv_id, turn, role AS r, '{\"who\":\"' || role || '\",\"t\":' || turn || '}' AS j FROM conversations")
def struct_field_json(spark, d):
    f = frame(spark, d, "conversations", "conv_id", "turn").with_columns(s=E.struct(role=col("role"), t=col("turn")))
    df = f.df.withColumn("q", nested.rename_fields(f.df, "s", {"role": "who"}))
    return df.select("conv_id", "turn", nested.field(F.col("s"), "role").alias("r"), nested.json_encode(F.col("q")).alias("j"))


@query("json_path", "SELECT event_id, props->>'$.k' AS k, props->>'$.missing.x' AS no FROM events")
def json_path(spark, d):
    p = col("props").str
    return events(spark, d).select(eid, p.json_path("k").alias("k"), p.json_path("missing.x").alias("no")).df


__all__ = ["clock", "strings"]
