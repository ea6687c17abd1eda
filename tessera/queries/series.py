"""Windows, running and rolling statistics, ranks, fills and exponential weights, by user in event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import expr as E
from tessera.operators.ewm import ewm
from tessera.operators.expr import col, lit, when
from tessera.queries.base import ORACLES, frame, query

#: Events with some values missing, in the order of event_id.
_EV = "SELECT event_id, user_id, event_type, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS v FROM events"


def events(spark, d):
    k = col("event_id")
    return frame(spark, d, "events", "event_id").select(k, "user_id", "event_type", when((k % 6).eq(lit(0).cast("bigint"))).then(lit(None).cast("double")).otherwise(col("value")).alias("v"))


def _rounded(f, *names, digits=6):
    return f.df.withColumns({n: F.round(n, digits) for n in names})


_W = "PARTITION BY user_id ORDER BY event_id"


def _series(name, expressions, sql, digits=6):
    """One query per group of expressions over v, by user: {column: Expr}; sql: the columns' SQL over t."""

    @query(name, f"WITH t AS ({_EV}) SELECT event_id, {sql} FROM t")
    def run(spark, d):
        return _rounded(events(spark, d).with_columns(**{k: e.over("user_id") for k, e in expressions.items()}).select("event_id", *expressions), *expressions, digits=digits)

    return run


v = col("v")
_P = "PARTITION BY user_id"
_series("win_aggregates", {"s": v.sum(), "m": v.mean(), "lo": v.min(), "hi": v.max(), "sd": v.std(), "md": v.median()},
        f"ROUND(sum(v) OVER ({_P}), 6) AS s, ROUND(avg(v) OVER ({_P}), 6) AS m, ROUND(min(v) OVER ({_P}), 6) AS lo, ROUND(max(v) OVER ({_P}), 6) AS hi, ROUND(stddev_samp(v) OVER ({_P}), 6) AS sd, ROUND(median(v) OVER ({_P}), 6) AS md")
_series("win_share", {"share": v / v.sum()}, f"ROUND(v / sum(v) OVER ({_P}), 6) AS share")
_series("shift_lead_lag", {"s": v.shift(1), "l2": v.lag(2), "ld": v.lead(1), "back": v.shift(-2)},
        f"ROUND(lag(v) OVER ({_W}), 6) AS s, ROUND(lag(v, 2) OVER ({_W}), 6) AS l2, ROUND(lead(v) OVER ({_W}), 6) AS ld, ROUND(lead(v, 2) OVER ({_W}), 6) AS back")
_FULL = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_series("first_last_nth", {"f": v.first_value(), "l": v.last_value(), "n2": v.nth_value(2)},
        f"ROUND(first_value(v IGNORE NULLS) OVER ({_FULL}), 6) AS f, ROUND(last_value(v IGNORE NULLS) OVER ({_FULL}), 6) AS l, ROUND(nth_value(v, 2 IGNORE NULLS) OVER ({_FULL}), 6) AS n2")
_series("cumulative", {"cs": v.cum_sum(), "lo": v.cum_min(), "hi": v.cum_max()},
        f"CASE WHEN v IS NOT NULL THEN ROUND(sum(v) OVER ({_W}), 6) END AS cs, CASE WHEN v IS NOT NULL THEN ROUND(min(v) OVER ({_W}), 6) END AS lo, CASE WHEN v IS NOT NULL THEN ROUND(max(v) OVER ({_W}), 6) END AS hi")
_series("cum_product", {"cp": (v / 100.0 + 1).cum_prod().math("log")}, f"CASE WHEN v IS NOT NULL THEN ROUND(ln(product(v / 100.0 + 1) OVER ({_W})), 8) END AS cp", digits=8)
_series("diff_pct", {"d1": v.diff(), "d3": v.diff(3), "pc": v.pct_change()},
        f"ROUND(v - lag(v) OVER ({_W}), 6) AS d1, ROUND(v - lag(v, 3) OVER ({_W}), 6) AS d3, CASE WHEN lag(v) OVER ({_W}) <> 0 THEN ROUND((v - lag(v) OVER ({_W})) / lag(v) OVER ({_W}), 6) END AS pc")
_series("fills", {"ff": v.fill_forward(), "bf": v.fill_backward()},
        f"ROUND(last_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ff, ROUND(first_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bf")


def _roll(agg, frame_, minimum, count="v"):
    return f"CASE WHEN count({count}) OVER ({_W} {frame_}) >= {minimum} THEN ROUND({agg} OVER ({_W} {frame_}), 6) END"


_R5, _C4 = "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"
_series("rolling_stats", {"s": v.rolling_sum(5), "m": v.rolling_mean(5, 3), "lo": v.rolling_min(5), "hi": v.rolling_max(5)},
        f"{_roll('sum(v)', _R5, 1)} AS s, {_roll('avg(v)', _R5, 3)} AS m, {_roll('min(v)', _R5, 1)} AS lo, {_roll('max(v)', _R5, 1)} AS hi")
_series("rolling_spread", {"sd": v.rolling_std(5), "vr": v.rolling_var(5, 1, 0)}, f"{_roll('stddev_samp(v)', _R5, 2)} AS sd, {_roll('var_pop(v)', _R5, 1)} AS vr", digits=8)
ORACLES["rolling_spread"] = ORACLES["rolling_spread"].replace(", 6)", ", 8)")
_series("rolling_center", {"s": v.rolling_sum(4, 1, True), "m": v.rolling_mean(4, 2, True)}, f"{_roll('sum(v)', _C4, 1)} AS s, {_roll('avg(v)', _C4, 2)} AS m")
_series("rolling_quantiles", {"md": v.rolling_median(5), "q": v.rolling_quantile(0.8, 5)}, f"{_roll('median(v)', _R5, 1)} AS md, {_roll('quantile_cont(v, 0.8)', _R5, 1)} AS q")
_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_series("expanding_stats", {"s": v.expanding_sum(), "m": v.expanding_mean(2), "lo": v.expanding_min(), "hi": v.expanding_max(), "sd": v.expanding_std()},
        f"{_roll('sum(v)', _UP, 1)} AS s, {_roll('avg(v)', _UP, 2)} AS m, {_roll('min(v)', _UP, 1)} AS lo, {_roll('max(v)', _UP, 1)} AS hi, {_roll('stddev_samp(v)', _UP, 2)} AS sd", digits=9)
ORACLES["expanding_stats"] = ORACLES["expanding_stats"].replace(", 6)", ", 9)")
_series("interpolate", {"x": v.interpolate()}, """ROUND(coalesce(v, pv + (i - pi) / CAST(ni - pi AS DOUBLE) * (nv - pv)), 6) AS x""")
ORACLES["interpolate"] = f"""WITH t AS (SELECT *, row_number() OVER ({_W}) AS i FROM ({_EV})),
u AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni
FROM t WINDOW b AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, ROUND(coalesce(v, pv + (i - pi) / CAST(ni - pi AS DOUBLE) * (nv - pv)), 6) AS x FROM u"""


@query("cum_count", f"SELECT event_id, count(v) OVER ({_W}) AS n, row_number() OVER ({_W}) AS r FROM ({_EV})")
def cum_count(spark, d):
    return events(spark, d).with_columns(n=v.cum_count().over("user_id"), r=E.row_number().over("user_id")).select("event_id", "n", "r").df


@query(
    "ranks",
    """WITH t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ROUND(c_acctbal, -2) END AS b FROM customer),
    r AS (SELECT *, rank() OVER w AS lo, dense_rank() OVER w AS de, row_number() OVER (PARTITION BY c_nationkey ORDER BY b NULLS LAST, c_custkey) AS f, count(b) OVER (PARTITION BY c_nationkey, b) AS t, count(b) OVER (PARTITION BY c_nationkey) AS n FROM t WINDOW w AS (PARTITION BY c_nationkey ORDER BY b NULLS LAST))
    SELECT c_custkey, CASE WHEN b IS NOT NULL THEN lo + (t - 1) / 2.0 END::DOUBLE AS av, CASE WHEN b IS NOT NULL THEN lo END::DOUBLE AS mi, CASE WHEN b IS NOT NULL THEN lo + t - 1 END::DOUBLE AS ma, CASE WHEN b IS NOT NULL THEN de END::DOUBLE AS de, CASE WHEN b IS NOT NULL THEN f END::DOUBLE AS fi,
    CASE WHEN b IS NOT NULL THEN ROUND(CASE WHEN n > 1 THEN (lo + (t - 1) / 2.0 - 1) / (n - 1) ELSE 0 END, 9) END::DOUBLE AS pr FROM r""",
)
def ranks(spark, d):
    k = col("c_custkey")
    f = frame(spark, d, "customer", "c_custkey")
    f = f._with(f._df.withColumn("r", F.round("c_acctbal", -2))).with_columns(b=when((k % 9).eq(lit(0).cast("bigint"))).then(lit(None).cast("double")).otherwise(col("r")))
    b, by = col("b"), "c_nationkey"
    f = f.with_columns(av=b.rank().over(by), mi=b.rank("min").over(by), ma=b.rank("max").over(by), de=b.dense_rank().over(by), fi=b.ordinal_rank().over(by), pr=b.percent_rank().over(by))
    return f.select("c_custkey", "av", "mi", "ma", "de", "fi", "pr").df.withColumn("pr", F.round("pr", 9))


@query("win_nunique", f"SELECT event_id, CAST(u AS BIGINT) AS u, n FROM (SELECT user_id, count(DISTINCT event_type) AS u, count(*) AS n FROM ({_EV}) GROUP BY user_id) JOIN ({_EV}) USING (user_id)")
def win_nunique(spark, d):
    return events(spark, d).with_columns(u=col("event_type").n_unique().over("user_id"), n=E.count().over("user_id")).select("event_id", "u", "n").df


_EWM = f"""WITH RECURSIVE t AS (SELECT event_id, user_id, v, row_number() OVER ({_W}) AS i FROM ({_EV})),
r AS (SELECT event_id, user_id, i, {{init}} FROM t WHERE i = 1 UNION ALL SELECT t.event_id, t.user_id, t.i, {{step}} FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
SELECT event_id, {{out}} FROM r"""


@query("ewm_mean", _EWM.format(init="coalesce(0.3 * v, 0)::DOUBLE AS m, CASE WHEN v IS NULL THEN 0 ELSE 0.3 END::DOUBLE AS w", step="CASE WHEN t.v IS NULL THEN m ELSE 0.3 * t.v + 0.7 * m END, CASE WHEN t.v IS NULL THEN w ELSE 0.3 + 0.7 * w END", out="CASE WHEN w > 0 THEN ROUND(m / w, 6) END AS e"))
def ewm_mean(spark, d):
    return _rounded(events(spark, d).with_columns(e=v.ewm_mean(0.3).over("user_id")).select("event_id", "e"), "e")


@query("ewm_sum", _EWM.format(init="coalesce(v, 0)::DOUBLE AS s, (v IS NOT NULL)::INTEGER AS n", step="coalesce(t.v, 0) + 0.7 * s, n + (t.v IS NOT NULL)::INTEGER", out="CASE WHEN n > 0 THEN ROUND(s, 6) END AS e"))
def ewm_sum(spark, d):
    return _rounded(events(spark, d).with_columns(e=v.ewm_sum(0.3).over("user_id")).select("event_id", "e"), "e")


@query("ewm_grouped", _EWM.format(init="coalesce(v, 0)::DOUBLE AS m, (v IS NOT NULL)::INTEGER AS n", step="CASE WHEN t.v IS NULL THEN m WHEN n = 0 THEN t.v ELSE 0.4 * t.v + 0.6 * m END, n + (t.v IS NOT NULL)::INTEGER", out="CASE WHEN n > 0 THEN ROUND(m, 6) END AS e"))
def ewm_grouped(spark, d):
    out = ewm(events(spark, d).df, "v", ["user_id"], ["event_id"], 0.4, adjust=False, name="e")
    return out.select("event_id", F.round("e", 6).alias("e"))


_W2 = "(0.3 + 0.7 * w)"
_LATER = "CASE WHEN t.v IS NULL THEN {same} WHEN n = 0 THEN {first} ELSE {later} END"


@query(
    "ewm_var",
    _EWM.format(
        init="v AS m, 0::DOUBLE AS c, 1::DOUBLE AS w, 1::DOUBLE AS q, (v IS NOT NULL)::INTEGER AS n",
        step=", ".join([
            _LATER.format(same="m", first="t.v", later=f"(0.3 * t.v + 0.7 * m * w) / {_W2}"),
            _LATER.format(same="c", first="0", later=f"0.7 * (c + 0.3 * (t.v - m) * (t.v - m)) * ({_W2} * {_W2}) / ({_W2} * {_W2} - (0.09 + 0.49 * q))"),
            _LATER.format(same="w", first="1", later=_W2), _LATER.format(same="q", first="1", later="0.09 + 0.49 * q"), "n + (t.v IS NOT NULL)::INTEGER",
        ]),
        out="CASE WHEN n >= 2 THEN ROUND(c, 6) END AS e, CASE WHEN n >= 2 THEN ROUND(sqrt(greatest(c, 0)), 6) END AS s",
    ),
)
def ewm_var(spark, d):
    return _rounded(events(spark, d).with_columns(e=v.ewm_var(0.3).over("user_id"), s=v.ewm_std(0.3).over("user_id")).select("event_id", "e", "s"), "e", "s")


@query("rolling_apply", f"WITH t AS ({_EV}) SELECT event_id, ROUND(max(v) OVER ({_W} {_R5}) - min(v) OVER ({_W} {_R5}), 6) AS r FROM t")
def rolling_apply(spark, d):
    return _rounded(events(spark, d).with_columns(r=v.rolling_apply(lambda x: max(x) - min(x) if x else None, 5).over("user_id")).select("event_id", "r"), "r")
