"""Window kernels (rows 114-153): ranks, shifts, running and rolling frames, interpolation, exponential weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def whole(w):
    return w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def running(w):
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


class Frame:
    """An aggregate that needs the frame itself to be written down."""

    def __init__(self, fn):
        self.fn = fn

    def over(self, w) -> Column:
        return self.fn(w)


def variance(c, ddof: int = 1, over=None) -> Column:
    """count <= ddof gives null (row 85); over: a window."""
    at = (lambda x: x) if over is None else (lambda x: x.over(over))
    if ddof == 1:
        return at(F.var_samp(c))
    n = at(F.count(c))
    return F.when(n > ddof, at(F.var_pop(c)) * n / F.greatest(n - ddof, F.lit(1)))


def quantile(c, q: float, interpolation: str = "linear") -> Column:
    """At q (n - 1): linear, lower, higher, nearest or midpoint (row 91). Linear sorts nothing twice; the others gather a group's values."""
    if not 0 <= q <= 1:
        raise ValueError("q lies in [0, 1]")
    if interpolation == "linear":
        return F.percentile(c, q)
    return pick(F.sort_array(F.collect_list(c.cast("double"))), q, interpolation)


def pick(values: Column, q: float, interpolation: str) -> Column:
    at = (F.size(values) - 1) * F.lit(q)
    lo, hi = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    how = {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": F.get(values, F.bround(at).cast("int")), "linear": lo + (hi - lo) * (at - F.floor(at))}
    if interpolation not in how:
        raise ValueError(f"unknown interpolation {interpolation}")
    return F.when(F.size(values) > 0, how[interpolation])


def frame_quantile(c, w, q, interpolation):
    return F.percentile(c, q).over(w) if interpolation == "linear" else pick(F.sort_array(F.collect_list(c.cast("double")).over(w)), q, interpolation)


def rank(c, partition, order, method: str = "average", descending: bool = False) -> Column:
    """Nulls have no rank and do not count (row 118). average, min, max, first, dense."""
    key = c.desc_nulls_last() if descending else c.asc_nulls_last()
    w = W.partitionBy(*partition).orderBy(key)
    ties = F.count(c).over(W.partitionBy(*partition, c))
    low = F.rank().over(w)
    how = {
        "min": lambda: low, "max": lambda: low + ties - 1, "average": lambda: low + (ties - 1) / 2, "dense": lambda: F.dense_rank().over(w),
        "first": lambda: F.row_number().over(W.partitionBy(*partition).orderBy(key, *order)),
    }
    if method not in how:
        raise ValueError(f"unknown method {method}")
    return F.when(c.isNotNull(), how[method]().cast("double"))


def percent_rank(c, partition) -> Column:
    """(average rank - 1) / (n - 1) over non-null values; 0 where n <= 1 (row 121)."""
    n = F.count(c).over(W.partitionBy(*partition))
    return F.when(c.isNotNull(), F.when(n > 1, (rank(c, partition, ()) - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0)))


def shift(c, w, n: int, default=None) -> Column:
    d = None if default is None else default
    return F.lag(c, n, d).over(w) if n >= 0 else F.lead(c, -n, d).over(w)


def cum_extreme(c, w, agg) -> Column:
    """Running min or max; a NaN stays (row 129)."""
    d = c.cast("double")
    seen = F.coalesce(F.max(F.isnan(d).cast("int")).over(running(w)), F.lit(0))
    return F.when(d.isNotNull(), F.when(seen == 1, F.lit(float("nan"))).otherwise(agg(F.when(~F.isnan(d), d)).over(running(w))))


def pct_change(c, w, n: int) -> Column:
    before = F.lag(c, n).over(w).cast("double")
    return F.try_divide(c.cast("double") - before, before)


def interpolate(c, w, position: Column) -> Column:
    """Linear by position between neighbours; nulls at the ends stay (row 134). position: the row's number, a plain column."""
    v = c.cast("double")
    back, ahead = running(w), w.rowsBetween(W.currentRow, W.unboundedFollowing)
    at = F.when(v.isNotNull(), position)
    p, n = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
    i, j = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    return F.coalesce(v, p + F.try_divide((position - i).cast("double"), (j - i).cast("double")) * (n - p))


def rolling_bounds(w, window: int | None, center: bool):
    """The frame of a window of rows that ends here, or that has this row in its middle; None: all rows so far."""
    if window is None:
        return running(w)
    if window < 1:
        raise ValueError("a window has a row at least")
    half = window // 2
    return w.rowsBetween(-half, window - half - 1) if center else w.rowsBetween(-(window - 1), 0)


def rolling(c, w, agg, window, min_periods: int = 1, center: bool = False) -> Column:
    """agg over the frame where it holds min_periods values (rows 135-145)."""
    f = rolling_bounds(w, window, center)
    return F.when(F.count(c).over(f) >= max(min_periods, 1), agg(c).over(f)).cast("double")


def rolling_variance(c, w, window, min_periods, ddof, center) -> Column:
    f = rolling_bounds(w, window, center)
    n = F.count(c).over(f)
    return F.when(n >= max(min_periods, ddof + 1), F.var_pop(c).over(f) * n / F.greatest(n - ddof, F.lit(1)))


def apply_udf(fn):
    import pandas as pd

    def run(values):
        return values.map(lambda v: None if v is None else fn(list(v)))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def alpha_from_span(span: float) -> float:
    if span < 1:
        raise ValueError("span is 1 at least")
    return 2.0 / (span + 1.0)


def alpha_from_halflife(halflife: float) -> float:
    if halflife <= 0:
        raise ValueError("halflife is positive")
    return 1.0 - math.exp(-math.log(2.0) / halflife)


def alpha_from_com(com: float) -> float:
    if com < 0:
        raise ValueError("com is 0 at least")
    return 1.0 / (1.0 + com)


def _check_alpha(alpha: float) -> float:
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies in (0, 1]")
    return float(alpha)


def alpha_of(alpha: float | None = None, span: float | None = None, halflife: float | None = None, com: float | None = None) -> float:
    """The one given of alpha, span, halflife and com, as alpha (rows 147-152)."""
    given = [(f, v) for f, v in ((_check_alpha, alpha), (alpha_from_span, span), (alpha_from_halflife, halflife), (alpha_from_com, com)) if v is not None]
    if len(given) != 1:
        raise ValueError("one of alpha, span, halflife and com is needed")
    return given[0][0](given[0][1])


def _reach(decay: float) -> int:
    """Rows after which a weight is below 2**-64 of the newest: what lies before changes no double."""
    return 0 if decay <= 0 else math.ceil(64 * math.log(2) / -math.log(decay))


class History:
    """The values that weigh on a row, in order. Weights fade, so a window of fixed length holds them however long a group is."""

    def __init__(self, c, partition, order):
        self.c = c.cast("double")
        self.all = W.partitionBy(*partition).orderBy(*order)
        self.solid = W.partitionBy(*partition, c.isNull()).orderBy(*order)

    def values(self, decay: float) -> Column:
        """Of a row with a value: the non-null values up to it."""
        return F.collect_list(self.c).over(self.solid.rowsBetween(-_reach(decay), 0))

    def rows(self, decay: float) -> Column:
        """All rows up to this one, nulls kept (each wrapped, as lists drop nulls)."""
        return F.collect_list(F.struct(self.c.alias("v"))).over(self.all.rowsBetween(-_reach(decay), 0))

    def seen(self) -> Column:
        return F.count(self.c).over(running(self.all))

    def carried(self, value: Column, ignore_nulls: bool) -> Column:
        """A null row repeats the value before it, or is null unless ignore_nulls. value: a plain column."""
        return F.last(value, ignorenulls=True).over(running(self.all)) if ignore_nulls else F.when(self.c.isNotNull(), value)


def ewm_mean(h: History, add, alpha, adjust, ignore_nulls, min_periods) -> Column:
    """Weights do not decay across nulls (row 146). add: makes a column of its own."""
    a = _check_alpha(alpha)
    b = 1 - a
    if adjust:
        zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("w"))
        step = lambda s, v: F.struct((v + b * s["m"]).alias("m"), (F.lit(1.0) + b * s["w"]).alias("w"))
        mean = F.aggregate(h.values(b), zero, step, lambda s: F.try_divide(s["m"], s["w"]))
    else:
        none = F.lit(None).cast("double")
        mean = F.aggregate(h.values(b), none, lambda s, v: F.when(s.isNull(), v).otherwise(a * v + b * s))
    return F.when(h.seen() >= max(min_periods, 1), h.carried(add(F.when(h.c.isNotNull(), mean)), ignore_nulls))


def ewm_sum(h: History, alpha, ignore_nulls, min_periods) -> Column:
    """s = x + (1 - alpha) s; a null decays the sum (row 152)."""
    b = 1 - _check_alpha(alpha)
    out = F.aggregate(h.rows(b), F.lit(0.0), lambda s, x: F.coalesce(x["v"], F.lit(0.0)) + b * s)
    out = F.when(h.seen() >= max(min_periods, 1), out)
    return out if ignore_nulls else F.when(h.c.isNotNull(), out)


def ewm_var(h: History, add, alpha, adjust, ignore_nulls, min_periods, bias) -> Column:
    """The recursion that carries the corrected variance on (row 149): the first value gives null."""
    a = _check_alpha(alpha)
    b = 1 - a
    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("w"), F.lit(1.0).alias("q"))

    def step(s, x):
        weight, square = a + b * s["w"], a * a + b * b * s["q"]
        moved = b * (s["v"] + a * (x - s["m"]) * (x - s["m"]))
        if adjust and not bias:
            moved = moved * F.try_divide(weight * weight, weight * weight - square)
        first = F.struct(x.alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("w"), F.lit(1.0).alias("q"))
        later = F.struct(F.try_divide(a * x + b * s["m"] * s["w"], weight).alias("m"), moved.alias("v"), weight.alias("w"), square.alias("q"))
        return F.when(s["m"].isNull(), first).otherwise(later)

    # With the correction the variance fades by 1 - a / 2 a row.
    fades = 1 - a / 2 if adjust and not bias else b
    variance = add(F.when(h.c.isNotNull(), F.aggregate(h.values(fades), zero, step, lambda s: s["v"])))
    seen = h.seen()
    # A row that brings the first value itself has no variance, whatever min_periods.
    return F.when((seen >= max(min_periods, 1)) & (h.c.isNull() | (seen > 1)), h.carried(variance, ignore_nulls))
