"""Math and row-wise functions (rows 243-263)."""

from __future__ import annotations

import functools
import operator
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_(c):
    return F.abs(c)


def sqrt(c):
    return F.sqrt(c)


def _log(c: Column, f) -> Column:
    """-Infinity at 0 and NaN below (row 245); Spark's own gives null there."""
    d = c.cast("double")
    return F.when(d.isNull(), F.lit(None).cast("double")).when(F.isnan(d) | (d < 0), F.lit(float("nan"))).when(d == 0, F.lit(float("-inf"))).otherwise(f(d))


@functools.cache
def _logs() -> tuple[list[float], list[float], float, float]:
    """Logarithms of n/128 (as sums of two lists of doubles, from n = 0, where none is used) and of 2 (the first part has 42 bits)."""
    with localcontext(prec=50):
        at = [Decimal(max(n, 1)).ln() - Decimal(128).ln() for n in range(192)]
        two = Decimal(2).ln()
        most = int(two * 2**42) / 2**42
        return [float(v) for v in at], [float(v - Decimal(float(v))) for v in at], most, float(two - Decimal(most))


def _ln(c: Column) -> Column:
    """The double nearest to the natural logarithm; Spark's own is its neighbour for one number in a hundred."""
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    his, los, two_hi, two_lo = _logs()
    hi, lo = (lambda n, t=t: F.element_at(F.array(*map(F.lit, t)), n.cast("int") + 1) for t in (his, los))

    def near(k, m, n, u):
        # c = 2**k * m, m = n/128 + u: all of these and the rest of the division are exact. r is below 0.006.
        def sums(r, a):
            top = let(r * 134217729.0, lambda s: s - (s - r))
            rest = let(top, lambda t: (u - t * (n / 128.0) - (r - t) * (n / 128.0)) / (n / 128.0))
            q = F.lit(1 / 9)
            for i in range(8, 1, -1):
                q = q * r + (-1) ** (i + 1) / i
            b = hi(n)
            tail = q * r * r + rest + k * two_lo + lo(n)
            return let(a + b, lambda s: let(s + r, lambda t: t + (let(s - a, lambda v: (a - (s - v)) + (b - v)) + let(t - s, lambda v: (s - (t - v)) + (r - v)) + tail)))

        return let(u / (n / 128.0), lambda r: let(k * two_hi, lambda a: sums(r, a)))

    exact = let(F.rint(F.log2(c)), lambda k: let(c * F.pow(F.lit(2.0), -k), lambda m: let(F.rint(m * 128.0), lambda n: let(m - n / 128.0, lambda u: near(k, m, n, u)))))
    return F.when((c > 2.0**-1000) & (c < 2.0**1000), exact).otherwise(F.ln(c))


def log(c):
    return _log(c, _ln)


def log10(c):
    return _log(c, F.log10)


def exp(c):
    return F.exp(c)


def trig(c, name: str):
    """sin cos tan asin acos atan sinh cosh tanh."""
    return getattr(F, name)(c)


def _whole(c, f) -> Column:
    """f of a double (row 250); NaN, infinities and values from 2**53 are whole already and no longs."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= 2.0**53), d).otherwise(f(d).cast("double"))


def floor(c):
    return _whole(c, F.floor)


def ceil(c):
    return _whole(c, F.ceil)


def round_(c, decimals: int = 0):
    """Half to even (row 251)."""
    return F.bround(c, decimals)


def sign(c):
    return F.signum(c).cast("int")


def clip(c, lower=None, upper=None):
    """Into bounds, as double; null stays null (row 253)."""
    out = c.cast("double")
    if lower is not None:
        out = F.when(out < lower, F.lit(float(lower))).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(float(upper))).otherwise(out)
    return out


def power(a, b):
    return F.pow(a, b)


def sum_horizontal(*cs, floating: bool = True):
    """Nulls count as 0; of nulls alone 0 (row 260)."""
    kind = "double" if floating else "long"
    return functools.reduce(operator.add, [F.coalesce(c.cast(kind), F.lit(0).cast(kind)) for c in cs])


def mean_horizontal(*cs):
    n = functools.reduce(operator.add, [c.isNotNull().cast("int") for c in cs])
    return F.try_divide(sum_horizontal(*cs), n)


def _solid(c):
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def min_horizontal(*cs):
    """Nulls and NaN skipped (row 262)."""
    cs = [_solid(c) for c in cs]
    return F.least(*cs) if len(cs) > 1 else cs[0]


def max_horizontal(*cs):
    cs = [_solid(c) for c in cs]
    return F.greatest(*cs) if len(cs) > 1 else cs[0]
