"""Equi-joins with null keys that match, suffix naming, and as-of joins (rows 69-79)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import numbers

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


#: Null-key rows of either side that meet in one cell of a right join.
_CELL = 4096


def _spread(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with a cell (__i, __j), and whether the left one has rows whose keys are all null.

    Those rows match each other, and a right join can neither broadcast a small left side nor split one key: one task
    would make all their pairs. Cells of _CELL by _CELL rows spread them: a left row is in one __i and in every __j, a
    right row in every __i and in one __j, so that each pair meets in one cell. Copies are a small part of the pairs made.
    """

    def void(on):
        return functools.reduce(operator.and_, [F.col(f"`{c}`").isNull() for c in on])

    def cut(df, on):
        """The last number of the cells of a side's null-key rows; -1 without any."""
        return df.filter(void(on)).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(_CELL))).cast("int") - 1).scalar()

    def numbered(df, on, mine, own, theirs, other):
        # By the row's values, which a rerun of a task does not change.
        plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.DatetimeType))]
        at = F.pmod(F.xxhash64(*plain), F.greatest(own, F.lit(0)) + 1).cast("int") if plain else F.lit(0)
        every = F.sequence(F.lit(0), F.greatest(other, F.lit(0)))
        return df.withColumn(mine, F.when(void(on), at).otherwise(F.lit(0))).withColumn(theirs, F.explode(F.when(void(on), every).otherwise(F.array(F.lit(0)))))

    nl, nr = cut(left, left_on), cut(right, right_on)
    return numbered(left, left_on, "__i", nl, "__j", nr), numbered(right, right_on, "__j", nr, "__i", nl), nl >= 0


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "inner", suffix: str = "_right", coalesce_keys: bool = False) -> DataFrame:
    """Null keys equal each other; the condition stays a hash or sort-merge key. A right key of the same name as its left
    one is dropped (so right-only rows of an outer join have a null key, unless coalesce_keys); other names that
    clash get the suffix: the right column's, in a right join the left's. A full join is a right join and, read once more,
    the left rows without a partner: its own merge marks every pair, which takes far longer where keys have many."""
    if how not in _HOW:
        raise ValueError(f"unknown join {how}")
    pairs = list(zip(left_on, right_on))
    lcols, rcols, apart = left.columns, right.columns, how in ("right", "outer", "full") and bool(pairs)
    full = apart and how != "right"
    l, r = left.alias("__l"), right.alias("__r")
    cond = functools.reduce(operator.and_, [F.col(f"__l.`{a}`").eqNullSafe(F.col(f"__r.`{b}`")) for a, b in pairs], F.lit(True)) if pairs else None
    if how == "cross":
        joined = l.crossJoin(r)
    else:
        if not pairs:
            raise ValueError("a join needs keys")
        alone = l.join(r, cond, "left_anti") if full else None
        if apart:
            spread, copies, lnull = _spread(left, right, left_on, right_on)
            l, r = spread.alias("__l"), copies.alias("__r")
            cond = cond & (F.col("__l.__i") == F.col("__r.__i")) & (F.col("__l.__j") == F.col("__r.__j"))
        joined = l.join(r, cond, "right" if apart else _HOW[how])
    if apart:
        # A copy without a partner in its cell is no row without a partner where the left side has null keys.
        void = functools.reduce(operator.and_, [F.col(f"__r.`{c}`").isNull() for c in right_on])
        joined = joined.filter(~(F.col("__l.__i").isNull() & void & lnull))
    if how in ("semi", "anti"):
        return joined
    same = {a for a, b in pairs if a == b}
    out, own = [], []
    for c in lcols:
        own.append(F.col(f"__l.`{c}`").alias(c))
        value = F.col(f"__l.`{c}`")
        if c in same:
            value = F.col(f"__r.`{c}`") if how == "right" else F.coalesce(value, F.col(f"__r.`{c}`")) if coalesce_keys else value
        clash = how == "right" and c in rcols and c not in same
        out.append(value.alias(c + suffix if clash else c))
    for c in rcols:
        if c in same:
            continue
        clash = how != "right" and c in lcols
        out.append(F.col(f"__r.`{c}`").alias(c + suffix if clash else c))
        own.append(F.lit(None).cast(right.schema[c].dataType).alias(c + suffix if clash else c))
    return joined.select(*out).union(alone.select(*own)) if full else joined.select(*out)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], strategy: str = "backward") -> DataFrame:
    """Each left row with the last right row at or before it (or first at or after), per `by`.

    One sort-merge: both sides in one frame, the right side's row carried along by a running last or first. The
    join's keys spread the work; without any, everything meets in one task.
    """
    extra = [c for c in right.columns if c != on and c not in by]
    payload = F.struct(*[F.col(f"`{c}`") for c in extra])
    a = left.select(*by, F.col(on).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__right"), F.lit(1).alias("__side"))
    b = right.select(*by, F.col(on).alias("__t"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), payload.alias("__right"), F.lit(0).alias("__side"))
    both = a.unionByName(b)
    if strategy == "backward":
        w = W.partitionBy(*by).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
        hit = F.last("__right", ignorenulls=True).over(w)
    elif strategy == "forward":
        w = W.partitionBy(*by).orderBy("__t", F.col("__side").desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
        hit = F.first("__right", ignorenulls=True).over(w)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    done = both.withColumn("__hit", hit).filter("__side = 1")
    clash = set(left.columns)
    return done.select("__left.*", *[F.col("__hit").getField(c).alias(f"{c}_right" if c in clash else c) for c in extra])


#: Length exponent of intervals without an end, and of those of length 0.
_ENDLESS, _POINT = 5000, -1100


def within(left: DataFrame, right: DataFrame, low: str, high: str, value: str) -> DataFrame:
    """Pairs of a left row (alias l) and a right row (alias r) with l.low <= r.value <= l.high; nulls and NaN join nothing.

    Intervals are cut to a grid of their own length rounded up to a power of two, so that each lies in two cells at most;
    a value is looked up in one cell per length that occurs. Both sides shuffle on the cell; no pair outside it is made.
    """
    a, z, v = (F.col(f"`{c}`").cast("double") for c in (low, high, value))
    span = z - a
    endless = (F.abs(a) == float("inf")) | (F.abs(z) == float("inf"))
    level = F.when(endless, _ENDLESS).when(span == 0, _POINT).otherwise(F.ceil(F.log2(span))).cast("int")
    held = left.filter((a <= z) & ~F.isnan(a) & ~F.isnan(z)).withColumn("__level", level)
    cell = lambda x, n: F.when(n == _ENDLESS, F.lit(0.0)).when(n == _POINT, x).otherwise(numbers.floor(x / F.pow(F.lit(2.0), n)))
    cells = F.array_distinct(F.array(cell(a, F.col("__level")), cell(z, F.col("__level"))))
    # At most one number per exponent of a double.
    levels = held.agg(F.collect_set("__level")).scalar()
    sought = right.filter(v.isNotNull() & ~F.isnan(v)).withColumn("__in", F.explode(levels))
    x = held.withColumn("__cell", F.explode(cells)).alias("l")
    y = sought.withColumn("__at", cell(v, F.col("__in"))).alias("r")
    same = (F.col("l.__level") == F.col("r.__in")) & (F.col("l.__cell") == F.col("r.__at"))
    fits = (F.col(f"r.`{value}`") >= F.col(f"l.`{low}`")) & (F.col(f"r.`{value}`") <= F.col(f"l.`{high}`"))
    return x.join(y, same & fits).drop("__level", "__cell", "__in", "__at")
