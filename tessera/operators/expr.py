"""Expressions: immutable nodes that lower to Spark Columns.

A node is a function of a Scope. The scope says which columns order the rows and, under `over`, which
partition a leaf belongs to: aggregates and order-dependent functions then lower to window
expressions, so arithmetic over them inside `over` works as well. Outside `over`, aggregates lower to
plain aggregates and order-dependent functions to windows over the whole frame.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import clock, nested, numbers, strings
from tessera.operators import windows as win
from tessera.plans import semantics as S


#: The column of frame-wide row numbers.
NUMBER = "__number"


@dataclass(frozen=True)
class Scope:
    """order: ordering Columns of the frame; schema: its types; partition: Columns under `over`, else None."""

    order: tuple[Column, ...]
    schema: T.StructType
    partition: tuple[Column, ...] | None = None
    #: Columns that a frame must add before it uses the lowered ones (windows do not nest).
    temps: dict[str, Column] = field(default_factory=dict)

    def position(self) -> Column:
        """The row's number from 1 in its partition, as a column to be added first; over the frame, the frame gives it."""
        if self.partition is not None:
            return self.added(F.row_number().over(self.window()))
        self.temps[NUMBER] = None
        return F.col(NUMBER)

    def added(self, c: Column) -> Column:
        """c as a column to be added first."""
        name = f"__pos{len(self.temps)}"
        self.temps[name] = c
        return F.col(name)

    def window(self, order: bool = True):
        w = W.partitionBy(*(self.partition or ()))
        return w.orderBy(*self.order) if order else w


def _type_of(e: Expr, scope: Scope) -> T.DataType:
    return e.kind(scope) if e.kind else T.NullType()


@dataclass(frozen=True)
class Expr:
    lower: Callable[[Scope], Column]
    name: str | None = None
    #: The type of the result where the rules need it.
    kind: Callable[[Scope], T.DataType] | None = None
    aggregate: bool = False
    descending: bool | None = None
    #: (offset, length) of a slice of rows.
    cut: tuple | None = None
    source: str | None = field(default=None, compare=False)
    #: For filters: (the `lower` that this is about, conjuncts, a form that readers can push down or None).
    logic: tuple | None = field(default=None, compare=False)

    def conditions(self, scope: Scope) -> list[Column]:
        """As a filter: conditions that all must hold. A null drops a row either way, so conjunctions come apart
        and comparisons of floats need no branches; both then reach the files."""
        if self.logic and self.logic[0] is self.lower:
            _, parts, plain = self.logic
            return [c for p in parts for c in p.conditions(scope)] if parts else plain(scope)
        return [self.lower(scope)]

    # -- building blocks -------------------------------------------------------------------------
    def _map(self, fn, kind=None, **more) -> Expr:
        return replace(self, lower=lambda s: fn(self.lower(s)), kind=kind, **more)

    def _same(self, fn) -> Expr:
        return self._map(fn, self.kind)

    def _pair(self, other, fn, kind=None) -> Expr:
        o = wrap(other)
        return replace(self, lower=lambda s: fn(self.lower(s), o.lower(s), s), kind=kind, aggregate=self.aggregate or o.aggregate)

    def alias(self, name: str) -> Expr:
        return replace(self, name=name)

    as_ = alias

    def column(self, scope: Scope) -> Column:
        c = self.lower(scope)
        return c.alias(self.name) if self.name else c

    # -- arithmetic (rows 235-242, 254) ----------------------------------------------------------
    def _number(self, o: Expr):
        def kind(s):
            a, b = _type_of(self, s), _type_of(o, s)
            return a if isinstance(a, T.DecimalType) else S.promote(a, b)

        return kind

    def _arith(self, other, fn) -> Expr:
        o = wrap(other)
        kind = self._number(o)

        def lower(a, b, s):
            t = kind(s)
            return fn(a, b) if isinstance(t, T.DecimalType) else fn(a.cast(t), b.cast(t))

        return self._pair(o, lower, kind)

    def __add__(self, o):
        return self._arith(o, lambda a, b: a + b)

    def __radd__(self, o):
        return wrap(o, "literal") + self

    def __sub__(self, o):
        return self._arith(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return wrap(o, "literal") - self

    def __mul__(self, o):
        return self._arith(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return wrap(o, "literal") * self

    def __truediv__(self, o):
        o = wrap(o)
        kind = self._number(o)
        return self._pair(o, lambda a, b, s: S.divide(a, b, S.is_integral(kind(s))), kind)

    def __rtruediv__(self, o):
        return wrap(o, "literal") / self

    def __mod__(self, o):
        return self._arith(o, S.modulo)

    def __floordiv__(self, o):
        return self._pair(o, lambda a, b, s: S.floor_divide(a, b), lambda s: T.LongType())

    def __pow__(self, o):
        return self._pair(o, lambda a, b, s: F.pow(a, b), lambda s: T.DoubleType())

    def __neg__(self):
        return self._same(lambda c: -c)

    # -- comparison and logic (rows 57-68) -------------------------------------------------------
    def _compare(self, o, op):
        o = wrap(o)

        def floating(s):
            return S.is_floating(_type_of(self, s)) or S.is_floating(_type_of(o, s))

        def plain(s):
            a, b = self.lower(s), o.lower(s)
            holds = S.compare(a, b, op)
            return [holds, *[~F.isnan(c) for c, e in ((a, self), (b, o)) if S.is_floating(_type_of(e, s))]]

        out = self._pair(o, lambda a, b, s: S.compare(a, b, op, floating(s)), lambda s: T.BooleanType())
        return replace(out, logic=(out.lower, (), plain))

    def eq(self, o):
        return self._pair(o, lambda a, b, s: S.eq(a, b), lambda s: T.BooleanType())

    def ne(self, o):
        return self._pair(o, lambda a, b, s: S.ne(a, b), lambda s: T.BooleanType())

    def __eq__(self, o):
        return self.eq(o)

    def __ne__(self, o):
        return self.ne(o)

    __hash__ = object.__hash__

    def __lt__(self, o):
        return self._compare(o, "<")

    def __le__(self, o):
        return self._compare(o, "<=")

    def __gt__(self, o):
        return self._compare(o, ">")

    def __ge__(self, o):
        return self._compare(o, ">=")

    lt, le, gt, ge = __lt__, __le__, __gt__, __ge__

    def __and__(self, o):
        o = wrap(o)
        out = self._pair(o, lambda a, b, s: S.strict_and(a, b), lambda s: T.BooleanType())
        return replace(out, logic=(out.lower, (self, o), None))

    def __or__(self, o):
        return self._pair(o, lambda a, b, s: S.strict_or(a, b), lambda s: T.BooleanType())

    def __xor__(self, o):
        return self._pair(o, lambda a, b, s: S.strict_xor(a, b), lambda s: T.BooleanType())

    def __invert__(self):
        return self._map(lambda c: ~c, lambda s: T.BooleanType())

    def is_null(self):
        return self._map(lambda c: c.isNull(), lambda s: T.BooleanType())

    def is_not_null(self):
        return self._map(lambda c: c.isNotNull(), lambda s: T.BooleanType())

    def is_nan(self):
        return replace(self, lower=lambda s: F.coalesce(F.isnan(self.lower(s)), F.lit(False)) if S.is_floating(_type_of(self, s)) else F.lit(False), kind=lambda s: T.BooleanType())

    def is_not_nan(self):
        return ~self.is_nan()

    def is_in(self, values):
        """Null matches only a listed null; never null (row 67)."""
        values = list(values)
        some = [v for v in values if v is not None]

        def fn(c):
            hit = F.coalesce(c.isin(some), F.lit(False)) if some else F.lit(False)
            return hit | c.isNull() if None in values else hit

        return self._map(fn, lambda s: T.BooleanType())

    def is_between(self, lower, upper, inclusive: bool = True):
        a, b = wrap(lower), wrap(upper)
        return self.ge(a) & self.le(b) if inclusive else self.gt(a) & self.lt(b)

    # -- conditionals, casts, fills (rows 255-259) -------------------------------------------------
    def cast(self, target: str):
        return replace(self, lower=lambda s: S.cast(self.lower(s), _type_of(self, s), target), kind=lambda s: T._parse_datatype_string({"str": "string"}.get(target, target)))

    def fill_null(self, value):
        return self._pair(value, lambda a, b, s: F.coalesce(a, b), self.kind)

    def sort(self, descending: bool = False):
        return replace(self, descending=descending)

    # -- aggregates (rows 80-92) -------------------------------------------------------------------
    def _agg(self, fn, kind) -> Expr:
        """fn(column, scope) -> aggregate Column, windowed under `over`."""

        def lower(s: Scope):
            a = fn(self.lower(replace(s, partition=None)), s)
            return a.over(s.window(order=False)) if s.partition is not None else a

        return replace(self, lower=lower, kind=kind, aggregate=True)

    def sum(self):
        def fn(c, s):
            t = _type_of(self, s)
            return F.sum(c.cast("int") if isinstance(t, T.BooleanType) else c)

        return self._agg(fn, lambda s: T.DoubleType() if S.is_floating(_type_of(self, s)) else T.LongType())

    def mean(self):
        return self._agg(lambda c, s: F.avg(c), lambda s: T.DoubleType())

    def median(self):
        return self._agg(lambda c, s: F.percentile(c, 0.5), lambda s: T.DoubleType())

    def quantile(self, q: float, interpolation: str = "linear"):
        return self._agg(lambda c, s: win.quantile(c, q, interpolation), lambda s: T.DoubleType())

    def min(self):
        return self._agg(lambda c, s: F.min(S.skip_nan(c, S.is_floating(_type_of(self, s)))), self.kind)

    def max(self):
        return self._agg(lambda c, s: F.max(S.skip_nan(c, S.is_floating(_type_of(self, s)))), self.kind)

    def var(self, ddof: int = 1):
        def lower(s: Scope):
            c = self.lower(replace(s, partition=None))
            return win.variance(c, ddof, s.window(order=False) if s.partition is not None else None)

        return replace(self, lower=lower, kind=lambda s: T.DoubleType(), aggregate=True)

    def std(self, ddof: int = 1):
        return self.var(ddof)._map(F.sqrt, lambda s: T.DoubleType())

    def count(self):
        return self._agg(lambda c, s: F.count(c), lambda s: T.LongType())

    def product(self):
        return self._agg(lambda c, s: F.product(c) if S.is_floating(_type_of(self, s)) else F.product(c).cast("long"), self.kind)

    def first(self):
        return self._ends(F.min_by, F.first, False)

    def last(self):
        return self._ends(F.max_by, F.last, True)

    def _ends(self, by, over, last):
        def lower(s: Scope):
            c = self.lower(replace(s, partition=None))
            if s.partition is not None:
                return over(c).over(s.window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            return by(c, F.struct(*s.order))

        return replace(self, lower=lower, aggregate=True)

    def n_unique(self):
        """Null is a value (row 89)."""

        def lower(s: Scope):
            c = self.lower(replace(s, partition=None))
            null = F.max(c.isNull().cast("int"))
            if s.partition is not None:
                w = s.window(order=False)
                return (F.size(F.collect_set(c).over(w)) + null.over(w)).cast("long")
            return F.coalesce(F.count_distinct(c) + null, F.lit(0)).cast("long")

        return replace(self, lower=lower, kind=lambda s: T.LongType(), aggregate=True)

    def arg_min(self):
        return self._arg(False)

    def arg_max(self):
        return self._arg(True)

    def _arg(self, greatest: bool):
        """The number, from 0 in the frame's order, of the first row with the extreme value; nulls and NaN have none (row 92)."""

        def lower(s: Scope):
            plain = replace(s, partition=None)
            c = S.skip_nan(self.lower(plain), S.is_floating(_type_of(self, s)))
            at = plain.position().cast("long") - 1
            key = F.when(c.isNotNull(), F.struct(c.alias("v"), (-at if greatest else at).alias("i")))
            return (F.max_by if greatest else F.min_by)(at, key)

        return replace(self, lower=lower, kind=lambda s: T.LongType(), aggregate=True)

    def arg_sort(self, descending: bool = False):
        """Per row i: the number, from 0, of the row that a sort puts in place i; nulls last, ties in order (row 157)."""

        def lower(s: Scope):
            c = self.lower(replace(s, partition=None))
            at = s.position().cast("long") - 1
            key = S.sort_key(c, descending)
            place = s.added(F.row_number().over(W.partitionBy(*(s.partition or ())).orderBy(key, *s.order)))
            w = W.partitionBy(*(s.partition or ()))
            # Numbers in the order of their places, each row taking the one of its own number.
            return F.get(F.array_sort(F.collect_list(F.struct(place.alias("p"), at.alias("i"))).over(w)), at.cast("int"))["i"]

        return replace(self, lower=lower, kind=lambda s: T.LongType())

    def slice(self, offset: int, length: int | None = None):
        """The values of a slice of the frame's rows, from the end for a negative offset; bounds are clipped (row 162).
        A selection's expressions must have the same slice."""
        return replace(self, cut=(offset, length))

    def whole(self):
        """Without its slice."""
        return replace(self, cut=None)

    def all(self):
        return self._agg(lambda c, s: F.coalesce(F.bool_and(c), F.lit(True)), lambda s: T.BooleanType())

    def any(self):
        return self._agg(lambda c, s: F.coalesce(F.bool_or(c), F.lit(False)), lambda s: T.BooleanType())

    # -- order-dependent functions (rows 114-153) ----------------------------------------------------
    def over(self, *by) -> Expr:
        """By partition; with no columns, over the whole frame."""
        keys = [wrap(b, None) if isinstance(b, Expr) else col(b) for b in by]
        return replace(self, lower=lambda s: self.lower(replace(s, partition=tuple(k.lower(s) for k in keys))), aggregate=False)

    def _ordered(self, fn, kind=None) -> Expr:
        """fn(column, window) with the scope's partition and order."""
        return replace(self, lower=lambda s: fn(self.lower(replace(s, partition=None)), s.window()), kind=kind or (lambda s: T.DoubleType()))

    def rank(self, method: str = "average", descending: bool = False):
        return replace(self, lower=lambda s: win.rank(self.lower(replace(s, partition=None)), s.partition or (), s.order, method, descending), kind=lambda s: T.DoubleType())

    def dense_rank(self, descending: bool = False):
        return self.rank("dense", descending)

    def ordinal_rank(self, descending: bool = False):
        return self.rank("first", descending)

    def percent_rank(self):
        return replace(self, lower=lambda s: win.percent_rank(self.lower(replace(s, partition=None)), s.partition or ()), kind=lambda s: T.DoubleType())

    def shift(self, n: int = 1, default=None):
        return self._ordered(lambda c, w: win.shift(c, w, n, default), self.kind)

    def lag(self, n: int = 1, default=None):
        return self.shift(n, default)

    def lead(self, n: int = 1, default=None):
        return self.shift(-n, default)

    def first_value(self):
        return self._ordered(lambda c, w: F.first(c, ignorenulls=True).over(win.whole(w)), self.kind)

    def last_value(self):
        return self._ordered(lambda c, w: F.last(c, ignorenulls=True).over(win.whole(w)), self.kind)

    def nth_value(self, n: int):
        if n < 1:
            raise ValueError("n counts from 1")
        return self._ordered(lambda c, w: F.nth_value(c, n, ignoreNulls=True).over(win.whole(w)), self.kind)

    def cum_count(self):
        return self._ordered(lambda c, w: F.count(c).over(win.running(w)), lambda s: T.LongType())

    def cum_sum(self):
        return self._ordered(lambda c, w: F.when(c.isNotNull(), F.sum(c.cast("double")).over(win.running(w))))

    def cum_prod(self):
        return self._ordered(lambda c, w: F.when(c.isNotNull(), F.product(c).over(win.running(w))))

    def cum_min(self):
        return self._ordered(lambda c, w: win.cum_extreme(c, w, F.min))

    def cum_max(self):
        return self._ordered(lambda c, w: win.cum_extreme(c, w, F.max))

    def diff(self, n: int = 1):
        if n < 1:
            raise ValueError("n counts from 1")
        return self._ordered(lambda c, w: c.cast("double") - F.lag(c, n).over(w).cast("double"))

    def pct_change(self, n: int = 1):
        return self._ordered(lambda c, w: win.pct_change(c, w, n))

    def fill_forward(self):
        return self._ordered(lambda c, w: F.last(c, ignorenulls=True).over(win.running(w)).cast("double"))

    def fill_backward(self):
        return self._ordered(lambda c, w: F.first(c, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)).cast("double"))

    def interpolate(self):
        return replace(self, lower=lambda s: win.interpolate(self.lower(replace(s, partition=None)), s.window(), s.position()), kind=lambda s: T.DoubleType())

    def _rolling(self, agg, window, min_periods, center, clean=False):
        return replace(self, lower=lambda s: win.rolling(S.skip_nan(self.lower(replace(s, partition=None)), clean and S.is_floating(_type_of(self, s))), s.window(), agg, window, min_periods, center), kind=lambda s: T.DoubleType())

    def rolling_sum(self, window, min_periods=1, center=False):
        return self._rolling(lambda c: F.sum(c.cast("double")), window, min_periods, center)

    def rolling_mean(self, window, min_periods=1, center=False):
        return self._rolling(F.avg, window, min_periods, center)

    def rolling_min(self, window, min_periods=1, center=False):
        return self._rolling(lambda c: F.min(c.cast("double")), window, min_periods, center, True)

    def rolling_max(self, window, min_periods=1, center=False):
        return self._rolling(lambda c: F.max(c.cast("double")), window, min_periods, center, True)

    def rolling_var(self, window, min_periods=1, ddof=1, center=False):
        return replace(self, lower=lambda s: win.rolling_variance(self.lower(replace(s, partition=None)), s.window(), window, min_periods, ddof, center), kind=lambda s: T.DoubleType())

    def rolling_std(self, window, min_periods=1, ddof=1, center=False):
        return self.rolling_var(window, min_periods, ddof, center)._map(F.sqrt, lambda s: T.DoubleType())

    def rolling_median(self, window, min_periods=1, center=False):
        return self.rolling_quantile(0.5, window, min_periods, "linear", center)

    def rolling_quantile(self, q, window, min_periods=1, interpolation="linear", center=False):
        return self._rolling(lambda c: win.Frame(lambda w: win.frame_quantile(c, w, q, interpolation)), window, min_periods, center)

    def rolling_apply(self, fn, window, min_periods=1, center=False):
        """fn: list of the window's non-null values -> number or None, batched through pandas (row 142)."""
        return self._rolling(lambda c: win.Frame(lambda w: win.apply_udf(fn)(F.collect_list(c.cast("double")).over(w))), window, min_periods, center)

    def expanding_sum(self, min_periods=1):
        return self.rolling_sum(None, min_periods)

    def expanding_mean(self, min_periods=1):
        return self.rolling_mean(None, min_periods)

    def expanding_min(self, min_periods=1):
        return self.rolling_min(None, min_periods)

    def expanding_max(self, min_periods=1):
        return self.rolling_max(None, min_periods)

    def expanding_std(self, min_periods=1, ddof=1):
        return self.rolling_std(None, min_periods, ddof)

    def _ewm(self, fn) -> Expr:
        """fn(history, add), add making a column that the frame adds first."""

        def lower(s: Scope):
            return fn(win.History(self.lower(replace(s, partition=None)), s.partition or (), s.order), s.added)

        return replace(self, lower=lower, kind=lambda s: T.DoubleType())

    def ewm_mean(self, alpha=None, adjust=True, ignore_nulls=True, min_periods=1, span=None, halflife=None, com=None):
        a = win.alpha_of(alpha, span, halflife, com)
        return self._ewm(lambda h, add: win.ewm_mean(h, add, a, adjust, ignore_nulls, min_periods))

    def ewm_sum(self, alpha=None, ignore_nulls=True, min_periods=1, span=None, halflife=None, com=None):
        a = win.alpha_of(alpha, span, halflife, com)
        return self._ewm(lambda h, add: win.ewm_sum(h, a, ignore_nulls, min_periods))

    def ewm_var(self, alpha=None, adjust=True, ignore_nulls=True, min_periods=2, bias=False, span=None, halflife=None, com=None):
        a = win.alpha_of(alpha, span, halflife, com)
        return self._ewm(lambda h, add: win.ewm_var(h, add, a, adjust, ignore_nulls, min_periods, bias))

    def ewm_std(self, alpha=None, adjust=True, ignore_nulls=True, min_periods=2, bias=False, span=None, halflife=None, com=None):
        return self.ewm_var(alpha, adjust, ignore_nulls, min_periods, bias, span, halflife, com)._map(lambda c: F.when(c > 0, F.sqrt(c)).when(c.isNotNull(), F.lit(0.0)), lambda s: T.DoubleType())

    # -- math ----------------------------------------------------------------------------------------
    def abs(self):
        return self._same(F.abs)

    def math(self, name: str, *args):
        """Any function of tessera.functions.numbers by name, or a trigonometric one."""
        fn = getattr(numbers, name + "_", None) or getattr(numbers, name, None)
        return self._map((lambda c: fn(c, *args)) if fn else (lambda c: numbers.trig(c, name)), lambda s: T.IntegerType() if name == "sign" else T.DoubleType())

    # -- namespaces ------------------------------------------------------------------------------------
    @property
    def str(self):
        return _Namespace(self, strings)

    @property
    def dt(self):
        return _Namespace(self, clock)

    @property
    def list(self):
        return _Namespace(self, nested)

    @property
    def struct(self):
        return _Namespace(self, nested)


class _Namespace:
    """expr.str.lower() and the like: every function of a module whose first argument is the column."""

    def __init__(self, expr: Expr, module):
        self._expr, self._module = expr, module

    def __getattr__(self, name):
        fn = getattr(self._module, name, None) or getattr(self._module, name + "_", None)
        if fn is None or name.startswith("_"):
            raise AttributeError(name)
        return lambda *a, **k: self._expr._map(lambda c: fn(c, *a, **k))


def col(name: str) -> Expr:
    """A column; missing names fail when the frame analyses the plan (row 49)."""
    return Expr(lambda s: F.col(f"`{name}`"), name, lambda s: s.schema[name].dataType if name in s.schema.names else T.NullType(), source=name)


def cols(*names: str) -> list[Expr]:
    return [col(n) for n in names]


def all_() -> Expr:
    return Expr(lambda s: F.col("*"))


def lit(value) -> Expr:
    """A constant (row 34); unnamed ones are called `literal`."""
    t = {bool: T.BooleanType(), int: T.LongType() if isinstance(value, int) and abs(value) > 2**31 - 1 else T.IntegerType(), float: T.DoubleType(), str: T.StringType(), datetime.datetime: T.TimestampNTZType(), datetime.date: T.DateType()}.get(type(value), T.StringType())
    return Expr(lambda s: F.lit(value).cast(t), "literal", lambda s: t)


def wrap(value, name: str | None = "") -> Expr:
    if isinstance(value, Expr):
        return value
    return lit(value) if name == "" else replace(lit(value), name=name)


class When:
    def __init__(self, branches, condition):
        self._branches, self._condition = branches, condition

    def then(self, value) -> Then:
        return Then([*self._branches, (self._condition, wrap(value))])


class Then(Expr):
    """when(...).then(...): an expression with null elsewhere, that can go on (row 255)."""

    def __init__(self, branches):
        self._set(branches, None)

    def _set(self, branches, other):
        def lower(s):
            c = None
            for cond, value in branches:
                k = F.coalesce(cond.lower(s), F.lit(False))
                c = F.when(k, value.lower(s)) if c is None else c.when(k, value.lower(s))
            return c if other is None else c.otherwise(other.lower(s))

        first = branches[0][1]
        for k, v in {"lower": lower, "name": first.name, "kind": first.kind, "aggregate": any(v.aggregate for _, v in branches), "descending": None, "source": None, "logic": None, "_branches": branches}.items():
            object.__setattr__(self, k, v)

    def when(self, condition: Expr) -> When:
        return When(self._branches, condition)

    def otherwise(self, value) -> Expr:
        out = Then(self._branches)
        out._set(self._branches, wrap(value))
        return Expr(out.lower, out.name, out.kind, out.aggregate or wrap(value).aggregate)

    def alias(self, name):
        return Expr(self.lower, name, self.kind, self.aggregate)


def when(condition: Expr) -> When:
    return When([], condition)


def count() -> Expr:
    """Rows (rows 96, 292)."""

    def lower(s: Scope):
        n = F.count(F.lit(1))
        return n.over(s.window(order=False)) if s.partition is not None else n

    return Expr(lower, "count", lambda s: T.LongType(), aggregate=True)


def row_number() -> Expr:
    """From 0 over the frame, from 1 under `over` (row 41)."""

    def lower(s: Scope):
        return F.row_number().over(s.window()).cast("long") if s.partition is not None else (s.position() - 1).cast("int")

    return Expr(lower, "row_number", lambda s: T.LongType())


def arange(start: int, end: int, step: int = 1) -> Expr:
    """start, start + step, ... by row; null beyond end (row 36)."""
    n = max(0, math.ceil((end - start) / step))
    return Expr(lambda s: F.when(s.position() <= n, (start + (s.position() - 1) * step).cast("int")), "arange", lambda s: T.IntegerType())


def _many(exprs):
    return [e if isinstance(e, Expr) else col(e) for e in exprs]


def _row_wise(name, fn, exprs) -> Expr:
    es = _many(exprs)
    return Expr(lambda s: fn(*[e.lower(s) for e in es]), es[0].name or name, lambda s: T.DoubleType())


def sum_horizontal(*exprs) -> Expr:
    es = _many(exprs)

    def lower(s):
        return numbers.sum_horizontal(*[e.lower(s) for e in es], floating=not all(S.is_integral(_type_of(e, s)) for e in es))

    return Expr(lower, es[0].name, lambda s: T.DoubleType())


def mean_horizontal(*exprs) -> Expr:
    return _row_wise("mean", numbers.mean_horizontal, exprs)


def min_horizontal(*exprs) -> Expr:
    return _row_wise("min", numbers.min_horizontal, exprs)


def max_horizontal(*exprs) -> Expr:
    return _row_wise("max", numbers.max_horizontal, exprs)


def concat(*exprs) -> Expr:
    return _row_wise("concat", strings.concat, exprs)


def concat_str(separator: str, *exprs) -> Expr:
    return _row_wise("concat", lambda *cs: strings.concat_ws(separator, *cs), exprs)


def struct(**fields) -> Expr:
    es = {k: wrap(v) for k, v in fields.items()}
    return Expr(lambda s: F.struct(*[e.lower(s).alias(k) for k, e in es.items()]), "struct")
