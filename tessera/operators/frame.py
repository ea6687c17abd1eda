"""Frames: ordered tables over Spark DataFrames.

Rows are ordered by `order`, named columns that order them uniquely; without any, by a hidden number
given when the frame is made. Order matters only to operators that say so; everything else stays a plain
Spark plan. All methods are lazy unless they say that they run a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import joins
from tessera.operators.expr import NUMBER, Expr, Scope, col, wrap
from tessera.operators.numbering import numbered
from tessera.plans import semantics as S

_ROW = "__row"

#: Names of the dictionary form of agg (row 95).
AGGREGATES = ("count", "sum", "mean", "median", "min", "max", "std", "var", "first", "last", "nunique")


class Frame:
    #: Whether `df` comes in the frame's order: after a sort.
    _in_order = False

    def __init__(self, df: DataFrame, order: list[str] | str | None = None):
        if len(set(df.columns)) != len(df.columns):
            raise ValueError("column names must differ")
        if order is None and _ROW not in df.columns:
            df = df.withColumn(_ROW, F.monotonically_increasing_id())
        self._df = df
        self._order = [order] if isinstance(order, str) else list(order or [_ROW])

    # -- making and leaving (rows 28-41, 300-311) -------------------------------------------------
    @classmethod
    def from_dict(cls, spark: SparkSession, data: dict[str, list], schema: T.StructType | str | None = None) -> Frame:
        sizes = {len(v) for v in data.values()}
        if len(sizes) > 1:
            raise ValueError("columns must be of one length")
        rows = [(i, *r) for i, r in enumerate(zip(*data.values()))]
        names = list(data)
        if schema is None:
            kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
            fields = []
            for n, v in data.items():
                known = [x for x in v if x is not None]
                kind = type(known[0]) if known else str
                kind = float if kind is int and any(isinstance(x, float) for x in known) else kind
                fields.append(T.StructField(n, kinds.get(kind) or T._infer_type(known[0])))
            rows = [(i, *[float(x) if isinstance(f.dataType, T.DoubleType) and x is not None else x for f, x in zip(fields, r)]) for i, *r in rows]
        else:
            fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
            if [f.name for f in fields] != names:
                raise ValueError("schema and columns must agree")
        return cls(spark.createDataFrame(rows, T.StructType([T.StructField(_ROW, T.LongType()), *fields])))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table) -> Frame:
        """A pyarrow table or record batch (row 307)."""
        import pyarrow as pa

        return cls(spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table))

    @classmethod
    def series(cls, spark: SparkSession, name: str, values: list, kind: str | None = None) -> Frame:
        """One column; lists make a list column (rows 31-32). kind: its type as SQL, else that of the values."""
        return cls.from_dict(spark, {name: values}, f"`{name}` {kind}" if kind else None)

    @classmethod
    def from_series(cls, *columns: Frame) -> Frame:
        """Frames of one column side by side (row 28): lengths must agree, names differ."""
        out = columns[0]
        if len({f.shape()[0] for f in columns}) > 1:
            raise ValueError("columns must be of one length")
        for c in columns[1:]:
            out = out.hconcat(c)
        return out

    @classmethod
    def empty(cls, spark: SparkSession, schema: str) -> Frame:
        return cls(spark.createDataFrame([], schema))

    @classmethod
    def date_range(cls, spark, name: str, start, end, days: int = 1) -> Frame:
        """Half open (row 38)."""
        d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(F.lit(days)))).alias(name))
        return cls(d.filter(F.col(name) < F.lit(end).cast("date")), name)

    @classmethod
    def datetime_range(cls, spark, name: str, start, end, **step) -> Frame:
        interval = F.make_dt_interval(*[F.lit(step.get(k, 0)) for k in ("days", "hours", "minutes")], F.lit(step.get("seconds", 0)).cast("decimal(18,6)"))
        d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), interval)).alias(name))
        return cls(d.filter(F.col(name) < F.lit(end).cast("timestamp_ntz")), name)

    @classmethod
    def int_range(cls, spark, name: str, start: int, end: int, step: int = 1) -> Frame:
        return cls(spark.range(start, end, step).toDF(name), name)

    @classmethod
    def repeat(cls, spark, name: str, value, n: int) -> Frame:
        return cls(spark.range(n).select(F.lit(value).alias(name)))

    @property
    def df(self) -> DataFrame:
        """The Spark DataFrame, without the hidden order; after a sort its rows are in order."""
        return (self._df.orderBy(*self._sorted()) if self._in_order else self._df).drop(_ROW)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def dtypes(self):
        return self.df.dtypes

    def shape(self) -> tuple[int, int]:
        """Runs a job."""
        return self._df.count(), len(self.columns)

    def collect(self) -> list:
        """Rows in order; runs a job."""
        return self._df.orderBy(*self._sorted()).drop(_ROW).collect()

    def fetch(self, n: int = 500) -> list:
        return self.head(n).collect()

    def to_dict(self) -> dict[str, list]:
        rows = self.collect()
        return {c: [r[i] for r in rows] for i, c in enumerate(self.columns)}

    def to_pandas(self):
        return self._df.orderBy(*self._sorted()).drop(_ROW).toPandas()

    def to_arrow(self):
        return self._df.orderBy(*self._sorted()).drop(_ROW).toArrow()

    def batches(self, rows: int = 100_000):
        """Lists of rows, a partition at a time on the driver (rows 6, 17)."""
        batch = []
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            batch.append(r)
            if len(batch) == rows:
                yield batch
                batch = []
        if batch:
            yield batch

    def value(self, i: int, column: str):
        return self.slice(i, 1).select(column).collect()[0][0]

    def explain(self, mode: str = "formatted") -> str:
        return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)

    def show(self, n: int = 10):
        self._df.orderBy(*self._sorted()).drop(_ROW).show(n, truncate=30)

    def cache(self) -> Frame:
        return self._with(self._df.cache())

    def lazy(self) -> Frame:
        return self

    # -- plumbing -----------------------------------------------------------------------------------
    def _with(self, df: DataFrame, order: list[str] | None = None) -> Frame:
        out = Frame.__new__(Frame)
        out._df, out._order = df, order or self._order
        out._in_order = self._in_order and out._order == self._order
        return out

    def _fresh(self, df: DataFrame, *keys) -> Frame:
        """A frame in a new order: that of the keys, or none in particular."""
        return Frame(df.drop(_ROW), list(keys) or None)

    def _sorted(self, descending: bool = False) -> list[Column]:
        return [S.sort_key(F.col(f"`{c}`"), descending) for c in self._order]

    def _carried(self) -> list[str]:
        """Hidden columns besides the number."""
        return [c for c in self._df.columns if c != _ROW and c not in self.columns]

    def _keys(self) -> list[tuple[Column, bool, bool]]:
        """The order as (column, descending, nulls last)."""
        return [(F.col(f"`{c}`"), False, True) for c in self._order]

    def _number(self, name: str, start: int = 0) -> DataFrame:
        """The rows with consecutive numbers in the frame's order."""
        return numbered(self._df, self._keys(), name, start)

    def _scope(self) -> Scope:
        return Scope(tuple(F.col(f"`{c}`") for c in self._order), self._df.schema)

    def _lower(self, exprs) -> tuple[DataFrame, list[Column], list[str]]:
        scope = self._scope()
        flat = [x for e in exprs for x in (e if isinstance(e, (list, tuple)) else [e])]
        exprs = [e if isinstance(e, Expr) else col(e) for e in flat]
        cols = [e.column(scope) for e in exprs]
        return self._prepared(scope), cols, list(scope.temps)

    def _prepared(self, scope: Scope) -> DataFrame:
        """The rows with the columns that lowered expressions need first."""
        df = self._number(NUMBER, 1) if NUMBER in scope.temps else self._df
        more = {n: c for n, c in scope.temps.items() if c is not None}
        return df.withColumns(more) if more else df

    def _hidden(self, names) -> list[str]:
        return [c for c in self._order if c not in names]

    # -- projection (rows 42-54) --------------------------------------------------------------------
    def select(self, *exprs) -> Frame:
        flat = [x for e in exprs for x in (e if isinstance(e, (list, tuple)) else [e])]
        parsed = [e if isinstance(e, Expr) else col(e) for e in flat]
        if any(e.cut for e in parsed):
            if len({e.cut for e in parsed}) > 1:
                raise ValueError("the expressions differ in length")
            return self._cut(*parsed[0].cut).select(*[e.whole() for e in parsed])
        if parsed and all(e.aggregate for e in parsed):
            return self.agg(*parsed)
        df, cols, _ = self._lower(parsed)
        names = df.select(*cols).columns
        if any(c not in names for c in self._order):
            # The order must outlive the projection: as the hidden number.
            if self._order == [_ROW]:
                return self._with(df.select(*cols, F.col(_ROW)))
            kept = [F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(self._order)]
            return _Projected(df.select(*cols, *kept), [f"__o{i}" for i in range(len(kept))])
        return self._with(df.select(*cols, *([F.col(_ROW)] if self._order == [_ROW] and _ROW not in names else [])))

    def __getitem__(self, names):
        return self.select(*([names] if isinstance(names, str) else names))

    def select_if(self, predicate) -> Frame:
        """Columns whose field (a StructField) the predicate holds for (row 44)."""
        return self.select(*[f.name for f in self.schema.fields if predicate(f)])

    def with_columns(self, *exprs, **named) -> Frame:
        """All expressions read the frame as it was (row 45)."""
        exprs = [*exprs, *[wrap(e).alias(n) for n, e in named.items()]]
        scope = self._scope()
        new = {e.name: e.lower(scope) for e in exprs}
        out = self._prepared(scope).withColumns(new).drop(*scope.temps)
        return self._with(out)

    def with_column(self, name: str, value) -> Frame:
        """An expression, or a list of one value per row (row 46; runs a count). Functions of pandas batches go to `map_pandas`."""
        if not isinstance(value, list):
            return self.with_columns(wrap(value).alias(name))
        out = self._beside(value, "__v").drop("__i")
        return self._with(out.withColumn(name, F.col("__v")).drop("__v"))

    def _beside(self, values: list, name: str) -> DataFrame:
        """The rows with a list's values by number (__i) as `name`."""
        if self._df.count() != len(values):
            raise ValueError("there must be one value per row")
        side = Frame.from_dict(self._df.sparkSession, {name: values})._df.withColumnRenamed(_ROW, "__i")
        return self._number("__i").join(side, "__i")

    def map_pandas(self, fn, schema: str) -> DataFrame:
        """A function from an iterator of pandas frames to another (row 296)."""
        return self.df.mapInPandas(fn, schema)

    def with_row_number(self, name: str = "row_nr", kind: str = "int") -> Frame:
        """Numbers from 0 (row 40), given by ranges of the order in parallel; `bigint` for tables of over 2**31 rows."""
        return self._with(self._number(name).withColumn(name, F.col(f"`{name}`").cast(kind)))

    def drop(self, *names: str) -> Frame:
        return self.select(*[c for c in self.columns if c not in names])

    def rename(self, names: dict[str, str]) -> Frame:
        known = {k: v for k, v in names.items() if k in self._df.columns}
        return self._with(self._df.withColumnsRenamed(known), [known.get(c, c) for c in self._order])

    # -- rows (rows 55-56, 154-169) -------------------------------------------------------------------
    def filter(self, predicate: Expr) -> Frame:
        """Rows for which it holds; null drops the row. A list of booleans, one per row, is a mask (row 56; runs a count)."""
        if isinstance(predicate, list):
            return self._with(self._beside(predicate, "__v").filter("__v").drop("__v", "__i"))
        scope = self._scope()
        conditions = predicate.conditions(scope)
        df = self._prepared(scope)
        for c in conditions:
            df = df.filter(c)
        return self._with(df.drop(*scope.temps) if scope.temps else df)

    def sort(self, *keys, descending: bool | list[bool] = False, nulls_last: bool = True) -> Frame:
        """By columns or expressions, ties in the order before; that is the order from then on."""
        scope = self._scope()
        exprs = [k if isinstance(k, Expr) else col(k) for k in keys]
        down = descending if isinstance(descending, list) else [descending] * len(exprs)
        by = [(e.lower(scope), d if e.descending is None else e.descending, nulls_last) for e, d in zip(exprs, down)]
        return _Sorted(self._prepared(scope), [*by, *self._keys()], [*self._carried(), *scope.temps])

    def head(self, n: int = 5) -> Frame:
        return self._with(self._df.orderBy(*self._sorted()).limit(max(n, 0)))

    limit = head

    def tail(self, n: int = 5) -> Frame:
        return self._with(self._df.orderBy(*self._sorted(True)).limit(max(n, 0)))

    def slice(self, offset: int, length: int) -> Frame:
        return self._with(self._df.orderBy(*self._sorted()).offset(offset).limit(length))

    def _cut(self, offset: int, length: int | None) -> Frame:
        """A slice with clipped bounds, from the end for a negative offset."""
        out = self.tail(-offset) if offset < 0 else self._with(self._df.orderBy(*self._sorted()).offset(offset)) if offset else self
        return out if length is None else out.head(length)

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int = 0) -> Frame:
        """Exactly n rows, or the floor of a share of them (runs a count), without replacement (row 164)."""
        if n is None:
            n = int(self._df.count() * fraction)
        return self._with(self._df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in self._order])).limit(n))

    def take(self, indices: list[int]) -> Frame:
        """Rows by number, repeats allowed (row 165)."""
        spark = self._df.sparkSession
        want = spark.createDataFrame(list(enumerate(indices)), "__at long, __n long")
        out = self._number("__n").drop(_ROW).join(F.broadcast(want), "__n").drop("__n").withColumnRenamed("__at", _ROW)
        return self._with(out, [_ROW])

    def unique(self, *columns: str) -> Frame:
        """The first row of each combination of the columns, of all without any (row 166)."""
        keys = list(columns) or self.columns
        n = F.row_number().over(W.partitionBy(*keys).orderBy(*self._sorted()))
        return self._with(self._df.withColumn("__n", n).filter("__n = 1").drop("__n"))

    def reverse(self) -> Frame:
        return _Sorted(self._df, [(c, not d, n) for c, d, n in self._keys()], self._carried())

    def drop_nulls(self, *columns: str) -> Frame:
        return self._with(self._df.na.drop(subset=list(columns) or self.columns))

    # -- grouping (rows 93-112) -----------------------------------------------------------------------
    def group_by(self, *keys) -> Grouped:
        return Grouped(self, [k if isinstance(k, Expr) else col(k) for k in keys])

    def agg(self, *exprs: Expr) -> Frame:
        """One row of aggregates over all rows."""
        df, cols, _ = self._lower(exprs)
        return self._fresh(df.agg(*cols))

    def value_counts(self, column: str) -> Frame:
        """(column, count), most frequent first, then as they first came (row 109)."""
        rank = F.min(F.struct(*[F.col(f"`{c}`") for c in self._order])).alias("__first")
        g = self._df.groupBy(column).agg(F.count(F.lit(1)).cast("int").alias("count"), rank)
        return _Sorted(g, [(F.col("count"), True, True), (F.col("__first"), False, True)], drop=["__first"])

    def describe(self) -> DataFrame:
        """(statistic, one column per numeric column): count mean std min 25% 50% 75% max (row 110)."""
        names = S.numeric_columns(self.schema)
        floats = {f.name: S.is_floating(f.dataType) for f in self.schema.fields}
        parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        quarters = {"25%": 0.25, "50%": 0.5, "75%": 0.75}

        def ranks(name):
            """The values at a quarter, a half and three quarters of the sorted column, as one list: by their numbers, not by gathering it."""
            v = self._df.select(F.col(f"`{name}`").cast("double").alias("v")).filter("v is not null")
            n = v.agg(F.count(F.lit(1))).scalar()
            at = numbered(v, [(F.col("v"), False, True)], "r")
            return at.agg(F.array(*[F.max(F.when(F.col("r") == F.floor(n * F.lit(q)), F.col("v"))) for q in quarters.values()])).scalar()

        every = F.struct(*[fn(S.skip_nan(F.col(f"`{n}`"), floats[n] and k in ("min", "max")).cast("double")).cast("double").alias(f"{k}|{n}") for k, fn in parts.items() for n in names])
        one = self._df.agg(every.alias("p")).select("p.*", *[ranks(n).alias(f"q|{n}") for n in names])
        at = {q: i for i, q in enumerate(quarters)}
        value = lambda k, n: F.get(F.col(f"`q|{n}`"), F.lit(at[k])) if k in at else F.col(f"`{k}|{n}`")
        rows = [F.struct(F.lit(k).alias("statistic"), F.struct(*[value(k, n).alias(n) for n in names]).alias("v")) for k in ("count", "mean", "std", "min", *quarters, "max")]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.statistic", "r.v.*")

    def null_count(self) -> DataFrame:
        """(column, null_count) (row 111)."""
        return self._long("null_count", lambda c: F.count_if(c.isNull()).cast("int"))

    def n_unique(self) -> DataFrame:
        """(column, n_unique); null is a value (row 112)."""
        return self._long("n_unique", lambda c: (F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("int"))

    def _long(self, name, fn) -> DataFrame:
        one = self._df.agg(*[fn(F.col(f"`{c}`")).alias(c) for c in self.columns])
        return one.unpivot([], self.columns, "column", name)

    # -- joins (rows 69-79, 170-174) --------------------------------------------------------------------
    def join(self, other: Frame, on=None, left_on=None, right_on=None, how: str = "inner", suffix: str = "_right", coalesce_keys: bool = False) -> Frame:
        left = [on] if isinstance(on, str) else on or ([left_on] if isinstance(left_on, str) else left_on)
        right = [on] if isinstance(on, str) else on or ([right_on] if isinstance(right_on, str) else right_on)
        return self._fresh(joins.join(self.df, other.df, left, right, how, suffix, coalesce_keys))

    def cross_join(self, other: Frame, suffix: str = "_right") -> Frame:
        return self._fresh(joins.join(self.df, other.df, [], [], "cross", suffix))

    def join_asof(self, other: Frame, on: str, by: list[str] | None = None, strategy: str = "backward") -> Frame:
        return self._fresh(joins.asof(self.df, other.df, on, by or [], strategy))

    def join_where(self, other: Frame, condition: Column, how: str = "inner") -> DataFrame:
        """Any condition between the two sides, named l and r in it. Without an equality in it every pair is compared:
        intervals go to join_range."""
        return self.df.alias("l").join(other.df.alias("r"), condition, how)

    def join_range(self, other: Frame, low: str, high: str, value: str) -> DataFrame:
        """Rows of both sides, named l and r, where r.value lies between l.low and l.high, by equi-joined intervals."""
        return joins.within(self.df, other.df, low, high, value)

    def vconcat(self, *others: Frame) -> Frame:
        """UNION ALL of equal schemas, rows of earlier frames first (row 170)."""
        out = self._numbered(0)
        for i, o in enumerate(others, 1):
            if [(f.name, f.dataType) for f in o.schema.fields] != [(f.name, f.dataType) for f in self.schema.fields]:
                raise ValueError("frames must have the same columns and types")
            out = out.unionByName(o._numbered(i))
        return self._with(out, [_ROW])

    union = vconcat

    def _numbered(self, i: int) -> DataFrame:
        order = F.struct(F.lit(i).alias("i"), F.col("__n").alias("n"))
        return self._number("__n").withColumn(_ROW, order).select(*self.columns, _ROW)

    def hconcat(self, other: Frame) -> Frame:
        """Side by side, by row number; heights must agree (row 172)."""
        if set(self.columns) & set(other.columns):
            raise ValueError("column names must differ")
        a, b = self._number("__n").drop(_ROW), other._number("__n").drop(_ROW)
        return self._with(a.join(b, "__n", "full").withColumnRenamed("__n", _ROW), [_ROW])

    def intersect(self, other: Frame) -> Frame:
        return self._fresh(self.df.intersect(other.df))

    def except_(self, other: Frame) -> Frame:
        return self._fresh(self.df.exceptAll(other.df).distinct())

    # -- reshape (rows 173-176 and supersets) --------------------------------------------------------
    def melt(self, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> Frame:
        return self._fresh(self.df.unpivot(ids, values, variable, value))

    def explode(self, *columns: str) -> Frame:
        """Lists to rows, null and empty lists to one null; several columns side by side (row 176)."""
        rest = [c for c in self.columns if c not in columns]
        if len(columns) == 1:
            out = self.df.select(*[F.explode_outer(c).alias(c) if c in columns else F.col(f"`{c}`") for c in self.columns])
        else:
            out = self.df.select(*rest, F.inline_outer(F.arrays_zip(*columns))).select(*self.columns)
        return self._fresh(out)

    def unnest(self, column: str) -> Frame:
        """One column per field of a struct (row 280)."""
        return self._fresh(self.df.select(*[f"`{c}`" for c in self.columns if c != column], f"`{column}`.*"))

    def pivot(self, index: list[str], columns: str, values: str, how: str = "sum", names: list | None = None) -> Frame:
        return self._fresh(self.df.groupBy(*index).pivot(columns, names).agg(getattr(F, {"mean": "avg"}.get(how, how))(values)))

    def transpose(self, index: str) -> DataFrame:
        return self.df.transpose(F.col(index))

    def group_dynamic(self, on: str, every: str, by: list[str] | None = None) -> DynamicGrouped:
        """Windows of fixed length over a time column, like "5 minutes"."""
        return DynamicGrouped(self, on, every, by or [])

    def rollup(self, *keys: str):
        return self.df.rollup(*keys)

    def cube(self, *keys: str):
        return self.df.cube(*keys)


class _Sorted(Frame):
    """A frame whose order is a list of sort keys (column, descending, nulls last) rather than columns. Operators that need the order
    as a column get a number that rises with it, given task by task after a range exchange."""

    _in_order = True

    def __init__(self, df, keys, drop=()):
        self._base, self._by, self._extra = df, keys, list(drop)
        self._order = [_ROW]

    @property
    def _df(self):
        return self.df.withColumn(_ROW, F.monotonically_increasing_id())

    @property
    def df(self):
        """Sorted by a range exchange: no single task."""
        return self._base.orderBy(*[S.sort_key(*k) for k in self._by]).drop(_ROW, *self._extra)

    def _number(self, name, start=0):
        # By the keys: the rising number may differ from one reading to the next.
        return numbered(self._base, self._by, name, start).drop(*self._extra).withColumn(_ROW, F.col(f"`{name}`"))

    def collect(self):
        return self.df.collect()

    def head(self, n: int = 5) -> Frame:
        """A top-k plan: each task keeps n rows."""
        return _Sorted(self._base.orderBy(*[S.sort_key(*k) for k in self._by]).limit(max(n, 0)), self._by, self._extra)

    limit = head

    def slice(self, offset, length):
        return _Sorted(self._base.orderBy(*[S.sort_key(*k) for k in self._by]).offset(offset).limit(length), self._by, self._extra)


class _Projected(Frame):
    """A projection that lost its order columns; they travel hidden."""

    def __init__(self, df, hidden):
        self._df, self._order, self._hide = df, hidden, hidden

    @property
    def df(self):
        return self._df.drop(*self._hide, _ROW)

    def collect(self):
        return self._df.orderBy(*self._sorted()).drop(*self._hide, _ROW).collect()

    def _with(self, df, order=None):
        if order is None:
            return _Projected(df, self._hide)
        return super()._with(df.drop(*self._hide), order)


class Grouped:
    def __init__(self, frame: Frame, keys: list[Expr]):
        self.frame, self.keys = frame, keys
        self.names = [k.name for k in keys]

    def _values(self, numeric: bool) -> list[str]:
        f = self.frame
        return [c for c in (S.numeric_columns(f.schema) if numeric else f.columns) if c not in self.names]

    def agg(self, *exprs, **named) -> Frame:
        """Expressions of aggregates, or a dictionary column -> names of AGGREGATES, named {column}_{name}.
        Null is a key like any other; keys come once."""
        if exprs and isinstance(exprs[0], dict):
            exprs = [self._by_name(c, n).alias(f"{c}_{n}") for c, ns in exprs[0].items() for n in ns]
        exprs = [*exprs, *[e.alias(n) for n, e in named.items()]]
        f = self.frame
        scope = f._scope()
        keys = [k.column(scope) for k in self.keys]
        columns = [e.column(scope) for e in exprs]
        return f._fresh(f._prepared(scope).groupBy(*keys).agg(*columns), *self.names)

    @staticmethod
    def _by_name(column: str, name: str) -> Expr:
        if name not in AGGREGATES:
            raise ValueError(f"unknown aggregate {name}")
        c = col(column)
        return {"nunique": c.n_unique, "count": c.count}.get(name, getattr(c, name, None))()

    def _each(self, name, numeric=True) -> Frame:
        return self.agg(*[self._by_name(c, name).alias(c) for c in self._values(numeric)])

    def count(self) -> Frame:
        """Non-null values per column (row 96)."""
        return self._each("count", numeric=False)

    def size(self, name: str = "count") -> Frame:
        return self.frame._fresh(self.frame._df.groupBy(*self.names).agg(F.count(F.lit(1)).alias(name)), *self.names)

    def sum(self):
        return self._each("sum")

    def mean(self):
        return self._each("mean")

    def median(self):
        return self._each("median")

    def min(self):
        return self._each("min")

    def max(self):
        return self._each("max")

    def std(self):
        return self._each("std")

    def var(self):
        return self._each("var")

    def first(self):
        return self._each("first", numeric=False)

    def last(self):
        return self._each("last", numeric=False)

    def n_unique(self):
        return self._each("nunique", numeric=False)

    def apply(self, fn, schema: str) -> DataFrame:
        """A function of each group's pandas frame (row 297); a group meets in one task."""
        return self.frame.df.groupBy(*self.names).applyInPandas(fn, schema)

    def agg_udf(self, column: str, fn, name: str, kind: str = "double") -> Frame:
        """A custom aggregate: values of a group (a pandas series) -> one value."""
        import pandas as pd

        def run(v: pd.Series) -> float:
            return fn(v)

        run.__annotations__ = {"v": pd.Series, "return": float}
        return self.frame._fresh(self.frame.df.groupBy(*self.names).agg(F.pandas_udf(run, kind)(column).alias(name)), *self.names)

    def n_groups(self) -> int:
        """Runs a job."""
        return self.frame.df.select(*self.names).distinct().count()

    def groups(self):
        """(key, Frame) one at a time; the keys stream to the driver (row 103)."""
        for key in self.frame.df.select(*self.names).distinct().toLocalIterator():
            cond = F.lit(True)
            for n, v in zip(self.names, key):
                cond = cond & F.col(n).eqNullSafe(F.lit(v))
            yield tuple(key), self.frame._with(self.frame._df.filter(cond))


class DynamicGrouped:
    def __init__(self, frame, on, every, by):
        self.frame, self.on, self.every, self.by = frame, on, every, by

    def agg(self, *exprs: Expr) -> Frame:
        f = self.frame
        scope = f._scope()
        out = f._df.groupBy(*self.by, F.window(self.on, self.every).alias("__w")).agg(*[e.column(scope) for e in exprs])
        return f._fresh(out.select(*self.by, F.col("__w.start").alias(self.on), *[c for c in out.columns if c not in (*self.by, "__w")]), *self.by, self.on)
