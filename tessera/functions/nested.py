"""List and struct functions (rows 264-281). Lists stay lists; as_text gives the bracketed rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lengths(c):
    return F.when(c.isNotNull(), F.size(c))


def get(c, i: int):
    """Negative counts from the end; out of range is null (row 265)."""
    return F.get(c, F.lit(i)) if i >= 0 else F.get(c, F.size(c) + i)


def first(c):
    return get(c, 0)


def last(c):
    return get(c, -1)


def contains(c, value, tolerance: float = 1e-10):
    """Doubles within a tolerance, a null value matches a null element (row 266)."""
    if value is None:
        return F.exists(c, lambda x: x.isNull())
    if isinstance(value, float):
        return F.exists(c, lambda x: F.coalesce(F.abs(x - value) <= tolerance, F.lit(False)))
    return F.exists(c, lambda x: x.eqNullSafe(F.lit(value)))


def _some(c):
    return F.filter(c, lambda x: x.isNotNull())


def sum_(c):
    """Nulls skipped; of an empty list null (row 267)."""
    s = _some(c)
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double")))


def mean(c):
    return F.try_divide(sum_(c), F.size(_some(c)))


def min_(c):
    return F.array_min(c).cast("double")


def max_(c):
    return F.array_max(c).cast("double")


def reverse(c):
    return F.reverse(c)


def sort(c, descending: bool = False):
    """Nulls last either way."""
    up = F.concat(F.sort_array(_some(c), asc=not descending), F.filter(c, lambda x: x.isNull()))
    return up


def unique(c):
    return F.array_distinct(c)


def slice_(c, offset: int, length: int | None = None):
    n = F.size(c)
    start = F.greatest(n + offset, F.lit(0)) if offset < 0 else F.least(F.lit(offset), n)
    return F.slice(c, start + 1, n if length is None else F.lit(length))


def head(c, n: int = 5):
    return slice_(c, 0, n)


def tail(c, n: int = 5):
    return slice_(c, -n) if n else F.slice(c, 1, 0)


def join(c, sep: str = ","):
    """A null element is an empty text (row 274)."""
    return F.array_join(c, sep, "")


def as_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ", ", "null"), F.lit("]"))


def field(c, name: str):
    return c.getField(name)


def field_names(df, column: str) -> list[str]:
    return list(df.schema[column].dataType.names)


def rename_fields(df, column: str, names: dict[str, str]) -> Column:
    """The struct column with fields renamed (row 278)."""
    t = df.schema[column].dataType
    return F.col(column).cast(T.StructType([T.StructField(names.get(f.name, f.name), f.dataType, f.nullable) for f in t.fields]))


def json_encode(c):
    return F.to_json(c, {"ignoreNullFields": "false"})
