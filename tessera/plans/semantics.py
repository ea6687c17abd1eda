"""Value rules that differ from Spark's own: null-safe equality, IEEE NaN, strict boolean nulls, integer
division, promotion and casts. Every rule is a Column expression that holds with ANSI mode on and off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, _FLOATING)


def is_numeric(t: T.DataType) -> bool:
    return is_integral(t) or is_floating(t) or isinstance(t, T.DecimalType)


def numeric_columns(schema: T.StructType, but=()) -> list[str]:
    return [f.name for f in schema.fields if f.name not in but and is_numeric(f.dataType)]


def eq(a: Column, b: Column) -> Column:
    """Null equals null and nothing else; never null (rows 57)."""
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    """The negation of eq; never null (row 58)."""
    return ~a.eqNullSafe(b)


def _ordered(a: Column, b: Column, holds: Column) -> Column:
    nan = a.eqNullSafe(F.lit(float("nan"))) | b.eqNullSafe(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(nan, F.lit(False)).otherwise(holds)


def compare(a: Column, b: Column, op: str, floating: bool = False) -> Column:
    """< <= > >=: a null operand gives null; with `floating`, NaN compares false as IEEE says (rows 59-61)."""
    holds = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return _ordered(a, b, holds) if floating else holds


def strict_and(a: Column, b: Column) -> Column:
    """Any null operand gives null (row 62)."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def strict_or(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def strict_xor(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a != b)


def divide(a: Column, b: Column, integral: bool) -> Column:
    """Integers truncate towards zero (a zero divisor gives null); floats follow IEEE: x/0 is signed infinity, 0/0 NaN (row 238)."""
    if integral:
        a, b = a.cast("long"), b.cast("long")
        # Not `div`: a zero divisor raises there in ANSI mode even where a branch excludes it.
        whole = a - F.try_mod(a, b)
        exact = F.try_divide(whole.cast("decimal(20,0)"), b.cast("decimal(20,0)"))
        # A double holds a multiple of b below 2**53.
        small = (whole < 2**53) & (whole > -(2**53))
        return F.when(b != 0, F.when(small, F.try_divide(whole, b).cast("long")).otherwise(exact.cast("long")))
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    at_zero = F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; a zero divisor gives null (row 239)."""
    return F.try_mod(a, b)


def floor_divide(a: Column, b: Column) -> Column:
    """Quotient rounded down (row 254)."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def promote(left: T.DataType, right: T.DataType) -> T.DataType:
    """Common type of an arithmetic pair: double if either floats, else long (row 242)."""
    return T.DoubleType() if is_floating(left) or is_floating(right) else T.LongType()


def cast(c: Column, source: T.DataType, target: str) -> Column:
    """The cast matrix (rows 256-257): text that does not parse gives null, floats truncate, floats print in shortest form."""
    if target in ("string", "str"):
        text = c.cast("string")
        return F.regexp_replace(text, r"\.0$", "") if is_floating(source) else text
    if isinstance(source, T.StringType):
        return c.try_cast(target)
    if isinstance(source, T.BooleanType) and target in ("long", "bigint"):
        return F.lit(None).cast("long")
    return c.try_cast(target)


def skip_nan(c: Column, floating: bool = True) -> Column:
    """NaN as null, for min and max that skip it (rows 83-84)."""
    return F.when(~F.isnan(c), c) if floating else c


def sort_key(c: Column, descending: bool = False, nulls_last: bool = True) -> Column:
    """Sort order: nulls last either way unless told otherwise; NaN greatest (row 154)."""
    if descending:
        return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if nulls_last else c.asc_nulls_first()
