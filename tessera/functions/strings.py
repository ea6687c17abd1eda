"""String functions as Columns (rows 177-209). Lengths and positions count code points; null gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clock


def quote(literal: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def lower(c):
    return F.lower(c)


def upper(c):
    return F.upper(c)


def titlecase(c: Column) -> Column:
    """Letters after anything but a letter or apostrophe are capitals, others small (row 179)."""
    chars = F.split(F.lower(c), "")
    prev = F.concat(F.array(F.lit(" ")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))))
    return F.array_join(F.zip_with(chars, prev, lambda x, p: F.when(p.rlike("[\\p{L}']"), x).otherwise(F.upper(x))), "")


def strip(c, chars: str | None = None):
    return F.btrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_start(c):
    return F.regexp_replace(c, r"(?U)^\s+", "")


def strip_end(c):
    return F.regexp_replace(c, r"(?U)\s+$", "")


def pad_start(c, n: int, fill: str = " "):
    """Never shortens (row 183)."""
    return F.when(F.length(c) < n, F.lpad(c, n, fill)).otherwise(c)


def pad_end(c, n: int, fill: str = " "):
    return F.when(F.length(c) < n, F.rpad(c, n, fill)).otherwise(c)


def zfill(c, n: int):
    """Zeros go behind a sign (row 184)."""
    sign, rest = F.regexp_extract(c, r"^([+-]?)", 1), F.regexp_replace(c, r"^[+-]", "")
    return F.when(F.length(c) < n, F.concat(sign, F.lpad(rest, F.lit(n) - F.length(sign), F.lit("0")))).otherwise(c)


def _clamped(c, at: int):
    n = F.length(c)
    return F.greatest(n + at, F.lit(0)) if at < 0 else F.least(F.lit(at), n)


def substring(c, start: int, length: int | None = None):
    """From 0; a negative start counts from the end (row 185)."""
    a = _clamped(c, start)
    return F.substring(c, a + 1, F.length(c) if length is None else F.lit(length))


def slice_(c, start: int, end: int | None = None):
    """Half open, negatives from the end (row 204)."""
    a, z = _clamped(c, start), F.length(c) if end is None else _clamped(c, end)
    return F.substring(c, a + 1, F.greatest(z - a, F.lit(0)))


def head(c, n: int):
    return F.substring(c, F.lit(1), F.lit(max(n, 0)))


def tail(c, n: int):
    return F.when(F.length(c) <= n, c).otherwise(F.right(c, F.lit(max(n, 0))))


def contains(c, pattern: str, literal: bool = True):
    return c.contains(pattern) if literal else c.rlike(pattern)


def starts_with(c, prefix: str):
    return c.startswith(prefix)


def ends_with(c, suffix: str):
    return c.endswith(suffix)


def matches(c, pattern: str):
    return c.rlike(pattern)


def replace(c, pattern: str, by: str, literal: bool = True):
    return F.replace(c, F.lit(pattern), F.lit(by)) if literal else F.regexp_replace(c, pattern, by)


def replace_first(c, pattern: str, by: str):
    """The first match of a pattern only (row 191); groups of the replacement count from the pattern's first."""
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 2}", by)
    return F.regexp_replace(c, f"(?s)^(.*?)({pattern})", "$1" + shifted)


def split(c, separator: str, parts: int | None = None):
    """An array; with `parts`, that many columns, null where there are fewer (row 192)."""
    arr = F.split(c, quote(separator))
    return arr if parts is None else [F.get(arr, i) for i in range(parts)]


def split_max(c, separator: str, max_split: int):
    return F.split(c, quote(separator), max_split)


def extract(c, pattern: str, group: int = 0):
    """No match is null, not an empty text (row 193)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def extract_groups(c, pattern: str):
    """One column per group of the first match (row 194)."""
    return [extract(c, pattern, g) for g in range(1, re.compile(pattern).groups + 1)]


def length(c):
    return F.length(c)


def byte_length(c):
    return F.octet_length(c)


def concat(*cs):
    return F.concat(*cs)


def concat_ws(sep: str, *cs):
    return F.concat_ws(sep, *cs)


def count_matches(c, pattern: str, literal: bool = True):
    return F.regexp_count(c, F.lit(quote(pattern) if literal else pattern))


def reverse(c):
    return F.reverse(c)


def find(c, pattern: str, start: int = 0):
    """Place from 0, -1 where missing (row 200)."""
    return F.locate(pattern, c, start + 1) - 1


def find_last(c, pattern: str):
    at = F.locate(pattern[::-1], F.reverse(c))
    return F.when(at > 0, F.length(c) - len(pattern) - at + 1).otherwise(F.when(c.isNotNull(), F.lit(-1)))


def encode_base64(c):
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "\\s", "")


def decode_base64(c):
    return F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8")


def encode_hex(c):
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def decode_hex(c):
    return F.decode(F.try_to_binary(c, F.lit("hex")), "UTF-8")


def repeat(c, n: int):
    return F.repeat(c, max(n, 0))


def strptime(c, target: str = "datetime", fmt: str | None = None):
    """Text to date or wall-clock time (rows 205-206); what does not parse is null. % formats, or ISO without one."""
    t = c.try_cast("timestamp_ntz") if fmt is None else F.try_to_timestamp(c, F.lit(clock.java_pattern(fmt))).cast("timestamp_ntz")
    return t.cast("date") if target == "date" else t


def to_date(c, fmt: str | None = None):
    """Text to date (row 206)."""
    return strptime(c, "date", fmt)


def to_datetime(c, fmt: str | None = None):
    """Text to wall-clock time (row 206)."""
    return strptime(c, "datetime", fmt)


def strptime_strict(df, column: str, target: str = "datetime", fmt: str | None = None):
    """strptime that raises, with up to five examples, where a text does not parse. Runs a job."""
    parsed = df.withColumn("_parsed", strptime(F.col(column), target, fmt))
    bad = [r[0] for r in parsed.filter(F.col(column).isNotNull() & F.col("_parsed").isNull()).select(column).limit(5).collect()]
    if bad:
        raise ValueError(f"not a {target}: {bad}")
    return parsed.withColumn(column, F.col("_parsed")).drop("_parsed")


def json_path(c, path: str):
    """A dotted path with [i] (row 207); errors give null."""
    return F.get_json_object(c, path if path.startswith("$") else f"$.{path}")
