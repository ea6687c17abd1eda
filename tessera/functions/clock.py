"""Date and time functions on wall-clock times (rows 210-234): timestamp_ntz in, timestamp_ntz or numbers out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 0001-01-01 to 1970-01-01, and per unit of fixed length.
_EPOCH_OFFSET = 62_135_596_800_000_000
_MICROS = {"w": 604_800_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}

#: Strftime directives as Java patterns.
_JAVA = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a",
    "%f": "SSSSSS", "%3f": "SSS", "%6f": "SSSSSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy", "%-d": "d", "%-m": "M", "%-H": "H", "%-M": "m", "%-S": "s", "%-I": "h", "%e": "d", "%%": "%",
}


def java_pattern(fmt: str) -> str:
    """A % format as a Java pattern; other text is quoted."""
    out = []
    for d, other in re.findall(r"(%[-_0]?[0-9]?[A-Za-z%])|([^%]+)", fmt):
        if d:
            if d not in _JAVA:
                raise ValueError(f"unsupported directive {d}")
            out.append("%" if d == "%%" else _JAVA[d])
        else:
            out.append("".join(f"'{x}'" if x.isalpha() else "''" if x == "'" else x for x in other))
    return "".join(out)


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Microseconds of the wall clock since 1970 (unix_micros takes no wall-clock time, so through the parts)."""
    t = _ntz(c)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(t).cast("long") * 3600 + F.minute(t) * 60
    return days * _MICROS["d"] + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def from_micros(us: Column) -> Column:
    """The inverse of micros, whatever the session's zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days = F.floor(us.cast("decimal(38,0)") / _MICROS["d"]).cast("long")
    return zero + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), ((us - days * _MICROS["d"]).cast("decimal(20,6)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def year(c):
    return F.year(c)


def month(c):
    return F.month(c)


def day(c):
    return F.dayofmonth(c)


def hour(c):
    return F.hour(_ntz(c))


def minute(c):
    return F.minute(_ntz(c))


def second(c):
    return F.second(_ntz(c))


def millisecond(c):
    return F.pmod(F.floor(micros(c) / 1000).cast("long"), F.lit(1000)).cast("int")


def microsecond(c):
    return F.pmod(micros(c), F.lit(1000)).cast("int")


def nanosecond(c):
    """Always 0: times hold microseconds."""
    return F.when(c.isNotNull(), F.lit(0))


def weekday(c):
    """Sunday is 0 (row 213)."""
    return F.dayofweek(c) - 1


def ordinal_day(c):
    return F.dayofyear(c)


def iso_week(c):
    return F.weekofyear(c)


def iso_year(c):
    return F.extract(F.lit("YEAROFWEEK"), c)


def quarter(c):
    return F.quarter(c)


def is_leap_year(c):
    y = F.year(c)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def is_weekend(c):
    return F.dayofweek(c).isin(1, 7)


def is_month_start(c):
    return F.dayofmonth(c) == 1


def is_month_end(c):
    return c.cast("date") == F.last_day(c)


def is_quarter_start(c):
    return (F.dayofmonth(c) == 1) & (F.month(c) % 3 == 1)


def is_quarter_end(c):
    return is_month_end(c) & (F.month(c) % 3 == 0)


def is_year_start(c):
    return F.dayofyear(c) == 1


def is_year_end(c):
    return (F.month(c) == 12) & (F.dayofmonth(c) == 31)


def truncate(c, unit: str):
    """year, quarter, month, week, day, hour, minute or second (row 222)."""
    t = _ntz(c)
    if unit in ("year", "quarter", "month", "week"):
        return F.trunc(t.cast("date"), unit).cast("timestamp_ntz")
    return interval_floor(t, {"day": "1d", "hour": "1h", "minute": "1m", "second": "1s"}[unit])


def _step(interval: str) -> int:
    parts = re.findall(r"(\d+)(ms|us|[wdhms])", interval)
    if not parts or "".join(a + b for a, b in parts) != interval:
        raise ValueError(f"not an interval of fixed length: {interval}")
    return sum(int(n) * _MICROS[u] for n, u in parts)


def _grid(c, interval: str, shift: float):
    step = _step(interval)
    us = micros(c) + _EPOCH_OFFSET + F.lit(int(step * shift))
    return from_micros(us - F.pmod(us, F.lit(step)) - _EPOCH_OFFSET)


def interval_floor(c, interval: str):
    """Down to a grid that counts from year 1 (row 223)."""
    return _grid(c, interval, 0)


def interval_round(c, interval: str):
    return _grid(c, interval, 0.5)


def interval_ceiling(c, interval: str):
    down = interval_floor(c, interval)
    return F.when(down == _ntz(c), down).otherwise(from_micros(micros(down) + _step(interval)))


def add_days(c, n: int):
    return _ntz(c) + F.make_dt_interval(F.lit(n))


def add_months(c, n: int):
    """To the month's last day where the day is missing (row 224)."""
    return _ntz(c) + F.make_ym_interval(F.lit(0), F.lit(n))


def add_years(c, n: int):
    return add_months(c, 12 * n)


def add(c, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0):
    return _ntz(c) + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds).cast("decimal(18,6)"))


def offset_by(c, by: str, date: bool = False):
    """Like -1y2mo3w4d5h6m7s8ms9us: months, then days, then the rest (row 230); nanoseconds are below a microsecond and drop."""
    sign, rest = (-1, by[1:]) if by.startswith("-") else (1, by)
    parts = re.findall(r"(\d+)(mo|ms|us|ns|[ywdhmsq])", rest)
    if "".join(a + b for a, b in parts) != rest:
        raise ValueError(f"not a duration: {by}")
    months = sum(int(n) * {"y": 12, "q": 3, "mo": 1}[u] for n, u in parts if u in ("y", "q", "mo"))
    us = sum(int(n) * _MICROS[u] for n, u in parts if u in _MICROS) + sum(int(n) // 1000 for n, u in parts if u == "ns")
    out = add_months(c, sign * months) if months else _ntz(c)
    if us:
        days, left = divmod(us, _MICROS["d"])
        out = out + F.make_dt_interval(F.lit(sign * days), F.lit(0), F.lit(0), F.lit(f"{sign * left / 1e6:.6f}").cast("decimal(18,6)"))
    return out.cast("date") if date else out


def convert_time_zone(c, source: str, target: str):
    """Wall clock in one zone to wall clock in another (row 226)."""
    return F.convert_timezone(F.lit(source), F.lit(target), _ntz(c))


def to_utc(c):
    return _ntz(c)


def strftime(c, fmt: str):
    """% formats (row 228); %s %u %w %C are put together from other functions."""
    special = {"%s": lambda t: epoch(t, "s"), "%u": lambda t: F.weekday(t) + 1, "%w": weekday, "%C": lambda t: F.lpad(F.floor(F.year(t) / 100).cast("string"), 2, "0")}
    parts = [p for p in re.split(r"(%[suwC])", fmt) if p]
    return F.concat(*[special[p](c).cast("string") if p in special else F.date_format(_ntz(c), java_pattern(p)) for p in parts])


def to_iso_string(c):
    return F.concat(F.date_format(_ntz(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def start_of(c, unit: str):
    return truncate(c, unit)


def end_of(c, unit: str):
    """The last millisecond of the month, quarter or year (row 232)."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return add(add_months(truncate(c, unit), months), seconds=-0.001)


def epoch(c, unit: str = "s"):
    """Seconds (down), ms, us or ns since 1970 (row 233)."""
    us = micros(c)
    if unit in ("ns", "us"):
        return us * 1000 if unit == "ns" else us
    step = F.lit({"ms": 1000, "s": 1_000_000}[unit])
    # Decimals: a double does not hold all microseconds.
    return ((us - F.pmod(us, step)).cast("decimal(20,0)") / step).cast("long")
