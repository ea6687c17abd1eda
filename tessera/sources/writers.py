"""CSV, Parquet, JSON and NDJSON writers (rows 19-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.frame import Frame


def _plain(x: Frame | DataFrame) -> DataFrame:
    return x.df if isinstance(x, Frame) else x


def csv_cell(c: Column, t: T.DataType, null: str = "", precision: int | None = None) -> Column:
    """The text of a cell: shortest float, or a fixed precision; NaN and infinities as null; ISO dates; lower-case booleans (row 22)."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        text = F.format_string(f"%.{precision}f", d) if precision is not None else F.regexp_replace(d.cast("string"), r"\.0$", "")
        out = F.when(~F.isnan(d) & (F.abs(d) != float("inf")), text)
    elif isinstance(t, T.DateType):
        out = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    elif isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(null))


def _cells(df: DataFrame, null: str, precision: int | None) -> DataFrame:
    return df.select(*[csv_cell(F.col(f"`{f.name}`"), f.dataType, null, precision).alias(f.name) for f in df.schema.fields])


def write_csv(frame, path: str, header: bool = True, separator: str = ",", null: str = "", precision: int | None = None, mode: str = "overwrite") -> None:
    """A folder of parts; quotes only where needed, doubled inside."""
    w = _cells(_plain(frame), null, precision).write.mode(mode).option("header", header).option("sep", separator).option("quote", '"').option("escape", '"').option("emptyValue", "")
    w.csv(path)


def csv_text(frame, header: bool = True, separator: str = ",", null: str = "", precision: int | None = None) -> str:
    """The whole table as one text, on the driver (row 21)."""
    df = _plain(frame)
    cells = _cells(df, null, precision)

    def quoted(c):
        v = F.col(f"`{c}`")
        return F.when(v.rlike('["\n\r]') | v.contains(separator), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    rows = [r[0] for r in cells.select(F.concat_ws(separator, *[quoted(c) for c in cells.columns])).collect()]
    return "\n".join([separator.join(df.columns)] * header + rows) + "\n"


def write_parquet(frame, path: str, compression: str = "snappy", mode: str = "overwrite", partition_by=()) -> None:
    w = _plain(frame).write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _json_ready(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, which JSON has no words for (row 24)."""
    return df.select(*[F.when(~F.isnan(f.name) & (F.abs(F.col(f"`{f.name}`")) != float("inf")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_ndjson(frame, path: str, mode: str = "overwrite") -> None:
    """An object per line, null keys kept (row 25)."""
    _json_ready(_plain(frame)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_text(frame) -> str:
    """One array of row objects, on the driver (row 24)."""
    df = _json_ready(_plain(frame))
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()) + "]"


def write_json(frame, path: str, mode: str = "overwrite") -> None:
    """One array of row objects in one file: brackets and commas around lines, which keep their order."""
    df = _json_ready(_plain(frame))
    lines = df.select(F.monotonically_increasing_id().alias("n"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    last = lines.agg(F.max("n")).first()[0]
    if last is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode(mode).text(path)
        return
    first = lines.agg(F.min("n")).first()[0]
    text = lines.orderBy("n").select(F.concat(F.when(F.col("n") == first, "[").otherwise(""), "value", F.when(F.col("n") == last, "]").otherwise(",")).alias("value"))
    text.coalesce(1).write.mode(mode).text(path)
