"""CSV, Parquet, JSON and NDJSON readers with type inference (rows 4-18)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.frame import Frame

#: Texts that read as null, whatever their case; and the order in which types are tried.
NULL_TOKENS = ("", "null", "na", "n/a", "nan")
TYPES = ("boolean", "int", "bigint", "double", "date", "timestamp_ntz")


@dataclass
class CsvOptions:
    header: bool = True
    separator: str = ","
    quote: str = '"'
    comment: str | None = None
    infer_rows: int = 1000
    schema: dict[str, str] = field(default_factory=dict)
    columns: list[str] | None = None
    n_rows: int | None = None
    skip_rows: int = 0
    null_values: tuple[str, ...] = NULL_TOKENS
    encoding: str = "UTF-8"
    try_dates: bool = True
    batch_rows: int = 100_000


def _parsed(c: Column, kind: str) -> Column:
    if kind == "boolean":
        t = F.lower(c)
        return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False))
    if kind == "date":
        return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))
    if kind in ("int", "bigint"):
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast(kind))
    return c.try_cast(kind)


def infer(df: DataFrame, columns: list[str], rows: int, dates: bool = True) -> dict[str, str]:
    """The first type in order that all non-null texts of the first rows parse as; columns of nulls alone are
    boolean, as are those of 0 and 1 (row 7). Runs one job over the sample."""
    kinds = [k for k in TYPES if dates or k not in ("date", "timestamp_ntz")]
    sample = df.limit(rows or 10_000)
    bad = sample.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & _parsed(F.col(f"`{c}`"), k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in kinds]).first()
    return {c: next((k for k in kinds if bad[f"{i}_{k}"] == 0), "string") for i, c in enumerate(columns)}


def _typed(raw: DataFrame, opts: CsvOptions) -> DataFrame:
    """Text columns -> trimmed, null tokens out, typed; a cell that does not parse is null (row 8)."""
    names = raw.columns
    clean = raw.select(*[F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*[v.lower() for v in opts.null_values]), F.trim(F.col(f"`{c}`"))).alias(c) for c in names])
    if opts.columns:
        clean = clean.select(*opts.columns)
    if opts.n_rows is not None:
        clean = clean.limit(opts.n_rows)
    open_ = [c for c in clean.columns if c not in opts.schema]
    kinds = {**infer(clean, open_, opts.infer_rows, opts.try_dates), **opts.schema} if open_ else dict(opts.schema)
    return clean.select(*[(_parsed(F.col(f"`{c}`"), kinds[c]) if kinds[c] in TYPES else F.col(f"`{c}`").try_cast(kinds[c])).alias(c) for c in clean.columns])


def _reader(spark, opts: CsvOptions):
    r = spark.read.option("header", opts.header).option("sep", opts.separator).option("quote", opts.quote).option("escape", opts.quote).option("encoding", opts.encoding).option("mode", "PERMISSIVE").option("inferSchema", False).option("enforceSchema", True)
    return r.option("comment", opts.comment) if opts.comment else r


def _named(raw: DataFrame, opts: CsvOptions) -> DataFrame:
    return raw if opts.header else raw.toDF(*[f"column_{i}" for i in range(len(raw.columns))])


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None, **kw) -> Frame:
    """A file or folder; the schema comes from one job over a sample unless it is given whole."""
    opts = options or CsvOptions(**kw)
    if opts.skip_rows:
        return _without_heads(spark, path, opts)
    return Frame(_typed(_named(_reader(spark, opts).csv(path), opts), opts))


def _without_heads(spark: SparkSession, path: str, opts: CsvOptions) -> Frame:
    """Files of which each begins with skip_rows lines that do not count, and then a header if there is one. Heads lie in a file's
    first block; the others are read as they are."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    head = opts.skip_rows + bool(opts.header)
    heads = lines.filter("b = 0").withColumn("k", F.row_number().over(W.partitionBy("f").orderBy("n"))).filter(F.col("k") <= head)
    last = heads.groupBy("f").agg(F.max("n").alias("last"))
    # A row per file, which the driver lists in any case; lines keep their order.
    body = lines.join(F.broadcast(last), "f", "left").filter(F.col("n") > F.coalesce("last", F.lit(-1))).select("value")
    first = heads.filter(F.col("k") == head).orderBy("f").select("value").first() if opts.header else None
    return read_csv_lines(spark, body, replace(opts, skip_rows=0), names=first[0] if first else None)


def read_csv_lines(spark: SparkSession, lines: DataFrame | str, options: CsvOptions | None = None, names: str | None = None, **kw) -> Frame:
    """CSV from a text, or from a frame with one text column of lines (row 5). A text is small by nature. names: the header line, where it is not among the lines."""
    opts = options or CsvOptions(**kw)
    if isinstance(lines, str):
        rows = [(x,) for x in lines.splitlines()]
        lines = spark.createDataFrame(rows or [("",)], "value string").coalesce(1)
    head = names or lines.first()[0]
    shape = spark.createDataFrame([(head,)], "value string").select(F.schema_of_csv(F.lit(head), {"sep": opts.separator, "quote": opts.quote}).alias("s")).first()[0]
    n = len(T.StructType.fromDDL(shape[len("STRUCT<") : -1]) if shape.upper().startswith("STRUCT<") else T.StructType.fromDDL(shape))
    ddl = ", ".join(f"_c{i} string" for i in range(n))
    body = lines.filter(F.length(F.trim("value")) > 0)
    if opts.comment:
        body = body.filter(~F.col("value").startswith(opts.comment))
    raw = body.select(F.from_csv("value", ddl, {"sep": opts.separator, "quote": opts.quote, "escape": opts.quote}).alias("r")).select("r.*")
    if names is not None:
        given = spark.createDataFrame([(names,)], "value string").select(F.from_csv("value", ddl, {"sep": opts.separator, "quote": opts.quote}).alias("r")).select("r.*").first()
        raw = raw.toDF(*[v.strip() for v in given])
    elif opts.header:
        names = [v.strip() for v in body.limit(1).select(F.from_csv("value", ddl, {"sep": opts.separator, "quote": opts.quote}).alias("r")).select("r.*").first()]
        raw = raw.withColumn("_n", F.monotonically_increasing_id())
        low = raw.agg(F.min("_n")).first()[0]
        raw = raw.filter(F.col("_n") > low).drop("_n").toDF(*names)
    else:
        raw = _named(raw, opts)
    return Frame(_typed(raw, opts))


scan_csv = read_csv


def read_csv_batches(spark: SparkSession, path: str, options: CsvOptions | None = None, **kw):
    """Lists of batch_rows rows, partition by partition (row 6)."""
    opts = options or CsvOptions(**kw)
    return read_csv(spark, path, opts).batches(opts.batch_rows)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> Frame:
    """Filters and columns reach the files. Without `order`, rows are numbered as they are read."""
    df = spark.read.parquet(path)
    return Frame(df.select(*columns) if columns else df, order)


scan_parquet = read_parquet

#: Fields of a root object that may hold the rows.
ROOTS = ("data", "rows", "items", "records")


def read_json(spark: SparkSession, path: str) -> Frame:
    """A root array, or an object that holds the rows under one of ROOTS (row 13); comments are allowed. Types come from all
    rows: boolean, bigint, double or string; nested values stay nested (row 15)."""
    df = spark.read.option("multiLine", True).option("allowComments", True).json(path)
    return Frame(_rooted(df))


def _rooted(df: DataFrame) -> DataFrame:
    for name in ROOTS:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.StructType):
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def read_json_text(spark: SparkSession, text: str) -> Frame:
    """JSON from a text, which is small by nature (row 14)."""
    schema = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    parsed = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema).alias("r"))
    if schema.upper().startswith("ARRAY"):
        return Frame(parsed.select(F.explode("r").alias("r")).select("r.*"))
    return Frame(_rooted(parsed.select("r.*")))


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> Frame:
    """A row per line; malformed lines drop out (row 16). Columns come in name order unless a schema says otherwise."""
    r = spark.read.option("mode", "DROPMALFORMED")
    return Frame((r.schema(schema) if schema else r).json(path))


scan_ndjson = read_ndjson


def read_batches(frame: Frame, rows: int = 100_000):
    """Lists of rows, partition by partition (rows 6 and 17)."""
    return frame.batches(rows)
