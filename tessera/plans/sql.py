"""SQL over registered frames (rows 282-295): Spark's own parser and planner, with a few extra names."""

from __future__ import annotations

import contextlib
import re
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.frame import Frame

#: Aggregate names that Spark spells otherwise.
_NAMES = {"STD": "STDDEV_SAMP", "VAR": "VAR_SAMP", "LEN": "LENGTH"}

#: Views of one name would meet: one query is analysed at a time.
_ANALYSIS = threading.RLock()


def _spelled(query: str) -> str:
    """Function names of _NAMES outside quoted text."""
    parts = re.split(r"('(?:[^']|'')*'|`[^`]*`|\"[^\"]*\")", query)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\b(STD|VAR|LEN)\s*(?=\()", lambda m: _NAMES[m[1].upper()], parts[i], flags=re.I)
    return "".join(parts)


@contextlib.contextmanager
def _views(spark: SparkSession, tables: dict[str, DataFrame]):
    """The tables as temporary views; views of the session that have their names come back after."""
    before = {}
    for name in tables:
        with contextlib.suppress(AnalysisException):
            if spark.catalog.getTable(f"`{name}`").isTemporary:
                before[name] = spark.table(f"`{name}`")
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(f"`{name}`")
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(f"`{name}`")


class SqlContext:
    """Frames by name, whatever its case, and queries over them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, name: str, frame: Frame | DataFrame) -> SqlContext:
        self.tables[name.lower()] = frame.df if isinstance(frame, Frame) else frame
        return self

    def unregister(self, name: str) -> bool:
        return self.tables.pop(name.lower(), None) is not None

    def sql(self, query: str) -> DataFrame:
        """One SELECT. Spark's parser finds the relations; the query is analysed at once, and no view is left behind."""
        if not query.strip():
            raise ValueError("the query is empty")
        words = set(re.findall(r"\w+", query.lower()))
        with _ANALYSIS, _views(self.spark, {n: d for n, d in self.tables.items() if set(re.findall(r"\w+", n)) <= words}):
            out = self.spark.sql(_spelled(query))
            out.schema  # noqa: B018 - analysed while the views stand
            return out


def sql(frame: Frame | DataFrame, query: str) -> DataFrame:
    """A query over one frame, called `self`."""
    df = frame.df if isinstance(frame, Frame) else frame
    return SqlContext(df.sparkSession).register("self", df).sql(query)
