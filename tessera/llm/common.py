"""Working tables in the shared folder, size-checked broadcasts, and batch plumbing."""

from __future__ import annotations

import contextlib
import functools
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A working table is broadcast only while its files hold at most this many bytes (numbers that hardly compress: three to eight times as many in memory).
BROADCAST_BYTES = 8 << 20
#: Batches are cut into pieces of about this many text bytes before numpy touches them.
PIECE_BYTES = 1 << 20


@functools.lru_cache(maxsize=8)
def _local_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where it is unset, a temporary
    folder in local mode (as in tests) and the warehouse otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local":
        return "file://" + _local_dir(sc.applicationId)
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_work"


#: Lists that collect the tables written while they are open (see `tracked`).
_OPEN: list[list] = []


@contextlib.contextmanager
def tracked():
    """The working tables written inside, so that their maker can drop those no longer needed."""
    made: list[Table] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


class Table:
    """A written working table: `df` reads it, `bytes` is its size on disk, `drop()` removes it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @functools.cached_property
    def bytes(self) -> int:
        fs, p = self._fs()
        return int(fs.getContentSummary(p).getLength())

    @functools.cached_property
    def rows(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)

    def small(self) -> DataFrame:
        """The table, marked for broadcast only when its measured size allows it; else Spark's
        own choice (a shuffled join, split by AQE where skewed)."""
        return F.broadcast(self.df) if self.bytes <= BROADCAST_BYTES else self.df


#: While a working table is written, Python workers get batches of at most so many rows and bytes.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession, records: int | None = None):
    """Bounded memory for Python workers: whole texts come in small batches (`records` rows, for narrow ones); the session's settings return after."""
    before = {k: spark.conf.get(k, None) for k in _BATCHES}
    try:
        for k, v in (_BATCHES | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {})).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, name: str = "t", path: str | None = None, compression: str = "zstd", records: int | None = None) -> Table:
    """Write df to the shared folder and cut its lineage there; survives lost executors."""
    spark = df.sparkSession
    path = path or f"{work_dir(spark)}/tessera/{uuid.uuid4().hex}/{name}"
    with small_batches(spark, records):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    out = Table(spark, path, df.schema)
    for made in _OPEN:
        made.append(out)
    return out


class Shipped:
    """An object for the workers, broadcast as bytes that carry its class with them."""

    def __init__(self, spark: SparkSession, value):
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._held.value)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced. Spark holds the last execution
    until the next one ends, which here is one without tasks."""
    import gc

    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_column(df: DataFrame, column: str = "text"):
    """The named column as a string column, null where the frame has none."""
    return F.col(f"`{column}`").cast("string") if column in df.columns else F.lit(None).cast("string")


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES):
    """Slices of record batches that hold about `limit` bytes of `column` (a single longer row is its own slice)."""
    import numpy as np

    for b in batches:
        if b.num_rows == 0:
            continue
        arr = b.column(b.schema.get_field_index(column))
        off = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1] if arr.type == pa.string() else np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
        start = 0
        n = len(arr)
        while start < n:
            end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            end = min(n, max(start + 1, end))
            yield b.slice(start, end - start)
            start = end


def batch_of(schema: pa.Schema, **cols):
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)
