"""Connected components by alternating large-star and small-star steps, on DataFrames alone.

No node's neighbours are ever gathered: each step is a minimum per node (combined before the
shuffle) and a join whose hot side Spark may split. Lineage is cut by a written table per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, stash


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    sym = _both(e)
    low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Whether every a has one smaller b and no b is an a: then the edges are the answer."""
    ends = e.select(F.col("a").alias("n"), F.col("b").alias("p")).unionByName(e.select(F.col("b").alias("n"), F.lit(None).cast("long").alias("p")))
    bad = ends.groupBy("n").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count_if(F.col("p").isNull()).alias("up"))
    return bad.filter((F.col("lo") != F.col("hi")) | (F.col("lo") >= F.col("n")) | (F.col("lo").isNotNull() & (F.col("up") > 0))).isEmpty()


#: Edge tables of up to so many bytes on disk may be solved in one task.
ONE_TASK_BYTES = 4 << 20


def _one_task(batches):
    """Union-find over all edges of a bounded table."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> Table:
    """edges (a long, b long), either way round, repeats and loops allowed -> Table(node, root), root the
    smallest node of the component; nodes without edges are left out. DataFrame operations only."""
    now = stash(edges.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_star_forest(now.df):
            break
        big = stash(_large_star(now.df), "large")
        new = stash(_small_star(big.df), "small")
        big.drop()
        now.drop()
        now = new
    else:
        raise RuntimeError("components did not settle")
    out = stash(now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "roots")
    now.drop()
    return out


def components_of(tables: list[Table]) -> Table:
    """components of several written edge tables; while they are small by their measured size, in one task."""
    edges = tables[0].df
    for t in tables[1:]:
        edges = edges.unionByName(t.df)
    if sum(t.bytes for t in tables) <= ONE_TASK_BYTES:
        return stash(edges.filter("a <> b").coalesce(1).mapInArrow(_one_task, "node long, root long"), "roots")
    return components(edges)
