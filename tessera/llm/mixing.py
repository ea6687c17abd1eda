"""Mixing sources to target weights by entropy balancing.

Document rates r minimise sum size * (r log r - r + 1) subject to each margin's token constraint: the
rates are exponential tilts exp(sum of the dual variables of a document's categories). The dual is
convex; Newton iterations solve it on sums per cell of categories, which are all that gradient and
Hessian need and which are distributed sums. Of one margin the Hessian is diagonal, so its iterations are column
expressions, category by category; several margins take joint steps with the whole Hessian. Rates become whole
copies by systematic rounding along documents sorted by size, so that copies and words both stay near
their expectation in every source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, text_column

#: Fixed values of the contract: weights by rank of the source, and most copies of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents of one source and size are ranked in so many parts.
SALT = 64
NEWTON_STEPS = 60
#: Documented bound: categories with a target, of all margins, whose dual is solved jointly.
CATEGORIES = 4096
#: Sizes that one first-level prefix sum covers.
SIZES = 32
WORD = "[^\\x20\\x09-\\x0D]+"


def text_size(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target: weights by rank share the total; a target stops at MOST times its
    source's size and the excess goes to the others by weight. One row per source is all that meets here.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS)).cast("int")).cast("long")
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    every = W.partitionBy(F.lit(1))
    # Caps bind in the order of cap / weight: a source is capped if its cap is no more than its share once all before it are.
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left_tokens", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("share", F.col("left_tokens").cast("double") / F.col("left_weight"))
    level = F.max(F.when(F.col("cap") / F.col("weight") > F.col("share"), F.struct("left_weight", "share"))).over(every)["share"]
    s = s.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return s.withColumn("target", target).select("source", "source_size", "target")


def _newton(start: Column, tokens: Column, target: Column) -> Column:
    """The dual variable with tokens * exp(dual) = target, from `start`: damped Newton steps g / h."""

    def step(lam, _):
        now = tokens * F.exp(lam)
        move = (now - target) / now
        return lam - F.greatest(F.lit(-2.0), F.least(move, F.lit(2.0)))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)
    return F.when((tokens > 0) & (target > 0), solved).when(tokens > 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))


def balance(cells: DataFrame, margins: dict[str, DataFrame], rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """Solve the dual: cells (one column per margin, tokens) and per margin a frame (column, target) -> cells
    with `rate`. Categories without a target row are free; null is a category like others. Margins must agree in their totals."""
    if len(margins) == 1:
        ((name, targets),) = margins.items()
        t = targets.select(F.col(name).alias("_c"), F.col("target").cast("double").alias("_t"))
        now = cells.groupBy(name).agg(F.sum(F.col("tokens").cast("double")).alias("_n"))
        dual = now.join(t, F.col(name).eqNullSafe(F.col("_c"))).select("_c", _newton(F.lit(0.0), F.col("_n"), F.col("_t")).alias("_d"))
        dual = stash(dual, "dual").df
        return cells.join(dual, F.col(name).eqNullSafe(F.col("_c")), "left").withColumn("rate", F.exp(F.coalesce("_d", F.lit(0.0)))).drop("_c", "_d")
    return _joint(cells, margins, rounds, tolerance)[0]


def _joint(cells: DataFrame, margins: dict[str, DataFrame], rounds: int, tolerance: float) -> tuple[DataFrame, int]:
    """Newton on all margins' dual variables at once: cells with `rate`, and how many steps it took.

    A step solves Hessian * step = target - sums; the sums of a step come from one aggregation of the cells per pair of
    margins, and numbers by category (CATEGORIES at most) reach the driver. Steps that do not lower the dual are halved.
    """
    spark, names = cells.sparkSession, list(margins)
    number, target = {}, []
    for m in names:
        rows = margins[m].select(m, F.col("target").cast("double")).distinct().collect()
        if len(target) + len(rows) > CATEGORIES:
            raise ValueError(f"more than {CATEGORIES} categories have a target")
        number[m] = [(r[0], len(target) + i) for i, r in enumerate(rows)]
        target += [r[1] for r in rows]
    held = cells
    for m in names:
        kind = cells.schema[m].dataType.simpleString()
        # At most CATEGORIES rows.
        at = spark.createDataFrame(number[m], f"`_c` {kind}, `_{m}` int")
        held = held.join(F.broadcast(at), F.col(m).eqNullSafe(F.col("_c")), "left").drop("_c")
    held = stash(held, "cells")
    target = np.array(target)
    dual, move, size = np.zeros(len(target)), np.zeros(len(target)), np.inf

    def tilted(x):
        df = held.df.withColumn("_log", F.lit(0.0))
        for m in names:
            values = spark.createDataFrame([(k, float(x[k])) for _, k in number[m]], f"`_k` int, `_{m}_x` double")
            df = df.join(F.broadcast(values), F.col(f"_{m}") == F.col("_k"), "left").drop("_k")
            df = df.withColumn("_log", F.col("_log") + F.coalesce(f"_{m}_x", F.lit(0.0))).drop(f"_{m}_x")
        return df.withColumn("_now", F.col("tokens") * F.exp("_log"))

    def sums(x):
        """The dual's value, gradient and Hessian."""
        now = tilted(x)
        parts = [now.groupBy(F.col(f"_{a}").alias("i"), F.col(f"_{b}").alias("j")).agg(F.sum("_now").alias("s")) for p, a in enumerate(names) for b in names[p:]]
        parts.append(now.agg(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.sum("_now").alias("s")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        h, total = np.zeros((len(x), len(x))), 0.0
        for i, j, s in every.filter("i is not null and j is not null").collect():
            if i < 0:
                total = s or 0.0
            else:
                h[i, j] = h[j, i] = s
        return total - target @ x, np.diag(h) - target, h

    step = 0
    value, gradient, hessian = sums(dual)
    for step in range(1, rounds + 1):
        if np.abs(gradient).max(initial=0.0) <= tolerance * max(target.max(initial=0.0), 1.0):
            step -= 1
            break
        # Margins that cover the same tokens make the Hessian singular along their constants: least squares.
        move = np.linalg.lstsq(hessian, -gradient, rcond=1e-12)[0]
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
        for _ in range(30):
            size, slope, curve = sums(dual + move)
            if size <= value + 1e-12 * abs(value):
                break
            move /= 2
        dual, value, gradient, hessian = dual + move, size, slope, curve
    return tilted(dual).withColumn("rate", F.exp("_log")).select(*cells.columns, "rate"), step


def rates_to_copies(rows: DataFrame, cell: str, rate: str, size: str, doc_id: str, text_hash: str) -> DataFrame:
    """rows with `copies`: along each cell's documents by (size, part, doc_id, text hash), copies are the steps of
    the rounded running sum of rates; the part is doc_id mod SALT, or for a null id SALT and more by the text's hash.
    Rows that agree in all of these are alike, so reruns give the same copies. Nulls are a cell of their own.

    Prefix sums go through counts per (cell, size, part), in two levels: per SIZES sizes of a cell, and inside these."""
    part = F.coalesce(F.pmod(F.col(doc_id), F.lit(SALT)), SALT + F.pmod(F.col(text_hash), F.lit(SALT))).cast("int")
    rows = rows.withColumn("_part", part).withColumn("_range", F.floor(F.col(size) / SIZES))
    keys = [cell, "_range", size, "_part"]
    counts = stash(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), "counts")
    before = lambda by, order: F.sum("_m").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_m")
    ranges = counts.df.groupBy(cell, "_range").agg(F.sum("_m").alias("_m")).select(F.col(cell).alias("_k0"), F.col("_range").alias("_k1"), before([cell], ["_range"]).alias("_base"))
    inner = counts.df.select(*keys, before([cell, "_range"], [size, "_part"]).alias("_inner"))
    first = inner.join(ranges, F.col(cell).eqNullSafe(F.col("_k0")) & (F.col("_range") == F.col("_k1"))).select(*keys, (F.col("_base") + F.col("_inner")).alias("_first"))
    f = stash(first, "first").small().select(F.col(cell).alias("_k0"), F.col(size).alias("_k1"), F.col("_part").alias("_k2"), "_first")
    counts.drop()
    ranked = rows.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(doc_id).asc_nulls_last(), text_hash)))
    ranked = ranked.join(f, F.col(cell).eqNullSafe(F.col("_k0")) & (F.col(size) == F.col("_k1")) & (F.col("_part") == F.col("_k2")))
    at = F.col("_first") + F.col("_i")
    r = F.round(F.col(rate), 9)
    copies = (F.floor(r * at + 0.5) - F.floor(r * (at - 1) + 0.5)).cast("long")
    return ranked.withColumn("copies", F.least(copies, F.lit(MOST).cast("long"))).drop("_part", "_range", "_first", "_i", "_k0", "_k1", "_k2")


def mix_plan(df: DataFrame, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of df: doc_id, size, source_size, target, rate, copies and taken, with `carry` columns as a struct.

    Null texts are of size 0 and take nothing. Null is a source, last in rank. Repeated rows are documents
    of their own. A frame without the source column is one source.
    """
    col = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None)
    rows = df.select(
        col(doc_id).cast("long").alias("doc_id"), col(source).cast("string").alias("source"), text_size(text_column(df, text)).alias("size"), F.xxhash64(text_column(df, text)).alias("_text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] if carry else []),
    )
    held = stash(rows, "sizes")
    cells = held.df.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stash(source_targets(cells), "targets")
    rated = balance(targets.df.select("source", F.col("source_size").alias("tokens")), {"source": targets.df.select("source", "target")})
    plan = targets.df.withColumnRenamed("source", "_s").join(rated.select(F.col("source").alias("_r"), "rate"), F.col("_s").eqNullSafe(F.col("_r"))).select("_s", "source_size", "target", "rate")
    plan = stash(plan, "plan").small()
    rows = held.df.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return rates_to_copies(rows, "source", "rate", "size", "doc_id", "_text").drop("_text").withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(df: DataFrame, **names) -> DataFrame:
    """df's rows, each as often as its copies say, with df's columns."""
    plan = mix_plan(df, carry=df.columns, **names).filter("copies > 0")
    return plan.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))), "_carry").select("_carry.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


_ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS lt, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS lw
      FROM s WINDOW b AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT CAST(lt AS DOUBLE) / lw AS level FROM o WHERE cap / CAST(weight AS DOUBLE) > CAST(lt AS DOUBLE) / lw ORDER BY lw DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * (SELECT level FROM l)) END AS target FROM o),
r AS (SELECT doc_id, size, source_size, target, round(CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END, 9) AS rate,
      row_number() OVER (PARTITION BY d.source ORDER BY size, coalesce(((doc_id % 64) + 64) % 64, 64), doc_id NULLS LAST) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST(size * least(3, floor(rate * k + 0.5) - floor(rate * (k - 1) + 0.5)) AS BIGINT) AS taken FROM r
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": _ORACLE}
