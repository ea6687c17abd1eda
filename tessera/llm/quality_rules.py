"""Quality rules: Gopher-style base rules, and robust multivariate outliers by minimum covariance determinant.

Everything here is DataFrame expressions. Each text becomes a few counts and a vector of transformed
statistics. Per group (language and source) the MCD estimate starts from two deterministic subsets
(coordinate-wise median and MAD distances, squared and summed; the same clipped, in absolute value) and
takes concentration steps: the rows within the h-quantile of the current Mahalanobis distances give
the next mean and covariance. The start of smaller determinant wins. Distances come from a Cholesky
factor written out as column expressions, so no row leaves the JVM and no group meets in one task:
a step is a quantile sketch and sums, both combined before the shuffle.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, stash, text_column

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of rows a concentration step keeps, steps per start, and rows below which a group uses all documents' estimate.
SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 60
#: Share of clean documents that the cutoff may reject. Transformed text statistics have longer tails than the normal law
#: behind the usual chi-square quantile: the logarithm of their squared robust distances is about normal. Its centre is each
#: group's own median, its spread that of all rows around their group's, by the median absolute deviation; neither follows
#: the outliers while they are fewer than half.
TAIL = 2e-4
#: Least centre and spread of the logarithm: a squared distance of 1, and the spread of a chi-square of DIM degrees.
LEAST_CENTRE, LEAST_SPREAD = 0.0, 0.7
#: Smallest standard deviation per coordinate, in units of the transformed statistics.
FLOORS = (0.05, 0.15, 0.15, 0.15, 0.03)

DIM = len(FLOORS)


def text_counts(text: Column) -> dict[str, Column]:
    """Contract counts of one text, null as empty: words, their characters, symbols, duplicate lines, words in repeated 3-word windows."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {"words": words, "lines": lines, "symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))}


def _sorted_windows(words: Column, n: Column) -> Column:
    """Hashes of all 3-word windows with their starts, sorted: equal windows are neighbours."""
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)).cast("int")), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))


def with_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns of df and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (longs)."""
    c = text_counts(text_column(df, text))
    a = df.select(*keep, c["words"].alias("_w"), c["lines"].alias("_l"), c["symbols"].cast("long").alias("n_symbols"))
    a = a.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_lines", F.size("_l").cast("long"))
    a = a.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_l")))
    a = a.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    a = a.withColumn("_s", F.when(F.col("n_words") >= 3, _sorted_windows(F.col("_w"), F.col("n_words"))))
    # Of a sorted list of windows, those equal to a neighbour.
    # Their starts, sorted, each add the words their window has before the next one starts.
    n = F.size("_s")
    prev = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.col("_s.h"), 1, n - 1))
    succ = F.concat(F.slice(F.col("_s.h"), 2, n - 1), F.array(F.lit(None).cast("long")))
    near = F.filter(F.arrays_zip(F.col("_s.h").alias("h"), F.col("_s.i").alias("i"), prev.alias("p"), succ.alias("q")), lambda z: z["h"].eqNullSafe(z["p"]) | z["h"].eqNullSafe(z["q"]))
    a = a.withColumn("_d", F.sort_array(F.transform(near, lambda z: z["i"])))
    m = F.size("_d")
    gaps = F.zip_with(F.slice("_d", 2, F.greatest(m - 1, F.lit(0))), F.slice("_d", 1, F.greatest(m - 1, F.lit(0))), lambda x, y: F.least(x - y, F.lit(3)))
    a = a.withColumn("n_repeat_words", F.when(m > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0).cast("long"))
    return a.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PERCENT)


def vector() -> list[Column]:
    """The transformed statistics: logs of ratios, which hardly depend on a text's length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")

    return [
        F.log(chars / n),
        F.log1p(F.col("n_symbols") * 100.0 / n),
        F.log1p(F.col("n_dup_lines") * 10.0 / lines),
        F.log1p(F.col("n_repeat_words") * 10.0 / n),
        F.least(F.log(n / lines), F.lit(9.0)) * 0.1,
    ]


_X = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _estimate(df: DataFrame, key: str) -> DataFrame:
    """key, n, m0.., c00..: mean and floored covariance of the rows, by group."""
    sums = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)], *[F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in _PAIRS]
    )
    cov = [(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in _PAIRS]
    return sums.select(key, "n", *[f"m{i}" for i in range(DIM)], *cov)


def _factor(est: DataFrame, key: str) -> DataFrame:
    """The estimate with the lower Cholesky factor l00.. of its covariance and its log determinant, column by column."""
    out = est
    for j in range(DIM):
        s = F.col(f"c{j}{j}")
        for k in range(j):
            s = s - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(s, F.lit(1e-8))))
        for i in range(j + 1, DIM):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", s / F.col(f"l{j}{j}"))
    det = F.lit(0.0)
    for j in range(DIM):
        det = det + 2.0 * F.log(F.col(f"l{j}{j}"))
    return out.withColumn("logdet", det).select(key, "n", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i, j in _PAIRS], "logdet")


def _distance(df: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """df (x.., m.., l..) with d2: forward substitution through the factor."""
    out = df
    for i in range(DIM):
        s = F.col(_X[i]) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", s / F.col(f"l{i}{i}"))
    d2 = F.lit(0.0)
    for i in range(DIM):
        d2 = d2 + F.col(f"z{i}") * F.col(f"z{i}")
    return out.withColumn("d2", d2 / scale)


def _steps(rows: Table, start: DataFrame, key: str) -> Table:
    """Concentration steps from a frame (key, x.., d2) of starting distances -> factored estimates per group."""
    now, est = start, None
    for step in range(STEPS):
        cut = now.groupBy(key).agg(F.percentile_approx("d2", SUPPORT, 2000).alias("cut"))
        cut = stash(cut, "cut")
        old = est
        est = stash(_factor(_estimate(now.join(cut.small(), key).filter("d2 <= cut"), key), key), "est")
        cut.drop()
        if old is not None:
            old.drop()
        now = _distance(rows.df.join(est.small(), key)).select(key, *_X, "d2")
    return est


def mcd(rows: Table, key: str) -> Table:
    """rows (key, x0..) -> per key the better of two MCD estimates with the distance scale that makes the
    median squared distance that of a normal sample, and the cutoff of the scaled squared distance (see TAIL)."""
    med = [F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(_X)]
    centre = stash(rows.df.groupBy(key).agg(*med), "centre")
    dev = rows.df.join(centre.small(), key).select(key, *_X, *[f"m{i}" for i in range(DIM)])
    spread = stash(dev.groupBy(key).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"a{i}") for i, x in enumerate(_X)]), "spread")
    z = dev.join(spread.small(), key)
    units = [(F.col(x) - F.col(f"m{i}")) / F.greatest(F.col(f"a{i}") * 1.4826, F.lit(FLOORS[i])) for i, x in enumerate(_X)]
    plain, clipped = F.lit(0.0), F.lit(0.0)
    for u in units:
        plain = plain + u * u
        clipped = clipped + F.least(F.abs(u), F.lit(2.5))
    starts = [z.select(key, *_X, d.alias("d2")) for d in (plain, clipped)]
    ends = [_steps(rows, s, key) for s in starts]
    both = ends[0].df.withColumn("turn", F.lit(0)).unionByName(ends[1].df.withColumn("turn", F.lit(1)))
    cols = [c for c in ends[0].df.columns if c != key]
    best = both.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("logdet", "turn")).alias("b")).select(key, "b.*")
    best = stash(best, "best")
    # Median of chi-square with DIM degrees, by the cube-root (Wilson-Hilferty) formula.
    median = DIM * (1 - 2 / (9 * DIM)) ** 3
    scale = _distance(rows.df.join(best.small(), key)).groupBy(key).agg((F.greatest(F.percentile_approx("d2", 0.5, 2000), F.lit(median)) / median).alias("scale"))
    scaled = stash(best.df.join(scale, key), "scaled")
    logs = _distance(rows.df.join(scaled.small(), key), F.col("scale")).select(key, F.log(F.greatest("d2", F.lit(1e-12))).alias("log"))
    middle = stash(logs.groupBy(key).agg(F.greatest(F.percentile_approx("log", 0.5, 2000), F.lit(LEAST_CENTRE)).alias("middle")), "middle")
    off = logs.join(middle.small(), key).agg((F.percentile_approx(F.abs(F.col("log") - F.col("middle")), 0.5, 10_000) * 1.4826).alias("s"))
    z = NormalDist().inv_cdf(1 - TAIL)
    # One row.
    off = stash(off.select(F.greatest("s", F.lit(LEAST_SPREAD)).alias("s")), "off").df.scalar()
    out = stash(scaled.df.join(middle.df, key).withColumn("cutoff", F.exp(F.col("middle") + z * off)).drop("middle"), "mcd")
    for t in (centre, spread, best, scaled, middle, *ends):
        t.drop()
    return out


def score_documents(df: DataFrame, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of df: doc_id, the counts, base_failed, distance and cutoff (squared robust distances, null where base_failed) and kept,
    with the `carry` columns of df under their names.

    Null texts are empty and fail the base rules. Null lang or source is a group of its own; groups of
    under MIN_GROUP rows that pass the base rules are measured against the estimate of all such rows.
    Estimates use the rows that pass, repeated rows as often as they come. A frame without lang or source has one group.
    """
    spark = df.sparkSession
    col = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None)
    part = [col(doc_id).cast("long").alias("_doc"), F.xxhash64(col(lang).cast("string"), col(source).cast("string"), F.isnull(col(lang)), F.isnull(col(source))).alias("_g")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] if carry else []
    named = df.select(*part, *rest, text_column(df, text).alias("_text"))
    counted = with_counts(named, "_text", ["_doc", "_g", *(["_carry"] if carry else [])])
    scored = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    scored = stash(scored.select("*", *[v.alias(x) for v, x in zip(vector(), _X)]), "scored")
    good = scored.df.filter("not base_failed").select("_g", *_X)
    size = stash(good.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), "size")
    rows = stash(good.join(size.small(), "_g").filter(F.col("_n") >= MIN_GROUP).select("_g", *_X).unionByName(good.select(F.lit(None).cast("long").alias("_g"), *_X)).withColumn("_key", F.coalesce(F.col("_g").cast("string"), F.lit("all"))).drop("_g"), "vectors")
    est = mcd(rows, "_key")
    rows.drop()
    keyed = scored.df.join(size.small(), "_g", "left").withColumn("_key", F.when(F.col("_n") >= MIN_GROUP, F.col("_g").cast("string")).otherwise(F.lit("all")))
    est_cols = est.df.withColumnRenamed("n", "_support")
    est_small = F.broadcast(est_cols) if est.bytes <= (8 << 20) else est_cols
    out = _distance(keyed.join(est_small, "_key", "left"), F.col("scale"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.select(F.col("_doc").alias("doc_id"), *counts, "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("distance"), F.when(~F.col("base_failed"), F.col("cutoff")).alias("cutoff"), *(["_carry"] if carry else []))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True)))


def filter_documents(df: DataFrame, **names) -> DataFrame:
    """The rows of df that the rules keep, with df's columns."""
    return score_documents(df, carry=df.columns, **names).filter("kept").select("_carry.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cutoff")


QUERIES = {"op2_quality_rules": op2_quality_rules}
