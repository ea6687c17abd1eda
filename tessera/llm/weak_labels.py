"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns (there are at most 3 ** labellers) estimates each labeller's vote
probabilities given the hidden class, and the posterior of each pattern. Posteriors of a bounded
sample of documents train a logistic scorer on hashed byte trigrams, which then scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stash, text_column
from .kernels import buffers, lower_table, white_table, window_hashes, word_hashes, words

#: Documented bound: documents that train the scorer, those of least hash.
TRAIN_ROWS = 6_000
BUCKET_BITS = 12
VARIETY = 12
THRESHOLD = 0.5

#: Fixed values of the labellers: (name, bad at or beyond, good at or beyond); the statistic grows with badness unless bad < good.
LABELLERS = (
    ("symbols", 0.3, 0.05),  # characters of # * $ % & | < > per word
    ("capitals", 0.5, 0.15),  # A-Z among ASCII letters
    ("shouts", 0.3, 0.02),  # exclamation marks per word
    ("repeats", 0.5, 0.2),  # share of 3-word windows that came before in the text
    ("words", 20, 80),
    ("word_size", 16.0, 9.0),  # mean bytes of a word
    ("lines", 0.3, 0.02),  # share of lines that came before in the text
    ("odd_words", 0.4, 0.1),  # share of words that hold a sign of # * $ % & | < > ! = { } or nothing else than signs
    ("top_word", 0.25, 0.12),  # share of the most frequent word
    ("variety", 0.5, 0.7),  # log of different words per log of words
    ("letters", 0.7, 0.85),  # letters and bytes from 80 among the bytes of words
)
GOOD, BAD, NONE = 1, 0, 2


def statistics(arr) -> np.ndarray:
    """A row of labeller statistics per text; texts without words have none but their count."""
    data, off = buffers(arr)
    n = len(arr)
    out = np.zeros((n, len(LABELLERS)))
    if len(data) == 0:
        return out
    s, e, first = words(data, off, white_table())
    n_words = np.diff(first)
    per = np.maximum(n_words, 1)
    full = off[:-1] < off[1:]

    def total(mask):
        t = np.zeros(n)
        t[full] = np.add.reduceat(mask.astype(np.int64), off[:-1][full])
        return t

    sym = np.zeros(256, bool)
    sym[[ord(c) for c in "#*$%&|<>"]] = True
    upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
    caps = total(upper)
    out[:, 0] = total(sym[data]) / per
    out[:, 1] = caps / np.maximum(caps + total(lower), 1)
    out[:, 2] = total(data == 0x21) / per
    h = word_hashes(data, s, e, lower_table())
    g = window_hashes(h, 3)
    line = np.ones(256, bool)
    line[0x0A] = False
    ls, le, lfirst = words(data, off, line)
    lh = word_hashes(data, ls, le)
    for i in range(n):
        a, z = int(first[i]), int(first[i + 1])
        if z - a >= 3:
            x = np.sort(g[a : z - 2])
            out[i, 3] = np.count_nonzero(x[1:] == x[:-1]) / len(x)
        if z - a >= 2:
            x = np.sort(h[a:z])
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            out[i, 8] = np.diff(at).max() / (z - a)
            out[i, 9] = np.log(len(at) - 1) / np.log(z - a)
        p, q = int(lfirst[i]), int(lfirst[i + 1])
        if q - p > 1:
            x = np.sort(lh[p:q])
            out[i, 6] = np.count_nonzero(x[1:] == x[:-1]) / len(x)
    out[:, 4] = n_words
    odd = sym.copy()
    odd[[ord(c) for c in "!={}"]] = True
    alpha = upper | lower | (data >= 0x80)
    held = np.concatenate([[0], np.cumsum(odd[data])])
    real = np.concatenate([[0], np.cumsum(alpha)])
    strange = np.concatenate([[0], np.cumsum((held[e] > held[s]) | (real[e] == real[s]))])
    out[:, 7] = (strange[first[1:]] - strange[first[:-1]]) / per
    size = np.concatenate([[0], np.cumsum(e - s)])
    out[:, 10] = total(alpha) / np.maximum(size[first[1:]] - size[first[:-1]], 1)
    out[:, 5] = (size[first[1:]] - size[first[:-1]]) / per
    return out


def votes(stats: np.ndarray) -> np.ndarray:
    out = np.full(stats.shape, NONE, np.int64)
    for k, (_, bad, good) in enumerate(LABELLERS):
        x = stats[:, k]
        out[(x >= bad) if bad > good else (x < bad), k] = BAD
        out[(x <= good) if bad > good else (x >= good), k] = GOOD
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-10):
    """EM for two hidden classes: (prior of good, vote probabilities [labeller, class, vote], posterior of good per pattern).

    Starts from any bad vote against none. A vote that a labeller withholds says nothing. With no documents the prior is a half.
    """
    n, m = patterns.shape
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    post = np.where(bad > 0, 0.2, np.where(good > 0, 0.95, 0.5)).astype(float)
    prior, table = 0.5, np.full((m, 2, 2), 0.5)
    weight = counts.astype(float)
    for _ in range(rounds if n else 0):
        prior = float((post * weight).sum() + 1) / float(weight.sum() + 2)
        for k in range(m):
            for c, p in ((GOOD, post), (BAD, 1 - post)):
                hit = np.array([(weight * p * (patterns[:, k] == v)).sum() + 1.0 for v in (BAD, GOOD)])
                table[k, c] = hit / hit.sum()
        logit = np.full(n, np.log(prior / (1 - prior)))
        for k in range(m):
            for v in (BAD, GOOD):
                logit += (patterns[:, k] == v) * np.log(table[k, GOOD, v] / table[k, BAD, v])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < tolerance:
            post = new
            break
        post = new
    return prior, table, post


def trigram_buckets(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A bucket per byte: the hash of it and the two before it in its text (letters' case kept, digits as one)."""
    fold = np.arange(256, dtype=np.uint8)
    fold[0x30:0x3A] = 0x30
    b = fold[data].astype(np.uint32)
    g = b.copy()
    g[1:] += b[:-1] << np.uint32(8)
    g[2:] += b[:-2] << np.uint32(16)
    for j in (0, 1):
        edge = off[:-1] + j
        edge = edge[edge < off[1:]]
        g[edge] &= np.uint32(0xFF if j == 0 else 0xFFFF)
    g *= np.uint32(0x9E3779B1)
    return (g >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _features(arr):
    """Per text: (buckets, square roots of their shares), and a bucket for how many different trigrams it has for its length."""
    data, off = buffers(arr)
    b = trigram_buckets(data, off) if len(data) else np.zeros(0, np.int64)
    for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
        c = np.bincount(b[a:z], minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(c)
        if len(at) == 0:
            yield at, c[at] * 1.0
            continue
        variety = min(int(VARIETY * np.sqrt(len(at) / min(z - a, 1 << BUCKET_BITS))), VARIETY - 1)
        yield np.append(at, (1 << BUCKET_BITS) + variety), np.append(np.sqrt(c[at] / (z - a)), 0.5)


def fit(examples, targets: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4):
    """Logistic regression on sparse rows with soft targets, by full-batch Adagrad: (weights, bias)."""
    w, b = np.zeros((1 << BUCKET_BITS) + VARIETY), 0.0
    rows = [r for r in examples if len(r[0])]
    y = np.array([t for r, t in zip(examples, targets) if len(r[0])], float)
    if not rows:
        return w, b
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    start = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(rows)), size)
    hist, hb = np.full(len(w), 1e-8), 1e-8
    # Both classes weigh alike.
    mass = np.array([(1 - y).sum() + 1, y.sum() + 1])
    each = (1 - y) / mass[0] + y / mass[1]
    each /= each.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[at] * x, start) + b, -30, 30)))
        r = (p - y) * each
        g = np.bincount(at, weights=x * r[doc], minlength=len(w)) + ridge * w
        hist += g * g
        w -= rate * 0.1 * g / np.sqrt(hist)
        hb += r.sum() ** 2
        b -= rate * 0.1 * r.sum() / np.sqrt(hb)
    return w, b


def _vote_kernel(batches):
    for b in pieces(batches):
        v = votes(statistics(b.column(1)))
        code = v @ (3 ** np.arange(v.shape[1]))
        yield pa.RecordBatch.from_arrays([*[b.column(0)], pa.array(code, pa.int32()), b.column(2)], names=["doc_id", "pattern", "h"])


def classify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of df: doc_id, label (posterior of good from the votes), score (of the scorer, 0 to 1) and kept.

    Null and empty texts score 0 and are not kept. Repeated rows vote as often as they come. An empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(text_column(df, text), F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    voted = stash(hashed.mapInArrow(_vote_kernel, "doc_id long, pattern int, h long"), "votes")
    got = voted.df.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    m = len(LABELLERS)
    patterns = np.array([[r["pattern"] // 3**k % 3 for k in range(m)] for r in got], np.int64).reshape(-1, m)
    _, _, post = label_model(patterns, np.array([r["n"] for r in got], float))
    posterior = dict(zip([r["pattern"] for r in got], post.tolist()))
    # The rows of least hash, repeated ones once: a bounded sample, the same in every run, whatever the table's size.
    edge = voted.df.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    sample = hashed.filter(F.col("h") <= F.lit(edge) if edge is not None else F.lit(False)).dropDuplicates(["h"])

    def examples(batches):
        for b in pieces(batches):
            v = votes(statistics(b.column(1)))
            f = list(_features(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v @ (3 ** np.arange(v.shape[1])), pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in f], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in f], pa.binary())],
                names=["pattern", "at", "x"],
            )

    train = stash(sample.mapInArrow(examples, "pattern int, at binary, x binary"), "train").df.collect()
    data = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in sorted(train, key=lambda r: (r["pattern"], bytes(r["at"]), bytes(r["x"])))]
    target = np.array([posterior[p] for p in sorted(r["pattern"] for r in train)])
    held = spark.sparkContext.broadcast((*fit(data, target), posterior))

    def score(batches):
        w, bias, post = held.value
        for b in pieces(batches):
            v = votes(statistics(b.column(1)))
            code = v @ (3 ** np.arange(v.shape[1]))
            p = []
            for at, x in _features(b.column(1)):
                p.append(1 / (1 + np.exp(-np.clip(float(w[at] @ x) + bias, -30, 30))) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([post.get(c, 0.5) for c in code.tolist()], pa.float64()), pa.array(p, pa.float64())], names=["doc_id", "label", "score"])

    out = stash(rows.mapInArrow(score, "doc_id long, label double, score double"), "scored").df
    return out.withColumn("kept", F.col("score") >= THRESHOLD)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
