"""Substring dedup by level-wise doubling of repeated word windows.

A window of 2L words can repeat only where windows of L words inside it repeat. The search goes up
in levels: windows of half the wanted length give candidates, candidates extended to twice their
length are counted anew, and so on, until the wanted length, or until no candidates survive.

Level one keeps few of the half-length windows: of the half windows inside each wanted window, the
one of least hash. Which one that is depends on the wanted window's words alone, so two equal
windows keep equal halves, and a wanted window whose least half stands in one document only cannot
repeat. Copies of whole documents meet beforehand, as one class that its smallest doc_id stands for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, free_shuffles, pieces, stash, text_column
from .kernels import U64, buffers, mix, signed, slide, unsigned, white_table, window_hashes, word_hashes, words

WINDOW = 50


def _sequence_id(h: np.ndarray) -> int:
    """One number for a whole word sequence."""
    if len(h) == 0:
        return 0
    w = window_hashes(np.concatenate([h, np.array([len(h)], U64)]), len(h) + 1)
    return int(signed(w)[0])


def _scan(window: int):
    """(doc_id, text) -> (doc_id, n, seq, halves): the distinct least half windows of the document's windows."""
    half = window // 2

    def run(batches):
        for b in pieces(batches):
            data, off = buffers(b.column(1))
            s, e, first = words(data, off, white_table())
            h = word_hashes(data, s, e)
            low = slide(window_hashes(h, half), window - half + 1, np.minimum) if len(h) >= window else np.zeros(0, U64)
            new = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.zeros(0, bool)
            ns, seqs, halves = [], [], []
            for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                ns.append(z - a)
                if z - a < window:
                    seqs.append(None)
                    halves.append(None)
                    continue
                seqs.append(_sequence_id(h[a:z]))
                at = new[a : z - window + 1].copy()
                at[0] = True
                halves.append(signed(low[a : z - window + 1][at]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(seqs, pa.int64()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n", "seq", "halves"])

    return run


def _windows(window: int):
    """(doc_id, text, seq, halves that repeat) -> (doc_id, seq, pos, win): the candidate windows."""
    half = window // 2

    def run(batches):
        for b in pieces(batches):
            data, off = buffers(b.column(1))
            s, e, first = words(data, off, white_table())
            h = word_hashes(data, s, e)
            if len(h) < window:
                continue
            low = slide(window_hashes(h, half), window - half + 1, np.minimum)
            full = window_hashes(h, window)
            offsets = np.asarray(b.column(3).offsets)
            values = unsigned(b.column(3).values.to_numpy(zero_copy_only=False))
            seqs = b.column(2).to_pylist()
            ids = b.column(0).to_pylist()
            out = [[], [], [], []]
            for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if z - a < window or _sequence_id(h[a:z]) != seqs[i]:
                    continue
                keep = np.flatnonzero(np.isin(low[a : z - window + 1], values[offsets[i] : offsets[i + 1]]))
                if len(keep):
                    for o, v in zip(out, (ids[i], seqs[i], keep.astype(np.int32), signed(full[a + keep]))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64()))], names=["doc_id", "seq", "pos", "win"])

    return run


def _double(length: int):
    """(doc_id, seq, pos, win) of repeated windows -> the same of windows of twice the length, both halves of which repeat."""

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for d, q, pos, win in zip(*(c.to_pylist() for c in b.columns)):
                pos, win = np.array(pos, np.int64), np.array(win, np.int64)
                order = np.argsort(pos, kind="stable")
                pos, win = pos[order], win[order]
                at = np.searchsorted(pos, pos + length)
                at[at == len(pos)] = 0
                ok = pos[at] == pos + length
                if ok.any():
                    both = mix(unsigned(win[ok]) * U64(0x9E3779B97F4A7C15) + mix(unsigned(win[at[ok]])))
                    for o, v in zip(out, (d, q, pos[ok].astype(np.int32), signed(both))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64()))], names=["doc_id", "seq", "pos", "win"])

    return run


_LEVEL = "doc_id long, seq long, pos array<int>, win array<bigint>"


#: A window that more than one in so many starts of repeated windows is of meets its starts by a broadcast: there are fewer than so many such windows.
HOT = 256


def _repeats(level: DataFrame) -> Table:
    """(win, lo, n): windows that start in two documents or more, with the smallest doc_id and the number of starts."""
    w = level.select("doc_id", F.explode("win").alias("win"))
    return stash(w.groupBy("win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("win", "lo", "n"), "repeats")


def _starts(level: DataFrame, found: Table) -> DataFrame:
    """(doc_id, seq, pos, win, lo): each start of a found window. A passage that a third of all documents hold meets in no single task."""
    each = level.select("doc_id", "seq", F.explode(F.arrays_zip("pos", "win")).alias("z")).select("doc_id", "seq", "z.pos", "z.win")
    edge = (found.df.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = found.df.filter(F.col("n") > edge).select("win", F.col("lo").alias("hot"))
    marked = each.join(F.broadcast(hot), "win", "left")
    rest = marked.filter("hot is null").drop("hot").join(found.df.filter(F.col("n") <= edge).select("win", "lo"), "win")
    return marked.filter("hot is not null").withColumnRenamed("hot", "lo").unionByName(rest)


class Repeats:
    """Repeated windows of a table: `sources` has a row per distinct text (its smallest doc_id), `level` the
    candidate windows at the wanted length and `found` those that repeat."""

    def __init__(self, df: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"):
        if window < 2:
            raise ValueError("a window takes two words at least")
        self.spark, self.window = df.sparkSession, window
        self.docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(df, text).alias("text"))
        self.scan = stash(self.docs.mapInArrow(_scan(window), "doc_id long, n long, seq long, halves array<bigint>"), "scan")
        rows = self.scan.df.filter("seq is not null and doc_id is not null")
        self.classes = rows.groupBy("seq").agg(F.min("doc_id").alias("least"))
        lead = rows.join(self.classes.withColumnRenamed("least", "doc_id"), ["seq", "doc_id"])
        halves = stash(lead.select("doc_id", "seq", F.explode("halves").alias("half")).distinct(), "halves")
        twice = stash(halves.df.groupBy("half").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("half"), "twice")
        keep = stash(halves.df.join(twice.small(), "half").groupBy("doc_id", "seq").agg(F.collect_list("half").alias("halves")), "keep")
        halves.drop()
        # Two texts of one doc_id give two rows here, and rows that are not the text meant drop out by seq.
        texts = self.docs.join(keep.small(), "doc_id").select("doc_id", "text", "seq", "halves")
        self.level = stash(texts.mapInArrow(_windows(window), _LEVEL), "level")
        twice.drop()
        keep.drop()
        free_shuffles(self.spark)
        self.found = _repeats(self.level.df)

    def repeated(self) -> DataFrame:
        """(doc_id, seq, pos, win, lo): each start of a repeated window."""
        return _starts(self.level.df, self.found)

    def removals(self) -> Table:
        """(doc_id, verdicts): per doc_id with something to remove, its texts (seq) and window starts to remove (null: all)."""
        own = self.repeated().filter("doc_id > lo").select("doc_id", "seq", "pos").distinct().groupBy("doc_id", "seq").agg(F.collect_list("pos").alias("starts"))
        copies = self.scan.df.filter("seq is not null and doc_id is not null").select("doc_id", "seq").distinct().join(self.classes, "seq").filter("doc_id > least")
        every = own.unionByName(copies.select("doc_id", "seq", F.lit(None).cast("array<int>").alias("starts")))
        return stash(every.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "starts")).alias("verdicts")), "removals")

    def _reach(self, max_levels: int | None) -> DataFrame:
        """(doc_id, seq, longest): a row per level at which a window of the text repeats; level after level until no candidates survive."""
        length, now, out, turn = self.window, self.level, None, 0
        found = self.found
        while found.rows and (max_levels is None or turn <= max_levels):
            each = _starts(now.df, found)
            alive = stash(each.distinct().groupBy("doc_id", "seq").agg(F.collect_list(F.struct("pos", "win")).alias("z")).select("doc_id", "seq", F.col("z.pos").alias("pos"), F.col("z.win").alias("win")), "alive")
            reach = stash(alive.df.select("doc_id", "seq", F.lit(length).alias("longest")), "reach").df
            out = reach if out is None else out.unionByName(reach)
            if turn:
                now.drop()
                found.drop()
            now = stash(alive.df.mapInArrow(_double(length), _LEVEL), "level")
            alive.drop()
            free_shuffles(self.spark)
            found = _repeats(now.df)
            length, turn = 2 * length, turn + 1
        if out is None:
            return self.scan.df.select("doc_id", "seq", F.lit(0).alias("longest")).limit(0)
        return out

    def levels(self, max_levels: int | None = None) -> DataFrame:
        """(doc_id, longest): the longest length of the doubling sequence at which a window of the document
        repeats; goes on until no candidates survive or max_levels doublings are done."""
        return self._reach(max_levels).groupBy("doc_id").agg(F.max("longest").alias("longest"))

    def lengths(self) -> Table:
        """(seq, longest): the same by text, whole copies having the same."""
        return stash(self._reach(None).groupBy("seq").agg(F.max("longest").cast("long").alias("longest")), "lengths")


def _apply(window: int, with_text: bool, with_seq: bool):
    """(doc_id, text, verdicts) -> (doc_id, n_words, n_removed, kept_sha256[, kept_text][, seq])."""

    def run(batches):
        table = white_table()
        for b in pieces(batches):
            texts = b.column(1).to_pylist()
            verdicts = b.column(2).to_pylist()
            ns, gone, shas, kept = [], [], [], []
            for text, v in zip(texts, verdicts):
                seq = text.encode().split() if text else []
                ns.append(len(seq))
                if v and len(seq) >= window:
                    arr = pa.array([text], pa.string())
                    data, off = buffers(arr)
                    s, e, _ = words(data, off, table)
                    own = _sequence_id(word_hashes(data, s, e))
                    hit = [x["starts"] for x in v if x["seq"] == own]
                    if any(x is None for x in hit):
                        seq = []
                    elif hit:
                        edge = np.zeros(len(seq) + 1, np.int64)
                        for x in hit:
                            starts = np.unique(np.array(x, np.int64))
                            edge[starts] += 1
                            edge[starts + window] -= 1
                        stay = np.cumsum(edge[:-1]) == 0
                        seq = [w for w, k in zip(seq, stay.tolist()) if k]
                gone.append(ns[-1] - len(seq))
                rest = b" ".join(seq)
                shas.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode())
            if with_seq:
                data, off = buffers(b.column(1))
                s, e, first = words(data, off, table)
                h = word_hashes(data, s, e)
                seqs = [_sequence_id(h[a:z]) if z - a >= window else None for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
            cols = [b.column(0), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            if with_seq:
                cols.append(pa.array(seqs, pa.int64()))
                names.append("seq")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(df: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, with_longest: bool = False) -> DataFrame:
    """Per row of df: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text, after removing each
    word covered by a window of `window` words that also starts in a document of smaller doc_id. If asked,
    `longest`: of the lengths window, 2 * window, .. the greatest at which a window of the text also
    stands in a document of other text (0: none); the levels go on until no candidates survive.

    Equality of windows and texts is that of 64-bit hashes. Null and empty texts have no words. Rows of
    null doc_id are kept whole and make nothing else go. Texts of one doc_id don't remove each other.
    """
    found = Repeats(df, window, doc_id, text)
    gone = found.removals()
    # Both sides grow with the input: shuffled at every size.
    rows = found.docs.join(gone.df, "doc_id", "left").select("doc_id", "text", "verdicts")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "") + (", seq long" if with_longest else "")
    kept = stash(rows.mapInArrow(_apply(window, with_text, with_longest), out), "kept").df
    if not with_longest:
        return kept
    return kept.join(found.lengths().small(), "seq", "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long"))).drop("seq")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False, with_longest=True)


#: Lengths for the twin: enough doublings for texts of 51,199 words.
_LENGTHS = [WINDOW * 2**i for i in range(11)]
_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, hash(array_to_string(w[p : p + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS lo FROM g GROUP BY s),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS q FROM g JOIN m USING (s) WHERE doc_id > lo),
r AS (SELECT doc_id, count(*) AS n, list(q) AS qs FROM x GROUP BY doc_id),
u AS (SELECT d.doc_id, unnest(w) AS v, unnest(generate_series(1, len(w))) AS q FROM d),
k AS (SELECT u.doc_id, string_agg(v, ' ' ORDER BY u.q) AS t FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.q = x.q WHERE x.q IS NULL GROUP BY u.doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS least FROM d WHERE len(w) >= 50),
g50 AS (SELECT g.doc_id, p, s FROM g JOIN c USING (doc_id) WHERE doc_id = least),
""" + ",\n".join(
    f"g{2 * n} AS (SELECT doc_id, p, hash(s, t) AS s FROM (SELECT doc_id, p, s, lead(s, {n}) OVER (PARTITION BY doc_id ORDER BY p) AS t FROM g{n}) WHERE t IS NOT NULL)" for n in _LENGTHS[:-1]
) + r""",
a AS (""" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, {n} AS longest FROM g{n} JOIN (SELECT s FROM g{n} GROUP BY s HAVING count(DISTINCT doc_id) > 1) USING (s)" for n in _LENGTHS) + r"""),
b AS (SELECT c.doc_id, max(longest) AS longest FROM c JOIN a ON a.doc_id = c.least GROUP BY c.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN b ON d.doc_id = b.doc_id
"""

QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES = {"op3_substring_dedup": _ORACLE}
