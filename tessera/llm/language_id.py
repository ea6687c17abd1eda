"""Language identification by prediction by partial matching.

Per language, a context tree over byte symbols up to order ORDER with counts from all training texts.
The probability of a symbol after a context is PPM's (escape method C): seen symbols of the longest
context known to the language share its counts, an escape goes to the next shorter context, and so on
down to a uniform law. Statistics are frozen after training, so the code length of every (context,
symbol) is a constant. All languages' trees share one set of states: a state per context kept in any
tree, found by the last ORDER symbols. Each language has the exact code lengths in nats of its own contexts
and symbols, and for every state the row of its longest suffix among them, so that tables grow with the languages and
not with their square. Scoring a text adds up code lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, pieces, stash, text_column
from .kernels import buffers

ORDER = 3
#: Occurrences below which a symbol after a full-order context is not kept (its escape stands in); lower orders count all.
MIN_COUNT = 2
#: Held out are documents whose crc32(doc_id as text) mod FOLDS is FOLD.
FOLDS, FOLD = 4, 2


def symbols() -> tuple[np.ndarray, int]:
    """byte -> symbol, and how many symbols: letters without case, digits and white space and other ASCII as one
    each, and every byte from 80 on its own."""
    t = np.zeros(256, np.uint8)
    t[0x21:0x80] = 1
    t[0x30:0x3A] = 2
    for i in range(26):
        t[0x41 + i] = t[0x61 + i] = 3 + i
    t[0x27] = 29
    t[0x80:] = np.arange(30, 30 + 128)
    return t, 158


def _grams(data: np.ndarray, off: np.ndarray, table: np.ndarray, order: int):
    """Per byte: its symbol and the codes of the `order` symbols before it (0, white space, before a text's start)."""
    s = table[data].astype(np.int64)
    before = []
    for k in range(1, order + 1):
        p = np.zeros(len(s), np.int64)
        p[k:] = s[:-k]
        for j in range(k):
            edge = off[:-1] + j
            p[edge[edge < off[1:]]] = 0
        before.append(p)
    return s, before


def _count(order: int):
    """(lang, text) -> (lang, gram, n): occurrences of (order symbols, next symbol) by language, summed per task as far as memory goes."""

    def run(batches):
        table, n_sym = symbols()
        held: dict[str, list] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                g = np.concatenate([p[0] for p in parts])
                c = np.concatenate([p[1] for p in parts])
                o = np.argsort(g, kind="stable")
                g, c = g[o], c[o]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                held[lang] = [(g[first], np.add.reduceat(c, first))]

        def out():
            for lang, parts in held.items():
                for g, c in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

        for b in pieces(batches):
            langs = np.array(b.column(0).to_pylist(), object)
            data, off = buffers(b.column(1))
            if len(data) == 0:
                continue
            s, before = _grams(data, off, table, order)
            g = before[-1]
            for p in before[-2::-1]:
                g = g * n_sym + p
            g = (g * n_sym + s).astype(np.uint32)
            for lang in set(langs.tolist()):
                rows = np.flatnonzero(langs == lang)
                x = np.sort(np.concatenate([g[off[i] : off[i + 1]] for i in rows]))
                if len(x) == 0:
                    continue
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                held.setdefault(lang, []).append((x[first], np.diff(np.append(first, len(x)))))
                size += len(first)
            if size > 4_000_000:
                merged()
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size > 2_000_000:
                    yield from out()
                    held, size = {}, 0
        if held:
            merged()
            yield from out()

    return run


class Model:
    """The compiled trees: languages, transition from the last symbols, code lengths."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, lower: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """counts: per language, sorted (order + 1)-grams as numbers and how often each came. lower: the same of
        `order`-grams, from which all lower orders are counted; where it is None, counts holds every gram."""
        self.table, n_sym = symbols()
        self.n_sym, self.order = n_sym, order
        self.langs = sorted(counts if lower is None else lower)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        trees = [self._tree(counts.get(k, none), counts[k] if lower is None else lower[k]) for k in self.langs]
        # States: per depth, all contexts of any language; the root is state 0.
        self.contexts = [np.zeros(1, np.int64)] + [np.unique(np.concatenate([np.zeros(0, np.int64), *[t[d][0] for t in trees]])) for d in range(1, order + 1)]
        base = np.cumsum([0] + [len(c) for c in self.contexts])
        #: Per language: code lengths of its own contexts (row by symbol), and per state the row of its longest suffix among these.
        self.compiled = [self._compile(tree) for tree in trees]
        # Transition: the state of the longest suffix of the last symbols, dense in all of them but the oldest.
        self.goto = np.zeros(n_sym**order, np.int32) if order else np.zeros(1, np.int32)
        for d in range(1, order + 1):
            # A context of depth d is the last d symbols: all codes with that remainder.
            step = n_sym**d
            view = self.goto.reshape(-1, step)
            view[:, self.contexts[d]] = (base[d] + np.arange(len(self.contexts[d]))).astype(np.int32)

    def _tree(self, full, lower):
        """Per depth d: (sorted contexts, row starts, symbols, counts); of the full order from `full`, of the others from `lower`."""
        n_sym, order = self.n_sym, self.order
        tree = []
        for d in range(order + 1):
            grams, n = full if d == order else lower
            key = grams.astype(np.int64) % n_sym ** (d + 1)
            o = np.argsort(key, kind="stable")
            key_s, c = key[o], n[o]
            first = np.flatnonzero(np.concatenate([[True], key_s[1:] != key_s[:-1]])) if len(key_s) else np.zeros(0, int)
            key_u, c_u = key_s[first], np.add.reduceat(c, first) if len(first) else c
            if d == order:
                keep = c_u >= MIN_COUNT
                key_u, c_u = key_u[keep], c_u[keep]
            u, starts = np.unique(key_u // n_sym, return_index=True)
            tree.append((u, np.append(starts, len(key_u)), key_u % n_sym, c_u.astype(np.float64)))
        return tree

    def _compile(self, tree):
        """(code lengths by own context and symbol, row of each state), shortest contexts first: a context unknown to the language has its suffix's row."""
        n_sym = self.n_sym
        rows = np.full((1, n_sym), np.log(n_sym))
        places = []
        for d, (u, starts, sym, c) in enumerate(tree):
            ctx = self.contexts[d]
            if d == 0:
                place = np.zeros(1, np.int32)
            else:
                place = places[-1][np.searchsorted(self.contexts[d - 1], ctx % n_sym ** (d - 1))].copy()
            if len(u):
                at = np.searchsorted(ctx, u)
                total, kinds = np.add.reduceat(c, starts[:-1]), np.diff(starts)
                new = rows[place[at]] + np.log((total + kinds) / kinds)[:, None]
                row = np.repeat(np.arange(len(u)), kinds)
                new[row, sym] = np.log((total + kinds)[row] / c)
                place[at] = len(rows) + np.arange(len(u), dtype=np.int32)
                rows = np.concatenate([rows, new])
            places.append(place)
        return rows.astype(np.float32).ravel(), np.concatenate(places)

    @property
    def cost(self) -> np.ndarray:
        """The code length of every (state, symbol) by language, in one table."""
        return np.stack([rows.reshape(-1, self.n_sym)[place].ravel() for rows, place in self.compiled], axis=1)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in nats of each text under each language (rows by text)."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if len(data) == 0 or not self.langs:
            return out
        s, before = _grams(data, off, self.table, self.order)
        code = before[-1]
        for p in before[-2::-1]:
            code = code * self.n_sym + p
        state = self.goto[code]
        full = off[:-1] < off[1:]
        for k, (rows, place) in enumerate(self.compiled):
            out[full, k] = np.add.reduceat(rows[place[state].astype(np.int64) * self.n_sym + s], off[:-1][full], dtype=np.float64)
        return out


def _by_lang(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(lang, gram, n) -> per language, sorted grams and their counts."""
    got = counts.toArrow()
    codes = np.array(got.column("lang").to_pylist(), object)
    grams, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    out = {}
    for k in sorted(set(codes.tolist())):
        m = codes == k
        o = np.argsort(grams[m], kind="stable")
        out[k] = (grams[m][o], n[m][o])
    return out


def train(df: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> Model:
    """Counts of all rows with a language and a text -> the frozen model. All lower orders count every gram; of the
    full order every gram of MIN_COUNT occurrences reaches the driver. Both are bounded by the alphabet: symbols ** order
    and symbols ** (order + 1) numbers per language."""
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), text_column(df, text).alias("text")).filter("lang is not null and text is not null")
    counts = stash(rows.mapInArrow(_count(order), "lang string, gram long, n long"), "grams")
    total = stash(counts.df.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    full = _by_lang(total.df.filter(F.col("n") >= MIN_COUNT))
    lower = _by_lang(total.df.groupBy("lang", (F.col("gram") % symbols()[1] ** max(order, 1)).alias("gram")).agg(F.sum("n").alias("n")))
    counts.drop()
    total.drop()
    return Model(full, order, lower)


def predict(df: DataFrame, model: Model, keep=(), text: str = "text") -> DataFrame:
    """Per row of df: `keep` columns, lang_pred and score (posterior of the prediction under equal priors, from code
    lengths per byte at the reach of 200 bytes). `und` with score 0 for null texts, texts without a letter and an empty model."""
    spark = df.sparkSession
    held = Shipped(spark, model)
    rows = df.select(F.coalesce(text_column(df, text), F.lit("")).alias("text"), F.coalesce(text_column(df, text).rlike("\\p{L}"), F.lit(False)).alias("_letter"), *[c if not isinstance(c, str) else F.col(f"`{c}`") for c in keep])

    def kernel(batches):
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for b in pieces(batches):
            data, off = buffers(b.column(0))
            cost = m.score(data, off)
            letter = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if m.langs:
                best = cost.argmin(axis=1)
                size = np.maximum(np.diff(off), 1)
                gap = (cost - cost.min(axis=1, keepdims=True)) * (np.minimum(size, 200) / size)[:, None]
                p = 1.0 / np.exp(-gap).sum(axis=1)
                best, p = np.where(letter, best, len(m.langs)), np.where(letter, p, 0.0)
            else:
                best, p = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(names[best].tolist(), pa.string()), pa.array(p, pa.float64())], names=[*b.schema.names[2:], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return stash(rows.mapInArrow(kernel, f"{fields + ', ' if fields else ''}lang_pred string, score double"), "langs").df


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo FOLDS (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows of df that are not held out and have a language; predict all: doc_id, held_out, lang_pred, score.

    Nulls in any column are fine; repeated rows count as often as they come; an empty table gives an empty one.
    """
    col = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None)
    rows = df.select(col(doc_id).cast("long").alias("doc_id"), text_column(df, text).alias("text"), col(lang).cast("string").alias("lang"), held_out(col(doc_id)).alias("held_out"))
    model = train(rows.filter("not held_out"))
    return predict(rows, model, keep=("doc_id", "held_out"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_language_id": op4_language_id}
