"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are the strings of one automaton over word numbers. Documents stream
through it; at every word the automaton knows the longest suffix of what was read that occurs in
any item, so each occurrence of a window (``window`` consecutive item words; a shorter item, if
not empty, is one window) ends at a word whose matched length reaches the window's.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shipped, pieces, stash, text_column
from .kernels import alnum_table, buffers, lower_table, word_hashes, words

WINDOW = 13
#: Item words in one automaton; more items go to further automata, each streamed over the documents.
SHARD_WORDS = 2_000_000
#: Words of a matching span above which it is cut from a document that stays.
SPAN_WORDS = 50


class Automaton:
    """A generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        """items: (item id as text, its words as numbers from 0)."""
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[int]] = [[] for _ in items]
        for k, (_, seq) in enumerate(items):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends[k].append(last)
        self._windows(items, ends)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def state_of(self, state: int, length: int) -> int:
        """The state of the suffix of `length` words of what `state` stands for."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _windows(self, items, ends) -> None:
        """whole[(state, length)]: the items of which that string is a window."""
        whole: dict[tuple[int, int], set[int]] = {}
        for k, (_, seq) in enumerate(items):
            if not seq:
                continue
            n = min(self.window, len(seq))
            for i in range(n - 1, len(seq)):
                whole.setdefault((self.state_of(ends[k][i], n), n), set()).add(k)
        self.whole = {s: frozenset(v) for s, v in whole.items()}
        self.lengths = sorted({n for _, n in whole}, reverse=True)

    def scan(self, seq) -> tuple[list[tuple[int, int]], set[int], int]:
        """seq: a document's run of word numbers (below 0: in no item). Returns hit spans (start, end
        exclusive, merged, ascending), the items with occurring windows, and the longest match."""
        nxt, link, length, whole, lengths = self.next, self.link, self.len, self.whole, self.lengths
        least = lengths[-1] if lengths else 1 << 30
        state = size = longest = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if (q := nxt[state].get(w)) is None:
                size = 0
                continue
            state = q
            size += 1
            if size > longest:
                longest = size
            if size < least:
                continue
            s, reach = state, 0
            for n in lengths:
                if n > size:
                    continue
                while length[link[s]] >= n:
                    s = link[s]
                if (items := whole.get((s, n))) is not None:
                    reach = max(reach, n)
                    found |= items
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found, longest


def _shards(benchmark: DataFrame, item_id: str, text: str, shard_words: int):
    """Driver-side shards of (item id, word hashes): the items are a stated, bounded table; each shard
    holds at most shard_words words beside one item."""
    lower, table = lower_table(), alnum_table()
    shard, n = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), text_column(benchmark, text).alias("t")).filter("i is not null")
    for r in rows.toLocalIterator():
        arr = pa.array([r["t"] or ""], pa.string())
        data, off = buffers(arr)
        s, e, _ = words(data, off, table)
        seq = word_hashes(data, s, e, lower).tolist()
        if n and n + len(seq) > shard_words:
            yield shard
            shard, n = [], 0
        shard.append((r["i"], seq))
        n += len(seq)
    yield shard


def _kernel(held, window: int, cut: int | None):
    """(id, text, carried ..) -> carried columns and what was found; with cut, the text without spans of more words than that (null where it has none)."""

    def run(batches):
        lower, table = lower_table(), alnum_table()
        vocab, auto, names = held.value
        least = auto.lengths[-1] if auto.lengths else 1 << 30
        for b in pieces(batches):
            data, off = buffers(b.column(1))
            s, e, first = words(data, off, table)
            h = word_hashes(data, s, e, lower)
            at = np.searchsorted(vocab, h)
            at[at == len(vocab)] = 0
            number = np.where(vocab[at] == h, at, -1) if len(vocab) else np.full(len(h), -1)
            n_words = np.diff(first)
            # Only runs of item words as long as the shortest window can hold one.
            known = number >= 0
            known_at = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
            bounds = np.unique(np.concatenate([known_at, first]))
            lo, hi = bounds[:-1], bounds[1:]
            keep = (hi - lo >= least) & known[np.minimum(lo, max(len(known) - 1, 0))] if len(known) else np.zeros(len(lo), bool)
            doc = np.searchsorted(first, lo[keep], side="right") - 1
            spans: dict[int, list] = {}
            found: dict[int, set] = {}
            longest: dict[int, int] = {}
            for d, a, z in zip(doc.tolist(), lo[keep].tolist(), hi[keep].tolist()):
                got, items, most = auto.scan(number[a:z].tolist())
                longest[d] = max(longest.get(d, 0), most)
                if got:
                    base = a - int(first[d])
                    spans.setdefault(d, []).extend((x + base, y + base) for x, y in got)
                    found.setdefault(d, set()).update(items)
            rows = range(b.num_rows)

            def cut_text(d, texts):
                long_ = [v for x, y in spans.get(d, ()) if y - x > cut for v in (x, y)]
                return remove_spans(texts[d].as_py(), long_) if long_ else None

            yield pa.RecordBatch.from_arrays(
                [
                    *([c for c in b.columns[2:]]),
                    pa.array(n_words, pa.int64()),
                    pa.array([sum(y - x for x, y in spans.get(d, ())) for d in rows], pa.int64()),
                    pa.array([longest.get(d, 0) for d in rows], pa.int64()),
                    pa.array([[v for p in spans.get(d, ()) for v in p] for d in rows], pa.list_(pa.int32())),
                    pa.array([sorted(names[k] for k in found.get(d, ())) for d in rows], pa.list_(pa.string())),
                    *([pa.array([cut_text(d, b.column(1)) for d in rows], pa.string())] if cut is not None else []),
                ],
                names=[*b.schema.names[2:], "n_words", "n_hit", "longest", "spans", "items", *(["clean"] if cut is not None else [])],
            )

    return run


def match_items(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS, cut: int | None = None) -> DataFrame:
    """Per row of df: doc_id, df's columns as the struct _carry if asked, n_words, n_hit, longest match, spans (flat start, end word
    pairs) and the ids of items with occurring windows; with `cut`, clean: the text without spans of more than `cut` words, null where it has none.

    Null texts and items have no words; items of null id are left out; two items of one id count once.
    An empty benchmark matches nothing. Repeated rows are judged each on its own. With more than
    shard_words item words, each shard streams over all rows of the same pass's output.
    """
    spark = df.sparkSession
    ids = [F.col(f"`{doc_id}`").cast("long").alias("_d"), text_column(df, text).alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id")]
    rows = df.select(*ids, *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_carry")] if carry else []))
    found = "n_words long, n_hit long, longest long, spans array<int>, items array<string>"

    def scanned(docs: DataFrame, shard, cut=None) -> DataFrame:
        vocab = np.unique(np.array([w for _, seq in shard for w in seq], np.uint64))
        number = {w: i for i, w in enumerate(vocab.tolist())}
        names = sorted({i for i, _ in shard})
        place = {n: k for k, n in enumerate(names)}
        auto = Automaton([(i, [number[w] for w in seq]) for i, seq in shard], window)
        # Several rows may share an id: automaton items become id numbers.
        auto.whole = {s: frozenset(place[shard[k][0]] for k in v) for s, v in auto.whole.items()}
        held = Shipped(spark, (vocab, auto, names))
        return docs.mapInArrow(_kernel(held, window, cut), T.StructType(docs.schema.fields[2:] + T.StructType.fromDDL(found + (", clean string" if cut is not None else "")).fields))

    shards = _shards(benchmark, item_id, item_text, shard_words)
    shard, more = next(shards), next(shards, None)
    if more is None:
        return stash(scanned(rows, shard, cut), "matched").df
    # Further shards: the driver holds two at a time. Rows are numbered once, in a table that every shard reads, and what the
    # shards found of a row, short lists, meets under its number.
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "rows").df
    narrow = rows.select("_d", "text", "_row")
    parts = [stash(scanned(narrow, shard), "part").df]
    while more is not None:
        parts.append(stash(scanned(narrow, more), "part").df)
        more = next(shards, None)
    total = functools.reduce(lambda a, b: a.unionByName(b), parts)
    rest = total.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.max("longest").alias("longest"),
        F.flatten(F.collect_list("spans")).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("_s") / 2).cast("int") - 1), lambda i: F.struct(F.get("_s", i * 2).alias("a"), F.get("_s", i * 2 + 1).alias("z"))))
    pairs = F.when(F.size("_s") > 0, pairs).otherwise(F.array().cast("array<struct<a:int,z:int>>"))
    empty = F.array().cast("array<struct<a:int,z:int>>")
    merged = F.aggregate(pairs, empty, lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["z"] >= p["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["z"], p["z"]).alias("z"))))).otherwise(F.concat(acc, F.array(p))))
    rest = rest.withColumn("_m", merged)
    hit = F.aggregate("_m", F.lit(0).cast("long"), lambda acc, p: acc + (p["z"] - p["a"]).cast("long"))
    rest = rest.select("_row", "n_words", hit.alias("n_hit"), "longest", F.flatten(F.transform("_m", lambda p: F.array(p["a"], p["z"]))).alias("spans"), "items")
    kept = [f.name for f in rows.schema.fields[2:] if f.name != "_row"]
    out = rows.select("text", "_row", *kept).join(rest, "_row")
    if cut is None:
        return out.select(*kept, "n_words", "n_hit", "longest", "spans", "items")

    def cleaned(batches):
        for b in batches:
            texts, spans = b.column(0), b.column(1).to_pylist()
            long_ = [[v for x, y in zip(s[::2], s[1::2]) if y - x > cut for v in (x, y)] for s in spans]
            clean = pa.array([remove_spans(texts[i].as_py(), v) if v else None for i, v in enumerate(long_)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], clean], names=[*b.schema.names[1:], "clean"])

    flat = out.select("text", "spans", *kept, "n_words", "n_hit", "longest", "items")
    done = flat.mapInArrow(cleaned, T.StructType([*flat.schema.fields[1:], T.StructField("clean", T.StringType())]))
    return done.select(*kept, "n_words", "n_hit", "longest", "spans", "items", "clean")


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, span_words: int = SPAN_WORDS, percent: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows without those beyond the coverage limit (`contaminated`); of the others, spans of more than span_words
    words go from the text, with what stands between their words. df's columns; n_chars, where df has it, follows a changed text.

    Null and empty texts stay as they are; so do all rows where the benchmark is empty.
    """
    found = match_items(df, benchmark, window, carry=True, doc_id=doc_id, text=text, cut=span_words)
    stays = found.filter(~F.coalesce(contaminated(F.col("n_hit"), F.col("n_words"), percent), F.lit(False)))
    own = lambda c: F.col("_carry").getField(c)
    new = {text: F.coalesce("clean", own(text)), "n_chars": F.when(F.col("clean").isNull(), own("n_chars")).otherwise(F.length("clean"))} if "n_chars" in df.columns else {text: F.coalesce("clean", own(text))}
    return stays.select(*[(new[c].cast(df.schema[c].dataType) if c in new else own(c)).alias(c) for c in df.columns])


def remove_spans(text: str | None, spans: list[int]) -> str | None:
    """text without the words of the spans (flat word start, end pairs) and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]), alnum_table())
    out, at = [], 0
    for a, z in zip(spans[::2], spans[1::2]):
        out.append(raw[at : s[a]])
        at = e[z - 1]
    return b"".join([*out, raw[at:]]).decode()


def contaminated(n_hit, n_words, percent: int = 5):
    """The coverage rule: something is hit, and hit words are at least `percent` in a hundred."""
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = match_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.coalesce(contaminated(F.col("n_hit"), F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT i, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS s FROM (SELECT i, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS p FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT r, p, dw.n, i FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN names USING (r)
"""

QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES = {"op8_decontamination": _ORACLE}
