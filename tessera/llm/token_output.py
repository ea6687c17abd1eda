"""Token-id output: texts to token ids, packed with Simple-8b into block files and read back.

File format. The output is a folder of Parquet parts whose rows are blocks, numbered within a
part; parts and blocks follow ascending (doc_id, text hash). A block holds whole documents:

- ``doc_ids``: their ids (null allowed), in order;
- ``ends``: little-endian uint32 per document: how many of the block's ids come before its end;
- ``words``: the packed ids, little-endian 64-bit words. The top 4 bits of a word are its selector,
  the other 60 its payload. Selector s packs COUNT[s] ids of WIDTH[s] bits, lowest bits first;
  selector 15 is the escape: one id of up to 59 bits, or, with payload bit 59 set, the upper 32 bits of the
  id whose lower 32 the next word (an escape too) holds.

A block's rows say how many ids it holds, so any block decodes alone; offsets of a block in the
whole stream are prefix sums over parts and blocks.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, pieces, stash, text_column, work_dir
from .kernels import buffers, slide, word_hashes

#: Fixed values of the format: ids per word and bits per id for selectors 0-14.
COUNT = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTH = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
_UPPER = 1 << 59
BLOCK_IDS = 1 << 16
#: Distinct pieces that a worker keeps with their ids before it starts anew.
CACHE_PIECES = 700_000

_BLOCKS = "part int, block int, n_ids long, n_docs int, doc_ids array<bigint>, ends binary, words binary"


def pack(ids: np.ndarray) -> np.ndarray:
    """Greedy Simple-8b words. Each takes the longest run that fits; a value of over 30 bits takes an escape, or two."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    best = np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNT) - 1, -1, -1):  # from few ids to many: the last that fits is the longest
        c, w = COUNT[s], WIDTH[s]
        if n < c:
            continue
        ok = ids < np.uint64(1 << w)
        if not ok.any():
            continue
        best[: n - c + 1][slide(ok, c, np.logical_and)] = s
    step = np.array([*COUNT, 1], np.int64)[best]
    nxt = (np.arange(n) + step).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i = nxt[i]
    at = np.array(at, np.int64)
    sel = best[at]
    out = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel[sel != ESCAPE]):
        rows = np.flatnonzero(sel == s)
        c, w = COUNT[s], WIDTH[s]
        for j in range(c if w else 0):
            out[rows] |= ids[at[rows] + j] << np.uint64(j * w)
    rows = np.flatnonzero(sel == ESCAPE)
    if len(rows):
        big = ids[at[rows]]
        wide = big >= np.uint64(_UPPER)
        out[rows] |= np.where(wide, big & np.uint64(0xFFFFFFFF), big)
        upper = (np.uint64(ESCAPE) << np.uint64(60)) | np.uint64(_UPPER) | (big[wide] >> np.uint64(32))
        out = np.insert(out, rows[wide], upper)
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of packed words, one vector operation per selector and slot."""
    sel = (words >> np.uint64(60)).astype(np.uint8)
    upper = (sel == ESCAPE) & (words & np.uint64(_UPPER) != 0)
    n = np.array([*COUNT, 1], np.int64)[sel]
    n[upper] = 0
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint64)
    for s in np.unique(sel[sel != ESCAPE]):
        rows = np.flatnonzero(sel == s)
        c, w = COUNT[s], WIDTH[s]
        mask = np.uint64((1 << w) - 1)
        for j in range(c if w else 0):
            out[start[rows] + j] = (words[rows] >> np.uint64(j * w)) & mask
    one = (sel == ESCAPE) & ~upper
    out[start[one]] = words[one] & np.uint64(_UPPER - 1)
    out[start[upper]] |= (words[upper] & np.uint64(0xFFFFFFFF)) << np.uint64(32)
    return out


def _cut_safe(conf: dict) -> bool:
    """Whether the file's pre-tokens are those of byte-level BPE alone, so that texts can be cut between them."""
    pre, added = conf.get("pre_tokenizer") or {}, conf.get("added_tokens") or []
    return (
        conf.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and conf.get("post_processor") is None
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        and (conf.get("truncation"), conf.get("padding")) == (None, None)
    )


class Encoder:
    """Token ids of texts by the tokenizers library (raw: its JSON file's text), each distinct piece once.

    Where the file is plain byte-level BPE, a pre-token starts at a single space between two characters
    that are no white space, at what follows a letter and is none, and at what follows a single line feed
    between two such characters. Texts are cut there, distinct pieces go to the library, and their ids
    are put together again: the ids of the whole text. Texts with an added token's string, and all texts
    under any other file, go to the library whole.
    """

    def __init__(self, raw: str):
        from tokenizers import Tokenizer

        conf = json.loads(raw)
        self.tok = Tokenizer.from_str(raw)
        self.cuts = _cut_safe(conf)
        self.added = [t["content"].encode() for t in conf.get("added_tokens") or []]
        ascii_letter = np.zeros(256, bool)
        ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True
        self.letter = ascii_letter
        self.plain = np.zeros(256, bool)  # ASCII, neither white space nor control
        self.plain[0x21:0x7F] = True
        self.lead = np.zeros(256, bool)  # of two bytes, U+00C0 to U+07FF: no white space there
        self.lead[0xC3:0xE0] = True
        self.clear()

    def clear(self):
        self.n = self.used = 0
        #: Hashes of the pieces kept, sorted, and the number of each.
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: By number: where a piece's ids start in the store, how many, and in how many calls it came.
        self.at, self.size, self.calls = (np.zeros(1 << 12, t) for t in (np.int64, np.int64, np.int32))
        self.store = np.zeros(1 << 14, np.uint32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _keep(self, keys, place, size, flat):
        """Add pieces (sorted hashes, their places among the keys, their ids)."""
        n, m = self.n + len(keys), self.used + len(flat)
        self.at, self.size, self.calls = (self._room(a, n) for a in (self.at, self.size, self.calls))
        self.store = self._room(self.store, m)
        self.size[self.n : n] = size
        self.at[self.n : n] = self.used + np.cumsum(size) - size
        self.store[self.used : m] = flat
        self.keys, self.number = np.insert(self.keys, place, keys), np.insert(self.number, place, np.arange(self.n, n))
        self.n, self.used = n, m

    def _evict(self):
        """Drop pieces that came in one call only; all of them where that leaves too many."""
        old = self.calls[self.number] > 1
        keys, number = self.keys[old], self.number[old]
        size, at, store = self.size[number], self.at[number], self.store
        self.clear()
        if 0 < len(keys) <= CACHE_PIECES // 2 and size.sum():
            total = np.cumsum(size)
            self._keep(keys, np.zeros(len(keys), np.int64), size, store[np.arange(total[-1]) - np.repeat(total - size - at, size)])

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ascending byte positions at which pieces start, those of documents included."""
        first = off[:-1][off[:-1] < off[1:]]
        if not self.cuts or len(data) < 3:
            return first
        inner, plain, lead = (data & 0xC0) == 0x80, self.plain[data], self.lead[data]
        before = plain.copy()  # at i: the character that ends in byte i is surely no white space
        before[1:] |= inner[1:] & lead[:-1]
        after = plain | lead
        letter = self.letter[data]
        accent = inner.copy()  # U+00C0 to U+00FF but the two signs among them
        accent[0] = False
        accent[1:] &= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(len(data), bool)
        space = data == 0x20
        cut[1:-1] = space[1:-1] & before[:-2] & after[2:]
        cut[1:] |= (letter | accent)[:-1] & plain[1:] & ~letter[1:]
        cut[2:] |= (data[1:-1] == 0x0A) & before[:-2] & after[2:]
        # What stands around a document's bounds is another document's.
        for edge in (first, first + 1):
            cut[edge[edge < len(data)]] = False
        last = off[1:][off[:-1] < off[1:]] - 1
        cut[last[space[last]]] = False
        if self.added:
            raw = data.tobytes()
            for content in self.added:
                i = raw.find(content)
                while i >= 0:
                    d = int(np.searchsorted(off, i, side="right")) - 1
                    cut[off[d] : off[d + 1]] = False
                    i = raw.find(content, int(off[d + 1]))
        cut[first] = True
        return np.flatnonzero(cut)

    def __call__(self, arr) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has) of an Arrow string array."""
        data, off = buffers(arr)
        if self.n > CACHE_PIECES or self.used > 8 * CACHE_PIECES:
            self._evict()
        starts = self.starts(data, off)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(arr), np.int64)
        ends = np.append(starts[1:], len(data))
        h, one, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        near = np.searchsorted(self.keys, h)
        found = near < len(self.keys)
        found[found] = self.keys[near[found]] == h[found]
        place = np.empty(len(h), np.int64)
        place[found] = self.number[near[found]]
        new = np.flatnonzero(~found)
        if len(new):
            raw = data.tobytes()
            s, e = starts[one[new]].tolist(), ends[one[new]].tolist()
            coded = [x.ids for x in self.tok.encode_batch_fast([raw[i:j].decode() for i, j in zip(s, e)], add_special_tokens=False)]
            place[new] = np.arange(self.n, self.n + len(new))
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            self._keep(h[new], near[new], size, np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(size.sum())))
        self.calls[place] += 1
        where = place[back]
        n = self.size[where]
        total = np.cumsum(n)
        # Where each id stands in the store: steps of one, with a jump at the start of each piece.
        some = n > 0
        first, size, stop = self.at[where[some]], n[some], total[some]
        at = np.ones(total[-1], np.int32)
        if len(first):
            at[0] = first[0]
            at[stop[:-1]] = first[1:] - (first[:-1] + size[:-1] - 1)
        ids = self.store[np.cumsum(at, dtype=np.int32)]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, off)]
        return ids, np.diff(bounds)


def _worker_encoder(raw: str) -> Encoder:
    """This worker's encoder. Functions travel by value, so what a worker keeps between tasks hangs on a module of its own."""
    kept = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    if getattr(kept, "tokenizer", None) != (key := hash(raw)):
        kept.tokenizer, kept.encoder = key, Encoder(raw)
    return kept.encoder


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None, tokenizer_json: str | None = None) -> Table:
    """Encode every text (null: empty), append `end_id`, and write blocks to `path` in ascending doc_id order.

    Null doc_ids come first; rows of one doc_id are ordered by text. An empty table gives no blocks.
    The tokenizer file is read once on the driver and travels with the tasks.
    """
    spark = df.sparkSession
    raw = tokenizer_json if tokenizer_json is not None else open(tokenizer, encoding="utf-8").read()
    held = spark.sparkContext.broadcast(raw)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(text_column(df, text), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))

    def kernel(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        encode = None
        ids, ends, got, total, block = [], [], [], 0, 0

        def flush():
            flat = np.concatenate(ids)
            packed = pack(flat)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()), "n_docs": pa.array([len(got)], pa.int32()),
                    "doc_ids": pa.array([got], pa.list_(pa.int64())), "ends": pa.array([np.array(ends, "<u4").tobytes()], pa.binary()),
                    "words": pa.array([packed.astype("<u8").tobytes()], pa.binary()),
                }
            )

        for b in pieces(batches):
            encode = encode or _worker_encoder(held.value)
            flat, sizes = encode(b.column(1))
            flat = np.insert(flat, np.cumsum(sizes), end_id)
            at = np.concatenate([[0], np.cumsum(sizes + 1)])
            # Blocks end with the document that fills them.
            i, docs = 0, b.column(0).to_pylist()
            while i < len(docs):
                j = min(len(docs), int(np.searchsorted(at, at[i] + BLOCK_IDS - total)))
                j = max(j, i + 1)
                ids.append(flat[at[i] : at[j]])
                ends.extend((total + at[i + 1 : j + 1] - at[i]).tolist())
                got.extend(docs[i:j])
                total += int(at[j] - at[i])
                i = j
                if total >= BLOCK_IDS:
                    yield flush()
                    ids, ends, got, total, block = [], [], [], 0, block + 1
        if got:
            yield flush()

    return stash(ordered.mapInArrow(kernel, _BLOCKS), path=path, compression="none")


def read_tokens(files: Table) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    and where it lies (part, block, ordinal)."""
    blocks = files.df
    #: One row per part: as many as the writer had tasks.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    heads = blocks.select("part", "block", "n_ids").withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_ids"))
    at = heads.join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))

    def kernel(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8")).astype("<u4")
                ends = np.frombuffer(r["ends"], "<u4").astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([r["part"]] * n, pa.int32()), "block": pa.array([r["block"]] * n, pa.int32()), "ordinal": pa.array(range(n), pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()),
                        "inner": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    docs = stash(blocks.mapInArrow(kernel, "part int, block int, ordinal int, doc_id long, inner long, n_tokens long, ids_crc32 long"), "read").df
    return docs.join(at, ["part", "block"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "ordinal")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of `docs` under the shared folder and read them back."""
    spark = docs.sparkSession
    files = write_tokens(docs, f"{work_dir(spark)}/tessera/{uuid.uuid4().hex}/tokens", tokenizer or default_tokenizer())
    return read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_token_output": op9_token_output}
