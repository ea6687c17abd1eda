"""Vectorised text kernels: words, hashes and word windows of whole texts, on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_TABLES: dict = {}


def white_table() -> np.ndarray:
    """True for bytes of words: all but space and 09-0D."""
    t = np.ones(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words once A-Z is folded: 0-9, a-z, A-Z and all of non-ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def same_table() -> np.ndarray:
    return np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: int, n: int):
    """base**i and base**-i modulo 2**64 for i < n (base odd); grown and kept per worker."""
    got = _TABLES.get(base)
    if got is None or len(got[0]) < n:
        m = max(n, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inv):
            a = np.full(m, U64(b), U64)
            a[0] = U64(1)
            both.append(np.cumprod(a, dtype=U64))
        got = _TABLES[base] = tuple(both)
    return got


def buffers(arr):
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    if arr.null_count:
        arr = arr.fill_null("")
    wide = arr.type == pa.large_string()
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Byte starts and ends of every word, and the index of the first word of each document (with the total last)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    s[first], e[last] = w[first], w[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the folded bytes, finalised with the length."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = powers(_P, len(data) + 1)
    v = (data if fold is None else fold[data]).astype(U64)
    v += U64(1)
    v *= up[: len(v)]
    c = np.empty(len(v) + 1, U64)
    c[0] = 0
    np.cumsum(v, out=c[1:])
    h = (c[ends] - c[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(_Q)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on (len(h) - k + 1 of them), whatever stands around them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out = np.zeros(n, U64)
        for i in range(k):
            out *= U64(_Q)
            out += h[i : i + n]
        return mix(out ^ U64(k))
    up, down = powers(_Q, len(h) + 1)
    c = np.empty(len(h) + 1, U64)
    c[0] = 0
    np.cumsum(h * up[: len(h)], out=c[1:])
    return mix(((c[k:] - c[:-k]) * down[:n]) ^ U64(k))


def slide(values: np.ndarray, k: int, op) -> np.ndarray:
    """op (an idempotent ufunc such as minimum) over each run of k values, by doubling."""
    have, out = 1, values
    while have < k:
        step = min(have, k - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, dtype=np.int64).view(U64)
