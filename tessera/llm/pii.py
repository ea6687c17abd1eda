"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns run over every maximal stretch of text that could hold a match. The field then looks
at the neighbourhood of every digit and at sign: tokens are letter/digit runs and single signs, a
candidate segment is a run of at most MAX_TOKENS of them, and features of the whole segment (its
shape, digit count, checksum, range of its numbers, inner gaps, the words around) score it for each
type. Dynamic programming over segment ends chooses boundaries and types jointly; forward and
backward sums over the same lattice give the gradient in training. Segments that clash with a base span, or win by
less than MARGIN, are dropped; base spans always stay.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, pieces, stash, text_column
from .kernels import buffers

#: Kinds of the base patterns in their order, then those that only the field finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_TOKENS = 16
MARGIN = 2.0
#: Code points of context on each side of a trigger.
CONTEXT = 48

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str, ats) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches, given the places of all at signs."""
    out, done = [], 0
    for at in ats:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
    return out


def _numbers(run: str, at: int) -> list[tuple[str, int, int]]:
    """ip, card and phone matches of one stretch of digits and their separators that starts at `at`."""
    out = []
    if "." in run:
        for m in _IP.finditer(run):
            if all(len(p) <= 12 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append(("ip", at + m.start(), at + m.end()))
    for m in _CARD.finditer(run):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", at + m.start(), at + m.end()))
    if "+" in run:
        for m in _PHONE.finditer(run):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", at + m.start(), at + m.end()))
    return out


_TOKEN = re.compile(r"[^\W_]+|[^\s]")


class Region:
    """Tokens of a piece of text and the candidate segments between them."""

    def __init__(self, text: str):
        self.text = text
        self.kept: dict[tuple[int, int], tuple[str, ...]] = {}
        self.tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        t = self.tokens
        self.gap = [0] * len(t)
        for i in range(1, len(t)):
            self.gap[i] = t[i][0] - t[i - 1][1]
        self.digit = [any("0" <= c <= "9" for c in x) for _, _, x in t]
        self.segments: dict[int, list[int]] = {}  # by end: the starts
        for i in range(len(t)):
            if not (self.digit[i] or t[i][2] in "+([" or t[i][2][0].isalnum()):
                continue
            hot = False
            for j in range(i, min(len(t), i + MAX_TOKENS)):
                if j > i and self.gap[j]:
                    # A gap is crossed only between digits and signs, by one character.
                    left, right = t[j - 1][2], t[j][2]
                    if self.gap[j] > 1 or left.isalpha() or right.isalpha() or not (self.digit[j] or right == "("):
                        break
                hot = hot or self.digit[j] or t[j][2] == "@"
                if hot and (self.digit[j] or t[j][2][0].isalnum()):
                    self.segments.setdefault(j, []).append(i)

    def features(self, i: int, j: int) -> tuple[str, ...]:
        """Features of the whole segment, kept while the region lives."""
        got = self.kept.get((i, j))
        if got is None:
            got = self.kept[(i, j)] = self._features(i, j)
        return got

    def _features(self, i: int, j: int) -> tuple[str, ...]:
        t = self.tokens
        words = [x for _, _, x in t[i : j + 1]]
        body = self.text[t[i][0] : t[j][1]]
        digits = "".join(c for c in body if "0" <= c <= "9")
        n = len(digits)
        shape = "".join((f"d{min(len(w), 5)}" if w.isdigit() else "a" if w.isalpha() else "x") if w[0].isalnum() else w for w in words)
        gaps = sum(1 for k in range(i + 1, j + 1) if self.gap[k])
        solid = re.fullmatch(r"[0-9A-Za-z_+/=-]+", body) is not None
        mixed = solid and n >= 4 and sum(c.isalpha() for c in body) >= 4
        out = [f"n={min(n, 22)}", f"len={j - i}", f"gaps={min(gaps, 4)}", f"at={body.count('@')}", f"dots={min(body.count('.'), 5)}", f"dashes={min(body.count('-'), 4)}", f"colons={min(body.count(':'), 8)}"]
        if len(shape) <= 24:
            out.append(f"shape={shape}")
        if 13 <= n <= 19 and len(digits) == len(re.sub(r"[ -]", "", body)):
            out.append(f"luhn={luhn(digits)}")
        if body.count(".") == 3 and re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", body):
            out.append(f"octets={all(int(p) < 256 for p in body.split('.'))}")
        if body.count(":") >= 2 and re.fullmatch(r"[0-9a-fA-F:]+", body):
            out.append(f"hexgroups={body.count(':') == 7}")
        if "@" in body:
            out.append(f"address={re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', body) is not None}")
        if mixed and len(body) >= 16:
            out.append(f"key={'long' if len(body) >= 32 else 'short'}")
            out.append(f"hex={re.fullmatch(r'[0-9a-f]+', body) is not None}")
        glued = (i > 0 and not self.gap[i] and t[i - 1][2] not in "\"'([:;,=") or (j + 1 < len(t) and not self.gap[j + 1] and t[j + 1][2] in "@.-:/+_" and j + 2 < len(t) and not self.gap[j + 2] and t[j + 2][2][0].isalnum())
        out.append(f"glued={glued}")
        before = [x.lower() for _, _, x in t[max(0, i - 4) : i] if x[0].isalnum()]
        if i and t[i - 1][2] == "+":
            out.append("plus")
        if any(w in SECRET_WORDS for w in before):
            out.append("named")
        return tuple(out)


#: Words that announce a credential.
SECRET_WORDS = frozenset(("token", "secret", "password", "passwd", "key", "apikey", "api", "auth", "bearer", "credential"))


class Field:
    """Weights by (feature, kind) and the semi-Markov lattice."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = weights if weights is not None else {}

    def score(self, region: Region, i: int, j: int, kind: str) -> float:
        w = self.w
        return w.get(("bias", kind), -2.0) + sum(w.get((f, kind), 0.0) for f in region.features(i, j))

    def decode(self, region: Region) -> list[tuple[str, int, int, float]]:
        """Best segmentation: (kind, first token, last token, score); tokens outside segments score 0."""
        n = len(region.tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(n):
            best[j + 1], back[j + 1] = best[j], None
            for i in region.segments.get(j, ()):
                for kind in KINDS:
                    s = self.score(region, i, j, kind)
                    if best[i] + s > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + s, (kind, i, j, s)
        out, at = [], n
        while at:
            if back[at] is None:
                at -= 1
            else:
                out.append(back[at])
                at = back[at][1]
        return out[::-1]

    def step(self, region: Region, gold: set[tuple[str, int, int]], rate: float) -> float:
        """One gradient step on the conditional log likelihood of `gold`; returns that likelihood."""
        n = len(region.tokens)

        def logsum(xs):
            m = max(xs)
            return m + math.log(sum(math.exp(x - m) for x in xs))

        arcs = [(k, i, j, self.score(region, i, j, k)) for j, starts in region.segments.items() for i in starts for k in KINDS]
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for a in arcs:
            by_end.setdefault(a[2], []).append(a)
            by_start.setdefault(a[1], []).append(a)
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(n):
            alpha[j + 1] = logsum([alpha[j], *(alpha[i] + s for _, i, _, s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            beta[i] = logsum([beta[i + 1], *(beta[j + 1] + s for _, _, j, s in by_start.get(i, ()))])
        like = -alpha[n]
        for k, i, j, s in arcs:
            p = math.exp(alpha[i] + s + beta[j + 1] - alpha[n])
            g = ((k, i, j) in gold) - p
            like += s if (k, i, j) in gold else 0.0
            if abs(g) > 1e-3:
                for f in ("bias", *region.features(i, j)):
                    self.w[(f, k)] = self.w.get((f, k), -2.0 if f == "bias" else 0.0) + rate * g
        return like


def _examples(rng: random.Random, count: int):
    """Training regions: (text, [(kind, start, end)]), with look-alikes that are nothing."""
    word = lambda a=2, b=8: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    octet = lambda: str(rng.randint(0, 255))

    def card():
        body = num(15)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(d, sep):
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    tens = lambda: f"{rng.randint(200, 999)}"
    positive = [
        ("email", lambda: f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com"), ("email", lambda: f"{word()}_{word()}@{word()}.org"),
        ("ip", lambda: ".".join(octet() for _ in range(4))), ("ip", lambda: ":".join(hexa(rng.randint(1, 4)) for _ in range(8))),
        ("card", card), ("card", lambda: grouped(card(), " ")), ("card", lambda: grouped(card(), "-")),
        ("phone", lambda: f"+{rng.randint(1, 99)} ({tens()}) {tens()}-{num(4)}"), ("phone", lambda: f"({tens()}) {tens()}-{num(4)}"),
        ("phone", lambda: f"{tens()}-{tens()}-{num(4)}"), ("phone", lambda: f"{tens()}.{tens()}.{num(4)}"), ("phone", lambda: f"+{rng.randint(10, 99)} {num(3)} {num(3)} {num(4)}"),
        ("secret", lambda: hexa(40)), ("secret", lambda: hexa(32)), ("secret", lambda: f"sk_{word(4, 4)}_{hexa(24)}"), ("secret", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
    ]
    negative = [
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", lambda: f"{rng.randint(1, 999)},{num(3)}", lambda: f"{rng.randint(0, 99)}.{num(2)}", lambda: num(rng.randint(1, 9)),
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{octet()}.{octet()}", lambda: f"{num(2)}-{num(2)}", lambda: f"{word().upper()}-{num(4)}",
        lambda: f"${num(2)}.{num(2)}", lambda: num(16 if rng.random() < 0.5 else 12), lambda: f"{word()}{num(2)}", lambda: f"@{word()}", lambda: f"{word()} @ {num(3)}", lambda: f"{num(3)}-{num(2)}", lambda: f"{num(3)}-{num(4)}",
        lambda: f"{num(4)} {num(4)} {num(2)}", lambda: f"{num(3)} {num(3)}", lambda: f"{num(13)}", lambda: f"{word()}.{num(2)}", lambda: f"{num(1)}/{num(1)}",
    ]
    tails = ["", "", "", ",", ".", "!!", "###", "%%%", ";", "***"]
    for _ in range(count):
        text, spans = " ".join(word().capitalize() if k == 0 else word() for k in range(rng.randint(1, 4))), []
        for _ in range(rng.randint(1, 2)):
            text += " "
            if rng.random() < 0.6:
                kind, make = rng.choice(positive)
                body = make()
                if kind == "secret":
                    text += rng.choice(['token = "', "api key: ", 'secret="', "password: "])
                elif rng.random() < 0.1:
                    text += "("
                spans.append((kind, len(text), len(text) + len(body)))
                text += body
            else:
                body = rng.choice(negative)()
                if body.isdigit() and 13 <= len(body) <= 19 and luhn(body):
                    body = body[:-1]
                text += body
            text += rng.choice(tails) + " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        yield text, spans


@functools.lru_cache(maxsize=4)
def train(examples: int = 500, epochs: int = 5, seed: int = 7) -> Field:
    """The field, fitted by stochastic gradient on generated regions (the count is the bound)."""
    field, rng = Field(), random.Random(seed)
    data = []
    for text, spans in _examples(rng, examples):
        region = Region(text)
        starts, ends = {s: k for k, (s, _, _) in enumerate(region.tokens)}, {e: k for k, (_, e, _) in enumerate(region.tokens)}
        gold = {(k, starts[s], ends[e]) for k, s, e in spans if s in starts and e in ends}
        data.append((region, {g for g in gold if g[1] in region.segments.get(g[2], ())}))
    for epoch in range(epochs):
        rng.shuffle(data)
        for region, gold in data:
            field.step(region, gold, 0.3 / (1 + epoch))
    field.w = {k: round(v, 4) for k, v in field.w.items() if abs(v) > 0.02}
    return field


_ORDER = {k: i for i, k in enumerate(KINDS)}


class Finder:
    """Base spans and added spans of texts of one Arrow array."""

    def __init__(self, field: Field):
        self.field = field
        self.memo: dict[str, list] = {}
        sep = np.zeros(256, bool)
        for c in b"0123456789 +().-":
            sep[c] = True
        self.run = sep
        self.digit = np.zeros(256, bool)
        self.digit[0x30:0x3A] = True

    def added(self, text: str) -> list[tuple[str, int, int]]:
        """Segments the field finds in a region, by offsets; equal regions are decoded once."""
        got = self.memo.get(text)
        if got is None:
            region = Region(text)
            got = [(k, region.tokens[i][0], region.tokens[j][1]) for k, i, j, s in self.field.decode(region) if s >= MARGIN] if region.segments else []
            if len(self.memo) > 20_000:
                self.memo.clear()
            self.memo[text] = got
        return got

    def __call__(self, arr):
        """Per text: (base spans, all spans), each sorted by start, then kind."""
        data, off = buffers(arr)
        base: dict[int, list] = {}
        spots: dict[int, list] = {}
        if len(data):
            run, dig = self.run[data], self.digit[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[0] = edge[-1] = True
            edge[1:-1] = run[1:] != run[:-1]
            edge[off[:-1]] = True
            at = np.flatnonzero(edge)
            lo, hi = at[:-1], at[1:]
            count = np.concatenate([[0], np.cumsum(dig)])
            keep = run[lo] & (count[hi] > count[lo])
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
            lo, hi = lo[keep], hi[keep]
            doc = np.searchsorted(off, lo, side="right") - 1
            head = point[off[doc]]
            raw = data.tobytes()
            for d, a, z, p in zip(doc.tolist(), lo.tolist(), hi.tolist(), (point[lo] - head).tolist()):
                if (found := _numbers(raw[a:z].decode("ascii"), p)):
                    base.setdefault(d, []).extend(found)
                spots.setdefault(d, []).append((p, p + z - a))
            ats = np.flatnonzero(data == 0x40)
            doc = np.searchsorted(off, ats, side="right") - 1
            by_doc: dict[int, list] = {}
            for d, p in zip(doc.tolist(), (point[ats] - point[off[doc]]).tolist()):
                by_doc.setdefault(d, []).append(p)
                spots.setdefault(d, []).append((p, p + 1))
            for d, places in by_doc.items():
                base.setdefault(d, []).extend(_emails(arr[d].as_py(), places))
        for d in range(len(arr)):
            own = sorted(base.get(d, ()), key=lambda s: (s[1], _ORDER[s[0]]))
            every = own
            if d in spots:
                text = arr[d].as_py()
                more = []
                for a, z in self.regions(text, spots[d]):
                    for k, s, e in self.added(text[a:z]):
                        if not any(s + a < y and x < e + a for _, x, y in own):
                            more.append((k, s + a, e + a))
                if more:
                    every = sorted(own + more, key=lambda s: (s[1], _ORDER[s[0]]))
            yield own, every

    @staticmethod
    def regions(text: str, spots) -> list[tuple[int, int]]:
        """Stretches around the spots, cut at white space where some is near, merged where they meet."""
        out = []
        for a, z in sorted(spots):
            a, z = max(0, a - CONTEXT), min(len(text), z + CONTEXT)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], z)
            else:
                out.append([a, z])
        fixed = []
        for a, z in out:
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while z < len(text) and not text[z].isspace():
                z += 1
            if fixed and a <= fixed[-1][1]:
                fixed[-1] = (fixed[-1][0], max(z, fixed[-1][1]))
            else:
                fixed.append((a, z))
        return fixed


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Per row of df: doc_id, base and spans (arrays of kind, start, end in code points, end exclusive).

    Null texts are empty. Rows are judged each on its own; repeats, ties and other columns don't matter.
    """
    held = Shipped(df.sparkSession, field or train())
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(text_column(df, text), F.lit("")).alias("text"))
    kind = "array<struct<kind:string,start:int,end:int>>"

    def kernel(batches):
        finder = Finder(held.value)
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in pieces(batches):
            base, every = [], []
            for own, spans in finder(b.column(1)):
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                every.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, shape), pa.array(every, shape)], names=["doc_id", "base", "spans"])

    return stash(rows.mapInArrow(kernel, f"doc_id long, base {kind}, spans {kind}"), "pii").df


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), secrets, F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op7_pii": op7_pii}
