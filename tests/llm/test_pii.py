"""Base spans against the plain patterns, the field on held-out generated text, and awkward rows."""

import hashlib
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii
from tessera.llm.pii import BASE_KINDS, MARGIN, Finder, Region, find_pii, luhn, train

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


FINDER = Finder(train())
PARTS = ["1.2.3.4", "255.255.255.255.1.1.1.1", "300.1.1.1", "a@b.c", "x.y+z@ho-st.co.uk.", "@", "a@b", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49 30 1234567890 ", "++1234567890", "é", "ñ ", " ", "\n", "7", "00.", "-", "word", "+", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=4))
def test_base_spans(texts):
    for t, (base, every) in zip(texts, FINDER(pa.array(texts, pa.string())), strict=True):
        assert base == brute(t)
        assert set(base) <= set(every)
        assert all(0 <= s < e <= len(t) for _, s, e in every)


def test_field_on_held_out_regions():
    rng, hit, want, wrong = random.Random(12345), 0, 0, 0
    for text, spans in pii._examples(rng, 300):
        r = Region(text)
        got = {(k, r.tokens[i][0], r.tokens[j][1]) for k, i, j, s in FINDER.field.decode(r) if s >= MARGIN}
        hit, want, wrong = hit + len(got & set(spans)), want + len(spans), wrong + len(got - set(spans))
    assert hit >= 0.97 * want and wrong <= 0.03 * want


def test_decoding_is_the_best_segmentation():
    rng = random.Random(4)
    for text, _ in pii._examples(rng, 40):
        r = Region(text)
        best = FINDER.field.decode(r)
        starts = [(k, i, j, FINDER.field.score(r, i, j, k)) for j, ss in r.segments.items() for i in ss for k in pii.KINDS]
        total = sum(s for *_, s in best)
        # Replacing any part of the answer by one other segment is no better.
        for k, i, j, s in starts:
            rest = [b for b in best if b[2] < i or b[1] > j]
            assert sum(b[3] for b in rest) + s <= total + 1e-9


def test_tables(spark):
    rows = [(1, "call +1 (743) 555-3824 or 4111 1111 1111 1111"), (2, None), (3, ""), (None, "a.b@c.de"), (1, "call +1 (743) 555-3824 or 4111 1111 1111 1111"), (4, "w " * 50000 + "10.0.0.1"), (5, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'), (6, "plain words only, in 2024")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kind string, base int")
    got = {}
    for r in find_pii(df).collect():
        got.setdefault(r["doc_id"], []).append(([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]))
    for d, t in rows:
        assert all(base == brute(t or "") for base, _ in got[d])
    assert len(got[1]) == 2 and got[5][0][1] == [("secret", 9, 49)] and got[6] == [([], [])]
    assert find_pii(df.filter("1 = 0")).count() == 0


def test_query_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "x@y.org 1.2.3.4"), (2, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 0)
    assert got[1]["spans"] == "email:0:7,ip:8:15" and got[1]["base_sha256"] == hashlib.sha256(b"email:0:7,ip:8:15").hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_secrets_of_documents_that_no_generator_here_made():
    """Every quoted token in the test documents is found, and nothing else is called a secret."""
    import os

    import pyarrow.parquet as pq
    import pytest

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    texts = pa.concat_arrays(pq.read_table(path, columns=["text"]).column("text").chunks).cast(pa.string())
    secret = re.compile(r'token = "([0-9a-f]{40})"')
    planted = found = 0
    for t, (_, every) in zip(texts.to_pylist(), FINDER(texts), strict=True):
        wanted = [m.span(1) for m in secret.finditer(t or "")]
        got = [(s, e) for k, s, e in every if k == "secret"]
        planted += len(wanted)
        found += sum(any(s < z and a < e for s, e in got) for a, z in wanted)
        assert len(got) == len(wanted)
    assert planted > 5 and found == planted
