import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.token_output import Encoder, default_tokenizer, pack, token_table, unpack

SCHEMA = "doc_id long, text string, part string, words int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=600))
def test_pack_round_trip(ids):
    words = pack(np.array(ids, np.uint64))
    assert words.dtype == np.uint64
    assert unpack(words).tolist() == ids


def test_words_hold_selector_and_ids():
    assert pack(np.zeros(240, np.uint64)).tolist() == [0]
    assert pack(np.array([5, 7], np.uint64)).tolist() == [14 << 60 | 7 << 30 | 5]
    assert pack(np.array([1 << 40], np.uint64)).tolist() == [15 << 60 | 1 << 40]
    assert len(pack(np.array([1 << 63], np.uint64))) == 2


CHARS = list("abst é×\n\n\t .,'  $12\u00a0\u0085\u2003ñßЖ中\x1c") + ["<|endoftext|>", "'s", " the", "don't", ".\n"]
TOK = Tokenizer.from_file(default_tokenizer())
ENCODE = Encoder(open(default_tokenizer(), encoding="utf-8").read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CHARS), max_size=25).map("".join), max_size=6))
def test_cut_encoding_is_the_library_s(texts):
    ids, sizes = ENCODE(pa.array(texts, pa.string()))
    want = [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [v for w in want for v in w]


def test_eviction_keeps_the_ids(monkeypatch):
    import tessera.llm.token_output as module

    monkeypatch.setattr(module, "CACHE_PIECES", 20)
    encode = Encoder(open(default_tokenizer(), encoding="utf-8").read())
    for i in range(40):
        texts = [f"word{j} common thing{j}, {i} end" for j in range(i % 7 * 3)]
        ids, _ = encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [v for t in texts for v in TOK.encode(t, add_special_tokens=False).ids]


def brute(rows):
    tok, at, out = TOK, 0, []
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tables(spark):
    rows = [(5, "the quick  brown fox\n\njumps <|endoftext|> over"), (2, None), (9, ""), (3, "word " * 40000), (-1, "élan vital — naïve")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, token_table(df).collect()), key=lambda r: r[1])
    assert got == brute(sorted(rows))


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 2), (None, "z", "x", 1), (None, None, None, None)], SCHEMA)
    got = sorted(map(tuple, token_table(df).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 1]
    assert got[2][2:] == got[3][2:] and sum(r[2] for r in got[:-1]) == got[-1][1]
    assert token_table(df.filter("1 = 0")).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_partitions_do_not_matter(spark, n):
    rows = [(i, f"text {i} " * (i % 13)) for i in range(300)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(n)
    assert sorted(map(tuple, token_table(df).collect()), key=lambda r: r[1]) == brute(rows)


def test_other_tokenizer_whole_texts():
    import public_tokenizers

    raw = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok, encode = Tokenizer.from_str(raw), Encoder(raw)
    texts = ["   ", "Some words, here", "", "  ", "again words"]
    ids, sizes = encode(pa.array(texts, pa.string()))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [v for w in want for v in w]
