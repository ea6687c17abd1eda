"""Line dedup, language identification, weak labels and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm.language_id import Model, identify, symbols
from tessera.llm.line_dedup import dedup_lines, line_verdicts
from tessera.llm.weak_labels import LABELLERS, NONE, classify, label_model, statistics, votes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, line int, kept boolean"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, 1, 2, 3, True) for d, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    a = ["the", "and", "house", "water", "thing", "other", "which", "would", "there", "people", "about"]
    b = ["der", "und", "nicht", "straße", "für", "wasser", "über", "schön", "haben", "werden", "können"]
    out = []
    for i in range(120):
        words, lang = (a, "en") if i % 2 else (b, "de")
        text = ".\n".join(" ".join(rng.choice(words) + rng.choice(["", "s", "e"]) for _ in range(rng.randint(12, 30))) for _ in range(rng.randint(3, 6)))
        out.append((i, text, lang if i % 7 else None, f"s{i % 3}"))
    return [*out, (200, None, "en", None), (None, "the people", None, None), (201, "", "de", "s1"), (202, "123 !!", "en", "s1"), (5, out[5][1], "en", "s0"), (203, "x" * 100_000, "en", "s0")]


def test_exact_and_fuzzy_lines(spark):
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, long_ = line(40), line(400)
    near = shared.replace(shared.split()[20], shared.split()[20] + "s")
    rows = [(2, f"{line(10)}\n{shared}\n\n{long_}", "en", "s"), (1, f"{shared.upper()}!\n{line(12)}", "en", "s"), (3, f"{near}\n{line(9)}\n{long_}\n{long_}.", "en", "s"), (None, shared, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, "\n***\n", "en", "s")]
    got = {}
    for r in line_verdicts(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], {})[r["line"]] = r["removed"]
    assert got[1] == {0: False, 1: False} and got[2] == {0: False, 1: True, 3: False} and got[None] == {0: True}
    assert got[3][1] is False and got[3][2] is True and got[3][3] is True and 4 not in got and 5 not in got and 6 not in got
    out = {r["doc_id"]: r["text"] for r in dedup_lines(table(spark, rows)).collect()}
    assert out[4] is None and out[5] == "" and out[6] == "\n***\n" and out[None] == "" and out[1] == rows[1][1]
    assert out[2] == "\n".join(x for i, x in enumerate(rows[0][1].split("\n")) if i != 1)
    assert dedup_lines(table(spark, rows)).columns == table(spark, rows).columns
    assert line_verdicts(table(spark, rows).filter("1 = 0")).count() == 0


def test_fuzzy_lines_reach_those_within_the_bits(spark):
    """Lines whose SimHashes differ in no more than the bits, and that are similar enough, are one group."""
    rng = random.Random(2)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(1000)) for _ in range(110)]
    rows = [(0, " ".join(base), "en", "s")]
    for i in range(1, 12):
        w = list(base)
        w[i * 9] = "changed"
        rows.append((i, " ".join(w), "en", "s"))
    got = {r["doc_id"]: r["removed"] for r in line_verdicts(table(spark, rows)).collect()}
    assert got[0] is False and sum(got.values()) >= 8


def test_language_on_held_out(spark, rows):
    got = identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    true = {i: "en" if i % 2 else "de" for i in range(120)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    assert len(held) > 15 and all(r["lang_pred"] == true[r["doc_id"]] for r in held)
    assert by[200]["lang_pred"] == by[201]["lang_pred"] == by[202]["lang_pred"] == "und" and by[200]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert identify(table(spark, rows).filter("1 = 0")).count() == 0
    none = identify(table(spark, [(1, "abc", None, None)])).collect()
    assert none[0]["lang_pred"] == "und"


def test_ppm_code_lengths():
    """Method C by hand: after 'ab' the language has seen c twice and d once."""
    table_, n = symbols()
    a, b, c, d = (int(table_[ord(x)]) for x in "abcd")
    grams = {}
    text = "abcabcabd"
    s = [int(table_[ord(x)]) for x in text]
    for i, x in enumerate(s):
        ctx = 0
        for k in (3, 2, 1):
            ctx = ctx * n + (s[i - k] if i >= k else 0)
        grams[ctx * n + x] = grams.get(ctx * n + x, 0) + 1
    keys = np.array(sorted(grams), np.int64)
    m = Model({"x": (keys, np.array([grams[k] for k in keys.tolist()]))}, order=3)
    data = np.frombuffer(b"abd", np.uint8)
    # Depth 2 context 'ab' (depth 3 contexts that came once are not kept): 3 symbols seen after it in 2 kinds.
    cost = m.score(data, np.array([0, 3]))[0, 0]
    rest = m.score(data[:2], np.array([0, 2]))[0, 0]
    assert cost - rest == pytest.approx(np.log((3 + 2) / 1), rel=1e-5)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    v = np.full((20000, 5), NONE)
    for k, (good, bad) in enumerate([(0.95, 0.9), (0.97, 0.7), (0.99, 0.8), (0.96, 0.6), (0.98, 0.85)]):
        right = np.where(y, rng.random(20000) < max(good, 0.996), rng.random(20000) < bad)
        v[:, k] = np.where(rng.random(20000) < 0.3, NONE, np.where(right, y, ~y).astype(int))
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    prior, _, post = label_model(patterns, counts)
    at = {tuple(p): q for p, q in zip(patterns.tolist(), post)}
    guess = np.array([at[tuple(r)] > 0.5 for r in v.tolist()])
    assert abs(prior - 0.8) < 0.03 and (guess == y).mean() > 0.97


def test_classifier_keeps_prose_and_drops_junk(spark, rows):
    rng = random.Random(4)
    junk = [(1000 + i, " ".join(f"{w}%%%$$$" for w in rows[i][1].split()), "en", "s") for i in range(0, 20)]
    shout = [(1100 + i, " ".join(f"{w.upper()}!!" for w in rows[i][1].split()), "en", "s") for i in range(0, 20)]
    got = {r["doc_id"]: r for r in classify(table(spark, rows + junk + shout)).collect()}
    assert all(got[i]["kept"] for i in range(120) if i != 5)
    assert not any(got[i]["kept"] for i in [*range(1000, 1020), *range(1100, 1120)])
    assert got[200]["score"] == 0 and not got[201]["kept"]
    assert classify(table(spark, rows).filter("1 = 0")).count() == 0
    assert votes(statistics(pa.array([None, "", "a b"], pa.string()))).shape == (3, len(LABELLERS))
    del rng


def test_pipeline(spark, tmp_path, rows):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(n))
    docs = [(i, text(4 + i % 5), "en", f"s{i % 2}") for i in range(90)]
    docs += [(100 + i, docs[i][1], "en", "s0") for i in range(10)]  # copies
    item = " ".join(text(1).split()[:20])
    docs += [(200, text(4) + " " + item, "en", "s1"), (201, "too short", "en", "s1"), (202, None, None, None)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        now.write.parquet(out)
        now = spark.read.parquet(out)
        left[name] = sorted(r[0] for r in now.select("doc_id").collect())
    assert left["quality rules"] == [*range(90), *range(100, 110), 200]
    assert left["near duplicates"] == [*range(90), 200]
    assert left["benchmark decontamination"] == list(range(90))
    assert set(left["mixing"]) <= set(range(90)) and len(left["mixing"]) > 60
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == left["mixing"]
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    empty = table(spark, docs).filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
