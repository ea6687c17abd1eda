"""op5, op3, op8, op2 and op6 against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.decontaminate import contaminated, decontaminate, match_items, remove_spans
from tessera.llm.jaccard_join import _several, divide_skip, drop_near_copies, jaccard_components, needed
from tessera.llm.mixing import _joint, balance, mix_documents, mix_plan
from tessera.llm.quality_rules import filter_documents, score_documents
from tessera.llm.substring_dedup import Repeats, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators also use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n long, label string, cid long, rid long, size long, kept boolean, _carry string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, 1, "x", 2, 3, 4, True, "c") for d, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Ünïcode", "don't", "a,b"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(70), text(200)
    out = []
    for i in range(60):
        t = text(rng.choice([3, 20, 60, 120]))
        if i % 5 == 0:
            t += "\n" + passage
        out.append([i, t])
    for i in range(60, 110):  # near copies, some far from each other
        w = base.split()
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append([i, "  ".join(w[: len(w) - i % 7])])
    for i in range(110, 130):  # exact copies
        out.append([i, out[i % 3 * 20 + 60][1]])
    out += [[130, None], [131, ""], [132, " \t\n"], [133, "one two three"], [134, "ONE two three"], [135, "one two three four"], [None, base], [7, base], [7, base], [None, None]]
    out.append([136, " ".join([text(50)] * 60)])
    rng.shuffle(out)
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for d, t in out]


def shingles(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_jaccard_components(spark, rows):
    sets = [shingles(t) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = []
    for i, (d, *_rest) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        want.append((d, len(sets[i]), min(ids) if ids else None))
    got = [tuple(r) for r in jaccard_components(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    left = drop_near_copies(table(spark, rows))
    assert left.columns == table(spark, rows).columns
    assert left.count() == sum(1 if sets[g] else len(v) for g, v in groups.items())


def test_empty_tables(spark, rows):
    none = table(spark, rows[:1]).filter("1 = 0")
    assert jaccard_components(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert score_documents(none).count() == 0
    assert mix_plan(none).count() == 0
    assert match_items(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_divide_skip_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        query = sorted(rng.sample(range(60), rng.randint(1, 30)))
        records = [sorted(rng.sample(range(60), rng.randint(1, 30))) if rng.random() < 0.5 else sorted(set(query) - set(rng.sample(query, len(query) // 6)) | set(rng.sample(range(60), 2))) for _ in range(rng.randint(0, 6))]
        want = [len(set(query) & set(r)) >= needed(len(query), len(r), 75) for r in records]
        assert divide_skip(query, records, 75) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_remove_repeats(spark, rows):
    starts = collections.defaultdict(list)
    for d, t, _, _ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            if d is not None:
                starts[tuple(w[i : i + 50])].append(d)
    want = []
    for d, t, _, _ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and min(starts[tuple(w[i : i + 50])]) < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d is None, d or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [(r[0] is None, r[0] or 0, *r[1:]) for r in map(tuple, remove_repeats(table(spark, rows)).collect())]
    assert sorted(got) == sorted(want)


def test_levels_reach_the_longest_repeat(spark):
    w = [f"v{i}" for i in range(500)]
    rows = [(1, " ".join(w[:230]), "en", "s"), (2, " ".join(["x"] + w[10:225]), "en", "s"), (3, " ".join(w[300:380]), "en", "s"), (4, " ".join(w[310:375] + ["y"]), "en", "s")]
    got = {r[0]: r[1] for r in Repeats(table(spark, rows)).levels().collect()}
    assert got == {1: 200, 2: 200, 3: 50, 4: 50}


@pytest.mark.parametrize("shard", [2_000_000, 30])
def test_match_items(spark, rows, shard):
    rng = random.Random(9)
    items = []
    for k in range(12):
        w = WORD.findall(rows[k * 3][1] or "")
        items.append((str(k), " ".join(w[: rng.choice([0, 2, 5, 13, 14, 40])])))
    items += [("a", None), ("0", "one two THREE"), (None, "one"), ("b", "w1, w1; w1")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[a : a + n])].add(i)
    want = []
    for d, t, _, _ in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    names |= found
        want.append((d is None, d or 0, len(w), len(hit), sorted(names)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = match_items(table(spark, rows), bench, shard_words=shard).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in got) == sorted(want)
    kept = match_items(table(spark, rows), bench, carry=True).filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select("_carry.*")
    assert kept.columns == table(spark, rows).columns


def test_remove_spans():
    assert remove_spans("One, two; three four!", [1, 3]) == "One,  four!"
    assert remove_spans(None, [0, 1]) is None and remove_spans("x", []) == "x"


def test_quality_counts(spark, rows):
    def base(t):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        n = len(w)
        return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n

    extra = [(500, "a a a a " * 30, "en", "s1"), (501, "x | y # z\n" * 20, None, "s1"), (502, "tab\tsep\x0bword\n\n\nline " * 15, "en", None)]
    got = score_documents(table(spark, rows + extra)).collect()
    want = sorted((d is None, d or 0, *base(t)) for d, t, _, _ in rows + extra)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert filter_documents(table(spark, rows)).columns == table(spark, rows).columns


def test_outliers_go_and_prose_stays(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    prose = lambda: ".\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(3, 6)))
    rows = [(i, prose(), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%$$$" for w in prose().split()), "en", f"s{i % 2}") for i in range(12)]
    got = {r["doc_id"]: r["kept"] for r in score_documents(table(spark, rows)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(12))


def test_mix(spark, rows):
    plan = mix_plan(table(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / sum(weight[x] for x in free) for s in free})
            break
        target.update({s: 3 * sizes[s] for s in over})
        free -= over
    taken = collections.Counter()
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    biggest = max(r["size"] for r in plan)
    assert all(abs(taken[s] - target[s]) <= biggest for s in order)
    again = mix_plan(table(spark, rows).repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    out = mix_documents(table(spark, rows))
    assert out.columns == table(spark, rows).columns and out.count() == sum(r["copies"] for r in plan)


def test_two_margins_balance(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 30), ("b", "y", 120)], "s string, l string, tokens long")
    m = {"s": spark.createDataFrame([("a", 120.0), ("b", 180.0)], "s string, target double"), "l": spark.createDataFrame([("x", 150.0), ("y", 150.0)], "l string, target double")}
    got = balance(cells, m).collect()
    for c, k, t in (("s", "a", 120), ("s", "b", 180), ("l", "x", 150), ("l", "y", 150)):
        assert sum(r["tokens"] * r["rate"] for r in got if r[c] == k) == pytest.approx(t, rel=1e-6)


def test_joint_newton_takes_fewer_steps_than_raking(spark):
    """Two margins that hang together closely: the whole Hessian sees it, one margin after the other does not."""
    tokens = np.array([[1000.0, 5.0], [4.0, 900.0]])
    a, b = np.array([700.0, 1209.0]), np.array([800.0, 1109.0])
    rows = [(s, l, float(tokens[i, j])) for i, s in enumerate("ab") for j, l in enumerate("xy")]
    cells = spark.createDataFrame(rows, "s string, l string, tokens double")
    m = {"s": spark.createDataFrame(list(zip("ab", a.tolist())), "s string, target double"), "l": spark.createDataFrame(list(zip("xy", b.tolist())), "l string, target double")}
    got, steps = _joint(cells, m, 50, 1e-9)
    rate = {(r["s"], r["l"]): r["rate"] for r in got.collect()}
    now, rounds = tokens.copy(), 0
    while max(np.abs(now.sum(1) - a).max(), np.abs(now.sum(0) - b).max()) > 1e-6:
        now *= (a / now.sum(1))[:, None]
        now *= b / now.sum(0)
        rounds += 1
    assert steps < 15 < rounds
    for i, s in enumerate("ab"):
        for j, l in enumerate("xy"):
            assert rate[s, l] == pytest.approx(now[i, j] / tokens[i, j], rel=1e-5)


def test_mix_breaks_ties_by_text(spark):
    """Rows of one doc_id (or none) and size, with other texts: the same copies however they are dealt."""
    rows = [(7, f"w{i} x", "en", f"s{i % 2}") for i in range(40)] + [(None, f"v{i} y", "en", "s0") for i in range(30)] + [(100 + i, "a b c d", "en", "s2") for i in range(9)]
    df = table(spark, rows)
    text = lambda n: sorted(r["text"] for r in mix_documents(df.repartition(n)).collect())
    assert text(1) == text(3) == text(7)


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_decontaminate_drops_documents_and_cuts_long_spans(spark, shard):
    item = [f"i{k}" for k in range(60)]
    clean = [f"c{k}" for k in range(3000)]
    inside = " ".join(clean[:1500]) + " " + " ".join(item) + ", " + " ".join(clean[1500:])
    short = " ".join(clean[:1500] + item[:20] + clean[1500:])
    rows = [(1, inside, "en", "s"), (2, " ".join(item + clean[:100]), "en", "s"), (3, short, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"j{k}" for k in range(40)))], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate(table(spark, rows), bench).collect()}
    assert got == {1: " ".join(clean[:1500]) + " , " + " ".join(clean[1500:]), 3: short, 4: None, 5: ""}
    found = {r["doc_id"]: r["clean"] for r in match_items(table(spark, rows), bench, cut=50, shard_words=shard).collect()}
    assert found[1] == got[1] and found[3] is None and found[4] is None
    assert decontaminate(table(spark, rows), bench).columns == table(spark, rows).columns


def test_lists_of_several_classes_whatever_the_batches():
    rng = random.Random(31)
    for _ in range(200):
        rows = sorted((rng.randrange(12), rng.randrange(6)) for _ in range(rng.randrange(1, 60)))
        several = collections.defaultdict(set)
        for t, c in rows:
            several[t].add(c)
        want = sorted({(t, c) for t, c in rows if len(several[t]) > 1})
        batches, at = [], 0
        while at < len(rows):
            n = rng.choice([0, 1, 2, 3, 30])
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.int64()), pa.array([c for _, c in part], pa.int64())], names=["tok", "cid"]))
            at += n
        got = [(t, c) for b in _several(iter(batches)) for t, c in zip(*(x.to_pylist() for x in b.columns))]
        assert sorted(got) == want


def test_every_link_comes_from_the_lists(spark, rows, monkeypatch):
    """Without the search nothing links but equal sets."""
    import tessera.llm.jaccard_join as module

    def nothing(k, percent):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).slice(0, 0)

        return run

    linked = jaccard_components(table(spark, rows)).collect()
    monkeypatch.setattr(module, "_search", nothing)
    alone = jaccard_components(table(spark, rows)).collect()
    assert len({r["group_id"] for r in alone}) > len({r["group_id"] for r in linked})
    assert all(r["group_id"] == r["class_id"] for r in alone)
