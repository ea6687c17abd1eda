"""Language models whose full-order contexts and rare grams are many."""

import random

import numpy as np
import pytest

from tessera.llm.language_id import symbols, train

SCHEMA = "lang string, text string"


def zipf(n_chars=4000, length=200_000):
    rng = random.Random(5)
    chars = [chr(0x4E00 + i) for i in range(n_chars)]
    return "".join(rng.choices(chars, [1 / (i + 1) for i in range(n_chars)], k=length))


def test_lower_orders_count_every_gram_and_no_context_is_cut(spark):
    text = zipf()
    m = train(spark.createDataFrame([("zh", text), ("en", "once")], SCHEMA))
    assert m.langs == ["en", "zh"]
    table, n_sym = symbols()
    s = table[np.frombuffer(text.encode(), np.uint8)].astype(np.int64)
    count = np.bincount(s, minlength=n_sym)
    kinds = (count > 0).sum()
    # The root is state 0: method C over the counts of all bytes.
    for x in np.flatnonzero(count):
        assert m.cost[x, 1] == pytest.approx(np.log((len(s) + kinds) / count[x]), rel=1e-5)
    p = np.concatenate([[0, 0, 0], s])
    grams, n = np.unique(((p[:-3] * n_sym + p[1:-2]) * n_sym + p[2:-1]) * n_sym + s, return_counts=True)
    contexts = np.unique(grams[n >= 2] // n_sym)
    assert len(contexts) > 6000
    assert np.array_equal(m.contexts[3], contexts)
