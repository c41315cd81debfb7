"""The exact mix against a walk from pick to pick."""

import random

import pytest

from loomery.operators import mixed

SCHEMA = "doc_id long, lang string, text string"


def greedy(rows, weights, epochs):
    names, whole = sorted(weights), mixed.whole_weights(weights)
    queue = {k: [(i, p, len(t.encode()) + 1) for p in range(epochs.get(k, 1)) for i, s, t in sorted(rows) if s == k] for k in names}
    place, served, alive, out = dict.fromkeys(names, 0), dict.fromkeys(names, 0), list(names), []
    while alive:
        tokens, share = sum(served[k] for k in alive), sum(whole[k] for k in alive)
        best = max(alive, key=lambda k: whole[k] * tokens - share * served[k])
        if place[best] == len(queue[best]):
            alive.remove(best)
            continue
        i, p, n = queue[best][place[best]]
        out.append((len(out), best, i, p, n, sum(served.values())))
        place[best] += 1
        served[best] += n
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_picks(spark, seed):
    """Many small blocks give what one walk gives, to the last document of the last source."""
    r = random.Random(seed)
    rows = [(i * 7, r.choices("abcz", [0.3, 0.6, 0.1, 0.1])[0], "é" * r.randint(0, 20) if r.random() < 0.9 else "x" * r.randint(50, 150)) for i in range(1500)]
    weights, epochs = {"a": 0.5, "b": 0.3, "c": 0.2, "none": 1}, {"c": 2}
    want = greedy(rows, weights, epochs)
    docs = spark.createDataFrame([*rows, (None, "a", "x"), (5, None, "x"), (6, "a", None)], SCHEMA).selectExpr("*", "1 AS n", "2 AS before", "3 AS part", "4 AS position")
    got = mixed.mixed_stream(docs, weights, epochs=epochs, block=1).collect()
    assert sorted(map(tuple, got)) == want and want[-1][5] > 20 * 2 * 2 * 4 * 301 / 20
    cut = mixed.mixed_stream(docs, weights, epochs=epochs, block=1, max_tokens=9000).collect()
    assert sorted(map(tuple, cut)) == [w for w in want if w[5] < 9000]


def test_shares_hold_on_every_prefix(spark):
    """Long and short documents: shares hold in tokens within 2 points, from the first thousands on."""
    rows = [(i, "long", "a" * (300 + (i * 37) % 700)) for i in range(300)] + [(1000 + i, "short", "b" * (2 + (i * 7) % 8)) for i in range(30_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    picks = sorted(mixed.mixed_stream(docs, {"long": 0.6, "short": 0.4}, block=20_000, max_tokens=120_000).collect())
    served = {"long": 0, "short": 0}
    for p in picks:
        served[p.lang] += p.n
        total = sum(served.values())
        assert total < 30_000 or abs(served["long"] / total - 0.6) < 0.02
    assert total >= 120_000 and total - picks[-1].n < 120_000
    assert sum(p.lang == "long" for p in picks[:1000]) >= 5


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixed.mixed_stream(docs, {"a": 1}).count() == 0
    assert mixed.mixed_stream(spark.createDataFrame([(1, "a", "")], SCHEMA), {"a": 1, "b": 2}).collect() == [(0, "a", 1, 0, 1, 0)]


def test_weights():
    assert mixed.whole_weights({"a": 0.6, "b": 0.4, "c": 2}) == {"a": 3, "b": 2, "c": 10}
