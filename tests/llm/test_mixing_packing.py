"""Balanced mixes and packings: their invariants, and the small parts by hand."""

import numpy as np
from collections import Counter

from loomery.llm import mixing, packing
from tests.llm.conftest import odd_rows


def reshared(sizes, weights, total):
    """Targets by the rule as it is said: what exceeds a cap is dealt anew until none does."""
    target, open_ = {}, set(range(len(sizes)))
    left = total
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 2 * sizes[i]}
        if not over:
            return target | share
        target |= {i: 2.0 * sizes[i] for i in over}
        left -= sum(2.0 * sizes[i] for i in over)
        open_ -= over
    return target


def test_targets(spark):
    sizes = [100, 5, 70, 0, 300, 40, 1]
    names = ["a", "b", "c", "d", "e", "é", None]
    rows = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, size long, n long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = reshared(sizes, [3, 1, 2, 3, 1, 2, 3], 1.5 * sum(sizes))
    assert all(abs(got[n] - want[i]) < 1e-6 for i, n in enumerate(names))


def test_flight_keeps_totals():
    r = np.random.default_rng(1)
    sizes, p = r.integers(1, 500, 800).astype(float), np.full(800, 0.37)
    got = mixing.flight(p, sizes, np.ones(800), r, land=False)
    assert ((got > 0) & (got < 1)).sum() <= 2
    assert abs((got - p) @ sizes) < 1e-3 and abs((got - p).sum()) < 1e-6
    landed = mixing.flight(p, sizes, np.ones(800), r, land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed - p) @ sizes) < 30


def test_mix(spark, odd, none):
    a, b = (sorted((tuple(r) for r in mixing.taken(odd, block=3).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == len(odd_rows())
    assert all(0 <= r[-1] <= 2 for r in a)
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 90), "ab"[i % 3 == 0]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.taken(docs, block=100).toPandas()
    by = rows.assign(took=rows["copies"] * rows["size"]).groupby("source").agg(took=("took", "sum"), target=("target", "first"))
    assert (abs(by.took - by.target) <= 0.001 * by.target + 2).all()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    counts = Counter((r.doc_id, r.text) for r in mixed.collect())
    many = Counter((r[0], r[1]) for r in odd_rows())
    assert all(n <= 2 * many[k] for k, n in counts.items())
    assert mixing.mix(none).count() == 0 and mixing.taken(none).count() == 0


def test_repeated_rows(spark):
    """Sources of one row, many times over, meet their targets, in the table and in the mix."""
    rows = spark.range(100_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'x' AS source")
    rows = rows.unionByName(spark.range(40).selectExpr("id AS doc_id", "repeat('w ', int(1 + id)) AS text", "'y' AS source"))
    by = mixing.taken(rows).selectExpr("*", "copies * size AS took").groupBy("source").agg({"took": "sum", "target": "max", "copies": "max", "*": "count"}).collect()
    assert {r["source"]: r["count(1)"] for r in by} == {"x": 100_000, "y": 40}
    assert all(r["max(copies)"] <= 2 and abs(r["sum(took)"] - r["max(target)"]) <= 5 for r in by)
    odd = rows.where("source = 'y'").unionByName(spark.range(101).selectExpr("null", "'a b c d e f g h i j'", "'x'").toDF("doc_id", "text", "source"))
    took = Counter(r.source for r in mixing.mix(odd).collect())
    want = mixing.taken(odd).groupBy("source").agg({"copies": "sum"}).collect()
    assert dict(took) == {r.source: r["sum(copies)"] for r in want}


def brute_mix(p, sizes):
    """The least error, over all ways to decide the documents, of words and of documents together."""
    ways = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    return (np.abs((ways - p) @ sizes) + np.abs((ways - p).sum(1))).min()


def test_mix_against_all_ways():
    """On tables of up to ten documents, the mix is as near to its totals as any choice."""
    for seed in range(30):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 11))
        sizes, p = r.integers(1, 60, n).astype(float), r.uniform(0.05, 0.95, n)
        got = mixing.flight(p, sizes, np.ones(n), r, land=True)
        assert set(got) <= {0.0, 1.0}
        assert abs((got - p) @ sizes) + abs((got - p).sum()) <= brute_mix(p, sizes) + 1e-6


def least_cost(lengths, capacities, attention):
    """The cost of the best packing of a few pieces: each piece joins a bin or opens one."""
    best = [float("inf")]

    def go(i, used):
        if i == len(lengths):
            caps = [min(c for c in capacities if c >= u) for u in used]
            best[0] = min(best[0], sum(c + c * c / attention for c in caps))
            return
        for k in range(len(used)):
            if used[k] + lengths[i] <= max(capacities):
                go(i + 1, [*used[:k], used[k] + lengths[i], *used[k + 1 :]])
        go(i + 1, [*used, lengths[i]])

    go(0, [])
    return best[0]


def test_packing_against_all_ways():
    """On up to seven pieces the cost is never below the best packing's, and within a third of it on average."""
    ratios = []
    for seed in range(40):
        r = np.random.default_rng(seed)
        lengths = sorted(r.integers(1, 33, int(r.integers(1, 8))).tolist(), reverse=True)
        _, _, sizes = packing.best_fit(lengths, (8, 16, 32), 64)
        ratios.append(sum(c + c * c / 64 for c in sizes.tolist()) / least_cost(lengths, (8, 16, 32), 64))
    assert min(ratios) >= 1 - 1e-9 and sum(ratios) / len(ratios) < 4 / 3


def test_pack_repeated_rows(spark):
    """Rows alike in id and text are dealt to several blocks, and each is packed."""
    rows = spark.range(100_000).selectExpr("CAST(null AS long) AS doc_id", "'a b c d e' AS text")
    packed = packing.pack(rows, block=5_000)
    by = packed.selectExpr("bin_id >> 32 AS block").groupBy("block").count().collect()
    assert sum(r["count"] for r in by) == 100_000 and len(by) == 20 and max(r["count"] for r in by) < 6_500


def test_best_fit():
    bins, places, sizes = packing.best_fit([9, 6, 4, 3, 1], (10,))
    assert bins.tolist() == [0, 1, 1, 2, 0] and places.tolist() == [0, 0, 6, 0, 9] and sizes.tolist() == [10, 10, 10]
    bins, _, sizes = packing.best_fit([5, 3], (4, 8, 16))
    assert bins.tolist() == [0, 0] and sizes.tolist() == [8]
    _, _, sizes = packing.best_fit([3], (4, 8, 16))
    assert sizes.tolist() == [4]


def test_pack(odd, none):
    rows = packing.pack(odd, capacities=(64, 256), block=50).toPandas()
    full = rows[rows.bin_id.notna()]
    assert full.n_words.sum() == sum(len((r[1] or "").encode().split()) for r in odd_rows())
    for _, part in full.groupby("bin_id"):
        part = part.sort_values("place")
        assert part.capacity.nunique() == 1 and part.n_words.sum() <= part.capacity.iloc[0]
        assert part.place.tolist() == [0, *part.n_words.cumsum().tolist()[:-1]]
        assert part.capacity.iloc[0] == 64 or part.n_words.sum() > 64
    assert len(rows[rows.bin_id.isna()]) == 4 and packing.pack(none).count() == 0
    assert packing.bins(packing.pack(odd)).agg({"n_words": "sum"}).first()[0] == full.n_words.sum()
    assert {r.doc_id for r in packing.pack(odd).collect()} == {r[0] for r in odd_rows()}
