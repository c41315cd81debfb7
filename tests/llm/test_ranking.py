"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomery.llm import ranking
from tests.llm.conftest import odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=20):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, k + 1, i if there else None, -s) for k, (s, there, i) in enumerate(sorted(found)[:best])]
    return out


def test_terms():
    for text in ["", "A-b C1_d", "É€😀x\x7fy ~z{", "\x00a\tb", "ÀB" * 5]:
        assert [t.decode() for p in ranking.pieces(text.encode()) for t in p] == terms(text)


@pytest.mark.parametrize("most", [ranking.MOST, 60])
def test_ranks(spark, odd, monkeypatch, most):
    monkeypatch.setattr(ranking, "BLOCK", 8)
    more = [(100 + i, prose(i % 30, 40 + i % 7) + " " + prose(7, i % 60), "en", "a", 1) for i in range(150)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, odd.select("doc_id", "text", "lang", "source", "n_chars").schema))
    docs = docs.selectExpr("*", "'x' AS row", "1 AS term", "2 AS part", "3 AS near")
    items = [(1, prose(3, 12)), (2, prose(7, 30) + " " + prose(7, 5)), (3, None), (4, "..."), (5, "Word unheard-of"), (None, prose(12, 9)), (6, prose(1, 5)), (6, prose(1, 5)), (7, "not there at all")]
    got = ranking.ranked(docs, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank"), most=most)
    want = brute([(r[0], r[1]) for r in odd_rows() + more], items)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 60


def test_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranking.ranked(none, items).count() == 0
    assert ranking.ranked(odd, items.where("false")).count() == 0


def test_long_text():
    text = b"Ab-c " * 1_000_000
    parts = list(ranking.pieces(text))
    assert len(parts) > 3 and sum(map(len, parts)) == 2_000_000


def run_of(rows, items, weights):
    """An index row of documents given as {term number: part}."""
    sizes = np.array([len(r) for r in rows])
    term, part = (np.array([x for r in rows for x in f(r)], np.int64) for f in (sorted, lambda r: [r[t] for t in sorted(r)]))
    here, most, pair, pair_most = ranking._summed_up(np.repeat(np.arange(len(rows)), sizes), term, part, len(rows), items.pairs()[3], len(items.terms))
    return {"row": np.arange(len(rows)), "doc_id": np.arange(len(rows)), "size": sizes, "term": term, "part": part, "here": here, "most": most, "pair": pair, "pair_most": pair_most}


def test_bounds_skip_and_miss_nothing():
    """Over random runs, the best are found, and most documents aren't scored."""
    r = np.random.default_rng(2)
    names = [b"t%03d" % k for k in range(120)]
    items = ranking.Items.of([(i, b" ".join(names[k] for k in r.choice(120, 6))) for i in range(15)])
    search, all_ = ranking.Search(items, best=5), []
    for run in range(12):
        base = r.choice(len(items.terms), 40, replace=False)  # documents of a run are alike
        rows = [{int(t): int(r.integers(1, 1000)) * (10 if run == 3 else 1) for t in r.choice(base, 12, replace=False)} for _ in range(32)]
        block = run_of(rows, items, None)
        block["doc_id"], block["row"] = block["doc_id"] + run * 32, block["row"] + run * 32
        all_ += rows
        search.add(block)
    for i in range(len(items.ids)):
        own = slice(items.start[i], items.start[i + 1])
        scores = [sum(int(n) * d.get(int(t), 0) for t, n in zip(items.term[own], items.times[own], strict=True)) for d in all_]
        want = [(s, k) for s, k in sorted(((s, k) for k, s in enumerate(scores) if s), key=lambda x: (-x[0], x[1]))[:5]]
        assert [(int(x[0]), int(x[1])) for x in search.found[i]] == want
    assert search.scored < 0.4 * search.passed


def test_flat():
    sizes, values = ranking._flat(pa.array([[1, 2], [], [3]], pa.list_(pa.int32())))
    assert sizes.tolist() == [2, 0, 1] and values.tolist() == [1, 2, 3]
