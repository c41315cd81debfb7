"""Duplicate passages against a count of all windows."""

import hashlib
from collections import Counter

import pytest

from loomery.llm import substrings
from tests.llm.conftest import odd_rows, prose


def brute(rows, window=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def planted():
    """Passages shared at various offsets, some differing by a word, and one with many neighbours."""
    passage, other = prose(50, 70), prose(51, 36)
    rows = [(200 + i, f"{prose(60 + i, 20 + i)} {passage} {prose(90 + i, 15)}") for i in range(6)]
    rows += [(220, f"{passage} {other}"), (221, f"{other} {passage.replace(passage.split()[40], 'changed')}"), (222, " ".join([prose(70, 40)] * 3))]
    rows += [(230 + i, f"{prose(150 + i, 20)} {prose(80, 20)} {prose(180 + i, 20)}") for i in range(5)]  # 20 words only
    return rows


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"block": 1}])
def test_digests(spark, odd, how):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(planted(), "doc_id long, text string"))
    want = brute([(r[0], r[1]) for r in odd_rows()] + planted())
    got = sorted((tuple(r) for r in substrings.digests(docs, **how).collect()), key=str)
    assert got == want


def test_remove(odd, none):
    left = substrings.remove(odd)
    assert left.columns == odd.columns and left.count() == len(odd_rows())
    assert [r.text for r in left.where("doc_id = 8").collect()] == ["", ""]
    assert [r.text for r in left.where("doc_id = 3").collect()] == ["tail"]
    assert left.where("doc_id = 7").first().text == next(r[1] for r in odd_rows() if r[0] == 7)
    assert substrings.remove(none).count() == 0 and substrings.digests(none).count() == 0


def test_greedy_factors():
    block = [[1, 2, 3, 4], [9, 2, 3, 8], [3, 4, 5]]
    index = {}
    for s, seg in enumerate(block):
        for at, x in enumerate(seg):
            index.setdefault(x, []).append((s, at))
    assert substrings.factors(block[0], index, block, 0) == [(1, 2), (3, 3)]
    assert substrings.factors(block[1], index, block, 1) == [(1, 2)]
