"""Fingerprints, links and components against brute force."""

import numpy as np
import xxhash

from loomery.llm import simhash
from tests.llm.conftest import odd_rows, prose


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    n = len(ids)
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    roots = [find(i) for i in range(n)]
    low = {r: min((ids[i] for i in range(n) if roots[i] == r and ids[i] is not None), default=None) for r in set(roots)}
    return [low[r] for r in roots]


def test_fingerprint():
    for text in ["", None, "One", "a B c", "A b C d É f", "x y z " * 50, "ä b c d e"]:
        assert simhash.simhash(text) == plain(text)


def test_components_on_odd_rows(odd, none):
    rows = odd_rows()
    got = simhash.near_duplicates(odd).collect()
    want = brute_components([r[0] for r in rows], [plain(r[1]) for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(zip([r[0] for r in rows], want, strict=True), key=key)
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_chunks(spark):
    """A dense cluster, with chunks so small that most links lie between chunks."""
    r = np.random.default_rng(3)
    centres = [int(x) for x in r.integers(0, 1 << 63, 12)]
    prints = {c ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 4)), replace=False)) for c in centres for _ in range(40)}
    prints = sorted(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    want = brute_components(list(range(len(prints))), prints)
    marked = spark.createDataFrame(rows, "doc_id long, fp long")
    for chunk in (7, 1500):
        linked = simhash.links(marked.select("fp"), chunk=chunk)
        roots = {x.node: x.root for x in simhash.components(linked).collect()}
        groups = {}
        for i, f in rows:
            groups.setdefault(roots.get(f, f), []).append(i)
        assert sorted(sorted(g) for g in groups.values()) == sorted(sorted(i for i, w in enumerate(want) if w == v) for v in set(want))


def test_deduplicate(odd, none):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 7, 8, None, 9, -5, 10, 2**62], key=str)
    assert simhash.deduplicate(none).count() == 0


def test_deduplicate_by_component(spark):
    """Repeated ids join no components, and near copies without ids are one component."""
    one, two, three = prose(20, 300), prose(21, 300), prose(22, 300)
    rows = [(1, one), (1, two), (2, two + " tail"), (None, three), (None, three + " tail"), (3, one)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.doc_id) == sorted([(1, one), (1, two)])
    assert [r.text in (three, three + " tail") for r in kept if r.doc_id is None] == [True]


def test_more_pieces_find_the_same(spark):
    """However many pieces are chosen for a table's size, the components are the same."""
    r = np.random.default_rng(5)
    prints = {int(c) ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 5)), replace=False)) for c in r.integers(0, 1 << 63, 30) for _ in range(8)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = [{(x.node, x.root) for x in simhash.components(simhash.links(df, blocks=b)).collect()} for b in simhash.BLOCKS]
    assert all(f == found[0] for f in found)
    assert [simhash.pieces_for(n) for n in (10, 10**7, 10**9, 10**12)] == [6, 7, 8, 10]
