"""Near copies against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from loomery.llm import overlaps, simhash
from tests.llm.conftest import prose


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """Components of texts whose sets of five-word shingles are 0.8 alike, as frozensets of places."""
    sets = [shingled(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    return {frozenset(i for i, v in enumerate(label) if v == w) for w in label}


def texts():
    """Copies with more and more words changed, around the limit, long and short; and a passage that all of a family share."""
    r, out = random.Random(5), [None, "", " \n", "One two", "one  TWO", "one two three"]
    shared = prose(77, 60)
    for k in range(12):
        base = prose(100 + k, r.choice([6, 12, 40, 150])).split()
        out.append(" ".join(base))
        for changes in range(5):
            words = list(base)
            for _ in range(changes):
                words[r.randrange(len(words))] = f"w{r.random()}"
            out.append(" ".join(words).upper() if changes % 2 else " ".join(words))
        out.append(shared + " " + prose(200 + k, 30))
    out += [" ".join(prose(300, 100).split()[k:]) for k in range(0, 60, 4)]  # a chain whose ends are unlike
    return out


def test_stage_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(min(g) for g in groups([t for _, t in rows]))
    monkeypatch.setattr(overlaps, "SAMPLE", 1)  # frequent hashes are ranked last
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "unused").collect()) == want
    assert len(want) < len(rows) - 20


def test_ids(spark):
    """Repeated ids join no components, near copies without ids are one."""
    one, two, three = prose(20, 300), prose(21, 300), prose(22, 300)
    rows = [(1, one), (1, two), (2, two + " tail"), (None, three), (None, three + " tail"), (3, one)]
    kept = overlaps.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept if r.doc_id == 1) == sorted([one, two]) and len(kept) == 3


def test_sketches_bound_what_differs():
    """Of sets of all sizes, alike or not, the bound is never too high; for unlike ones it is above what SHARE allows."""
    r = np.random.default_rng(3)
    ruled_out = 0
    for n in (0, 1, 7, 40, 300, 5000):
        for share in (0.0, 0.5, 0.85, 0.95, 1.0):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(n * share)], r.integers(0, 2**63, int(n * (1 - share))).astype(np.uint64)]))
            least, differ = overlaps.least_apart(overlaps.sketch(a), overlaps.sketch(b)), len(np.setxor1d(a, b))
            assert least <= differ
            for f in overlaps.FOLDS:
                assert overlaps.least_apart(overlaps.folded(overlaps.sketch(a), f), overlaps.sketch(b)) <= differ
            assert n < 40 or 0.8 < share or least * 9 > len(a) + len(b)
            ruled_out += n >= 40 and least * 9 > len(a) + len(b)
    assert ruled_out >= 8


def test_texts_not_quite_alike(spark, monkeypatch):
    """A large group of copies of one text with edits of their own, most of them less than 0.8 alike: brute force, with runs cut into chunks, and few pairs leave them."""
    monkeypatch.setattr(overlaps, "CHUNK", 16)
    r = random.Random(8)
    base = prose(50, 150).split()
    rows = []
    for i in range(120):
        said = list(base)
        for k in r.sample(range(150), r.randint(1, 6)):
            said[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(said)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(x.doc_id for x in overlaps.deduplicate(docs).collect())
    sets = [set(overlaps.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links += 1
                label[max(find(i), find(j))] = min(find(i), find(j))
    assert kept == sorted({find(i) for i in range(len(rows))}) and 0 < links < 3000 and len(kept) > 3


def test_fingerprints_pair_what_pigeonhole_blocks_link(spark, monkeypatch):
    """The pairs connect exactly what fingerprints at most four bits apart connect; the stage asks for them, and makes each text's prefixes once."""
    r = np.random.default_rng(6)
    prints = [int(x) for x in r.integers(0, 2**63, 30)]
    prints += [p ^ (1 << int(r.integers(0, 60))) ^ (1 << int(r.integers(0, 60))) for p in prints[:12]] + prints[:5]
    classes = spark.createDataFrame([(100 + k, p) for k, p in enumerate(prints)], "fp long, print long")
    pairs = [(x.a - 100, x.b - 100) for x in overlaps.by_fingerprints(classes).collect()]

    def parts(links):
        label = list(range(len(prints)))
        for a, b in links:
            label = [label[a] if v == label[b] else v for v in label]
        return {frozenset(i for i, v in enumerate(label) if v == w) for w in label}

    close = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE]
    assert parts(pairs) == parts(close) and len(close) > 12
    asked, real = [], overlaps.by_fingerprints
    monkeypatch.setattr(overlaps, "by_fingerprints", lambda c: asked.append(c) or real(c))
    base = prose(60, 400)
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (3, prose(61, 90))], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "unused").collect()) == [1, 3]
    got = {x.fp: x["print"] for x in asked[0].collect()}
    want = [simhash.voted(overlaps.shingles(t)) for t in (base, base + " tail", prose(61, 90))]
    assert sorted(x % 2**64 for x in got.values()) == sorted(want)


def test_prefixes_are_made_once(spark):
    """A filter on the result doesn't make Spark run the function a second time."""
    texts = spark.createDataFrame([(prose(70, 50),), (None,)], "text string")
    marked = spark.sparkContext.broadcast(bytes(1 << 24))
    rows = texts.select(overlaps.prefixes(texts.text, np.zeros(0, np.uint64), marked, False).alias("p")).where("p IS NOT NULL")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and rows.count() == 2


def test_slices_of_texts():
    import pyarrow as pa

    from loomery.llm.common import in_slices

    values = pa.array(["a" * 10, None, "b" * 95, "", "c" * 300, "d"])
    for whole in (values, values.slice(1, 4), values.slice(0, 0)):
        parts = list(in_slices(whole, 100))
        assert [x for p in parts for x in p.to_pylist()] == whole.to_pylist()
        assert all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= 100 for p in parts)


def test_steps_with_nothing_to_do_are_left_out(spark, monkeypatch):
    """Near copies that the first pairs join cost one check and one round of components; no table is stored for steps without pairs."""
    from loomery.llm import components

    calls = []
    for module, name in ((overlaps, "verified"), (overlaps, "components"), (overlaps, "_sets"), (components, "written")):
        monkeypatch.setattr(module, name, lambda *a, name=name, f=getattr(module, name): calls.append(name) or f(*a))
    base = prose(60, 400)
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (3, prose(61, 90))], "doc_id long, text string")
    assert sorted(x.doc_id for x in overlaps.deduplicate(docs).collect()) == [1, 3]
    assert sorted(calls) == ["_sets", "components", "verified", "written"]


def test_components_of_links_that_are_stars_need_no_round(spark, monkeypatch):
    from loomery.llm import components

    stored = []
    monkeypatch.setattr(components, "written", lambda df, f=components.written: stored.append(1) or f(df))
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7), (200, 200)]
    for rows, rounds in (([(1, 5), (9, 1), (2, 3)], 0), ([], 0), (links, None)):
        stored.clear()
        got = {x.node: x.root for x in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
        want = {v: v for a, b in rows if a != b for v in (a, b)}
        for _ in want:
            for a, b in rows:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        assert got == want and (rounds is None or len(stored) == 1 + rounds)


def test_a_class_with_many_pairs_is_salted(spark, monkeypatch):
    """With salts on one side, on both or on none, each pair gets both sets."""
    pairs = spark.createDataFrame([(1, k) for k in range(2, 12)] + [(k, 20) for k in range(1, 9)], "a long, b long")
    sets = spark.createDataFrame([(k, [k, k + 1]) for k in range(1, 30)], "fp long, set array<long>")
    want = sorted((x.a, x.b, [x.a, x.a + 1], [x.b, x.b + 1]) for x in pairs.collect())
    for most, crowded in ((3, {"a", "b"}), (9, {"a"}), (99, set())):
        monkeypatch.setattr(overlaps, "SALTED", most)
        assert overlaps._crowded(pairs) == crowded
        got = overlaps._with_sets(pairs, sets, crowded).select("a", "b", "set_a", "set_b").collect()
        assert sorted(tuple(x) for x in got) == want


def test_bits_pass_the_driver_packed(spark):
    """A sparse bit map takes a small part of its size on its way, and comes out whole."""
    from loomery.llm import common

    r = np.random.default_rng(9)
    keys = r.integers(-(2**63), 2**63, 5000)
    table = spark.createDataFrame([(int(k),) for k in keys], "h long")
    assert common.bit_chunks(table, "h").selectExpr("sum(length(bits))").first()[0] < 1 << 19
    bits = np.frombuffer(common.bit_map(table, "h"), np.uint8)
    assert common.in_bit_map(keys.view(np.uint64), bits).all() and int(np.bitwise_count(bits).sum()) == len(set((keys & (2**27 - 1)).tolist()))
