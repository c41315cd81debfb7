"""Fingerprints: equal for equal texts, near the generalised Jaccard similarity, edits as told."""

import hashlib
import math
from collections import Counter

from loomery.llm import fingerprints
from loomery.llm.queries import op5_fingerprints
from tests.llm.conftest import odd_rows, prose


def weights(text):
    return {w: 1 + math.log(n) for w, n in Counter((text or "").encode().split()).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys) if keys else 1.0


def within(got, want, draws=fingerprints.DRAWS):
    """Whether a share of equal draws can come from that similarity: within five standard errors and a draw."""
    return abs(got - want) <= 5 * math.sqrt(want * (1 - want) / draws) + 1 / draws


def test_likeness_estimates_jaccard(spark):
    """Single estimates by their standard error, and no bias on average: for long texts, and for texts of 4 to 40 words."""
    for n, lengths in ((150, [300]), (900, [4, 9, 20, 40])):
        pairs = []
        for i in range(n):
            words = prose(i, lengths[i % len(lengths)]).split()
            cut = len(words) * (i % 60) // 60
            pairs.append((i, " ".join(words), " ".join(words[cut:] + words[:5] * (i % 7) + prose(1000 + i, cut).split())))
        rows = spark.createDataFrame(pairs, "i int, a string, b string")
        rows = fingerprints.fingerprints(fingerprints.fingerprints(rows, text="a", name="fa"), text="b", name="fb")
        got = {r.i: r.near for r in rows.select("i", fingerprints.likeness("fa", "fb").alias("near")).collect()}
        want = {i: jaccard(a, b) for i, a, b in pairs}
        assert all(within(got[i], want[i]) for i in want)
        error = math.sqrt(sum(w * (1 - w) for w in want.values()) / fingerprints.DRAWS) / n
        assert abs(sum(got[i] - want[i] for i in want) / n) < 4 * error < 0.03


def test_draws_by_hand(spark):
    """The draws of a few texts, from the definition, in Python."""
    texts = ["a b b c c c", "x", "a a a a", "q w e r t y"]
    rows = fingerprints.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string"), draws=8).collect()
    hashes = {w: h for w, h in ((r.w, r.h) for r in spark.createDataFrame([(w,) for w in set(" ".join(texts).split())], "w string").selectExpr("w", "xxhash64(w) AS h").collect())}
    cells = [(h, d) for h in hashes.values() for d in range(16)]
    seeded = spark.createDataFrame(cells, "h long, d int")
    u = {(r.h, r.d): r.x & (2**64 - 1) for r in seeded.selectExpr("h", "d", "xxhash64(h, d) AS x").collect()}
    mine = {}
    for r in rows:
        least = []
        for d in range(8):
            a = {}
            for w, n in Counter(r.text.split()).items():
                x, y = u[hashes[w], 2 * d], u[hashes[w], 2 * d + 1]
                rr = -math.log(((x >> 43) + 0.5) * ((x >> 22 & 2**21 - 1) + 0.5) / 2**42)
                beta = ((x & 2**22 - 1) + 0.5) / 2**22
                c = -math.log(((y >> 32) + 0.5) * ((y & 2**32 - 1) + 0.5) / 2**64)
                t = math.floor(math.log(1 + math.log(n)) / rr + beta)
                a[w] = math.log(c) - rr * (t - beta + 1)
            least.append(min(a.values()))
        mine[r.text] = least
    for r in rows:
        for o in rows:
            same = [math.isclose(p, q, rel_tol=1e-12) for p, q in zip(mine[r.text], mine[o.text], strict=True)]
            assert [p == q for p, q in zip(r.signature, o.signature, strict=True)] == same


def test_odd_rows(odd, none):
    rows = fingerprints.fingerprints(odd)
    assert rows.columns == [*odd.columns, "signature"] and rows.count() == len(odd_rows())
    by = {}
    for r in rows.collect():
        assert by.setdefault(r.text, r.signature) == r.signature
    assert by[None] == by[""] == [] and fingerprints.fingerprints(none).count() == 0
    assert rows.where("size(signature) > 0").count() == len(odd_rows()) - 4


def test_compared(spark, odd, none):
    rows = spark.createDataFrame([(r[0], r[1] or "") for r in odd_rows()], "doc_id long, t string").selectExpr("doc_id", "t", "xxhash64(t) AS h").collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    want = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        m = len(r.t) // 3
        edited = r.t[: len(r.t) - m] + after.t[:m]
        want.append((r.doc_id, len(r.t), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.compared(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compared(none).count() == 0
    one = fingerprints.compared(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_ids_missing(spark):
    """Rows without ids are dealt to all ranges, and each still has a next one."""
    rows = spark.range(2000).selectExpr("CAST(null AS long) AS doc_id", "concat('text ', id % 1500, ' of some words') AS text")
    keys = rows.selectExpr("isnull(doc_id) AS k_none", "0L AS k", "xxhash64(text) AS h").distinct()
    numbered = fingerprints._numbered(keys)
    assert sorted(r.number for r in numbered.collect()) == list(range(1500))
    assert fingerprints.compared(rows).count() == 2000


def test_query(spark, small):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op5_fingerprints(spark, small).collect()}
    bias = []
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert within(got[i].near_edited, jaccard(t, edited)) and within(got[i].near_next, jaccard(t, nxt))
        bias.append(got[i].near_edited - jaccard(t, edited))
    assert abs(sum(bias) / len(bias)) < 4 * 0.5 / math.sqrt(fingerprints.DRAWS * len(bias))
