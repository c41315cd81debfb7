"""Vector codes and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from loomery.llm import codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long, cid long, team string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


def planted(seed=3, n=300, dims=64):
    """Random vectors of three labels, of which one holds a group of copies, a chain and exact copies; and odd rows."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    for i in range(40, 90):
        x[i] = x[40] + r.standard_normal(dims) * 0.15
    for i in range(100, 120):  # each is near the one before it, not the first
        x[i] = x[i - 1] + r.standard_normal(dims) * 0.3
    x[130:134] = x[129]
    label = np.where(np.arange(n) < 200, 0, 1 + np.arange(n) % 2)
    rows = [(int(i * 3 - 50), [float(np.float32(c)) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    nan, inf = float("nan"), float("inf")
    odd = [(7001, None, 0), (7002, [0.0] * dims, 0), (7003, [nan] * dims, 0), (7004, [inf] + [1.0] * (dims - 1), 0), (7005, [None] + [1.0] * (dims - 1), 0)]
    odd += [(7006, rows[0][1], None), (7007, rows[0][1], None), (None, rows[40][1], 0), (rows[40][0], rows[40][1], 0), (7008, [], 0), (7009, rows[0][1][:10], 0), (7010, rows[0][1][:10], 0), (None, None, None)]
    odd += [(7011, [c * 1e30 for c in rows[5][1]], 0), (7012, [c * 1e-30 for c in rows[5][1]], 0)]
    return rows + odd


def brute_links(rows, cosine=vectors.COSINE):
    def unit(v):
        if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float) / max(map(abs, v))
        return v / np.sqrt(v @ v)

    u, n = [unit(r[1]) for r in rows], len(rows)
    near = [[j for j in range(n) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= cosine] for i in range(n)]
    seen, out = set(), [None] * n
    for i in range(n):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in part:
                    part.add(j)
                    todo.append(j)
        seen |= part
        low = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (rows[j][0], len(near[j]), low, rows[j][0] == low)
    return out


@pytest.mark.parametrize(("crowd", "chunk"), [(512, 1024), (512, 16), (20, 16)])
def test_links(spark, monkeypatch, crowd, chunk):
    monkeypatch.setattr(vectors, "CROWD", crowd)
    rows = planted()
    got = vectors.near_duplicates(frame(spark, rows), chunk=chunk).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_links(rows)))


def test_links_of_nothing(spark):
    assert vectors.near_duplicates(frame(spark, planted()).where("false")).count() == 0


def test_recall_at_the_threshold():
    """Pairs at the threshold itself share a key in 99 of 100 cases, and their estimates let them pass; far pairs are seldom computed."""
    r = np.random.default_rng(5)
    n, dims = 4000, 64
    x = vectors.unit(r.standard_normal((n, dims)))
    e = r.standard_normal((n, dims))
    e = vectors.unit(e - (e * x).sum(1)[:, None] * x)
    y = vectors.COSINE * x + math.sqrt(1 - vectors.COSINE**2) * e
    turn = vectors.rotation(vectors.BITS, dims)
    (a, fa), (b, fb) = vectors.encoded(x, turn), vectors.encoded(y, turn)
    masks = vectors.plan(3_000_000)
    assert len(masks) > 20
    shared = np.array([((a ^ b) & m == 0).all(1) for m in masks]).any(0)
    assert shared.mean() > 0.99
    estimate = (vectors.corners(a, turn, dims) * y).sum(1) / fa
    assert abs(estimate.mean() - vectors.COSINE) < 0.002  # unbiased
    assert (estimate >= vectors.least_estimate(fa, vectors.COSINE, vectors.BITS)).all()
    far = vectors.corners(a[:500], turn, dims) @ x[500:1500].T / fa[:500, None]
    assert (far >= vectors.least_estimate(fa[:500], vectors.COSINE, vectors.BITS)[:, None]).mean() < 1e-4


def test_pairs_computed_anew():
    """In a block, hardly more pairs are computed than there are links."""
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 64))
    x[:20] = x[0] + 0.1 * r.standard_normal((20, 64))
    turn = vectors.rotation(256, 64)
    words, factor = vectors.encoded(vectors.unit(x), turn)
    block = {"code": words, "factor": factor, "side": np.full(400, -1), "key": 0, "m": np.ones(400, np.int64)}
    n, a, b, computed = vectors.compared(block, [v.astype("<f8").tobytes() for v in x], vectors.plan(1), turn, 8, 0.93)
    assert n.sum() == 20 * 19 and len(a) == 19 and computed <= 200


def brute_codes(rows, entries=256):
    kept = sorted((r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-max(len(r[1]) for r in kept) // 4)
    x = [[max(-codes.MOST, min(codes.MOST - 1, math.floor(1024 * c))) for c in r[1]] + [0] * (4 * width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i][: len(kept[i][1])]))
    parts = [[v[p * width : p * width + width] for v in x] for p in range(4)]
    books = [[list(parts[p][i]) for i in order[:entries]] for p in range(4)]
    apart = lambda u, v: sum((s - t) ** 2 for s, t in zip(u, v, strict=True))
    near = lambda u, book: min((apart(u, e), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            own = [near(u, books[p])[1] for u in parts[p]]
            for k in set(own):
                of = [u for u, o in zip(parts[p], own, strict=True) if o == k]
                books[p][k] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    out = []
    for i, r in enumerate(kept):
        found = [near(parts[p][i], books[p]) for p in range(4)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted((*o, sum(q[3] for q in out if q[1] == o[1])) for o in [(str(a), b, c, d) for a, b, c, d in out]), books


def test_codes(spark):
    rows = [r for r in planted(n=320, dims=16) if r[0] not in (7011,)]
    want, books = brute_codes(rows)
    coded, found = codes.compress(frame(spark, rows))
    got = sorted(((str(r.vec_id), r.label, r.code, r.error, r.label_error) for r in coded.collect()), key=str)
    assert found.tolist() == books and got == sorted(want, key=str)
    back = codes.decoded(coded.where("vec_id = -50"), found).first()
    whole = [math.floor(1024 * c) for c in rows[0][1]]
    assert sum((round(a * 1024) - b) ** 2 for a, b in zip(back.vector, whole, strict=True)) == back.error


def test_codes_of_little(spark):
    assert codes.compress(frame(spark, planted()).where("false"))[0].count() == 0
    few = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [], 1), (3, [1e38, -1e38, 0.0, 0.0, 5.0], None)]
    coded, books = codes.compress(frame(spark, few))
    assert books.shape == (4, 3, 2) and {r.vec_id: r.error for r in coded.collect()} == {1: 0, 2: 0, 3: 0}


def test_nearest_with_ties():
    r = np.random.default_rng(1)
    entries, x = r.integers(-3, 4, (256, 4)), r.integers(-5, 6, (3000, 4))
    x[7], x[8] = 10**8, -(10**8)
    index, apart = codes.Book(entries).nearest(x)
    all_ = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == all_.argmin(1)).all() and (apart == all_.min(1)).all()
