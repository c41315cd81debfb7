"""The two models: pseudo-likelihoods against loops, toxicity on a held-out fold."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomery.llm import likelihood, toxicity
from loomery.llm.queries import op10_toxicity
from tests.llm.conftest import odd_rows, prose


def small_vocabulary(spark, texts):
    return likelihood.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string")).shipped()


def test_pseudo_likelihood_is_the_sum_over_words(spark):
    texts = ["a b c d e f", "", "x", prose(1, 5000)]
    vocab, net = small_vocabulary(spark, texts), likelihood.fresh(3)
    r = np.random.default_rng(4)
    net["w1"], net["w2"] = (r.normal(0, 0.3, net[k].shape).astype(np.float32) for k in ("w1", "w2"))
    coded = [likelihood._encoded(vocab, t)[0] for t in texts]
    got, plain = likelihood.pseudo_likelihoods(net, vocab, coded)
    for t, total, alone in zip(coded[:3], got, plain, strict=False):
        want = want_alone = 0.0
        for i, c in enumerate(vocab.classes(t)):
            x = net["bias"].copy()
            for k in (1, 2):
                x += net["left"][t[i - k] if i >= k else likelihood.NOWHERE] + net["right"][t[i + k] if i + k < len(t) else likelihood.NOWHERE]
            h, band, ending = np.tanh(x), c // likelihood.ENDINGS, c % likelihood.ENDINGS
            one, two = h @ net["w1"] + vocab.log_band, h @ net["w2"] + vocab.log_ending[band]
            want += one[band] - np.log(np.exp(one).sum()) + two[ending] - np.log(np.exp(two).sum())
            want_alone += vocab.log_band[band] + vocab.log_ending[band, ending]
        assert abs(want - total) < 1e-3 and abs(want_alone - alone) < 1e-9
    assert np.isclose(likelihood.pseudo_likelihoods(net, vocab, coded[3:])[0][0], got[3], rtol=1e-6)


def test_gradients(spark):
    text = "a b c d e a b c"
    vocab, net = small_vocabulary(spark, [text]), likelihood.fresh(5)
    net["w1"] += 0.1
    at = likelihood._encoded(vocab, text)[0]
    (around, owner, target), eps = next(likelihood.streams([at])), 1e-2
    loss = lambda n: -float(likelihood.pseudo_likelihoods(n, vocab, [at])[0][0]) / len(at)
    net["w2"] = np.random.default_rng(1).normal(0, 0.5, net["w2"].shape).astype(np.float32)
    c = int(vocab.classes(at)[0])
    for name, place in (("w1", (3, c // 64)), ("w2", (2, c % 64)), ("left", (int(at[1]), 2)), ("bias", (4,))):
        moved = {k: v.copy() for k, v in net.items()}
        moved[name][place] += eps
        slope = (loss(moved) - loss(net)) / eps
        trained, memory = {k: v.copy() for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
        likelihood.step(trained, memory, vocab, around, owner, target, 0.0)
        assert np.isclose(np.sqrt(memory[name][place]), abs(slope), rtol=0.1, atol=5e-4)


def test_words_and_counts(spark):
    """Hashes are Spark's, long texts are read in slices, and the probabilities of all words add up to 1 but for the unseen."""
    text = " ".join(prose(i, 3000) for i in range(3)) + " \u00e9\u00e0 \t x"
    h, e = likelihood.words_of(text)
    want = spark.createDataFrame([(w,) for w in text.encode().decode().split()], "w string").selectExpr("w", "xxhash64(w) AS h").collect()
    assert [x - (1 << 64) if x >> 63 else x for x in h.tolist()] == [r.h for r in want] and len(e) == len(h)
    kept, likelihood.SLICE = likelihood.SLICE, 100
    try:
        again = likelihood.words_of(text)
    finally:
        likelihood.SLICE = kept
    assert (again[0] == h).all() and (again[1] == e).all()
    docs = spark.createDataFrame([(text,)], "text string")
    for size in (10, 100_000):
        vocab = likelihood.vocabulary(docs, size=size)
        total = 0.0
        counts = {r.h & (2**64 - 1): (r.n, r.ending) for r in vocab.counts.collect()}
        known = dict(zip(vocab.hashes.tolist(), zip(vocab.word_class, vocab.log_in_class, strict=True), strict=True))
        for x, (n, ending) in counts.items():
            c, inside = known.get(x, ((likelihood.BANDS - 1) * likelihood.ENDINGS + ending, None))
            inside = np.log((n + 0.5) / vocab.tail_total[ending]) if inside is None else inside
            total += np.exp(vocab.log_band[c // likelihood.ENDINGS] + vocab.log_ending[c // likelihood.ENDINGS, c % likelihood.ENDINGS] + inside)
        assert 0.75 < total <= 1 + 1e-9


def test_words_are_hashed_once(spark, monkeypatch):
    """Counting and coding hash the distinct words of a slice, not each occurrence, and give what words one by one give, however texts are cut."""
    texts = ["", None, " \t\n", " a  b\x1c\x0b\u00e9 ", prose(1, 4000) * 3, "x\x00 \x00 y", prose(2, 50)] + ["of the of the"] * 500
    vocab = small_vocabulary(spark, texts[:6])
    plain = [(t or "").encode().split() for t in texts]
    hashes = [[likelihood._digest(w) for w in words] for words in plain]
    calls, digest = [], likelihood._digest
    monkeypatch.setattr(likelihood, "_digest", lambda w: calls.append(w) or digest(w))
    array = pa.array(texts)
    for size in (likelihood.SLICE, 100):
        monkeypatch.setattr(likelihood, "SLICE", size)
        calls.clear()
        found = list(likelihood._counted(iter([pa.record_batch({"text": array})])))
        if size > 100:
            assert len(calls) <= len({w for words in plain for w in words}) + 1
        got = dict(zip(found[0]["h"].to_numpy().view(np.uint64).tolist(), found[0]["n"].to_pylist(), strict=True))
        assert len(found) == 1 and got == Counter(h for row in hashes for h in row)
        n, codes, inside, n_rare, rare = likelihood._encoded_texts(vocab, array)
        assert n.tolist() == [len(words) for words in plain] and n.sum() == len(codes)
        known = dict(zip(vocab.hashes.tolist(), zip(vocab.code, vocab.log_in_class, strict=True), strict=True))
        assert rare.tolist() == [h for row in hashes for h in row if h not in known] and n_rare.tolist() == [sum(h not in known for h in row) for row in hashes]
        for row, words, end, total in zip(hashes, texts, np.cumsum(n), inside, strict=True):
            endings = likelihood.words_of(words)[1]
            last = likelihood.OWN + (likelihood.BANDS - 1) * likelihood.ENDINGS
            assert codes[end - len(row) : end].tolist() == [known[h][0] if h in known else last + e for h, e in zip(row, endings, strict=True)]
            want = sum(known[h][1] if h in known else -np.log(vocab.tail_total[e]) for h, e in zip(row, endings, strict=True))
            assert np.isclose(total, want, rtol=1e-12, atol=1e-12)


def test_training_learns_order(spark, odd, none):
    """Held-out documents are likelier in context than by their words alone, shuffled ones are not, and dealing rows otherwise changes nothing."""
    words = [f"w{i}{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(30)]
    docs = [(i, " ".join(words[(i + k) % 30] for k in range(200))) for i in range(240)]
    train, rest = spark.createDataFrame(docs[:180], "doc_id long, text string"), spark.createDataFrame(docs[180:], "doc_id long, text string")
    vocab = likelihood.vocabulary(train)
    net = likelihood.fit(likelihood.coded(train, vocab), vocab, copy=2000)
    mean = lambda d: d.agg({"mean_log_likelihood": "avg", "mean_unigram": "avg"}).first()
    held = mean(likelihood.scored(likelihood.coded(rest, vocab), vocab, net))
    assert held["avg(mean_log_likelihood)"] > held["avg(mean_unigram)"] + 0.5
    mixed = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).permutation(t.split()))) for i, t in docs[180:]], "doc_id long, text string")
    other = mean(likelihood.scored(likelihood.coded(mixed, vocab), vocab, net))
    assert other["avg(mean_log_likelihood)"] < held["avg(mean_log_likelihood)"] - 0.5
    a, b = (sorted(map(tuple, likelihood.scores(train.repartition(n), copy=2000).collect())) for n in (1, 7))
    assert a == b
    rows = likelihood.scores(odd).collect()
    assert len(rows) == len(odd_rows())
    assert all((r.n_tokens == 0) == (r.mean_log_likelihood is None) for r in rows)
    assert likelihood.scores(none).count() == 0


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.classified(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == len(odd_rows()) and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.classified(none, toxicity.fit(none, labels)).count() == 0


def test_toxicity_on_held_out_rows(spark, odd):
    r = np.random.default_rng(1)
    bad = ["vilewretch", "grotesque", "abominable", "despicable"]
    docs, labels = [], []
    for i in range(900):
        words = prose(i, 40).split()
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words.insert(int(r.integers(0, 40)), bad[int(r.integers(0, 4))])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, m)
    rows = toxicity.classified(d, model).collect()
    held = [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert {x.doc_id for x in held} == {x.doc_id for x in rows if x.held_out}
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.95
    assert {x.score for x in rows} == {x.score for x in toxicity.classified(d, toxicity.fit(d, m)).collect()}
    assert toxicity.classified(odd, model).count() == len(odd_rows())


def test_toxicity_of_long_labelled_texts(spark):
    """A bound on characters leaves texts out and never makes the score a constant; a long text is the last to be taken."""
    docs = [(i, prose(i, 25) + (" grotesque vilewretch" if i % 2 else "")) for i in range(300)]
    long = spark.range(1).selectExpr("1000L AS doc_id", "repeat('grotesque words ', 1600000) AS text")
    d = spark.createDataFrame(docs, "doc_id long, text string").unionByName(long)
    m = spark.createDataFrame([(i, i % 2) for i, _ in docs] + [(1000, 1)], "doc_id long, toxic int")
    for how in ({}, {"sample_chars": 200}, {"sample_chars": 20_000}):
        model = toxicity.fit(d, m, **how)
        assert model.constant is None
        scores = {r.doc_id: r.score for r in toxicity.classified(d, model).collect()}
        assert len(set(scores.values())) > 1 or how == {"sample_chars": 200}
    only = toxicity.fit(long.unionByName(d.where("doc_id % 2 = 0 AND doc_id < 200")), m)
    assert only.constant is None


def test_thresholds_and_histograms():
    """Thresholds are the least gains that few enough ordinary windows reach; features agree with the list of gains."""
    counts = np.zeros(2 * toxicity.MOST + 1, np.int64)
    counts[toxicity.MOST] = 9_900
    counts[toxicity.MOST + 1 : toxicity.MOST + 4] = (90, 9, 1)
    assert toxicity.calibrated(counts) == (1, 1, 2, 3)
    gains = [0, 0, 3, -30, 5, 40, 1]
    h = toxicity.histogram(" ".join(map(str, range(len(gains)))), lambda w: gains[int(w)])
    v = np.clip(gains, -toxicity.MOST, toxicity.MOST)
    f = toxicity.features(h, (1, 4))
    assert f[:3] == [24.0, np.mean([24, 5, 3]), v.mean()] and f[5:7] == [4 / 7, 2 / 7] and np.allclose(f[3:5], np.log1p([4, 2]))


def test_labels_of_the_fold_are_not_read(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)
    rows = op10_toxicity(spark, small).collect()
    assert len(rows) == docs.count() and all(r.predicted == (r.score >= 0.3) for r in rows)
