"""Operators on small inputs whose results are known by hand."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.operators import chats, filters, guard, mix, order, overlap, records, retrieval, sampling, schedule, scores, shards, telemetry
from loomery.sources import sinks, tables


def test_round_robin_drops_dry_parts(spark):
    rows = [(0, "A", 3), (1, "A", 2), (2, "A", 4), (3, "B", 2), (4, "B", 3), (5, "C", 3), (6, "C", 3), (7, "C", 3), (8, "C", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, int_score int")
    got = mix.round_robin(docs).where(filters.row_filter({"int_score": 3})).orderBy("position").collect()
    assert [(r.source, r.seq) for r in got] == [("A", 0), ("C", 0), ("B", 1), ("C", 1), ("A", 2), ("C", 2)]


def test_file_prefix(spark):
    files = spark.createDataFrame([("g", f"f{i}", 40) for i in range(4)], "g string, path string, size long")
    need = lambda n: mix.file_prefix(files, F.lit(n).cast("long"), "g", "path").count()
    assert [need(n) for n in (1, 80, 81, 10_000, None)] == [1, 2, 3, 4, 4]


def test_row_filter_and_nulls(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (2, None, "x"), (3, 5, None), (4, 5, "bad"), (5, 1, "x")], "i int, s int, k string")
    assert [r.i for r in rows.where(filters.row_filter({"s": 3}, {"k": ["bad"]})).collect()] == [1, 3]




@pytest.mark.parametrize(("spec", "hours"), [("9-17", set(range(9, 17))), ("22-6", {22, 23, 0, 1, 2, 3, 4, 5}), ("5-5", set(range(24))), (None, set(range(24)))])
def test_in_hours(spark, spec, hours):
    assert {r.id for r in spark.range(24).where(filters.in_hours(spec, F.col("id"))).collect()} == hours


def test_shares_of_long_and_short_documents(spark):
    rows = [(i, "x" * (1200 + i * 37 % 1700), "long") for i in range(300)] + [(1000 + i, "y" * (20 + i * 7 % 60), "short") for i in range(40_000 // 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = mix.take_budget(mix.stride_order(docs, {"long": 0.6, "short": 0.4}), 120_000)
    share = {r.lang: r.pct for r in mix.share_report(taken, {"long": 0.6, "short": 0.4}).collect()}
    assert abs(share["long"] - 60) < 3


def test_next_fit_rule():
    assert shards.next_fit([4, 4, 4, 20, 3, 7, 1], 10).tolist() == [0, 0, 1, 2, 3, 3, 4]
    assert shards.next_fit([20, 20, 5], 10).tolist() == [0, 1, 2]
    assert shards.next_fit([10, 1], 10).tolist() == [0, 1] and shards.next_fit([], 10).tolist() == []


def test_packed_windows_are_the_stream(spark):
    texts = ["abc", "", "é€", "z" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.packed_windows(docs, 8).orderBy("window_id").collect()
    stream = b"".join(t.encode() + b"\0" for t in texts)
    assert "".join(r.x for r in rows) == stream.hex().upper()
    assert [r.next_token for r in rows] == [r.x[:2] for r in rows[1:] + rows[:1]]


def test_rank_windows_cover(spark):
    rows = spark.range(24).select("id", shards.rank_of(F.col("id"), [3, 1]).alias("rank")).collect()
    assert [r.rank for r in rows[:8]] == [0, 0, 0, 1, 0, 0, 0, 1]


def test_anneal_counts(spark):
    rows = schedule.anneal_blend(schedule.steps(spark, range(7)), batch=8, start=3, ramp=1, fraction=0.5).orderBy("step").collect()
    assert [r.anneal for r in rows] == [0, 0, 0, 4, 4, 4, 4] and rows[-1].main_at + rows[-1].main == 40


def test_dealt_shares(spark):
    speeds = spark.createDataFrame([(0, 10.0), (1, 5.0), (2, 0.1)], "rank int, speed double")
    assert [r.share for r in schedule.dealt_shares(speeds, 16).orderBy("rank").collect()] == [10, 5, 1]


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "tool", "q"), (3, 1, "assistant", "a"), (4, 0, "user", " \n"), (4, 1, "assistant", "a"), (5, 0, "system", "s"), (5, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chats.valid(turns).where("valid").collect()} == {1}
    assert {r.conv_id: r.rendered for r in chats.chatml(turns).collect()}[1] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    counts = {r.conv_id: r for r in chats.supervision(turns).collect()}
    assert counts[1].n_supervised == len("a<|im_end|>\n") and counts[2].n_supervised == 0


def test_threads(spark):
    nodes = [(1, None, "user", None, 0), (2, 1, "assistant", 2.0, 1), (3, 1, "assistant", 1.0, 2), (4, 3, "user", None, 3), (5, 3, "assistant", 0.0, 4), (6, None, "user", 0.0, 5), (7, None, "assistant", 0.0, 6)]
    got = chats.best_threads(spark.createDataFrame(nodes, "message_id long, parent_id long, role string, rank double, seq long")).collect()
    assert sorted((r.root, r.depth, r.message_id) for r in got) == [(1, 0, 1), (1, 1, 3)]


def test_long_and_circular_threads(spark):
    schema = "message_id long, parent_id long, role string, rank double, seq long"
    nodes = [(i, i - 1 if i else None, "assistant" if i % 2 else "user", None, i) for i in range(70)]
    got = chats.best_threads(spark.createDataFrame(nodes, schema)).collect()
    assert sorted((r.depth, r.message_id) for r in got) == [(i, i) for i in range(70)]
    circle = [(0, None, "user", None, 0), (1, 0, "assistant", None, 1), (2, 1, "user", None, 2), (1, 2, "assistant", None, 3)]
    with pytest.raises(RuntimeError):
        chats.best_threads(spark.createDataFrame(circle, schema))


def test_reward_margin(spark):
    rows = spark.createDataFrame([("2", "1"), ("1", "2"), (None, "1"), ("x", "1"), ("1", "1")], "c string, r string")
    assert [r.k for r in rows.select(filters.margin_ok("c", "r", 0.0).alias("k")).collect()] == [True, False, True, True, True]


def test_overlap(spark):
    context = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(context,), ("short",)], "text string")
    rows = spark.createDataFrame([(1, context.upper() + "!"), (2, "another " + context[:40]), (3, None), (4, "")], "id int, text string")
    assert [r.id for r in overlap.overlapping(rows, "id", bench).collect()] == [1]
    assert {r.id for r in overlap.clean(rows, "id", bench).collect()} == {2, 3, 4}


def test_overlap_with_large_benchmarks(spark):
    """The same keys, whether the hashes of the benchmark are held by all tasks or joined; empty tables have no overlap."""
    parts = [" ".join(f"w{k}" for k in range(a, a + 20)) for a in range(0, 400, 7)]
    bench = spark.createDataFrame([(x,) for x in parts[::3]], "text string")
    said = [(i, x) for i, x in enumerate(parts * 2)] + [(None, parts[0]), (998, None), (999, " ".join(["w1"] * 50))]
    rows = spark.createDataFrame(said, "id int, text string")
    grams = lambda x: {tuple(x.split()[i : i + 13]) for i in range(len((x or "").split()) - 12)} if x else set()
    wanted = set().union(*(grams(x) for x in parts[::3]))
    expected = {i for i, x in said if i is not None and grams(x) & wanted}
    for held in (0, 1 << 20):
        assert {r.id for r in overlap.overlapping(rows, "id", bench, held=held).collect()} == expected
        assert sorted(str(r.id) for r in overlap.clean(rows, "id", bench, held=held).collect()) == sorted(str(i) for i, _ in said if i not in expected)
    assert overlap.overlapping(rows.where("false"), "id", bench).count() == overlap.overlapping(rows, "id", bench.where("false")).count() == 0


def test_hex_buckets(spark):
    keys = spark.range(500).select(order.shuffle_key(3, "id").alias("k"))
    one, many = (keys.select("k", order.hex_bucket(keys, "k", rows).alias("b")).orderBy("k").collect() for rows in (1000, 1))
    assert {r.b for r in one} <= set(range(16)) and {r.b for r in many} <= set(range(4096)) and len({r.b for r in many}) > 400
    assert all([r.b for r in found] == sorted(r.b for r in found) for found in (one, many))


def test_bootstrap(spark):
    """Against draws by hand, with a number of resamples that isn't a whole number of blocks."""
    a = {"s": [1, 0, 0, 1, 0, 0, 1], "t": [0, 0, 1]}
    rows = spark.createDataFrame([(t, q, bool(1 - x), bool(x)) for t, xs in a.items() for q, x in enumerate(xs)], "task string, q int, correct boolean, correct_norm boolean")
    times, got = 2 * scores.BLOCK + 5, {}
    for t, xs in a.items():
        n, means = len(xs), []
        for b in range(times):
            digits = [hashlib.md5(f"0:{t}:{b}:{k}".encode()).hexdigest() for k in range(-(-n // 4))]
            drawn = [int(digits[i // 4][8 * (i % 4) : 8 * (i % 4) + 8], 16) % n for i in range(n)]
            means.append(sum(2 * xs[i] - 1 for i in drawn) / n)
        means.sort()
        got[t] = (means[int(0.025 * (times - 1))], means[int(0.975 * (times - 1))])
    assert {r.task: (r.low, r.high) for r in scores.bootstrap(rows, times).collect()} == got


def test_bootstrap_digests_by_numpy():
    """Many digests at once, of all lengths of prefix and number, are md5's; and a mean over several runs of them is the one drawn one by one."""
    for prefix in (b"", b"0:", b"0:t:17:", b"0:task \xc3\xa9:1999:", b"x" * 50, b"x" * 51, b"x" * 54, b"x" * 70):
        for first, last in ((0, 10), (10, 13), (95, 100), (100, 101), (99_990, 100_000), (1_000_000, 1_000_003)):
            got = scores.digests(prefix, first, last)
            for k in range(first, last):
                assert b"".join(int(x).to_bytes(4, "big") for x in got[:, k - first]) == hashlib.md5(prefix + str(k).encode()).digest()
    d = np.random.default_rng(1).integers(-1, 2, 47_003).astype(np.int8)
    quarters = b"".join(hashlib.md5(b"0:t:5:%d" % k).digest() for k in range(-(-len(d) // 4)))
    drawn = np.frombuffer(quarters, ">u4")[: len(d)] % len(d)
    assert scores.drawn_mean(d, b"0:t:5:") == d[drawn].sum() / len(d)
    some = np.where(np.arange(len(d)) % 9 == 0, scores.UNKNOWN, d).astype(np.int8)
    assert scores.drawn_mean(some, b"0:t:5:") == d[drawn[drawn % 9 != 0]].mean() and scores.drawn_mean(some[:1], b"") is None


def test_bootstrap_of_a_set_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(t, q, (q * 7 + t) % 3 == 0, (q * 5) % 4 == 0) for t in range(2) for q in range(41)], "task long, q int, correct boolean, correct_norm boolean")
    whole = sorted(scores.bootstrap(rows, 40).collect())
    monkeypatch.setattr(scores, "PART", 8)
    assert sorted(scores.bootstrap(rows, 40).collect()) == whole and len(whole) == 2


def test_choices(spark):
    rows = spark.createDataFrame([("t", 0, 0, -1.0, 2, 1), ("t", 0, 1, -3.0, 30, 1), ("t", 1, 0, -2.0, 4, 0), ("t", 1, 1, -2.0, 4, 0)], "task string, q int, idx int, logp double, n_bytes int, answer int")
    got = {r.q: (r.correct, r.correct_norm) for r in scores.choice_outcomes(rows).collect()}
    assert got == {0: (False, True), 1: (True, True)}


def test_paired(spark):
    a, b = [1, 1, 0, 0, 1, 0], [1, 0, 1, 1, 1, 0]
    rows = spark.createDataFrame([("piqa", i, bool(x), bool(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "task string, q int, correct boolean, correct_norm boolean")
    r = scores.paired(rows).first()
    d = [y - x for x, y in zip(a, b, strict=True)]
    assert math.isclose(r.delta, 1 / 6) and (r.b_wins, r.a_wins) == (2, 1) and math.isclose(r.se, math.sqrt(statistics.variance(d) / 6))


def test_verdict(spark):
    base = [("base", s, 3.0 + 0.001 * s, 0.40 + 0.002 * s) for s in range(3)]
    arms = [("good", 0, 2.9, 0.41), ("noise", 0, 3.0, 0.41), ("fell", 0, 2.9, 0.30), ("open", 0, None, None), ("only", 0, None, 0.5)]
    rows = spark.createDataFrame(base + arms, "arm string, seed int, loss double, suite double")
    got = {r.arm: r.adopt for r in scores.adopted(rows, ("only",)).collect()}
    assert got == {"good": True, "noise": False, "fell": False, "open": False, "only": True}
    assert not any(r.adopt for r in scores.adopted(rows.where("seed < 2 AND NOT (arm = 'base' AND seed = 1)")).collect())


def test_watch(spark):
    def events(values, **how):
        rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "run string, step long, norm double")
        return sorted((r.step, r.event) for r in telemetry.watched(rows, "run", "step", "norm", **how).collect())

    steady = [1.0 + 0.01 * (i % 5) for i in range(200)]
    how = {"alert": (10.0, 5), "halt": (100.0, 30), "least": 50}
    assert events(steady, **how, window=1000) == []
    assert events([*steady, *[20.0] * 12, 1.0, float("nan"), *[20.0] * 3, None, *[20.0] * 4], **how, window=1000) == [(204, "alert"), (219, "alert")]
    assert events([*[1.0] * 100, *[500.0] * 70, 1.0, *[500.0] * 40], **how) == [(104, "alert"), (129, "halt"), (175, "alert")]


def test_usual_is_the_least_median_of_usual_values():
    r = random.Random(1)
    values = [r.choice([1, 2, 3, 50]) * r.random() for _ in range(400)]
    usual, kept, level = telemetry.Usual(3.0, 40, 10), [], float("inf")
    for v in values:
        want = None
        if len(kept) >= 10:
            want = level = min(level, statistics.median(kept[-40:]))
        if want is None or v <= 3 * level:
            kept.append(v)
        assert usual.level_for(v) == want


def test_sample_windows_begin_with_the_first_sample(spark):
    rows = [("2024-01-01 00:00:07", 0, 60.0, 70.0, False), ("2024-01-01 00:00:07", 1, 10.0, 50.0, True), ("2024-01-01 00:05:06", 2, 55.0, float("nan"), False), ("2024-01-01 00:05:07", 3, 55.0, 40.0, False)]
    samples = spark.createDataFrame(rows, "ts string, seq int, load double, reading double, flagged boolean").withColumn("ts", F.to_timestamp("ts"))
    got = {r["window"]: r for r in telemetry.sample_windows(samples, 300).collect()}
    assert got[0].loaded == 1 and got[0]["first"] == 70.0 and got[1].hottest == 40.0


def test_text(spark):
    texts = ["a" * 250, "  ", ("word " * 80).strip() + "\n" + ("other " * 80).strip(), None, "x\n" * 500]
    parts = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.chunks(F.col("t"), 300, 40).alias("p")).collect()]
    assert parts[0] == ["a" * 250] and parts[1] == parts[3] == []
    assert len(parts[2]) > 1 and all(0 < len(p) <= 300 for p in parts[2] + parts[4])
    assert tx.cut_points(25, [9, 14], 10, 2) == [(0, 9), (7, 14), (12, 22), (20, 25)] and tx.cut_points(5, [], 10, 20) == [(0, 5)]
    row = spark.createDataFrame([("Café_1 x-2", "https://www.Example.gov:80/a?b", "<p>a &amp; b<script>x</script></p>", [1, 2, 1, 2, 3])], "t string, u string, h string, a array<int>")
    got = row.select(tx.words(F.col("t")), tx.host(F.col("u")), tx.trust_tier(tx.host(F.lit("https://x.nasa.gov/"))), tx.html_text(F.col("h")), tx.positions("a", [1, 2]), tx.capitalised(F.lit("hELLO"))).first()
    assert tuple(got) == (["café_1", "x", "2"], "example.gov:80", 0, "a & b", [0, 2], "Hello")


def test_sources_and_sinks(spark, tmp_path, small):
    path = tmp_path / "x.jsonl"
    path.write_text('{"text": "a"}\n\nnot json\n{"text": ""}\n{"text": "b"}\n')
    assert sorted(r.text for r in tables.json_lines(spark, str(path), "text string").collect()) == ["a", "b"]
    found = tables.files(spark, str(tmp_path))
    assert found.first()["size"] == path.stat().st_size
    recorded = spark.createDataFrame([(found.first().path, 1), ("gone", 5)], "path string, size long")
    assert tables.short_files(recorded, found).count() == 2
    docs = tables.table(spark, small, "documents")
    sinks.write_shards(docs, str(tmp_path / "shards"), 65_536)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()
    assert sinks.manifest(docs, 65_536).agg(F.sum("tokens")).first()[0] == docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]


def test_download_records(spark):
    schema = "source string, revision string, source_tokens double, files array<string>"
    old = spark.createDataFrame([("a", "1", 5.0, ["x"]), ("b", "1", 5.0, ["x", "y"]), ("c", "1", None, ["x"]), ("d", "1", 1.0, ["x"])], schema)
    new = spark.createDataFrame([("a", "1", 9.0, ["x", "y"]), ("b", "2", 1.0, ["z"]), ("c", "1", 3.0, ["x"])], schema)
    got = {r.source: (r.revision, r.source_tokens, r.files) for r in sinks.merged_records(old, new).collect()}
    assert got == {"a": ("1", 9.0, ["x", "y"]), "b": ("2", 1.0, ["z"]), "c": ("1", None, ["x"]), "d": ("1", 1.0, ["x"])}


def test_guard_states():
    g = guard.Guard(samples=1, grace=100.0, trips_an_hour=2)
    see = lambda now, hot=50.0, loaded=1, idle=30.0, slowed=False, cpu=None: g.see(now, hot, idle, loaded, slowed, cpu)
    assert see(0) is None and see(10, hot=95) == "trip: device" and g.state == "pausing"
    assert see(20) is None and see(30, loaded=0) == "cooling" and see(40, loaded=0, hot=70) is None
    assert see(50, loaded=0) == "resumed" and see(60, slowed=True) == "trip: slowdown"
    assert see(170) == "cooling" and see(180, loaded=0) == "stopped" and see(190, hot=99) is None
    g = guard.Guard(samples=1)
    assert g.see(0, 50, 30, 1, False, None) is None and g.see(1, 50, 38, 1, False, 99) == "trip: room"


def test_sampling_filters(spark):
    logits = spark.createDataFrame([(1, t, x) for t, x in enumerate([3.0, 2.0, 2.0, 0.0, -1.0])], "context int, token int, logit double")
    assert sorted(r.token for r in sampling.top_k(logits, 2).collect()) == [0, 1, 2]
    assert sorted(r.token for r in sampling.nucleus(logits, 0.5).collect()) == [0]
    assert sorted(r.token for r in sampling.nucleus(logits, 0.6).collect()) == [0, 1]
    got = {r.token: r.logit for r in sampling.penalised(logits, logits.where("token IN (0, 4)"), 2.0).collect()}
    assert got == {0: 1.5, 1: 2.0, 2: 2.0, 3: 0.0, 4: -2.0}


def test_records(spark):
    rows = spark.createDataFrame([(["A", "B"], "B"), (["A"], "C")], "labels array<string>, key string")
    assert [r.i for r in rows.select(records.answer_index("labels", "key").alias("i")).collect()] == [1, None]
    pairs = spark.createDataFrame([("p", "c", "r"), ("", "c", "r"), ("p", None, "r")], "p string, c string, r string")
    assert pairs.where(records.has_pair("p", "c", "r")).count() == 1
    tokens = spark.createDataFrame([(i, 10 + i, i % 2 == 0) for i in range(11)], "at long, token int, learnt boolean")
    got = records.masked_windows(tokens, 2, 2).orderBy("at").collect()
    assert [(r.window_id, r.x, r.y) for r in got[:3]] == [(0, 10, -100), (0, 11, 12), (1, 12, -100)] and len(got) == 8
    arrays = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r.a for r in records.padded(arrays, "a", 2, 0).collect()] == [[1, 2], [0, 0]]


def test_padded_to_longest(spark):
    rows = spark.createDataFrame([(1, 0, list(range(12))), (2, 0, [5]), (3, 1, [7]), (4, 1, [])], "id int, batch int, a array<int>")
    got = {r.id: r.a for r in records.padded_to_longest(rows, "a", -1, "batch").collect()}
    assert got == {1: list(range(12)), 2: [5] + [-1] * 11, 3: [7], 4: [-1]}
    assert {len(r.a) for r in records.padded_to_longest(rows, "a", -1, least=8).collect()} == {12}


def test_few_texts_are_chunked_at_once(spark, monkeypatch):
    """Parts leave the worker in several arrays, none of which holds more texts than CUT_AT_ONCE allows."""
    monkeypatch.setattr(tx, "CUT_AT_ONCE", 2000)
    texts = ["word " * k for k in range(0, 700, 7)] + [None, "", " \n"]
    cut = tx.chunks(F.col("t"))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", cut.alias("c")).orderBy("k").collect()
    for r, t in zip(rows, texts, strict=True):
        said = (t or "").strip()
        assert r.c == [x for x in (said[a:b].strip() for a, b in tx.cut_points(len(said), [], 1000, 120)) if x]


def test_similarities_are_added_up_where_the_index_lies(spark):
    """The index of some terms has the weights of the whole one; similarities are shuffled by document only once, and few of them at last."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 9))) for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2 w3 x"), (2, "w5 w5 w0"), (3, "none")], "item_id long, text string")
    whole, idf = retrieval.weighted(docs, "doc_id")
    some, same = retrieval.weighted(docs, "doc_id", wanted=retrieval.terms(items))
    asked = {r.term for r in retrieval.terms(items).collect()}
    known = {(r.doc_id, r.term): r.w for r in whole.collect()}
    got = {(r.doc_id, r.term): r.w for r in some.collect()}
    assert got.keys() == {k for k in known if k[1] in asked} and all(math.isclose(w, known[k]) for k, w in got.items())
    assert idf.count() == same.count()
    best = retrieval.top_k(some, same, items, 4, "doc_id", "item_id")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin [term" in plan
    assert "Exchange hashpartitioning(item_id" in plan and ", doc_id#" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(item_id" in line)
    assert sorted(best.collect()) == sorted(retrieval.top_k(whole, idf, items, 4, "doc_id", "item_id").collect())
