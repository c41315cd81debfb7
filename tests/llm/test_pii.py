"""Personal data: base spans against Python's re, added spans by planted contexts."""

import hashlib
import math
import random
import re
import time

from loomery.llm import pii
from loomery.llm.queries import op1_pii
from tests.llm.conftest import odd_rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TEXTS = [
    "a@b.c@d.e x@y.z.w. a@b.c_x@d.e %%q@ww.com. 1.2.3.4.5 1.2.3 300.1.1.1 0001.2.3.255 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 x 4111111111111111-2 é 4111-1111-1111-1111 12 34 4111  1111 1111 1111",
    "+1 (614) 555-8001 +1-2 +123456789012345678 ++1 614 555 8001- +1 2 3 4 5 6 7 8 9 0 x",
    "x" * 20_000 + "@" + "y" * 50, " ".join(["1.2.3.4"] * 1000), "@", "😀 é a@b.cd 😀 1.2.3.4", "a@b", "a@b.", "-@-.-", "1.2.3.4" * 3,
]


def test_base_spans(spark, odd, none):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    got = sorted(r.base_list for r in pii.find(docs).collect())
    assert got == sorted(plain(t) for t in [*TEXTS, *(r[1] for r in odd_rows())])
    assert pii.find(none).count() == 0


def test_contexts_find_more(spark):
    texts = [f"please write to me at {n}@mail.org or call" for n in ("jo", "al", "bo", "cy")]
    texts += ["please write to me at user99-at-host or call", "and 12345 is a number", "see room 99 there", "please write to me at user99-at-host or call"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert rows[4].base_list == "" and rows[4].span_list == rows[7].span_list == "email:22:36"
    assert rows[5].span_list == rows[6].span_list == ""
    assert all(rows[i].base_list == rows[i].span_list == plain(texts[i]) for i in range(4))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[0] == masked[4] == "please write to me at <EMAIL> or call" and masked[6] == texts[6]


def test_secrets_by_context(spark):
    """Digests seed a context, which then finds a key of another form; checksums of commits are no secrets."""
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(5)]
    texts = [f'log in with token = "{h}" now' for h in hexes] + ['or with token = "Zx9-Qw3_Lk8" then', 'see "Zx9-Qw3_Lk8" there'] + [f"fixed in commit {h[::-1]} of main" for h in hexes]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(rows[i].span_list == "secret:21:61" and rows[i].base_list == "" for i in range(5))
    assert rows[5].span_list == "secret:17:28" and all(rows[i].span_list == "" for i in range(6, 12))


def test_number_of_several_groups(spark):
    texts = [f"you can ring me at +1 (614) 555-80{i:02} any day" for i in range(4)] + ["you can ring me at 614 555 8001 any day", "you can ring me at (614) 555-8001. Bye", "rooms 1 2 3 4 5 6 7 8 9 10 11"]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[4].span_list == "phone:19:31" and rows[5].span_list == "phone:19:33" and rows[6].span_list == ""
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert masked[4] == "you can ring me at <PHONE> any day" and masked[5] == "you can ring me at <PHONE>. Bye"


def brute_bootstrap(edges, kinds, seeds=3, pattern_score=0.6, instance_score=0.7):
    """The scores by their definition, over dicts."""
    known = {v: (1.0, k) for v, k in kinds.items() if v in {v for vs in edges.values() for v in vs}}
    base = dict(known)
    while True:
        trusted = {}
        for p, vs in edges.items():
            scores = {}
            for v in vs:
                if v in known:
                    scores.setdefault(known[v][1], []).append(known[v][0])
            best = [(round(sum(s) / len(vs), 6), k) for k, s in scores.items() if len(s) >= seeds and len(vs) >= seeds]
            if best and max(best)[0] >= pattern_score:
                trusted[p] = max(b for b in best if b[0] >= pattern_score)
        after = {}
        for v in {v for vs in edges.values() for v in vs}:
            doubts = {}
            for p, (s, k) in trusted.items():
                if v in edges[p]:
                    doubts[k] = doubts.get(k, 0) + math.log(1 - min(s, 0.99))
            best = [(round(1 - math.exp(d), 6), k) for k, d in doubts.items() if round(1 - math.exp(d), 6) >= instance_score]
            if best:
                after[v] = max(best)
        after |= base
        if after == known:
            return trusted, known
        known = after


def test_scores_against_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        edges = {f"p{p}": {f"v{int(r.random() ** 2 * 40)}" for _ in range(r.randint(1, 14))} for p in range(30)}
        kinds = {f"v{i}": r.choice(["email", "phone", "email"]) for i in range(40) if r.random() < 0.35}
        rows = [(v, kinds.get(v), sorted(p for p in edges if v in edges[p])) for v in {v for vs in edges.values() for v in vs}]
        edges = {p: vs for p, vs in edges.items() if len(vs) >= 3}
        patterns, known = pii.bootstrapped(spark.createDataFrame(rows * 2, "v string, kind string, patterns array<string>"))
        want_p, want_k = brute_bootstrap(edges, kinds)
        assert {x.pattern: x.kind for x in patterns.collect()} == {p: k for p, (_, k) in want_p.items()}
        got = {x.v: (x.score, x.kind) for x in known.collect()}
        assert set(got) == set(want_k) and all(got[v][1] == want_k[v][1] and abs(got[v][0] - want_k[v][0]) < 1e-5 for v in got)


def test_very_many_matches(spark):
    """The work grows with the matches, not with their square."""
    n = 100_000
    text = " ".join(f"u{i}@x.org id-{i} é" for i in range(n))
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    began = time.time()
    got = pii.find(docs).where("doc_id = 1").first()
    want = plain(text)
    assert got.base_list == want and time.time() - began < 240
    masked = pii.mask(docs).where("doc_id = 1").collect()
    assert len(masked) == 2 and masked[0].text == re.sub(BASE["email"], "<EMAIL>", text) == masked[1].text


def test_unions_across_blocks(spark):
    """Overlapping spans, and spans over the border of a block, are masked once, under the first one's name."""
    text = "é" * (pii.CUT - 5) + " 1.2.3.44@x.org " + "w" * 50 + " 4111111111111111 +1 614 555 8001 " + "z" * pii.CUT + " a@b.cd"
    got = pii.mask(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == "é" * (pii.CUT - 5) + " <EMAIL> " + "w" * 50 + " <CARD> <PHONE> " + "z" * pii.CUT + " <EMAIL>"


def test_mask_keeps_rows(odd, none):
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == len(odd_rows())
    assert sorted(str(r.text) for r in masked.where("doc_id = 9").collect())[0].startswith("é€😀 mail ü@x.de <EMAIL> ")
    assert masked.where("text IS NULL").count() == 2 and pii.mask(none).count() == 0


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op1_pii(spark, small).collect():
        assert r.base_sha256 == hashlib.sha256(plain(texts[r.doc_id]).encode()).hexdigest()
        assert set(filter(None, plain(texts[r.doc_id]).split(","))) <= set(r.spans.split(","))
        assert r.n_email == plain(texts[r.doc_id]).count("email")
