"""The resumable stream of documents, and reading with errors."""

import gzip
import json

import pytest

from loomery.sources import documents


def folder(root, name, texts, files=3, extra=b""):
    (root / name).mkdir(parents=True)
    per = -(-len(texts) // files)
    for k in range(files):
        body = b"".join(json.dumps({"text": t, "n": k}).encode() + b"\n" for t in texts[k * per : (k + 1) * per])
        (root / name / f"{k:03d}.jsonl").write_bytes(body + extra)
    return {"name": name, "path": str(root / name), "weight": 1}


@pytest.fixture
def sources(tmp_path):
    long = folder(tmp_path, "long", [f"L{i} " + "a" * (300 + i * 37 % 500) for i in range(120)])
    short = folder(tmp_path, "short", [f"s{i} é" for i in range(3000)], extra=b"\n{broken\n[1]\n{\"text\": null}\n")
    return [long | {"weight": 0.6}, short | {"weight": 0.4}]


def run(spark, sources, root, seen, fail_at=None, how="before"):
    def write(docs, step):
        if step == fail_at and how == "before":
            raise RuntimeError("stopped before the write")
        seen[step] = sorted(map(tuple, docs.select("source", "at", "text").collect()))
        if step == fail_at:
            raise RuntimeError("stopped after the write")

    documents.follow_all(spark, sources, str(root / "progress"), str(root / "checkpoint"), write, step=20_000, split=4_000)


def test_stopped_and_resumed(spark, sources, tmp_path):
    whole, parts = {}, {}
    run(spark, sources, tmp_path / "one", whole)
    assert len(whole) > 5
    for step, how in ((2, "before"), (4, "after"), (5, "before")):
        with pytest.raises(Exception, match="stopped"):
            run(spark, sources, tmp_path / "two", parts, step, how)
    run(spark, sources, tmp_path / "two", parts)
    assert parts == whole
    assert documents.positions(str(tmp_path / "one" / "progress")) == documents.positions(str(tmp_path / "two" / "progress"))
    said = [t for rows in whole.values() for _, _, t in rows]
    assert sorted(said) == sorted([f"L{i} " + "a" * (300 + i * 37 % 500) for i in range(120)] + [f"s{i} é" for i in range(3000)])
    # Once the sources' bytes per token are known, and while both last, their tokens are near their shares.
    for k in (2, 3, 4):
        early = [(s, len(t.encode()) + 1) for j in range(1, k + 1) for s, _, t in whole[j]]
        assert abs(sum(n for s, n in early if s == "long") / sum(n for _, n in early) - 0.6) < 0.03


def test_new_files_and_nothing_new(spark, sources, tmp_path):
    seen = {}
    run(spark, sources, tmp_path / "run", seen)
    n = len(seen)
    run(spark, sources, tmp_path / "run", seen)
    assert len(seen) == n
    (tmp_path / "long" / "100.jsonl").write_text('{"text": "new"}\n{"text": "no newline"}')
    run(spark, sources, tmp_path / "run", seen)
    assert [t for k in range(n + 1, max(seen) + 1) for _, _, t in seen[k]] == ["new", "no newline"]


def test_lines_by_ranges(tmp_path):
    texts = ["x" * (i * 7 % 50) for i in range(200)]
    source = folder(tmp_path, "a", texts, files=1)
    for split in (1, 13, 1000, 1 << 20):
        found = [json.loads(x) for r in documents.ranges("a", source["path"], 0, 1 << 40, split) for _, _, x in documents.lines(r)]
        assert [f["text"] for f in found] == texts


def test_errors(spark, tmp_path):
    ok = [f"t{i}" for i in range(30)]
    good, bad, worse = (folder(tmp_path, n, ok, files=1) for n in ("good", "bad", "worse"))
    line = b'{"text": "\xff"}\n'
    (tmp_path / "bad" / "000.jsonl").write_bytes(line * 9 + b'{"text": "in between"}\n' + line * 9 + b'{"text": "after"}\n')
    (tmp_path / "worse" / "001.jsonl").write_bytes(line * 10 + b'{"text": "lost"}\n')
    cut = gzip.compress(b'{"text": "zipped"}\n' * 3)
    (tmp_path / "good" / "002.jsonl.gz").write_bytes(cut)
    (tmp_path / "good" / "003.jsonl.gz").write_bytes(cut[:-6])
    (tmp_path / "good" / "004.jsonl").write_text('{"text": "last"}\n')
    sources = [good, bad, worse]
    rows = documents.raw_lines(spark, sources, split=50)
    docs = documents.texts(documents.tolerated(rows)).collect()
    by = lambda n: sorted(r.text for r in docs if r.source == n)
    assert by("bad") == ["after", "in between"] and by("worse") == sorted(ok)
    assert by("good")[:1] == ["last"] and by("good").count("zipped") == 6 and len(by("good")) == 37
    assert {r.source: (r.n_docs, r.chars, r.tokens) for r in documents.counts(documents.texts(documents.tolerated(rows))).collect()}["bad"] == (2, 15, 17)
    with pytest.raises(OSError):
        documents.tolerated(rows, strict=True)
    # In a stream, errors in a row are counted across steps, and a dropped source isn't read on.
    seen = {}
    documents.follow_all(spark, sources, str(tmp_path / "p"), str(tmp_path / "c"), lambda d, k: seen.update({k: [tuple(r) for r in d.select("source", "text").collect()]}), step=200, split=50)
    flat = [r for v in seen.values() for r in v]
    assert sorted(flat) == sorted((r.source, r.text) for r in docs)
    assert documents.positions(str(tmp_path / "p"))["worse"]["dropped"] and not documents.positions(str(tmp_path / "p"))["bad"]["dropped"]
    with pytest.raises(Exception, match="bad|worse|good"):
        documents.follow_all(spark, sources, str(tmp_path / "p2"), str(tmp_path / "c2"), lambda d, k: d.count(), step=10**9, strict=True)


def test_step_by_reports():
    sources = [{"name": "a", "weight": 1}, {"name": "b", "weight": 1}, {"name": "c", "weight": 2}]
    sizes = {"a": 10**6, "b": 10**6, "c": 50}
    first = documents.next_step(sources, {"a": 0, "b": 0, "c": 0}, sizes, {}, 4000)
    assert first == {"a": 1000, "b": 1000, "c": 50}
    report = {"a": {"tokens": 900}, "b": {"tokens": 90}, "c": {"tokens": 10}}
    second = documents.next_step(sources, first, sizes, report, 4000)
    assert second["c"] == 50 and second["b"] - 1000 > 5 * (second["a"] - 1000)
    report["b"]["dropped"] = True
    assert documents.next_step(sources, first, sizes, report, 4000) == {"a": 5000, "b": 1000, "c": 50}
