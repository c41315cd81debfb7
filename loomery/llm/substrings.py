"""Duplicate passages by relative Lempel-Ziv parsing against reference blocks.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts
anywhere else in the corpus, the same document included.

Each document is cut at anchors: the anchor of a window is its GRAM of least hash, so
windows of equal words have equal anchors at equal places. All windows of one anchor
form a segment. The reference is the set of distinct segments, in blocks by anchor: what
a segment shares with any other place of the corpus lies in the one block of its anchor.
Within a block each segment is parsed greedily into factors, the longest runs of windows
that another segment of the block holds too, and the window that straddles a factor's end
is looked up anew. Factors of at least one window are duplicate spans.

Three passes keep this small. The first counts anchors; those seen twice go into a bit
map of fixed size, which can let through too much and never too little. The second emits
the segments whose anchors it lets through. Copies of a segment are counted before they
are shuffled, and are duplicate as a whole without a look at the block. An anchor with more
than HOT distinct segments isn't parsed in one task: its windows are counted apart, each
under its own hash. The third pass joins the spans to the texts.

Defined results: a null or empty text has no words; documents of fewer than WINDOW words
lose nothing; repeated rows hold the same windows, so all their words go if they are long
enough; a null id is an id like any other; other columns are kept by `remove` whatever
their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import bit_map, in_bit_map, text_of, written

WINDOW, GRAM, BLOCK, HOT = 35, 16, 4_000, 2_000
HELD = 500_000  # windows that a task holds before it hands them on
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n + 1, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


class _Hashes:
    """Hashes of all runs of words of one text, from running sums; powers are kept between texts."""

    up, down = _powers(_BASE, 4096), _powers(_INVERSE, 4096)

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        if n >= len(_Hashes.up):
            _Hashes.up, _Hashes.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(each * _Hashes.up[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        x = (self.sums[start + n] - self.sums[start]) * _Hashes.down[start]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        return x


def segments(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[_Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a text of at least `window` words; first window, number of windows and anchor of each segment."""
    hashes = _Hashes(words)
    grams = hashes.runs(np.arange(len(words) - gram + 1), gram)
    width = window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.concatenate([views[i : i + 8192].argmin(axis=1) for i in range(0, len(views), 8192)]) + np.arange(len(views))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return hashes, first, np.diff(np.r_[first, len(at)]), grams[at[first]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.empty(0, np.uint64)]
        for text in batch["text"]:
            words = text.as_py().encode().split()
            if len(words) >= WINDOW:
                found.append(segments(words)[3])
        yield pa.record_batch({"anchor": np.concatenate(found).view(np.int64)})


def _candidates(marked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("segment", pa.int64()), ("windows", pa.list_(pa.int64()))])

    def packed(batch: pa.RecordBatch, rows: dict[str, list]) -> pa.RecordBatch:
        cat = {k: np.concatenate(v) for k, v in rows.items()}
        windows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cat["n"])].astype(np.int32)), pa.array(cat["windows"].view(np.int64)))
        row = pa.array(cat["row"])
        return pa.record_batch([batch["id"].take(row), batch["h"].take(row), pa.array(cat["start"].astype(np.int32)), pa.array(cat["anchor"].view(np.int64)), pa.array(cat["segment"].view(np.int64)), windows], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marked.value, np.uint8)
        for batch in batches:
            rows, held = defaultdict(list), 0
            for row, text in enumerate(batch["text"]):
                words = text.as_py().encode().split()
                if len(words) < WINDOW:
                    continue
                hashes, first, n, anchor = segments(words)
                here = in_bit_map(anchor, bits)
                if not here.any():
                    continue
                first, n, anchor = first[here], n[here], anchor[here]
                ends = np.cumsum(n)
                each = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
                made = {"row": np.full(len(n), row), "start": first, "anchor": anchor, "segment": hashes.runs(first, n + WINDOW - 1), "windows": hashes.runs(each, WINDOW), "n": n}
                for k, v in made.items():
                    rows[k].append(v)
                held += int(ends[-1])
                if held >= HELD:
                    yield packed(batch, rows)
                    rows, held = defaultdict(list), 0
            if held:
                yield packed(batch, rows)

    return emit


def factors(windows: list[int], index: dict[int, list[tuple[int, int]]], block: list[list[int]], own: int) -> list[tuple[int, int]]:
    """Greedy parse of one segment against the others of its block: first and last window of each factor.

    index has, for each window of the block, the segments that hold it and where.
    """
    found, i = [], 0
    while i < len(windows):
        longest = 0
        for other, at in index[windows[i]]:
            if other == own:
                continue
            ref, n = block[other], 1
            while i + n < len(windows) and at + n < len(ref) and windows[i + n] == ref[at + n]:
                n += 1
            longest = max(longest, n)
        if longest:
            found.append((i, i + longest - 1))
        i += longest or 1  # the next window straddles the factor's end
    return found


def _parsed(rows: pa.Table) -> pa.Table:
    groups = defaultdict(list)
    for k, anchor in enumerate(rows["anchor"].to_pylist()):
        groups[anchor].append(k)
    windows, counts = rows["windows"].to_pylist(), rows["m"].to_pylist()
    keep, spans = [], []
    for members in groups.values():
        block = [windows[k] for k in members]
        index = defaultdict(list)
        for s, segment in enumerate(block):
            for at, x in enumerate(segment):
                index[x].append((s, at))
        for s, k in enumerate(members):
            if counts[k] == 1 and (got := factors(block[s], index, block, s)):
                keep.append(k)
                spans.append([{"a": a, "b": b} for a, b in got])
    keep = pa.array(keep, pa.int64())
    return pa.table({"anchor": rows["anchor"].take(keep), "segment": rows["segment"].take(keep), "spans": pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})


def duplicate_spans(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """For each document that repeats something: id, h (a hash of the text), spans: array of first and last word."""
    spark = docs.sparkSession
    t = text_of(f"`{text}`")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.xxhash64(t).alias("h"), t.alias("text"))
    twice = texts.select("text").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    marked = spark.sparkContext.broadcast(bit_map(twice, "anchor"))
    found = written(texts.mapInArrow(_candidates(marked), "id long, h long, start int, anchor long, segment long, windows array<long>"))
    marked.unpersist()

    key = ["anchor", "segment"]
    copies = found.groupBy(*key).agg(F.count("*").alias("m"), F.first("windows").alias("windows"))
    per = found.groupBy(*key).agg(F.count("*").alias("m")).groupBy("anchor").agg(F.count("*").alias("d"), F.sum("m").alias("all")).where("all > 1")
    segs = written(copies.join(per, "anchor"))
    whole = segs.where("m > 1").select(*key, F.expr("array(struct(0 AS a, size(windows) - 1 AS b))").alias("spans"))
    some = segs.where(f"d > 1 AND d <= {hot}")
    blocks = -(-some.count() // block) or 1
    parsed = some.select(*key, "m", "windows", F.pmod("anchor", F.lit(blocks)).alias("block")).groupBy("block").applyInArrow(_parsed, "anchor long, segment long, spans array<struct<a: int, b: int>>")
    each = segs.where(f"d > {hot}").select(*key, "m", F.posexplode("windows").alias("at", "w"))
    common = each.groupBy("anchor", "w").agg(F.sum("m").alias("n")).where("n > 1").select("anchor", "w")
    split = each.where("m = 1").join(common, ["anchor", "w"]).groupBy(*key).agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("spans"))
    verdicts = whole.unionByName(parsed).unionByName(split)

    spans = found.select(*key, "id", "h", "start").join(verdicts, key).select("id", "h", F.explode(F.expr(f"transform(spans, x -> struct(start + x.a AS a, start + x.b + {WINDOW - 1} AS b))")).alias("x"))
    return spans.groupBy("id", "h").agg(F.sort_array(F.collect_set("x")).alias("spans"))


def _keep_mask(n: int, spans) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for x in spans or ():
        edges[x["a"]] += 1
        edges[x["b"] + 1] -= 1
    return np.cumsum(edges[:n]) == 0


def _joined(docs: DataFrame, id_column: str, text: str, how: dict) -> DataFrame:
    """doc (a struct of all columns), t and spans."""
    spans = duplicate_spans(docs, id_column=id_column, text=text, **how)
    spans = spans.select(F.coalesce("id", F.lit(0)).alias("k_id"), F.isnull("id").alias("k_no_id"), F.col("h").alias("k_h"), "spans")
    t, doc_id = text_of(f"`{text}`"), F.col(f"`{id_column}`").cast("long")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(doc, t.alias("t"), F.coalesce(doc_id, F.lit(0)).alias("k_id"), F.isnull(doc_id).alias("k_no_id"), F.xxhash64(t).alias("k_h"))
    return rows.join(spans, ["k_id", "k_no_id", "k_h"], "left").select("doc", "t", "spans")


def digests(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, of the words that stay."""

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string>")
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(texts, spans, strict=True):
            words, s = x.as_py().encode().split(), s.as_py()
            kept = words
            if s:
                kept = [w for w, stays in zip(words, _keep_mask(len(words), s).tolist(), strict=True) if stays]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = _joined(slim, "doc_id", "text", how)
    return rows.select(F.col("doc.doc_id"), digest("t", "spans").alias("x")).select("doc_id", "x.*")


def remove(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, with their columns; texts that repeat something are the kept words, joined by a space."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(texts, spans, strict=True):
            text, s = x.as_py(), s.as_py()
            if s:
                words = text.encode().split()
                text = b" ".join(w for w, stays in zip(words, _keep_mask(len(words), s).tolist(), strict=True) if stays).decode()
            out.append(text)
        return pa.array(out, pa.string())

    rows = _joined(docs, id_column, text, how).select("doc", "spans", kept("t", "spans").alias("clean"))
    clean = F.when(F.isnull("spans"), F.col("doc").getField(text)).otherwise(F.col("clean"))
    return rows.select(*[clean.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])
