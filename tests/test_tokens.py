"""Byte-pair tokens against naive merging, and masks against a walk over bytes."""

import random

import numpy as np
import pytest

from loomery.functions import tokens
from loomery.operators import masks
from loomery.plans.streams import VOCABULARY

TEXTS = ["", None, "a", "aaaa", "the cat the hat", "é€😀 naïve", "USER: hi\nASSISTANT: yo", "<pad> x " * 40, "\x00퟿\n\n  \t"]


def naive(text, merges):
    ids = list((text or "").encode())
    for k, pair in enumerate(merges):
        out, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == pair:
                out.append(256 + k)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def some_merges():
    r = random.Random(4)
    merges, known = [], list(range(256))
    common = [ord(c) for c in "the catsAN:URI é"[:15]]
    while len(merges) < 120:
        pair = (r.choice(common + known[256:]), r.choice(common + known[256:]))
        if pair not in merges:
            merges.append(pair)
            known.append(255 + len(merges))
    return merges


def test_encoding_equals_merging_in_order(spark, tmp_path):
    """The heap gives what one pass for each merge gives, for merges in which a later one is never part of an earlier one."""
    merges = some_merges()
    tokens.write_merges(merges, str(tmp_path / "m.json"))
    assert tokens.read_merges(str(tmp_path / "m.json")) == merges
    r = random.Random(9)
    texts = TEXTS + ["".join(r.choice("the catsAN:URI é") for _ in range(r.randint(1, 200))) for _ in range(60)]
    for reserved in ([], ["<pad>", "<end>"]):
        vocabulary = tokens.from_merges(tokens.read_merges(str(tmp_path / "m.json")), reserved)
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
        rows = rows.select("k", "text", tokens.encoded(rows.text, vocabulary).alias("ids"))
        rows = rows.select("*", tokens.decoded(rows.ids, vocabulary).alias("back"), tokens.lengths(rows.ids, vocabulary).alias("sizes"))
        for row in rows.collect():
            assert row.ids == [i + len(reserved) for i in naive(row.text, merges)]
            assert row.back == (row.text or "") and sum(row.sizes) == len((row.text or "").encode())


def test_public_vocabulary(spark):
    vocabulary = tokens.read_vocabulary(VOCABULARY)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, text string")
    rows = rows.select("text", tokens.encoded(rows.text, vocabulary).alias("ids"), tokens.encoded(rows.text, tokens.read_vocabulary(VOCABULARY, split=True)).alias("split"))
    rows = rows.select("*", tokens.decoded(rows.ids, vocabulary).alias("back"), tokens.decoded(rows.split, vocabulary).alias("back_split")).collect()
    assert all(r.back == r.back_split == (r.text or "") for r in rows)
    assert len(rows[4].ids) < len("the cat the hat")
    one = spark.createDataFrame([([0, 255],), (None,)], "ids array<int>")
    assert [len(r[0]) for r in one.select(tokens.decoded(one.ids, tokens.from_merges([]))).collect()] == [2, 0]


def test_reserved_and_digits(spark):
    """24 reserved ids come first; digits stay single; the string of a reserved token in a text is text; nothing is lost."""
    digits = [(ord("1"), ord("2")), (ord("3"), ord("4")), (ord("a"), ord("b"))]
    reserved = [f"<|reserved_{k}|>" for k in range(24)]
    vocabulary = tokens.from_merges(digits, reserved, split=True)
    texts = ["ab 12 3412ab", "<|reserved_3|>12", "é ab\n\n  1"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    rows = rows.select("k", tokens.encoded(rows.text, vocabulary).alias("ids"))
    got = rows.select("*", tokens.decoded(rows.ids, vocabulary).alias("back")).orderBy("k").collect()
    assert [r.back for r in got] == texts and min(i for r in got for i in r.ids) >= 24
    ab = 24 + 256 + 2
    assert got[0].ids == [ab, 24 + 32, *[24 + ord(c) for c in "12"], 24 + 32, *[24 + ord(c) for c in "3412"], ab]
    # Merged whole, the same digits are merged.
    whole = spark.createDataFrame([("ab 12",)], "text string")
    assert whole.select(tokens.encoded(whole.text, tokens.from_merges(digits, reserved))).first()[0] == [ab, 24 + 32, ab - 2]


def walk(pieces, sizes):
    """Token by token: the state after each byte, a mark's tokens being none of either."""
    out, state = [], False
    for text, lengths in zip(pieces, sizes, strict=True):
        own, at = [0] * len(lengths), 0
        token_of = [t for t, n in enumerate(lengths) for _ in range(n)]
        marks = []
        for mark, then in masks.MARKS:
            i = 0
            while i <= len(text) - len(mark):
                if text[i : i + len(mark)] == mark:
                    marks.append((token_of[i], token_of[i + len(mark) - 1] + 1, then))
                    i += len(mark)
                else:
                    i += 1
        for first, after, then in sorted(marks, key=lambda m: m[0]):
            if first < at:
                continue
            for t in range(at, first):
                own[t] = int(state)
            state, at = then, after
        for t in range(at, len(lengths)):
            own[t] = int(state)
        out.append(own)
    return out


@pytest.mark.parametrize("run", [1000, 3])
def test_masks(spark, run):
    r = random.Random(2)
    rows, want = [], {}
    for stream in range(8):
        texts, sizes = [], []
        for piece in range(r.randint(1, 12)):
            text = b"".join(r.choice([b"ASSISTANT:", b"USER:", b"x", b"some text ", b"\n", b"ASSI"]) for _ in range(r.randint(0, 9)))
            cut, left = [], len(text)
            while left:
                cut.append(min(left, r.randint(1, 7)))
                left -= cut[-1]
            texts.append(text)
            sizes.append(cut)
            rows.append((stream, piece, bytearray(text), cut))
        for piece, m in enumerate(walk(texts, sizes)):
            want[stream, piece] = m
    rows.append((99, 0, None, None))
    want[99, 0] = []
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "stream long, piece int, bytes binary, sizes array<int>")
    got = masks.loss_masks(df, "stream", "piece", df.bytes, df.sizes, run=run).collect()
    assert {(g.stream, g.piece): g["mask"] for g in got} == want
    assert all(g.n_learnt == sum(g["mask"]) and g.n_tokens == len(g["mask"]) for g in got)


def test_mask_with_merged_tokens(spark):
    """With a public vocabulary: the tokens of an answer are learnt from, those that a mark shares a byte with aren't."""
    vocabulary = tokens.read_vocabulary(VOCABULARY)
    text = "USER: What?ASSISTANT: An answer.\nUSER: more ASSISTANT:\n" + "ASSISTANT:" * 3 + "x"
    rows = spark.createDataFrame([(1, text)], "conv_id long, text string")
    rows = rows.select("conv_id", tokens.encoded(rows.text, vocabulary).alias("ids"))
    rows = masks.cut(rows, "ids", 10**6)
    got = masks.loss_masks(rows, "conv_id", "piece", tokens.joined_bytes(rows.ids, vocabulary), tokens.lengths(rows.ids, vocabulary)).first()
    sizes = [len(tokens.token_bytes(vocabulary)[i]) for i in got.ids]
    assert got["mask"] == walk([text.encode()], [sizes])[0] and 3 < got.n_learnt < 12
    assert np.sum(sizes) == len(text)


def test_cut_texts_are_encoded_as_whole_ones(monkeypatch):
    """Texts cut at every place that the tokens allow give the ids of the whole; few bytes are with the encoder at once; split texts aren't cut."""
    monkeypatch.setattr(tokens, "PIECE", 8)
    monkeypatch.setattr(tokens, "AT_ONCE", 64)
    r = random.Random(11)
    words = ["the", " cat", "é€😀", "\n\n", "  ", "naïve ", "12345", "USER:", "\x00", "ß", "日本語", "\u00a0", "don't", "a" * 30, "<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(words) for _ in range(r.randint(1, 300))) for _ in range(40)] + ["", ""]
    public = tokens.read_vocabulary(VOCABULARY)
    for vocabulary in (public, tokens.from_merges(some_merges())):
        real, most = tokens.encoder(vocabulary), []
        want = [real.encode(t, add_special_tokens=False).ids for t in texts]
        monkeypatch.setattr(tokens, "encoder", lambda v, real=real, most=most: Watched(real, most))
        assert [x.tolist() for x in tokens._ids(texts, vocabulary)] == want
        monkeypatch.undo()
        monkeypatch.setattr(tokens, "PIECE", 8)
        monkeypatch.setattr(tokens, "AT_ONCE", 64)
        assert all("".join(tokens.pieces(t, vocabulary)) == t for t in texts)
        assert sum(map(len, most)) > 100 and max(sum(map(len, m[:-1])) for m in most) < 64
    assert max(len(tokens.pieces(t, public)) for t in texts) > 50
    assert tokens.pieces(texts[-5], tokens.read_vocabulary(VOCABULARY, split=True)) == [texts[-5]]


class Watched:
    def __init__(self, real, seen):
        self.real, self.seen = real, seen

    def encode_batch_fast(self, texts, **how):
        self.seen.append(list(texts))
        return self.real.encode_batch_fast(texts, **how)


def test_batches_larger_than_what_is_looked_up_at_once(spark, monkeypatch):
    vocabulary = tokens.read_vocabulary(VOCABULARY)
    texts = [t or "" for t in TEXTS] * 40 + ["word é " * 60_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").coalesce(1)
    rows = rows.select("k", "text", tokens.encoded(rows.text, vocabulary).alias("ids"))
    rows = rows.select("*", tokens.decoded(rows.ids, vocabulary).alias("back"), tokens.joined_bytes(rows.ids, vocabulary).alias("b"), tokens.lengths(rows.ids, vocabulary).alias("sizes")).orderBy("k").collect()
    assert [r.back for r in rows] == texts == [bytes(r.b).decode() for r in rows]
    assert all(sum(r.sizes) == len(r.b) and len(r.sizes) == len(r.ids) for r in rows)


def test_pieces_are_masked_once_and_many_at_a_time(spark, monkeypatch):
    """Pieces that lie side by side in a batch share no mark; a batch is masked in few calls, and not again for each use of the rows."""
    monkeypatch.setattr(masks, "AT_ONCE", 3)
    texts = [b"x USER: ab ASSIST", b"ANT: cd", b"", b"ASSISTANT:ef", b"USER", b": gh", b"ASSISTANT:", b"ij"]
    sizes = [[1] * len(t) for t in texts]
    rows = spark.createDataFrame([(1, k, bytearray(t), s) for k, (t, s) in enumerate(zip(texts, sizes, strict=True))], "stream long, piece int, bytes binary, sizes array<int>").coalesce(1)
    found = masks.loss_masks(rows, "stream", "piece", rows.bytes, rows.sizes)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(found.collect(), key=lambda g: g.piece)
    assert [g["mask"] for g in got] == walk(texts, sizes) and [g.n_learnt for g in got] == [sum(m) for m in walk(texts, sizes)]
    with pytest.raises(ValueError, match="add up"):
        masks.mask(b"abc", np.array([0, 3]), np.array([1, 1]), np.array([0, 2]))
