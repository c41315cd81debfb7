"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window,
one word with its borders, is compressed with either; the gain is the number of bytes
that the toxic dictionary saves over the ordinary one. The gains of all windows of a text
are counted above calibrated thresholds, and a logistic curve turns the counts, the
largest gains and the mean into a score from 0 to 1.

What both classes share would drown the difference, so each class's dictionary is trained
on words that its documents hold several times as often as the other's, and both are
continued by one base, trained on the ordinary rest, in which common words are found alike.
A window is compressed behind a fixed frame that ends both dictionaries, since zstandard
doesn't shorten inputs of a few bytes.

The labelled documents are in four folds. Dictionaries are trained on two of them. The
thresholds, the gains that only a given share of ordinary windows reaches, and the curve are
calibrated on a third, which the dictionaries haven't seen; the fourth is held out.

The model is fitted on at most SAMPLE labelled documents of each class, taken by hash, and
at most SAMPLE_CHARS characters in all: documents of over LONG characters come last, and those that
would pass the bound are left out, but the first of a class never is. A document id
stands for one text (that of least hash) here. Scoring covers every window of every text.

Defined results: a null text is empty and is scored like any; a null id isn't held out;
labels without an id or a mark are left out, and a document that has several labels is
toxic if one says so; repeated rows get one result each; other columns are ignored; an
empty table gives none; where a class has no label, the score is 0 if no label is toxic, else 1.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import shuffles, text_of, written

SAMPLE, SAMPLE_CHARS, LONG = 4_000, 40_000_000, 1_000_000
CUT, FOLDS, HELD_OUT, CALIBRATED = 0.3, 4, 2, 3
#: Of a class's documents, the share that must hold a word; how many times the other class's share that must be, at least.
SHARE, TIMES, COMMON = 0.02, {1: 4.0, 0: 2.0}, 0.001
OWN_SIZE, BASE_SIZE, LEVEL, CACHED = 2_048, 32_768, 16, 400_000
#: The thresholds are the least gains that these shares of ordinary windows reach, at most.
RARITY, MOST = (0.1, 0.01, 0.001, 0.0001), 24  # gains beyond MOST bytes either way count as MOST
FRAME = b"\x01the frame of every window, 0123456789\x02"
_EDGES = string.punctuation.encode()


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a logistic curve over standardised features; or a constant score."""

    toxic: bytes = b""
    ordinary: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    thresholds: tuple[int, ...] = ()
    constant: float | None = None


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z), without punctuation at their ends; one empty window for no words."""
    return [w.strip(_EDGES) for w in (text or "").encode().lower().split()] or [b""]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: as many as fit, each once
        return b"".join(dict.fromkeys(samples))[:size]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The two dictionaries, as raw content, from the texts of each class.

    Words are counted text by text, and read again for the samples, so that no more than the counts is held.
    """
    texts = {1: list(dict.fromkeys(toxic)), 0: list(dict.fromkeys(ordinary))}
    n = {c: len(t) for c, t in texts.items()}
    count = {1: Counter(), 0: Counter()}
    for c, found in texts.items():
        for t in found:
            count[c].update(set(windows(t)))

    def marks(c: int) -> set[bytes]:
        other = 1 - c
        return {w for w, k in count[c].items() if k >= SHARE * n[c] and k / n[c] > TIMES[c] * (count[other][w] + 1) / n[other]}

    own = {c: marks(c) for c in (0, 1)}
    common = {w for w, k in count[0].items() if w not in own[1] and k >= max(3, COMMON * n[0])}

    def samples(c: int, keep: set[bytes]) -> list[bytes]:
        return [b" " + w + b" " for t in texts[c] for w in sorted(set(windows(t)) & keep)]

    base = _trained(samples(0, common), BASE_SIZE, 24)
    return tuple(_trained(samples(c, own[c]), OWN_SIZE, 12) + base + FRAME for c in (1, 0))


class Gains:
    """The bytes that the toxic dictionary saves on a window; remembered, as words recur."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        def packer(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary, self.known = packer(toxic), packer(ordinary), {}

    def __call__(self, window: bytes) -> int:
        gain = self.known.get(window)
        if gain is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            framed = FRAME + b" " + window + b" "
            gain = self.known[window] = len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed))
        return gain


def histogram(text: str | None, gains: Gains) -> np.ndarray:
    """How many windows of a text have each gain, from -MOST to MOST."""
    v = np.fromiter(map(gains, windows(text)), np.int64)
    return np.bincount(np.clip(v, -MOST, MOST) + MOST, minlength=2 * MOST + 1)


def calibrated(ordinary: np.ndarray) -> tuple[int, ...]:
    """Thresholds, rising, from the summed histogram of ordinary texts."""
    reach = np.cumsum(ordinary[::-1])[::-1][MOST + 1 :] / max(1, ordinary.sum())  # share of windows with a gain of 1 or more, 2 or more, ...
    return tuple(int(np.argmax(np.r_[reach <= share, True])) + 1 for share in RARITY)


def features(counts: np.ndarray, thresholds: tuple[int, ...]) -> list[float]:
    """What the curve is given, from a text's histogram."""
    values, n = np.arange(-MOST, MOST + 1), int(counts.sum())
    top = np.repeat(values[::-1], np.minimum(counts[::-1], 3))[:3]
    over = [int(counts[MOST + t :].sum()) for t in thresholds]
    return [float(top[0]), float(top.mean()), float(values @ counts / n), *map(math.log1p, over), *[k / n for k in over], math.log1p(int(counts[: MOST - 2].sum())), math.log1p(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the constant first) of a logistic fit by Newton's method."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    return centre, scale, w


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) outside the held-out fold."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    marks = written(marks.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).withColumn("order", F.xxhash64("doc_id")))
    chosen = None
    for c, n in marks.groupBy("toxic").count().collect():
        # First what lies below a bound of the hash, of which about two samples are expected; then the sample of these.
        share = min(1.0, 2 * sample / n)
        some = marks.where((F.col("toxic") == c) & (F.pmod("order", F.lit(1 << 20)) < math.ceil(share * (1 << 20)))).orderBy("order", "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return Model(constant=0.0)
    texts = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    texts = texts.groupBy("doc_id", "toxic", "order").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    texts = written(texts.select("doc_id", "toxic", "order", F.col("t.text").alias("text"), F.length("t.text").alias("chars")))
    turn = Window.partitionBy("toxic").orderBy((F.col("chars") > LONG).cast("int"), "order", "doc_id")
    ranked = texts.select("doc_id", "toxic", F.sum("chars").over(turn).alias("sum"), F.row_number().over(turn).alias("place"))  # numbers only
    kept = ranked.where((F.col("sum") <= sample_chars // 2) | (F.col("place") == 1)).select("doc_id")
    texts = texts.join(F.broadcast(kept), "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS)
    of: dict[int, list[tuple[int, str]]] = {0: [], 1: []}
    for toxic, fold, text in texts.orderBy("order", "doc_id").select("toxic", "fold", "text").toLocalIterator():
        of[toxic].append((fold, text))
    if not of[0] or not of[1]:
        return Model(constant=1.0 if of[1] else 0.0)
    seen = {c: [t for fold, t in of[c] if fold != CALIBRATED] or [t for _, t in of[c]] for c in of}
    pair = Model(*dictionaries(seen[1], seen[0]))
    # Each class is calibrated on the fold that its dictionary hasn't seen, if it has one.
    fresh = {c: any(fold == CALIBRATED for fold, _ in of[c]) for c in of}
    wanted = (F.col("fold") == CALIBRATED) | ((F.col("toxic") == 1) & F.lit(not fresh[1])) | ((F.col("toxic") == 0) & F.lit(not fresh[0]))

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = Gains(pair.toxic, pair.ordinary)
        for part in parts:
            yield pd.DataFrame({"toxic": part["toxic"], "f": [histogram(t, gains) for t in part["text"]]})

    rows = texts.where(wanted).select("text", "toxic").repartition(shuffles(spark)).mapInPandas(measured, "toxic int, f array<long>").toPandas()
    rows = rows.assign(key=rows["f"].map(tuple)).sort_values(["key", "toxic"])  # in one order, whichever task ended first
    counts, toxic = np.array(rows["f"].tolist()), rows["toxic"].to_numpy(float)
    thresholds = calibrated(counts[toxic == 0].sum(0))
    centre, scale, weights = logistic(np.array([features(x, thresholds) for x in counts]), toxic)
    return Model(pair.toxic, pair.ordinary, tuple(centre), tuple(scale), tuple(weights), thresholds)


def score(text: Column, model: Model) -> Column:
    """The score of a text column, rounded to 6 digits."""
    if model.constant is not None:
        return F.lit(model.constant)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gains = Gains(model.toxic, model.ordinary)
        centre, scale, w = map(np.array, (model.centre, model.scale, model.weights))
        for texts in parts:
            x = np.array([features(histogram(t.as_py(), gains), model.thresholds) for t in texts]).reshape(len(texts), len(centre))
            z = w[0] + ((x - centre) / scale) @ w[1:]
            yield pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6))

    return scored(text)


def classified(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted."""
    doc_id = F.col(f"`{id_column}`")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score(text_of(f"`{text}`"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
