"""Document scores by masked pseudo-likelihood.

A small network predicts each word from the SPAN words on either side of it. All words of the
corpus are counted first, in a table that grows with it. A word's class is its band of
frequency and its ending; the VOCABULARY most frequent words have bands of about equal mass,
all others share the last band. The network predicts the band from the context, and the
ending from the context and the band; the word given its class is taken from the counts.
A document's score is the sum of the log-probabilities of all its words, each given both sides.

The network starts from the counts: without a context it gives each class its share of the
corpus. Training is data-parallel, in ROUNDS over as many parts of the documents, so that each
document is learnt from once. In a round a copy of the network is trained, in numpy, on about
COPY words at a time, and the copies are averaged by their words, in two levels of groups; so the
number of copies grows with the corpus, and no task holds more than about the square root of
them. Documents are dealt to copies by their hash, and read in its order, so the scores
don't depend on how the table is partitioned.

Through the driver pass the most frequent words (about a megabyte), the classes' totals and the
averaged network (under two). The counts of all other words are joined to where they occur.

Defined results: a null or empty text has no words and the score 0, and no mean; repeated
rows get one result each; other columns are ignored; an empty table gives none. Contexts end at
the ends of a document. A word that wasn't counted counts as half a one of the last band.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import in_slices, text_of, written

BANDS, ENDINGS, VOCABULARY, OWN = 32, 64, 65_536, 4_096
WIDTH, SPAN, BATCH, ROUNDS, RATE, SEED, COPY = 16, 2, 4096, 3, 0.05, 7, 1_000_000
CLASSES = BANDS * ENDINGS
NOWHERE = OWN + CLASSES  # the code of a place outside the document
SHAPES = {"left": (NOWHERE + 1, WIDTH), "right": (NOWHERE + 1, WIDTH), "bias": (WIDTH,), "w1": (WIDTH, BANDS), "w2": (WIDTH, ENDINGS)}
PIECE = 8192  # parameters to a row when copies are averaged
SLICE = 1 << 22  # bytes of texts that are split into words at a time
HELD = 1 << 19  # counts that a task holds before it adds them up

Net = dict[str, np.ndarray]


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words, by rising hash, with their codes, classes and log-probabilities in the class; the classes; all counts.

    A code is what a context sees: the word itself for the OWN most frequent ones, else OWN + its class.
    """

    hashes: np.ndarray
    code: np.ndarray
    word_class: np.ndarray
    log_in_class: np.ndarray
    own_class: np.ndarray  # of the codes below OWN
    log_band: np.ndarray
    log_ending: np.ndarray  # given the band
    tail_total: np.ndarray  # what the counts of the last band's words are divided by, for each ending
    counts: DataFrame | None = None

    def shipped(self) -> Vocabulary:
        """Without the table, for tasks."""
        return Vocabulary(*[getattr(self, f) for f in list(self.__dataclass_fields__)[:-1]])

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < OWN, self.own_class[np.minimum(codes, OWN - 1)], np.minimum(codes - OWN, CLASSES - 1))


_digest = partial(xxhash.xxh64_intdigest, seed=42)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """An array of texts in slices of some SLICE bytes, each with the place of its first text; a longer text comes in several, cut at blanks."""
    first = 0
    for part in in_slices(texts, SLICE):
        data = part[0].as_py().encode() if len(part) == 1 and part[0].is_valid else b""
        if len(data) <= SLICE:
            yield first, part
        else:
            start = 0
            while start < len(data):
                cut = _BLANK.search(data, start + SLICE) if start + SLICE < len(data) else None
                end = cut.start() if cut else len(data)
                yield first, pa.array([data[start:end]], pa.string())
                start = end + 1
        first += len(part)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, the place of each word among the distinct ones, and the hashes and endings of those.

    Words are hashed once for all their occurrences, which are many: hashing each of them is most of the work otherwise.
    """
    lists = pc.ascii_split_whitespace(texts)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    at, distinct = found.indices.to_numpy(), found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    if b"" in distinct:  # stands for blanks at the ends of a text
        real = at != np.flatnonzero(distinct == b"")[0]
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
        at = at[real]
    hashes = np.fromiter(map(_digest, distinct), np.uint64, len(distinct))
    flat = np.frombuffer(b"\0\0" + b"\0\0".join(distinct), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2)
    before, last = flat[ends - 2].astype(np.int64), flat[ends - 1].astype(np.int64)
    return n, at, hashes, (before * 1_000_003 + last * 8_191 >> 3) % ENDINGS


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash (as Spark's xxhash64, unsigned) and the ending of each word of a text: a class of its last two bytes."""
    hashes, endings = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, part in _pieces(pa.array([text or ""])):
        _, at, h, e = _split(part)
        hashes.append(h[at])
        endings.append(e[at])
    return np.concatenate(hashes), np.concatenate(endings)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, endings, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        return pa.record_batch({
            "h": pa.array(hashes[starts].view(np.int64)), "ending": pa.array(endings[order[starts]].astype(np.int32)),
            "n": pa.array(np.add.reduceat(n[order], starts) if len(starts) else n),
        })

    held, n_held = [], 0
    for batch in batches:
        for _, part in _pieces(batch.column(0)):
            _, at, hashes, endings = _split(part)
            n = np.bincount(at, minlength=len(hashes))
            held.append((hashes[n > 0], endings[n > 0], n[n > 0]))
            n_held += len(hashes)
            if n_held >= HELD:
                yield summed(held)
                held, n_held = [], 0
    if held:
        yield summed(held)


def vocabulary(docs: DataFrame, *, text: str = "text", size: int = VOCABULARY) -> Vocabulary:
    """The counts of all words of docs, and what is made of them."""
    found = docs.select(text_of(f"`{text}`").alias("text")).mapInArrow(_counted, "h long, ending int, n long")
    counts = written(found.groupBy("h", "ending").agg(F.sum("n").alias("n")))
    # The frequent words lie above a bound from the distribution of counts, so that hardly more than they are sorted.
    level, least = F.floor(8 * F.log2("n")).cast("int"), 0
    above = 0
    for at, words in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # a few hundred levels
        above += words
        if above >= size:
            least = at
            break
    top = counts.where(level >= least).orderBy(F.desc("n"), "h").limit(size).toPandas()  # bounded
    n_all, d_all = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        n_all[r.ending], d_all[r.ending] = r.n, r.d
    n, ending = top["n"].to_numpy(float), top["ending"].to_numpy(np.int64)
    total = max(1.0, n_all.sum())
    band = np.minimum((np.cumsum(n) - n) / total * (BANDS - 1), BANDS - 2).astype(np.int64)
    word_class = band * ENDINGS + ending
    of_class = np.bincount(word_class, n, CLASSES).astype(float)
    last = slice((BANDS - 1) * ENDINGS, CLASSES)
    of_class[last] = np.maximum(0, n_all - np.bincount(ending, n, ENDINGS))
    distinct = d_all - np.bincount(ending, minlength=ENDINGS)
    of_class += 0.5  # no class is impossible
    of_band = of_class.reshape(BANDS, ENDINGS).sum(1)
    code = np.where(np.arange(len(n)) < OWN, np.arange(len(n)), OWN + word_class)
    own_class = np.zeros(OWN, np.int64)
    own_class[: len(n)] = word_class[:OWN]
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64), kind="stable")
    return Vocabulary(
        top["h"].to_numpy(np.int64).view(np.uint64)[order], code[order], word_class[order], np.log(n / (of_class[word_class] - 0.5))[order], own_class,
        np.log(of_band / of_band.sum()), np.log(of_class.reshape(BANDS, ENDINGS) / of_band[:, None]), of_class[last] - 0.5 + 0.5 * (distinct + 1), counts,
    )


def _encoded_texts(vocab: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For an array of texts: each one's number of words; all codes, end to end, in two bytes each; each one's sum of the logs of its words
    within their classes, but for the counts of rare words; each one's number of rare words; their hashes, end to end."""
    n_words, inside, n_rare = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    codes, rare = [np.zeros(0, "<u2")], [np.zeros(0, np.uint64)]
    for first, part in _pieces(texts):
        n, at, hashes, endings = _split(part)
        place = np.minimum(np.searchsorted(vocab.hashes, hashes), max(0, len(vocab.hashes) - 1))
        known = vocab.hashes[place] == hashes if len(vocab.hashes) else np.zeros(len(hashes), bool)
        place = place[known]
        code, log = OWN + (BANDS - 1) * ENDINGS + endings, -np.log(vocab.tail_total[endings])
        code[known], log[known] = vocab.code[place], vocab.log_in_class[place]
        here, row, unknown = slice(first, first + len(n)), np.repeat(np.arange(len(n)), n), ~known[at]
        n_words[here] += n
        inside[here] += np.bincount(row, log[at], len(n))
        n_rare[here] += np.bincount(row[unknown], minlength=len(n))
        codes.append(code.astype("<u2")[at])
        rare.append(hashes[at[unknown]])
    return n_words, np.concatenate(codes), inside, n_rare, np.concatenate(rare)


def _encoded(vocab: Vocabulary, text: str | None) -> tuple[np.ndarray, float, np.ndarray]:
    """The same of one text: its codes, the sum and the rare words' hashes."""
    _, codes, inside, _, rare = _encoded_texts(vocab, pa.array([text or ""]))
    return codes.astype(np.int64), float(inside[0]), rare


def coded(docs: DataFrame, vocab: Vocabulary, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (a hash of id and text), n, codes (two bytes for each word), inside and rare of each row; written once, the texts aren't read again."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab.shipped())  # of bounded size

    @F.arrow_udf("struct<n: int, codes: binary, inside: double, rare: array<long>>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = shared.value
        ends = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        for texts in parts:
            n, codes, inside, n_rare, rare = _encoded_texts(v, texts)
            cells = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends(2 * n)), pa.py_buffer(codes)])
            rare = pa.ListArray.from_arrays(pa.array(ends(n_rare)), pa.array(rare.view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), cells, pa.array(inside), rare], ["n", "codes", "inside", "rare"])

    doc_id, t = F.col(f"`{id_column}`"), text_of(f"`{text}`")
    return written(docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, t).alias("h"), encode(t).alias("x")).select("doc_id", "h", "x.*"))


def fresh(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if k in ("left", "right") else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(net: Net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Net:
    ends = np.cumsum([np.prod(s) for s in SHAPES.values()])
    return {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(SHAPES.items(), np.split(values, ends[:-1]), strict=True)}


def streams(texts: list[np.ndarray], batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' codes end to end, with SPAN empty places around each, cut into batches.

    Gives the codes with SPAN more on either side, and for those between: their document, -1 for an empty place.
    """
    gap, none = np.full(SPAN, NOWHERE), np.full(SPAN, -1)
    parts, owners = [gap], [none]
    for d, x in enumerate(texts):
        parts += [x, gap]
        owners += [np.full(len(x), d), none]
    ids, owner = np.concatenate(parts), np.concatenate(owners)
    for i in range(SPAN, len(ids) - SPAN, batch):
        j = min(i + batch, len(ids) - SPAN)
        yield ids[i - SPAN : j + SPAN], owner[i:j], ids[i:j]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_chance(x: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    own = x[at, chosen].astype(float)
    return own - np.log(np.exp(x, out=x).sum(1))


def forward(net: Net, vocab: Vocabulary, around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the codes between the ends of `around`: band, ending, the hidden layer and what the softmax is taken of, for bands and endings."""
    n, c = len(target), vocab.classes(target)
    band, ending = c // ENDINGS, c % ENDINGS
    left, right = net["left"].take(around, 0), net["right"].take(around, 0)
    x = net["bias"] + sum(left[SPAN - k : SPAN - k + n] for k in range(1, SPAN + 1)) + sum(right[SPAN + k : SPAN + k + n] for k in range(1, SPAN + 1))
    h = np.tanh(x)
    x1, x2 = h @ net["w1"], h @ net["w2"]
    x1 += vocab.log_band.astype(np.float32)
    x2 += vocab.log_ending.astype(np.float32).take(band, 0)
    return band, ending, h, x1, x2


def step(net: Net, memory: Net, vocab: Vocabulary, around: np.ndarray, owner: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One step of gradient descent, with rates by each parameter's past."""
    real = owner >= 0
    n = int(real.sum())
    if not n:
        return
    band, ending, h, x1, x2 = forward(net, vocab, around, target)
    at, p1, p2 = np.arange(len(target)), _softmax(x1), _softmax(x2)
    p1[at, band] -= 1
    p2[at, ending] -= 1
    for p in (p1, p2):
        p[~real] = 0
        p /= n
    g = (p1 @ net["w1"].T + p2 @ net["w2"].T) * (1 - h * h)
    for k, d in {"w1": h.T @ p1, "w2": h.T @ p2, "bias": g.sum(0)}.items():
        memory[k] += d * d
        net[k] -= rate * d / np.sqrt(memory[k] + 1e-10)
    order = np.argsort(around.astype(np.uint16), kind="stable")  # by digits, for so small numbers
    starts = np.flatnonzero(np.diff(around[order], prepend=-1))
    ids = around[order[starts]]
    for k, sign in (("left", -1), ("right", 1)):
        spread = np.zeros((len(around), WIDTH), np.float32)
        for s in range(1, SPAN + 1):
            spread[SPAN + sign * s : SPAN + sign * s + len(target)] += g
        d = np.add.reduceat(spread.take(order, 0), starts, axis=0)
        past = memory[k].take(ids, 0) + d * d
        memory[k][ids] = past
        net[k][ids] -= rate * d / np.sqrt(past + 1e-10)


def pseudo_likelihoods(net: Net, vocab: Vocabulary, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each document's codes, the summed log-probability of their classes: in context, and by the counts alone."""
    total, plain = np.zeros(len(texts)), np.zeros(len(texts))
    for around, owner, target in streams(texts):
        real = owner >= 0
        band, ending, _, x1, x2 = forward(net, vocab, around, target)
        at = np.arange(len(target))
        total += np.bincount(owner[real], (_log_chance(x1, at, band) + _log_chance(x2, at, ending))[real], len(texts))
        plain += np.bincount(owner[real], (vocab.log_band[band] + vocab.log_ending[band, ending])[real], len(texts))
    return total, plain


def _codes(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_py(), "<u2").astype(np.int64)


def _trainer(start: np.ndarray, past: np.ndarray, vocab, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], bool]]:
        """The documents of one copy, some 50,000 words at a time, and whether the copy ends with them."""
        copy, held, n = None, [], 0
        for batch in batches:
            for c, cell in zip(batch["copy"].to_pylist(), batch["codes"], strict=True):
                if c != copy and copy is not None:
                    yield copy, held, True
                    held, n = [], 0
                copy = c
                held.append(_codes(cell))
                n += len(held[-1])
                if n >= 50_000:
                    yield copy, held, False
                    held, n = [], 0
        if copy is not None:
            yield copy, held, True

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, memory, tokens, v = shaped(start), shaped(past), 0, vocab.value
        for copy, texts, ends in copies(batches):
            tokens += sum(map(len, texts))
            for around, owner, target in streams(texts):
                step(net, memory, v, around, owner, target, rate)
            if ends:
                if tokens:
                    values = np.concatenate([flat(net), flat(memory)])
                    pieces = [values[i : i + PIECE] for i in range(0, len(values), PIECE)]
                    yield pa.record_batch({"copy": pa.array([copy] * len(pieces), pa.int64()), "piece": pa.array(range(len(pieces)), pa.int32()), "tokens": pa.array([float(tokens)] * len(pieces)), "v": pa.array([p.tolist() for p in pieces], pa.list_(pa.float32()))})
                net, memory, tokens = shaped(start), shaped(past), 0

    return train


def _averaged(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("copy")
    weights = rows["tokens"].to_numpy()
    total = sum(w * np.asarray(v.values, np.float64) for w, v in zip(weights, rows["v"], strict=True))
    out = {"copy": rows["copy"][:1], "piece": rows["piece"][:1], "tokens": pa.array([float(weights.sum())]), "v": pa.array([(total / weights.sum()).tolist()], pa.list_(pa.float32()))}
    return pa.table(out)


def fit(codes: DataFrame, vocab: Vocabulary, *, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED, copy: int = COPY) -> Net:
    """The network, after each row of coded documents was learnt from in one of the rounds."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(vocab.shipped())
    start, past = flat(fresh(seed)), np.zeros_like(flat(fresh(seed)))
    schema = "copy long, piece int, tokens double, v array<float>"
    n_words = codes.agg(F.sum("n")).first()[0] or 0
    n_copies = max(1, math.ceil(n_words / rounds / copy))
    for r in range(rounds):
        part = codes.where(F.pmod("h", F.lit(rounds)) == r).where("n > 0").select("h", "codes", F.pmod(F.xxhash64("h"), F.lit(n_copies)).alias("copy"))
        part = part.repartition("copy").sortWithinPartitions("copy", "h").select("copy", "codes")
        trained = written(part.mapInArrow(_trainer(start, past, shared, rate), schema))
        wide = math.isqrt(n_copies)
        some = trained.withColumn("g", F.pmod("copy", F.lit(wide))).groupBy("piece", "g").applyInArrow(lambda t: _averaged(t.drop_columns(["g"])), schema)
        rows = some.groupBy("piece").applyInArrow(_averaged, schema).collect()  # the network's fixed size
        if rows:
            start, past = np.split(np.concatenate([np.array(x.v, np.float32) for x in sorted(rows, key=lambda x: x.piece)]), 2)
    return shaped(start)


def scored(codes: DataFrame, vocab: Vocabulary, net: Net) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed), mean_log_likelihood and mean_unigram (by the counts alone; both null without words)."""
    shared = codes.sparkSession.sparkContext.broadcast((vocab.shipped(), flat(net)))  # of a fixed size

    @F.arrow_udf("struct<s: double, u: double>")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v, net = shared.value[0], shaped(shared.value[1])
        for cells in parts:
            found, held, n = [], [], 0
            for cell in cells:
                held.append(_codes(cell))
                n += len(held[-1])
                if n >= 200_000:
                    found.append(pseudo_likelihoods(net, v, held))
                    held, n = [], 0
            found.append(pseudo_likelihoods(net, v, held))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["s", "u"])

    rows = written(codes.select("doc_id", "n", "inside", "rare", scores("codes").alias("x"), F.monotonically_increasing_id().alias("row")))
    rare = rows.select("row", F.explode("rare").alias("h")).join(vocab.counts.select("h", F.col("n").alias("seen")), "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log(F.coalesce("seen", F.lit(0)) + 0.5)).alias("of_rare"))
    rows = rows.drop("rare").join(rare, "row", "left").withColumn("inside", F.col("inside") + F.coalesce("of_rare", F.lit(0.0)))
    total, each = F.col("x.s") + F.col("inside"), F.nullif(F.col("n"), F.lit(0))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_tokens"), F.round(total, 4).alias("log_likelihood"),
        F.round(total / each, 6).alias("mean_log_likelihood"), F.round((F.col("x.u") + F.col("inside")) / each, 6).alias("mean_unigram"),
    )


def scores(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The scores of docs by a network of their own."""
    vocab = vocabulary(docs, text=text)
    codes = coded(docs, vocab, id_column=id_column, text=text)
    return scored(codes, vocab, fit(codes, vocab, **how))
