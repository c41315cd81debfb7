"""Near copies by SimHash in pigeonhole blocks, held to their exact similarity, and by a prefix filter where fingerprints differ more.

Two texts are near copies if the Jaccard similarity of their sets of SHINGLE lower-cased
words is SHARE or more. Such sets have at least SHARE of the larger one in common, so, all
hashes being ranked in one order, the first n - ceil(SHARE n) + 1 hashes of either hold a
common one: no pair is missed, whatever the order. Hashes that are frequent in a sample are
ranked last, which only keeps the groups small.

Texts alike in their words are one class and are folded first. Classes whose fingerprints are
alike or differ in a few bits are paired first, by the blocks and links of simhash; a fingerprint is
that of the set's hashes. At SHARE, fingerprints differ in some ten bits, so most pairs need the prefixes. Of the classes that share a
hash, each is compared with one of them; what this links is one component, and then only
classes of different components are compared. That is done where they lie, in runs of one
hash (those of more than CHUNK classes are cut into chunks, each pair of which is a run), and only pairs
that may be alike leave a run: by their sizes, by what comes after the hash, and by their sketches.
A sketch says of each of some buckets whether an odd number of a set's hashes falls in it;
two sets differ in no fewer hashes than their sketches in buckets. So neither a group of near
copies nor one of texts not quite alike is listed in pairs. First only as many pairs leave
a run as connect its components; once these are verified and joined, all the others. Every pair is verified
on the whole sets, which are made only for texts of which a pair is left.

Most hashes are in one class only. Hashes alone are counted first, and those of two classes
are marked in a bit map of fixed size, so that the entries with their classes are few when they are shuffled.
Likewise for texts: those that sets are made of, and those that may go, are marked, and only these are shuffled.

Defined results: a text of fewer than SHINGLE words is one shingle; a null, empty or blank
text has no words, and all of these are one class. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import simhash
from loomery.llm.common import bit_map, in_bit_map, in_slices, shuffles, text_of, written
from loomery.llm.components import components, forest

#: SHARE is 4 / 5. The sample is one of SAMPLE classes, of which at most FREQUENT hashes pass through the driver (2 MB).
SHINGLE, SHARE, SEED, SAMPLE, FREQUENT, SALTED = 5, (4, 5), 42, 64, 1 << 18, 256
#: Bytes of the sketches that are compared in runs, one after the other; classes of a run; pairs held at once.
FOLDS, CHUNK, AT_ONCE = (64, 128, 256), 1024, 1 << 17


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles; words are parted and lowered as by simhash."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    joined = b" ".join(found)
    if len(found) < shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths).tolist(), ends[shingle - 1 :].tolist(), strict=False)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - shingle + 1))


def _word_classes(texts: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(b" ".join((x.as_py() or "").encode().lower().split()), SEED) for x in texts), np.uint64, len(texts))


def word_class(text: Column) -> Column:
    """A 64-bit hash of the lower-cased words in order."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(_word_classes(texts).view(np.int64))

    return of(text)


def hashes(text: Column) -> Column:
    """All shingle hashes of a text, as signed longs."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in in_slices(texts):
                yield _lists([shingles(x.as_py()) for x in part])

    return of(text)


def sketch(found: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls in each of 512 buckets or more, by their last bits: a bit each."""
    buckets = max(8 * FOLDS[0], 1 << max(0, 2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, size: int) -> bytes:
    """The sketch with as few buckets as `size` bytes have, if it has more."""
    a = np.frombuffer(x, np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """No more than the hashes that two sets with these sketches don't have in common."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(np.frombuffer(folded(x, size), np.uint64) ^ np.frombuffer(folded(y, size), np.uint64)).sum())


def prefixes(text: Column, frequent: np.ndarray, several: Broadcast, folded_ones: bool) -> Column:
    """fp, size, the first hashes of a text by rank (those not frequent, in their own order, then the frequent ones by theirs), the sketch, its small form and the fingerprint.

    Null for texts whose class is in the bit map of classes that may have several texts, or, with folded_ones, for those whose class isn't.
    """

    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def made(texts: pa.Array, bits: np.ndarray) -> pa.Array:
        fps = _word_classes(texts)
        there = in_bit_map(fps, bits) == folded_ones
        sizes, firsts, sketches, prints = [], [], [], np.zeros(len(texts), np.uint64)
        for k, (x, wanted) in enumerate(zip(texts, there, strict=True)):
            found = shingles(x.as_py()) if wanted else np.zeros(0, np.uint64)
            n = len(found)
            sketches.append(sketch(found) if wanted else None)
            prints[k] = simhash.voted(found) if n else 0
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                rank = np.where(known[at] == found, by_hash[at] + 1, 0)
                found = found[np.argsort(rank, kind="stable")]
            sizes.append(n)
            firsts.append(found[: n - -(-n * SHARE[0] // SHARE[1]) + 1] if n else found)
        small = [folded(x, FOLDS[-1]) if x else None for x in sketches]
        columns = [pa.array(fps.view(np.int64)), pa.array(sizes, pa.int32()), _lists(firsts), pa.array(sketches, pa.binary()), pa.array(small, pa.binary()), pa.array(prints.view(np.int64))]
        return pa.StructArray.from_arrays(columns, ["fp", "size", "prefix", "sketch", "small", "print"], mask=pa.array(~there))

    @F.arrow_udf("struct<fp: long, size: int, prefix: array<long>, sketch: binary, small: binary, print: long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = np.frombuffer(several.value, np.uint8)
        for texts in batches:
            for part in in_slices(texts):
                yield made(part, bits)

    return of.asNondeterministic()(text)  # else a filter on it makes Spark run it twice


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def frequent_hashes(texts: DataFrame) -> np.ndarray:
    """Of a sample of texts (fp, text): hashes in more than one class, the rarest first."""
    some = texts.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).dropDuplicates(["fp"])
    counted = some.select(F.explode(hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()  # bounded
    return np.array([r.h for r in reversed(top)], np.int64).view(np.uint64)


def _crowded(pairs: DataFrame) -> set[str]:
    """The sides of pairs (a, b) on which some class has more than SALTED pairs."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("fp")) for s in "ab"])).alias("e"))
    return {r.side for r in ends.groupBy("e.side", "e.fp").count().where(F.col("count") > SALTED).select("side").distinct().collect()}  # two at most


def _with_sets(pairs: DataFrame, sets: DataFrame, crowded: set[str]) -> DataFrame:
    """pairs with the sets of both sides. On a crowded side, a class with many pairs has its set under several salts."""
    out = pairs
    for side, other in ("b", "a"), ("a", "b"):
        named = sets.select(F.col("fp").alias(side), F.col("set").alias(f"set_{side}"))
        if side not in crowded:
            out = out.join(named, side)
            continue
        many = pairs.groupBy(side).agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")).where("salts > 1")
        keyed = named.join(many, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        salted = out.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        out = salted.join(keyed, [side, "salt"]).drop("salt")
    return out


def _allowed(x: Column, y: Column, m: Column, n: Column) -> Column:
    """Whether the sketches x and y of sets of m and n hashes allow SHARE."""

    @F.arrow_udf("boolean")
    def of(xs: pa.Array, ys: pa.Array, ms: pa.Array, ns: pa.Array) -> pa.Array:
        each = zip(xs.to_pylist(), ys.to_pylist(), ms.to_pylist(), ns.to_pylist(), strict=True)
        return pa.array([least_apart(x, y) * (SHARE[0] + SHARE[1]) <= (m + n) * (SHARE[1] - SHARE[0]) for x, y, m, n in each], pa.bool_())

    return of(x, y, m, n)


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, slim: DataFrame) -> DataFrame:
    """Of distinct stored pairs (a, b), those whose sets are SHARE alike."""
    crowded = _crowded(pairs)
    likely = _with_sets(pairs, classes.select("fp", F.struct("size", "sketch").alias("set")), crowded)
    likely = written(likely.where(_allowed(F.col("set_a.sketch"), F.col("set_b.sketch"), F.col("set_a.size"), F.col("set_b.size"))).select("a", "b"))
    if likely.isEmpty():
        return likely
    full = _with_sets(likely, _sets(likely, rows, slim), crowded)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return written(full.where(common * SHARE[1] >= (F.size("set_a") + F.size("set_b") - common) * SHARE[0]).select("a", "b"))


def _alike(x: str, y: str) -> Column:
    """Whether the sizes of two entries allow SHARE."""
    m, n = F.col(f"{x}.size").cast("long"), F.col(f"{y}.size").cast("long")
    return (m * SHARE[0] <= n * SHARE[1]) & (n * SHARE[0] <= m * SHARE[1])


def _may(x: str, y: str) -> Column:
    """Whether two entries of one hash, if it is the first that they share, allow SHARE: by their sizes, and by what comes after the hash."""
    m, n = F.col(f"{x}.size").cast("long"), F.col(f"{y}.size").cast("long")
    most = 1 + F.least(m - F.col(f"{x}.at"), n - F.col(f"{y}.at"))
    # J >= s / t needs a common part of s / (s + t) of both sizes.
    return _alike(x, y) & (most * (SHARE[0] + SHARE[1]) >= (m + n) * SHARE[0])


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.fp", f"{y}.fp").alias("a"), F.greatest(f"{x}.fp", f"{y}.fp").alias("b")]


def _likely(rows: pa.Table, done: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (places in rows) of each run that may be alike, and where the last run begins, which is left out unless done."""
    h, cell, side = (rows[c].to_numpy() for c in ("h", "cell", "side"))
    part, size, at = (rows[c].to_numpy().astype(np.int64) for c in ("c", "size", "at"))
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])])
    ends = np.r_[starts[1:], len(h)]
    if not done:
        starts, ends, rest = starts[:-1], ends[:-1], int(starts[-1])
    else:
        rest = len(h)
    end = np.repeat(ends, ends - starts)
    later = end - np.arange(rest) - 1
    small = rows["small"].to_pylist()
    length = np.array([len(x) for x in small])
    words = {f: np.frombuffer(b"".join([folded(x, f) if len(x) >= f else bytes(f) for x in small]), np.uint64).reshape(len(small), -1) for f in FOLDS}
    found, first, total = [], 0, np.cumsum(later)
    while first < rest:
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + AT_ONCE, "right")))
        n = later[first:last]
        a = np.repeat(np.arange(first, last), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        first = last
        x, y = size[a], size[b]
        most = 1 + np.minimum(x - at[a], y - at[b])
        good = (part[a] != part[b]) & ((side[a] < 0) | (side[a] != side[b])) & (x * SHARE[0] <= y * SHARE[1]) & (y * SHARE[0] <= x * SHARE[1])
        good &= most * (SHARE[0] + SHARE[1]) >= (x + y) * SHARE[0]
        a, b = a[good], b[good]
        for f in FOLDS:
            apart = np.bitwise_count(words[f][a] ^ words[f][b]).sum(axis=1, dtype=np.int64)
            good = (np.minimum(length[a], length[b]) < f) | (apart * (SHARE[0] + SHARE[1]) <= (size[a] + size[b]) * (SHARE[1] - SHARE[0]))
            a, b = a[good], b[good]
        found.append((a, b))
    join = lambda k: np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]])
    return join(0), join(1), rest


def _in_runs(batches: Iterator[pa.RecordBatch], some: bool) -> Iterator[pa.RecordBatch]:
    """From rows in order of h and cell: the pairs (a, b) of classes that may be alike, each once a batch; some: only as many as connect what they connect."""

    def paired(rows: pa.Table, done: bool) -> tuple[pa.RecordBatch, pa.Table]:
        x, y, rest = _likely(rows, done)
        if some and len(x):
            names, part = np.unique(rows["c"].to_numpy(), return_inverse=True)
            used = forest(part[x], part[y], len(names))
            x, y = x[used], y[used]
        fp = rows["fp"].to_numpy()
        pairs = np.unique(np.stack([np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])], axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]), rows.slice(rest)

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        if rows.num_rows:
            out, rest = paired(rows, False)
            yield out
    if rest is not None and rest.num_rows:
        yield paired(rest.combine_chunks(), True)[0]


def _between(placed: DataFrame, classes: DataFrame, some: bool) -> DataFrame:
    """From entries (h, e, c): pairs (a, b) of classes of different components c that may be alike; all, or some."""
    sizes = placed.groupBy("h").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    entries = placed.select("h", "c", "e.fp", "e.size", "e.at").join(sizes, "h").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    # A hash of few classes is one run. One of many has a run within each chunk (side -1) and one for each pair of chunks.
    cells = F.expr(
        """CASE WHEN chunks = 1 THEN array(struct(0L AS cell, -1 AS side)) ELSE
           transform(sequence(0L, chunks - 1), o -> CASE
             WHEN o = mine THEN struct(mine * chunks + mine AS cell, -1 AS side)
             WHEN o < mine THEN struct(o * chunks + mine AS cell, 1 AS side)
             ELSE struct(mine * chunks + o AS cell, 0 AS side) END) END"""
    )
    entries = entries.select("h", "c", "fp", "size", "at", F.explode(cells).alias("o")).join(classes.select("fp", "small"), "fp")
    runs = entries.select("h", "o.cell", "o.side", "c", "fp", "size", "at", "small").repartition(shuffles(placed.sparkSession), "h", "cell").sortWithinPartitions("h", "cell")
    return runs.mapInArrow(lambda batches: _in_runs(batches, some), "a long, b long").distinct()


def _marked(classes: DataFrame, marked: Broadcast) -> DataFrame:
    """From classes (fp, size, prefix): h, fp, size and at (the place in the prefix) of the hashes that may be in the bit map."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marked.value, np.uint8)
        for batch in batches:
            lists = batch["prefix"]
            sizes, h = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            here = in_bit_map(h.view(np.uint64), bits)
            taken = pa.array(row[here])
            yield pa.record_batch({"h": pa.array(h[here]), "fp": batch["fp"].take(taken), "size": batch["size"].take(taken), "at": pa.array(at[here].astype(np.int32))})

    return classes.select("fp", "size", "prefix").mapInArrow(pick, "h long, fp long, size int, at int")


def by_fingerprints(classes: DataFrame) -> DataFrame:
    """From classes (fp, print): distinct pairs (a, b) that connect all whose fingerprints are alike, or linked by simhash."""
    prints = written(classes.groupBy("print").agg(F.min("fp").alias("least")))
    alike = classes.join(prints, "print").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    least = {k: prints.select(F.col("print").alias(k), F.col("least").alias(f"least_{k}")) for k in "ab"}
    close = simhash.links(prints.select(F.col("print").alias("fp"))).join(least["a"], "a").join(least["b"], "b")
    return alike.unionByName(close.select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))).distinct()


def _may_be_in(marked: Broadcast) -> Callable[[Column], Column]:
    """A test of a column of longs: false only for what isn't in the bit map."""

    @F.arrow_udf("boolean")
    def of(h: pa.Array) -> pa.Array:
        return pa.array(in_bit_map(h.to_numpy(zero_copy_only=False).view(np.uint64), np.frombuffer(marked.value, np.uint8)))

    return of


def _sets(pairs: DataFrame, rows: DataFrame, slim: DataFrame) -> DataFrame:
    """fp and set of the classes in pairs; each is made from the row of least key."""
    of = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    chosen = written(slim.join(of, "fp").groupBy("fp").agg(F.min("key").alias("key")))
    marked = rows.sparkSession.sparkContext.broadcast(bit_map(chosen.select(F.xxhash64("key").alias("h")), "h"))
    whole = rows.select("key", "text").where(_may_be_in(marked)(F.xxhash64("key"))).join(chosen, "key").select("key", "fp", "text").dropDuplicates(["key", "fp"])
    sets = written(whole.select("fp", hashes(F.col("text")).alias("set")))
    marked.destroy()
    return sets


def class_roots(rows: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """From rows (key, fp, text), which are read several times, where key isn't null: fp, root for each class that has near copies. slim: their keys and classes, if they are stored."""
    slim = written(rows.select("key", "fp")) if slim is None else slim
    texts = rows.select("fp", "text")
    # Most classes are one text, and need no shuffle.
    spark = rows.sparkSession
    several = slim.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fp").alias("h"))
    marked = spark.sparkContext.broadcast(bit_map(several, "h"))
    frequent = frequent_hashes(texts)
    alone, folded_ones = (texts.select(prefixes(F.col("text"), frequent, marked, x).alias("p")).where("p IS NOT NULL") for x in (False, True))
    classes = alone.select("p").unionByName(folded_ones.groupBy("p.fp").agg(F.max("p").alias("p")).select("p"))
    classes = written(classes.select("p.fp", "p.size", "p.prefix", "p.sketch", "p.small", "p.print"))
    marked.destroy()  # the driver and the executors hold one bit map at a time
    twice = classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    marked = spark.sparkContext.broadcast(bit_map(twice, "h"))
    entries = written(_marked(classes, marked).select("h", F.struct("fp", "size", "at").alias("e")))
    marked.destroy()
    shared = entries.groupBy("h").agg(F.count("*").alias("n"), F.min("e").alias("first")).where("n > 1").select("h", "first")
    entries = written(entries.join(shared, "h"))  # the hashes of two classes or more

    stars = entries.where("e.fp <> first.fp").where(_may("e", "first")).select(*_pairs("e", "first")).distinct()
    stars = written(stars.union(by_fingerprints(classes)).distinct())
    found = verified(stars, classes, rows, slim)

    # What is linked to one class is one component; only pairs of different components are left. All their common hashes are here.
    # First some pairs are verified, which joins most components that belong together, then all that are left. A step with nothing to do is left out:
    # what the driver plans and keeps for it costs the same, however few its rows.
    grouped, placed = components(found), None
    for some in (True, False):
        if placed is None:
            placed = entries.select("h", "e").join(grouped, F.col("e.fp") == grouped.node, "left").select("h", "e", F.coalesce("root", F.col("e.fp")).alias("c"))
            mixed = placed.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
            placed = written(placed.join(mixed, "h"))
        rest = written(_between(placed, classes, some).join(stars, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            continue
        stars, found = stars.union(rest), verified(rest, classes, rows, slim)
        if not found.isEmpty():
            grouped, placed = components(grouped.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)), None
    return grouped.select(F.col("node").alias("fp"), "root")


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that stay: one of each component of near copies.

    It is the row with the component's smallest id; of rows with that id, the one whose
    text has the smallest hash, and of rows alike in both, one. An id that is null is
    smallest only where all ids of the component are null.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    doc_id, said = F.col("doc").getField(id_column), text_of(F.col("doc").getField(text))
    key = F.struct(F.isnull(doc_id).alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(said).alias("t")).alias("key")
    slim = written(rows.select(key, word_class(said).alias("fp")))
    read = rows.select(key, word_class(said).alias("fp"), said.alias("text"))
    roots = class_roots(read, slim)
    first = slim.groupBy("fp").agg(F.min("key").alias("key")).join(roots, "fp", "left")
    first = first.groupBy(F.coalesce("root", "fp").alias("root"), F.isnotnull("root").alias("linked")).agg(F.min("key").alias("key"))
    # Most rows stay, each the only one with its key. Only those that go, or aren't the only one, and what may be one of them, are shuffled.
    fate = slim.groupBy("key").agg(F.count("*").alias("n")).join(first.select("key", F.lit(True).alias("stays")).distinct(), "key", "left")
    fate = written(fate.where("n > 1 OR stays IS NULL").select("key", F.coalesce("stays", F.lit(False)).alias("stays")))
    marked = _may_be_in(docs.sparkSession.sparkContext.broadcast(bit_map(fate.select(F.xxhash64("key").alias("h")), "h")))
    keyed = rows.select("doc", key).withColumn("in_doubt", marked(F.xxhash64("key")))
    doubtful = keyed.where("in_doubt").join(fate, "key", "left").where("coalesce(stays, true)")
    once = doubtful.groupBy("key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    kept = keyed.where("NOT in_doubt").select("doc").unionByName(once.select("doc"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
