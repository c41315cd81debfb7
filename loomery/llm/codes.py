"""Vector code compression: each vector as four bytes, the entries of four codebooks that are nearest to its parts.

A component x becomes the integer floor(1024 * x); a vector is cut into PARTS equal
consecutive parts, each with a codebook of up to ENTRIES entries, fitted by rounds of
assignment and averaging in whole numbers.

The nearest entry is found by slicing and intersecting. For each position of a part the
entries' coordinates are sorted, and the set of entries among the first j is kept as a
mask of 64-bit words. The entries within a radius of a part in one position are then two
searches and one exclusive-or; the AND over all positions leaves a set that holds every
entry within that radius. A first radius is tried; a part without an entry in its radius
has it doubled, and one whose best entry lies outside its radius is searched once more
at that entry's distance, after which no nearer one can be missing. Only the entries in
the sets are measured.

Tasks send one sum for each entry that they used; the driver holds the codebooks alone.

Defined results: rows whose vector is null or holds null or non-finite components are
left out; an empty vector is a vector of zeros; shorter vectors are filled up with zeros
to the longest one's length, and that to a multiple of PARTS; integers beyond 2 ** 27 are
held to it; with fewer rows than ENTRIES the codebooks have as many entries as rows; null
ids come after all others and repeated ids are told apart by their vectors, so equal
tables have equal codebooks; rows that occur repeatedly are coded each; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import written

PARTS, ENTRIES, ROUNDS, UNIT, MOST = 4, 256, 4, 1024, 1 << 27
#: Rows compared at a time, rows that the first radius is taken from, and keys of a label in the join of its total.
RUN, PILOT, SALTS = 1024, 32, 16


class Book:
    """The entries of one part's codebook, with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        self.words = -(-n // 64)
        self.prefix = np.zeros((width, n + 1, self.words), np.uint64)
        for d in range(width):
            own = np.zeros((n, self.words), np.uint64)
            own[np.arange(n), order[:, d] // 64] = np.uint64(1) << (order[:, d] % 64).astype(np.uint64)
            self.prefix[d, 1:] = np.bitwise_or.accumulate(own, axis=0)

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row of x, which entries are within its radius in every position."""
        masks = np.full((len(x), self.words), ~np.uint64(0))
        for d, (values, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            low = np.searchsorted(values, x[:, d] - radius, "left")
            high = np.searchsorted(values, x[:, d] + radius, "right")
            masks &= prefix[high] ^ prefix[low]
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        return bits[:, : len(self.entries)].astype(bool)

    def measured(self, x: np.ndarray, chosen: np.ndarray, index: np.ndarray, apart: np.ndarray) -> None:
        """Holds the chosen entries against what is nearest to each row so far (index and apart, which are kept up to date; index is beyond all at first)."""
        for k in np.flatnonzero(chosen.any(axis=0)):
            rows = np.flatnonzero(chosen[:, k])
            gap = x[rows] - self.entries[k]
            gap = np.einsum("ij,ij->i", gap, gap)
            nearer = (gap < apart[rows]) | ((gap == apart[rows]) & (k < index[rows]))
            index[rows[nearer]], apart[rows[nearer]] = k, gap[nearer]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry, the first of equals, and the squared distance, for each row of x."""
        index, apart = np.full(len(x), len(self.entries)), np.full(len(x), np.iinfo(np.int64).max)
        for at in range(0, len(x), RUN):
            own = slice(at, at + RUN)
            self._run(x[own], index[own], apart[own])
        return index, apart

    def _run(self, x: np.ndarray, index: np.ndarray, apart: np.ndarray) -> None:
        pilot = np.arange(0, len(x), max(1, len(x) // PILOT))
        first, gap = index[pilot], apart[pilot]
        self.measured(x[pilot], np.ones((len(pilot), len(self.entries)), bool), first, gap)
        radius = np.full(len(x), int(np.ceil(np.sqrt(np.median(gap)))) or 1)
        open_, seen = np.arange(len(x)), np.zeros((len(x), len(self.entries)), bool)
        while len(open_):
            within = self.within(x[open_], radius[open_])
            own, least = index[open_], apart[open_]
            self.measured(x[open_], within & ~seen, own, least)
            index[open_], apart[open_] = own, least
            none = own == len(self.entries)
            far = ~none & (least > radius[open_] ** 2)
            radius[open_[none]] *= 2
            radius[open_[far]] = np.ceil(np.sqrt(least[far].astype(float))).astype(np.int64) + 1
            left = none | far
            open_, seen = open_[left], within[left]


def whole(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and x (array of whole numbers) of the rows that are kept."""
    column = F.col(f"`{vector}`")
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(c.cast("double") * UNIT, F.lit(MOST - 1.0)), F.lit(-float(MOST)))).cast("int")
    rows = vectors.where(column.isNotNull() & finite)
    return rows.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.transform(column, held).alias("x"))


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as an array of (row, part, position), filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), PARTS * width), np.int64)
    out[np.arange(PARTS * width)[None, :] < sizes[:, None]] = flat
    return out.reshape(len(column), PARTS, width)


def fit(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks, an array of (part, entry, position), from rows of `whole`, which are read once a round."""
    width = -(-(kept.agg(F.max(F.size("x"))).first()[0] or 0) // PARTS)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").toArrow()
    books = np.ascontiguousarray(_parts(first["x"], width).transpose(1, 0, 2))
    if not books.size:
        return books

    def summed(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in books]
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = _parts(batch["x"], width)
            for p, book in enumerate(found):
                index, _ = book.nearest(x[:, p])
                n[p] += np.bincount(index, minlength=books.shape[1])
                np.add.at(sums[p], index, x[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": n[part, entry], "s": list(sums[part, entry])}, schema=pa.schema([("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    for _ in range(rounds):
        part_sums = kept.select("x").mapInArrow(lambda b, books=books: summed(b, books), "part long, entry long, n long, s array<long>")
        totals = part_sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s")).collect()
        books = books.copy()
        for t in totals:  # at most PARTS * entries
            books[t.part, t.entry] = np.array(t.s, np.int64) // t.n
    return books


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error, the squared distances summed over parts."""
    kind = kept.select("vec_id", "label").schema.simpleString().removeprefix("struct<").removesuffix(">")
    width = books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in books] if books.size else []
        for batch in batches:
            x = _parts(batch["x"], width)
            index, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(found):
                index[:, p], apart = book.nearest(x[:, p])
                error += apart
            yield pa.record_batch([batch["vec_id"], batch["label"], pa.array([r.tobytes().hex() for r in index], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(code, f"{kind}, code string, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """Rows of `coded`, which are read twice, with label_error: the error summed over equal labels, nulls together."""
    total = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    total = total.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    rows = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(total.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("_s"))).drop("of", "salt", "_s")


def digest(books: np.ndarray) -> str:
    """The SHA-256 of the codebooks' numbers, in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, **columns: str) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of the vectors kept, and the codebooks."""
    kept = written(whole(vectors, **columns))
    books = fit(kept)
    return with_label_error(written(coded(kept, books))), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with `vector`, what their code stands for."""
    of_part = lambda p: F.element_at(F.array(*[F.array(*map(F.lit, (e / UNIT).tolist())) for e in books[p]]), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1)
    return codes.withColumn("vector", F.concat(*[of_part(p) for p in range(PARTS)]))
