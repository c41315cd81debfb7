"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the largest length are cut into pieces. Pieces are placed in
order of falling length, each into the open bin that it fills best. Where none has
room, a new bin is opened with the capacity of the least expected cost for each word
that it can hold, given what is still to come. At the end each bin is given the
smallest permitted length that holds its contents.

Pieces are dealt by hash to blocks of about BLOCK pieces, which are packed apart, so
that memory is bounded and the bins of all blocks together waste hardly more than one
global packing: a block leaves a few bins that could be fuller.

Defined results: a null or empty text has one piece of 0 words without a bin; repeated
rows are packed each, and dealt to blocks like any others; only the id and the text are read; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import repeated, text_of, words, written

CAPACITIES, BLOCK = (512, 1024, 2048, 4096), 20_000
#: A sequence of c words costs c + c * c / ATTENTION.
ATTENTION = 16_384


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order, all between 1 and the largest capacity: bin and place of each, and each bin's capacity."""
    lengths = list(lengths)
    falling = [-x for x in lengths]
    before = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    total = before[-1]
    cost = [(c, c + c * c / attention) for c in sorted(capacities)]
    room = 0  # bit r is set if a bin with r words of room is open
    open_: dict[int, list[int]] = {}
    used: list[int] = []
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths):
        fits = room >> x
        if fits:
            r = (fits & -fits).bit_length() - 1 + x
            b = open_[r].pop()
            if not open_[r]:
                room &= ~(1 << r)
        else:

            def price(c: int, of: float, x: int = x, i: int = i) -> float:
                later = total - before[max(i + 1, bisect_left(falling, x - c))]  # words of later pieces that fit beside x
                return of / (x + min(c - x, later))

            r = min((price(c, of), c) for c, of in cost if c >= x)[1]
            b = len(used)
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += x
        if r > x:
            open_.setdefault(r - x, []).append(b)
            room |= 1 << (r - x)
    sizes = np.array(sorted(capacities))
    return bins, places, sizes[np.searchsorted(sizes, np.array(used, np.int64))]


def pieces(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", longest: int = max(CAPACITIES)) -> DataFrame:
    """doc_id, start and n_words of each piece; start counts the document's words from 0."""
    n = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.size(words(text_of(f"`{text}`"))).alias("n"))
    n = n.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(longest))))
    return n.select("doc_id", "start", F.least(F.lit(longest), F.col("n") - F.col("start")).alias("n_words"))


def pack(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_words of each piece, its bin_id, the bin's capacity and the piece's place in it."""
    # Pieces alike in id, start and length are counted, and numbered, so that they don't all land in one block.
    cut = pieces(docs, id_column=id_column, text=text, longest=max(capacities)).groupBy("doc_id", "start", "n_words").agg(F.count("*").alias("n"))
    cut = repeated(written(cut), "n", "copy").drop("n")
    full = written(cut.where("n_words > 0"))
    blocks = -(-full.count() // block) or 1
    dealt = full.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "n_words", "copy"), F.lit(blocks))).drop("copy")
    schema = "doc_id long, start int, n_words int, bin_id long, capacity int, place int"

    def packed(part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, places, sizes = best_fit(part["n_words"].to_pylist(), capacities, attention)
        bin_id = (part["block"][0].as_py() << 32) + bins
        made = {"bin_id": bin_id, "capacity": sizes[bins].astype(np.int32), "place": places.astype(np.int32)}
        return pa.table({c: part[c] for c in ("doc_id", "start", "n_words")} | {k: pa.array(v) for k, v in made.items()})

    none = cut.where("n_words = 0").select("doc_id", "start", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("place"))
    return dealt.groupBy("block").applyInArrow(packed, schema).unionByName(none)


def bins(packed: DataFrame) -> DataFrame:
    """One row for each bin: bin_id, capacity, n_words and its pieces in order."""
    piece = F.struct("place", "doc_id", "start", "n_words")
    rows = packed.where("bin_id IS NOT NULL").groupBy("bin_id", "capacity")
    return rows.agg(F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list(piece)).alias("pieces"))
