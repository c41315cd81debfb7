"""Which tokens are learnt from, by role marks in the text, for tokens of any length.

A text is cut into pieces of tokens. A mark is found in a piece's bytes, and every token that
shares a byte with it is part of it. The tokens after an ASSISTANT: mark and before the next
mark are learnt from. A mark that begins in a token of the mark before it is passed over.
What a piece's first tokens are depends on the last mark of the pieces before it; that is
carried on in two levels, so that no task holds more than a run of pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.chats import ASSISTANT, USER
from loomery.session import stored

#: The marks, without the blank that follows, and whether what comes after is learnt from.
MARKS = ((ASSISTANT.strip().encode(), True), (USER.strip().encode(), False))
#: Pieces that are masked at once.
AT_ONCE = 1000


def _marks(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte and what follows of each mark that lies within one of the pieces beginning at `starts`, of which data is the whole."""
    at = [np.array([m.start() for m in re.finditer(mark, data)], np.int64) for mark, _ in MARKS]
    first = np.concatenate(at)
    last = np.concatenate([x + (len(mark) - 1) for x, (mark, _) in zip(at, MARKS, strict=True)])
    learnt = np.repeat([then for _, then in MARKS], [len(x) for x in at])
    inside = np.searchsorted(starts, first, "right") == np.searchsorted(starts, last, "right")
    return first[inside], last[inside], learnt[inside]


def mask(data: bytes, starts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pieces that lie one after the other: 0 or 1 for each token as if nothing came before its piece; and of each piece,
    how many tokens precede the first mark, what follows the last (-1: no mark), and how many tokens are 1.

    starts: where the pieces begin in data, and its end; tokens: likewise in lengths.
    """
    ends = np.cumsum(lengths, dtype=np.int64)
    if not np.array_equal(np.r_[0, ends][tokens], starts):
        raise ValueError("the lengths of the tokens don't add up to the pieces")
    first, last, learnt = _marks(data, starts[:-1])
    first, after = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right") + 1
    order = np.argsort(first, kind="stable")
    piece = np.searchsorted(tokens, first, "right") - 1  # tokens[piece] <= first: the last of those that begin there
    change = np.zeros(len(lengths) + 1, np.int8)
    head, said = np.diff(tokens), np.full(len(starts) - 1, -1, np.int8)
    at, now = 0, -1
    for k, f, a, then in zip(piece[order].tolist(), first[order].tolist(), after[order].tolist(), learnt[order].tolist(), strict=True):
        if k != now:
            if now >= 0 and said[now]:
                change[at] += 1
                change[tokens[now + 1]] -= 1
            now, at = k, f
            head[k] = f - tokens[k]
        elif f < at:
            continue
        elif said[k]:
            change[at] += 1
            change[f] -= 1
        said[k], at = then, a
    if now >= 0 and said[now]:
        change[at] += 1
        change[tokens[now + 1]] -= 1
    out = np.cumsum(change[:-1], dtype=np.int8)
    ones = np.diff(np.r_[0, np.cumsum(out, dtype=np.int64)][tokens])
    return out, head, said, ones


def masked(text: Column, lengths: Column) -> Column:
    """mask, head, last and ones (see `mask`; null: no mark) of a piece's bytes (a column of binaries) and its tokens' lengths; the lengths must add up."""

    def made(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        sizes = sizes if pa.types.is_list(sizes.type) else sizes.cast(pa.list_(pa.int32()))
        places = [np.cumsum(np.r_[0, pc.fill_null(n, 0).to_numpy(zero_copy_only=False)], dtype=np.int64) for n in (pc.binary_length(texts), pc.list_value_length(sizes))]
        data = b"".join([x.as_py() or b"" for x in texts])
        out, head, said, ones = mask(data, places[0], sizes.flatten().to_numpy(), places[1])
        masks = pa.ListArray.from_arrays(pa.array(places[1].astype(np.int32)), pa.array(out))
        last = pa.array(said == 1, pa.bool_(), mask=said < 0)
        return pa.StructArray.from_arrays([masks, pa.array(head.astype(np.int32)), last, pa.array(ones)], ["mask", "head", "last", "ones"])

    @F.arrow_udf("struct<mask: array<tinyint>, head: int, last: boolean, ones: long>")
    def of(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        parts = [made(texts.slice(k, AT_ONCE), sizes.slice(k, AT_ONCE)) for k in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else made(texts, sizes)

    return of(text, lengths)


def loss_masks(pieces: DataFrame, stream: str, piece: str, text: Column, lengths: Column, run: int = 1000) -> DataFrame:
    """pieces with mask (0 or 1 for each token), n_tokens and n_learnt. Pieces of a stream are numbered by `piece`, from any whole number.

    Before the first mark of a stream nothing is learnt from. A null text or one without tokens has an empty mask.
    """
    rows = stored(pieces.withColumn("_m", masked(text, lengths)))  # read three times
    rows = rows.withColumn("_run", F.floor(F.col(piece) / run))
    said = rows.where("_m.last IS NOT NULL").groupBy(stream, "_run").agg(F.max_by("_m.last", piece).alias("_said"))
    runs = rows.select(stream, "_run").distinct().join(said, [stream, "_run"], "left")
    earlier = Window.partitionBy(stream).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(stream).alias("_stream"), F.col("_run").alias("_r"), F.last("_said", ignorenulls=True).over(earlier).alias("_earlier"))
    within = Window.partitionBy(stream, "_run").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.last("_m.last", ignorenulls=True).over(within))
    rows = rows.join(runs, (F.col(stream) == F.col("_stream")) & (F.col("_run") == F.col("_r")))
    state = F.coalesce("_before", "_earlier", F.lit(False))
    full = F.when(state, F.transform("_m.mask", lambda x, i: F.when(i < F.col("_m.head"), F.lit(1).cast("tinyint")).otherwise(x))).otherwise(F.col("_m.mask"))
    rows = rows.withColumn("mask", full).withColumn("n_tokens", F.size("_m.mask").cast("long"))
    rows = rows.withColumn("n_learnt", F.col("_m.ones") + F.when(state, F.col("_m.head")).otherwise(0))  # none before the head is 1
    return rows.drop("_m", "_run", "_before", "_stream", "_r", "_earlier")


def cut(rows: DataFrame, ids: str, length: int) -> DataFrame:
    """Rows with `piece` and their ids in pieces of `length` tokens; a row without ids has one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.size(ids) / length)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn(ids, F.slice(ids, F.col("piece") * length + 1, length))
