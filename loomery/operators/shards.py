"""Token shards and packed windows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.mix import n_tokens
from loomery.operators.order import even_bucket, id_bucket, running_total
from loomery.session import stored


def next_fit(lengths: Iterable[int], size: int) -> np.ndarray:
    """The shard of each document: a document that doesn't fit closes the shard; one longer than a shard has its own."""
    shards, shard, fill = [], 0, 0
    for n in lengths:
        if fill and fill + n > size:
            shard, fill = shard + 1, 0
        shards.append(shard)
        fill += n
        if fill > size:  # only a document longer than a shard
            shard, fill = shard + 1, 0
    return np.array(shards, np.int64)


def cut_shards(docs: DataFrame, size: int, lane: int = 1000) -> DataFrame:
    """doc_id, n, lane and shard: next-fit over runs of `lane` consecutive ids, each with shards of its own.

    Cutting is sequential, so it runs over metadata only and lane by lane; a run of ids bounds a task.
    """
    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending")])
        return rows.append_column("shard", pa.array(next_fit(rows["n"].to_pylist(), size)))

    rows = docs.select("doc_id", n_tokens().alias("n"), id_bucket("doc_id", lane).alias("lane"))
    return rows.groupBy("lane").applyInArrow(cut, "doc_id long, n long, lane long, shard long")


def offsets(docs: DataFrame) -> DataFrame:
    """doc_id, n and start: the place of the document's first token in all, documents by id."""
    return running_total(docs.select("doc_id", n_tokens().alias("n")), "n", ["doc_id"], even_bucket(docs, "doc_id"), name="start")


def _ways(rows: pa.Table, size: int) -> pa.Table:
    """For a block of documents in order: for each that may be the first to open a shard in it, how many are opened from there, and the last one's start.

    A last shard that is closed with the block counts as begun at the block's end.
    """
    start, n = rows["start"].to_numpy(), rows["n"].to_numpy()
    end, m = start + n, len(start)
    after = np.maximum(np.searchsorted(end, start + size, "right"), np.arange(1, m + 1))
    opened, last = np.ones(m, np.int64), np.where(n > size, end, start)
    for k in range(m - 1, -1, -1):
        if after[k] < m:
            opened[k] += opened[after[k]]
            last[k] = last[after[k]]
    first = int(np.searchsorted(start, start[0] + size, "right"))
    block = rows["block"][0].as_py()
    return pa.table({"block": pa.array([block] * first, pa.int64()), "start": start[:first], "opened": opened[:first], "last": last[:first], "end": pa.array([int(end[-1])] * first, pa.int64())})


def _walk(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From the ways of all blocks in order: block, the start of the shard that is open when it begins, and the number of shards so far."""
    open_, shards, block, ways = 0, 0, None, []

    def leave() -> None:
        nonlocal open_, shards
        starts = [w[1] for w in ways]
        if open_ >= starts[0]:
            way = ways[0]
        elif ways[0][4] <= open_ + size:
            return  # the open shard takes the whole block
        else:
            way = ways[bisect_right(starts, open_ + size) - 1]
        shards, open_ = shards + way[2], way[3]

    for batch in batches:
        begun = []
        for row in zip(*(batch[c].to_pylist() for c in ("block", "start", "opened", "last", "end")), strict=True):
            if row[0] != block:
                if ways:
                    leave()
                block, ways = row[0], []
                begun.append((block, open_, shards))
            ways.append(row)
        yield pa.record_batch([pa.array([b[k] for b in begun], pa.int64()) for k in range(3)], ["block", "open", "shards"])


def _numbered_shards(rows: pa.Table, size: int) -> pa.Table:
    """The shard of each document of a block, given what is open when it begins."""
    start, n = rows["start"].to_numpy(), rows["n"].to_numpy()
    end, m = start + n, len(start)
    open_, shards = rows["open"][0].as_py(), rows["shards"][0].as_py()
    k = 0 if open_ >= start[0] else int(np.searchsorted(end, open_ + size, "right"))
    found = np.full(m, shards - 1, np.int64)
    while k < m:
        to = max(k + 1, int(np.searchsorted(end, start[k] + size, "right")))
        found[k:to] = shards
        shards, k = shards + 1, to
    return pa.table({"doc_id": rows["doc_id"], "n": rows["n"], "start": rows["start"], "shard": found})


def cut_stream(docs: DataFrame, size: int, max_tokens: int | None = None, shards_a_block: int = 4096) -> DataFrame:
    """doc_id, n, start and shard: next-fit over all documents in order of id, as one stream.

    A document that doesn't fit closes the shard, one longer than a shard has its own. With
    max_tokens, the last document is the first not longer than a shard that brings the total there.
    Where a shard is opened depends on all before it, but within a block only on which document
    is the first to open one. So blocks list what follows from each such document, one task
    passes along these lists, a few rows for thousands of documents, and the blocks number their shards.
    """
    rows = offsets(docs)
    if max_tokens is not None:
        end = F.col("start") + F.col("n")
        stop = rows.where((F.col("n") <= size) & (end >= max_tokens)).agg(F.min("start").alias("stop"))
        rows = rows.crossJoin(F.broadcast(stop)).where(F.col("start") <= F.coalesce("stop", F.col("start"))).drop("stop")  # one row
    rows = stored(rows.withColumn("block", F.floor(F.col("start") / (size * shards_a_block))))
    in_order = lambda t: t.sort_by([("start", "ascending")])
    ways = rows.groupBy("block").applyInArrow(lambda t: _ways(in_order(t), size), "block long, start long, opened long, last long, end long")
    begun = ways.repartition(1).sortWithinPartitions("block", "start").mapInArrow(lambda b: _walk(b, size), "block long, open long, shards long")
    return rows.join(stored(begun), "block").groupBy("block").applyInArrow(lambda t: _numbered_shards(in_order(t), size), "doc_id long, n long, start long, shard long")


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """The part of each document in each window of `length` tokens: window_id, doc_id, place, first, n_tokens.

    place is the one in the window, first the place in the document; the token that ends a text is its last.
    """
    rows = offsets(docs)
    last = F.floor((F.col("start") + F.col("n") - 1) / length)
    rows = rows.withColumn("window_id", F.explode(F.sequence(F.floor(F.col("start") / length), last)))
    left = F.greatest(F.col("window_id") * length, "start")
    right = F.least((F.col("window_id") + 1) * length, F.col("start") + F.col("n"))
    return rows.select("window_id", "doc_id", (left - F.col("window_id") * length).alias("place"), (left - F.col("start")).alias("first"), (right - left).alias("n_tokens"))


def packed_windows(docs: DataFrame, length: int) -> DataFrame:
    """One row for each window: its documents, its tokens in hexadecimal, and the first token of the next (the first window's after the last).

    A window holds `length` tokens at most, so no group is larger.
    """
    # The token that ends a text is 00, which no text holds.
    text = docs.select("doc_id", F.concat(F.encode("text", "UTF-8"), F.lit(b"\0")).alias("tokens"))
    parts = pieces(docs, length).join(text, "doc_id")
    parts = parts.withColumn("part", F.expr("hex(substr(tokens, int(first + 1), int(n_tokens)))")).drop("tokens")
    windows = parts.groupBy("window_id").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x.part), "").alias("x"),
    )
    last = windows.agg(F.max("window_id").alias("last"))
    ahead = windows.crossJoin(F.broadcast(last)).select(F.when(F.col("window_id") == 0, F.col("last")).otherwise(F.col("window_id") - 1).alias("window_id"), F.substring("x", 1, 2).alias("next_token"))
    return windows.join(ahead, "window_id")


def segments(docs: DataFrame, length: int) -> DataFrame:
    """The pieces with segment: how many documents of the window came before."""
    turn = Window.partitionBy("window_id").orderBy("place")
    return pieces(docs, length).withColumn("segment", F.row_number().over(turn) - 1)


def window_starts(spans: DataFrame, length: int) -> DataFrame:
    """For shards (shard_id, start, n): each window that begins in one, and where in it.

    Each shard lists its own windows, so this as-of lookup needs no join.
    """
    first, last = F.ceil(F.col("start") / length), F.ceil((F.col("start") + F.col("n")) / length) - 1
    rows = spans.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    return rows.select("window_id", "shard_id", (F.col("window_id") * length - F.col("start")).alias("offset"))


def state_before(markers: DataFrame, length: int, back: int) -> DataFrame:
    """From markers (at, state) of a token stream: window_id and state, of the last marker within `back` tokens before each window begins.

    Each marker lists the few windows that it can reach. Windows that none reaches have no row.
    """
    first, last = F.floor(F.col("at") / length) + 1, F.floor((F.col("at") + back) / length)
    rows = markers.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    return rows.groupBy("window_id").agg(F.max_by("state", "at").alias("state"))


def evaluation_slice(windows: DataFrame, n: int) -> DataFrame:
    """The first n windows, the same at every evaluation."""
    return windows.where(F.col("window_id") < n)


def rank_of(window: Column, shares: Sequence[int]) -> Column:
    """The rank that reads a window: each block of sum(shares) windows is dealt in runs of a rank's share."""
    owners = [rank for rank, share in enumerate(shares) for _ in range(share)]
    return F.element_at(F.array(*map(F.lit, owners)), (F.pmod(window, F.lit(len(owners))) + 1).cast("int"))


def hold_out(shards: DataFrame, n: int, name: str = "shard_id") -> DataFrame:
    """shards with split: val for the last n by name, else train."""
    last = shards.select(name).distinct().orderBy(F.desc(name)).limit(n).withColumn("val", F.lit(True))
    return shards.join(last, name, "left").withColumn("split", F.when(F.col("val"), "val").otherwise("train")).drop("val")
