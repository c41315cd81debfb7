"""SimHash near-duplicates, found by pigeonhole blocks.

A fingerprint of 64 bits is cut into pieces. Two fingerprints that differ in at most
DISTANCE bits agree in all but DISTANCE pieces at least, so each pair that is close
shares one of the keys made of that many pieces. Candidates are joined on these keys
and verified by their Hamming distance; none is missed. There are six pieces (15 keys of
21 bits) for up to eight million fingerprints, and up to ten (210 keys of 38 bits) for
more, so that chance meetings under a key don't grow with the corpus.

Exact copies have one fingerprint and are folded together before the join. Within a
key, fingerprints are compared where they are and only a spanning forest of the
links leaves the task. A key with more than CHUNK fingerprints is cut into chunks,
and each pair of chunks becomes a task of its own.

Defined results: a null or empty text has the fingerprint zero and is linked like any
other; repeated rows get one result row each; a null doc_id is no component's smallest
unless all ids of the component are null; only the id and the text are read from the
input; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import shuffles, text_of, written
from loomery.llm.components import components

BITS, DISTANCE, SHINGLE, SEED, CHUNK, SALTS = 64, 4, 4, 42, 1500, 16
#: Numbers of pieces to choose from; more pieces give more keys of more bits. A key should be shared by CROWD prints at most, by chance.
BLOCKS, CROWD = (6, 7, 8, 10), 4


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned hashes: the bits set in over half of them; zero for none."""
    votes = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number.

    bytes.lower() and bytes.split() touch exactly A-Z and the six ASCII blanks.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        digest = xxhash.xxh64_intdigest
        spans = zip((ends - lengths).tolist(), ends[shingle - 1 :].tolist(), strict=False)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - shingle + 1)
    return voted(hashes)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as Spark's signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((simhash(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64))

    return of(text)


def pieces_for(n: int, distance: int = DISTANCE) -> int:
    """Into how many pieces n fingerprints are cut: as few as keep their keys apart. The links found are the same."""
    return next((b for b in BLOCKS if b > distance and n <= CROWD << (BITS * (b - distance) // b)), max(*BLOCKS, distance + 1))


def key_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The bits of each key: every choice of blocks - distance of the pieces."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    pieces = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(pieces, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def forest(values: np.ndarray, distance: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect all values at most distance bits apart, as places in values.

    With group (0 and 1): only between values of different groups.
    """
    n = len(values)
    label = np.arange(n)
    left, right = [], []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance) + i + 1
        if group is not None:
            near = near[group[near] != group[i]]
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            fresh = others != label[i]
            if fresh.any():
                left += [i] * int(fresh.sum())
                right += near[first[fresh]].tolist()
                label[np.isin(label, others[fresh])] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _linked(rows: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Links within each run of rows with one key and pair of chunks."""
    rest = None
    ended = False
    rows = iter(rows)
    while not ended:
        part = next(rows, None)
        ended = part is None
        if ended:
            part = rest
        elif rest is not None:
            part = pd.concat([rest, part], ignore_index=True)
        if part is None or not len(part):
            continue
        ids = part[["key", "cell"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(part)]
        if not ended:
            rest = part.iloc[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        values, side = part["fp"].to_numpy().view(np.uint64), part["side"].to_numpy()
        size = ends - starts
        two = starts[size == 2]  # most runs are pairs: all of them at once
        near = two[(np.bitwise_count(values[two] ^ values[two + 1]) <= distance) & ((side[two] < 0) | (side[two] != side[two + 1]))]
        a, b = [values[near]], [values[near + 1]]
        for i, j in zip(starts[size > 2], ends[size > 2], strict=True):
            run = values[i:j]
            x, y = forest(run, distance, None if side[i] < 0 else side[i:j])
            a.append(run[x])
            b.append(run[y])
        yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def links(prints: DataFrame, *, distance: int = DISTANCE, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """From distinct fingerprints (fp long): a, b, links that connect what is at most distance bits apart."""
    blocks = blocks or pieces_for(prints.count(), distance)
    masks = F.array(*[F.lit(_signed(m)) for m in key_masks(blocks, distance)])
    keyed = prints.select("fp", F.posexplode(masks).alias("k", "m")).select("fp", F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / chunk))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    # A small key is one run. A large one has a run within each chunk (side -1) and one for each pair of chunks.
    cells = F.expr(
        """CASE WHEN chunks = 1 THEN array(struct(0L AS cell, -1 AS side)) ELSE
           transform(sequence(0L, chunks - 1), o -> CASE
             WHEN o = mine THEN struct(mine * chunks + mine AS cell, -1 AS side)
             WHEN o < mine THEN struct(o * chunks + mine AS cell, 1 AS side)
             ELSE struct(mine * chunks + o AS cell, 0 AS side) END) END"""
    )
    cells = shared.withColumn("mine", mine).select("fp", "key", F.explode(cells).alias("c")).select("key", "c.cell", "c.side", "fp")
    runs = cells.repartition(shuffles(prints.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "fp")
    return runs.mapInPandas(lambda rows: _linked(rows, distance), "a long, b long").distinct()


def class_components(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """From rows (doc_id, fp), which are read twice: fp, root and component_id for each distinct fingerprint.

    Components are told apart by root; where an id is repeated, or all are null, several have one component_id.
    """
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), distance=distance))
    linked = F.isnotnull("root").alias("linked")
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", linked, F.coalesce("root", "fp").alias("root"))
    # A component may hold a third of all classes. Its smallest id is found by partial minima and joined under SALTS keys.
    lowest = placed.where("linked").groupBy("root").agg(F.min("least").alias("lowest"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return placed.join(lowest, ["root", "salt"], "left").select("fp", "root", F.coalesce("lowest", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id in the row's component."""
    marked = written(docs.select(F.col(f"`{id_column}`").alias("doc_id"), fingerprint(text_of(f"`{text}`")).alias("fp")))
    return marked.join(class_components(marked, distance), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, with their columns, that stay: one of each component.

    It is the row with the component's smallest id; of rows with that id, the one whose
    text has the smallest hash, and of rows alike in both, one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    doc_id = F.col("doc").getField(id_column)
    # The key of a row has no nulls, so that the join and the grouping share one shuffle of the texts.
    key = [F.isnull(doc_id).alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text_of(F.col("doc").getField(text))).alias("t")]
    slim = written(rows.select(*key, doc_id.alias("doc_id"), fingerprint(text_of(F.col("doc").getField(text))).alias("fp")))
    first = slim.join(class_components(slim.select("doc_id", "fp"), distance), "fp")
    first = first.groupBy("root").agg(F.min(F.struct("no_id", "id", "t")).alias("k"))
    kept = rows.select("doc", *key).join(first.select("k.*").distinct(), ["no_id", "id", "t"], "left_semi")
    once = kept.groupBy("no_id", "id", "t").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return once.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
