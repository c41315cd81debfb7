"""Near-duplicate vectors of equal label, by randomised-rotation binary codes with stored correction factors.

A unit vector is filled up with zeros to BITS dimensions, turned by a random rotation and
coded by the signs. With the code goes a factor, the cosine between the turned vector and
its code's corner of the cube. A code's inner product with another vector, over the
factor, is an unbiased estimate of the two vectors' cosine; its error is known but for
one coordinate of a random direction in BITS - 1 dimensions, which exceeds
SIGMAS / sqrt(BITS - 1) less than once in a million times. Pairs whose interval reaches
the threshold are computed anew in double precision from the vectors; the others are
done with. Each pair has two intervals, one for either's code.

Which pairs are looked at: those that share one of several keys, each made of a few of
the codes' bits. The larger the largest label, the more bits has a key, so that chance
meetings under a key don't grow with the table, and the more keys there are, so that a
pair at the threshold itself shares none in MISS of cases only, were a code's bits
independent (0.5 % as measured, as they aren't; closer copies, far more seldom). With up to CROWD vectors to a label there is one key for all of them.
A pair that shares several keys is counted under the first.

Equal vectors are folded together first and counted by their number. A key with more than
CHUNK vectors is cut into chunks, and each pair of chunks becomes a task of its own. Of
each task only sums and a spanning forest of the links leave, so a group of copies is
never listed in pairs; counting its links still takes the comparison of each with each.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components, and rows without a label, have no links and stand for themselves; vectors of
unlike lengths have no links; a row's own repetitions are links to it; component_id is
the smallest id that isn't null of the component; kept is true where vec_id is that, or
both are null; only the three columns named are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import shuffles, written
from loomery.llm.components import components, forest

COSINE, BITS, SIGMAS, MISS, CROWD, CHUNK, SALTS, SEED = 0.93, 256, 5.0, 0.001, 512, 1024, 16, 17


def rotation(bits: int, dims: int) -> np.ndarray:
    """The first dims columns of a random rotation of as many dimensions as there are bits."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dims])


def unit(x: np.ndarray) -> np.ndarray:
    """The rows over their lengths; halved or doubled first, so that no square is too large or small."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encoded(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes, as rows of 64-bit words, and the factors of unit vectors."""
    turned = units @ turn[:, : units.shape[1]].T
    words = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    return words, np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def corners(words: np.ndarray, turn: np.ndarray, dims: int) -> np.ndarray:
    """What the codes stand for: corners of the cube, turned back."""
    signs = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
    return signs @ turn[:, :dims] / math.sqrt(len(turn))


def least_estimate(factor: np.ndarray, cosine: float, bits: int) -> np.ndarray:
    """The smallest estimate, for a code's factor, whose interval holds a cosine of that size."""
    error = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(max(0.0, 1 - cosine**2))
    return cosine - error * min(1.0, SIGMAS / math.sqrt(bits - 1)) - 1e-9


def plan(largest: int, cosine: float = COSINE, bits: int = BITS) -> np.ndarray:
    """The keys' masks, as rows of 64-bit words, for so many vectors in the largest group."""
    own = max(0, math.ceil(math.log2(max(1, largest) / CROWD)))
    alike = (1 - math.acos(cosine) / math.pi) ** own
    keys = 1 if own == 0 else math.ceil(math.log(MISS) / math.log1p(-alike))
    draw, masks = np.random.default_rng(SEED + 1), np.zeros((keys, bits), np.uint8)
    for mask in masks:
        mask[draw.choice(bits, own, replace=False)] = 1
    return np.packbits(masks, axis=1, bitorder="little").view("<u8")


def _classes(vectors: DataFrame, id_column: str, vector: str, label: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows (vec_id, print; no print: links with nothing), and the distinct vectors with their number."""
    v, kind = F.col(f"`{vector}`"), vectors.schema[vector].dataType.elementType.simpleString()
    good = F.col(f"`{label}`").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.to_json(F.struct(F.col(f"`{label}`").alias("l"), F.size(v).alias("n"))).alias("team"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, column = [], batch["v"]
            for team, at, x in zip(batch["team"].to_pylist(), batch["good"].to_pylist(), column, strict=True):
                raw = (x.values.to_numpy(zero_copy_only=False) + 0.0).tobytes() if at else None  # + 0.0: no negative zeros
                found.append((raw, hashlib.blake2b(team.encode() + b"\0" + raw, digest_size=16).digest()) if at else (None, None))
            yield pa.record_batch([batch["vec_id"], batch["team"], pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["vec_id", "team", "raw", "print"])

    id_kind = rows.schema["vec_id"].dataType.simpleString()
    rows = written(rows.mapInArrow(printed, f"vec_id {id_kind}, team string, raw binary, print binary"))
    classes = rows.where("print IS NOT NULL").groupBy("print").agg(F.first("team").alias("team"), F.first("raw").alias("raw"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "print"), classes.withColumn("cid", F.monotonically_increasing_id()), {"float": 4, "double": 8}[kind]


def _coded(classes: DataFrame, turn: np.ndarray, item: int) -> DataFrame:
    """classes with code (binary) and factor."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch["raw"].to_pylist()
            words, factors = [None] * len(raws), np.ones(len(raws))
            by_length: dict[int, list[int]] = {}
            for k, raw in enumerate(raws):
                by_length.setdefault(len(raw), []).append(k)
            for places in by_length.values():
                found, factors[places] = encoded(unit(np.frombuffer(b"".join(raws[k] for k in places), f"<f{item}").reshape(len(places), -1).astype(float)), turn)
                for k, w in zip(places, found, strict=True):
                    words[k] = w.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.binary()), pa.array(factors)], [*batch.schema.names, "code", "factor"])

    return classes.mapInArrow(code, "print binary, team string, raw binary, m long, least long, cid long, code binary, factor double")


def compared(block: dict[str, np.ndarray], raws: list[bytes], masks: np.ndarray, turn: np.ndarray, item: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one block: each row's new linked partners, a forest of the links as pairs of places, and how many pairs were computed anew."""
    x = unit(np.frombuffer(b"".join(raws), f"<f{item}").reshape(len(raws), -1).astype(float))
    words, factor, side = block["code"], block["factor"], block["side"]
    estimate = corners(words, turn, x.shape[1]) @ x.T / factor[:, None]
    near = estimate >= least_estimate(factor, cosine, len(turn))[:, None]
    near &= near.T
    if side[0] >= 0:
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    # A pair counts under the first key that it shares.
    key, other = block["key"], words[a] ^ words[b]
    fresh = ((other & masks[key]) == 0).all(axis=1)
    for earlier in masks[:key]:
        fresh &= ((other & earlier) != 0).any(axis=1)
    a, b = a[fresh], b[fresh]
    linked = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
    computed, a, b = len(a), a[linked], b[linked]
    m, n = block["m"], np.zeros(len(x), np.int64)
    np.add.at(n, a, m[b])
    np.add.at(n, b, m[a])
    kept = forest(a, b, len(x))
    return n, a[kept], b[kept], computed


def _runs(parts: Iterator[pd.DataFrame], masks: np.ndarray, turn: np.ndarray, item: int, cosine: float) -> Iterator[pd.DataFrame]:
    """Sums and links of each run of rows of one block, however the rows are cut into batches."""
    rest: list[pd.DataFrame] = []

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({"cid": [], "n": [], "other": []}).astype("int64")
        block = {"code": np.frombuffer(b"".join(rows["code"]), "<u8").reshape(len(rows), -1), "factor": rows["factor"].to_numpy(), "side": rows["side"].to_numpy(), "key": int(rows["k"].iloc[0]), "m": rows["m"].to_numpy()}
        n, a, b, _ = compared(block, list(rows["raw"]), masks, turn, item, cosine)
        ids, some = rows["cid"].to_numpy(), np.flatnonzero(n)
        return pd.DataFrame({"cid": np.r_[ids[some], ids[a]], "n": np.r_[n[some], np.zeros(len(a), np.int64)], "other": np.r_[ids[some], ids[b]]})

    for part in parts:
        ids = part[["key", "cell"]].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        for run in np.split(np.arange(len(part)), cuts):
            rows = part.iloc[run]
            if rest and tuple(rest[-1][["key", "cell"]].iloc[-1]) != tuple(rows[["key", "cell"]].iloc[0]):
                yield done(pd.concat(rest, ignore_index=True))
                rest = []
            rest.append(rows)
    if rest:
        yield done(pd.concat(rest, ignore_index=True))


def linked(coded: DataFrame, masks: np.ndarray, turn: np.ndarray, item: int, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """From rows (cid, team, raw, m, code, factor), which are read twice: cid, n, other.

    n, to be summed by cid, counts linked partners; cid and other connect what is linked.
    """
    words = masks.tolist()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), "<u8").reshape(batch.num_rows, -1)
            for k, mask in enumerate(masks):
                yield pa.record_batch([batch["cid"], batch["team"], pa.array([k] * batch.num_rows, pa.int32()), pa.array([w.tobytes() for w in code & mask], pa.binary())], ["cid", "team", "k", "bits"])

    keys = coded.select("cid", "team", "code").mapInArrow(keyed, "cid long, team string, k int, bits binary").select("cid", "k", F.xxhash64("team", "k", "bits").alias("key"))
    keys = written(keys)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("chunks", F.ceil(F.col("size") / chunk))
    # A small key is one run. A large one has a run within each chunk (side -1) and one for each pair of chunks.
    cells = F.expr(
        """CASE WHEN chunks = 1 THEN array(struct(0L AS cell, -1 AS side)) ELSE
           transform(sequence(0L, chunks - 1), o -> CASE
             WHEN o = mine THEN struct(mine * chunks + mine AS cell, -1 AS side)
             WHEN o < mine THEN struct(o * chunks + mine AS cell, 1 AS side)
             ELSE struct(mine * chunks + o AS cell, 0 AS side) END) END"""
    )
    shared = keys.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    shared = shared.select("cid", "k", "key", F.explode(cells).alias("c")).select("cid", "k", "key", "c.cell", "c.side")
    rows = shared.join(coded.select("cid", "raw", "m", "code", "factor"), "cid")
    runs = rows.repartition(shuffles(coded.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "cid")
    masks = np.array(words, np.uint64)
    return runs.mapInPandas(lambda parts: _runs(parts, masks, turn, item, cosine), "cid long, n long, other long")


def near_duplicates(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, classes, item = _classes(vectors, id_column, vector, label)
    dims = vectors.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0
    bits = max(BITS, -(-dims // 64) * 64)
    turn = rotation(bits, dims)
    coded = written(_coded(classes, turn, item))
    largest = coded.groupBy("team").count().agg(F.max("count")).first()[0] or 0
    found = written(linked(coded, plan(largest, cosine, bits), turn, item, cosine, chunk))
    sums = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    placed = coded.select("print", "cid", "m", "least").join(sums, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    placed = written(placed.select("print", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "cid").alias("root")))
    # A component may hold a third of all vectors. Its smallest id is found by partial minima and joined under SALTS keys.
    lowest = placed.groupBy("root").agg(F.min("least").alias("lowest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")).join(lowest.hint("merge"), ["root", "salt"]).select("print", "n", "lowest")
    out = rows.join(placed, "print", "left")
    own = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
