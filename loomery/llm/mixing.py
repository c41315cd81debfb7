"""Mixing sources to target weights by balanced sampling (the cube method).

Sources get shares of the mix by weight; no source is taken more than `cap` times
over, and what exceeds that is dealt to the others. A document of a source that is
to be taken m times on average is taken floor(m) times, and once more with inclusion
probability m - floor(m). These probabilities are moved through the null-space of the
constraints, which hold the number of documents and of words in each source, until
nearly all are 0 or 1 (the flight). What is left is a landing problem of a few documents.

Flights run in blocks of about BLOCK documents of one source; each block leaves two
undecided documents or so, which form the blocks of the next level. No task or driver
holds more than a block, however large a source is.

Rows that agree in id, source and text are one unit with a number of rows n: n * m copies
are due to them together, of which the whole part is dealt evenly and the fraction is one
copy to be decided like any other. So a source of repeated rows meets its target as well.

Defined results: a null or empty text has size 0; a null source is a source of its own,
ordered last; of n repeated rows, some are taken once more than the others; other columns
are kept by `mix` whatever their names; an empty table gives none. Choices depend on the
data and SEED only, so reruns agree (which of some repeated rows with unlike other columns
are taken once more isn't fixed).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import repeated, text_of, words, written

BLOCK, SEED, NEAR, LANDING = 2000, 20240607, 1e-9, 12
FEW = 50_000  # sources, of about 100 bytes each
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, size, n): source, source_size, n_docs and target, one row for each source.

    The water level of a fill in which source i holds weight_i * level up to its cap is
    found from running sums, in order of how early the cap is met. The windows here are
    over one row for each source.
    """
    if share > cap:
        raise ValueError("the mix can't be larger than the cap allows")
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.isnull("source"), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.isnull("source"), "source")
    before, everyone = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / heavy)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everyone)["level"]
    target = F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, counts: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities moved until no two documents of one size, and no three, are undecided.

    Each move keeps sum(p * sizes) and sum(p * counts) as they are. To land, LANDING
    documents of all sizes are kept back from the flight; of all ways to decide them
    and what the flight has left, the one nearest to the totals is taken.
    """
    p = p.astype(float).copy()
    x, y = sizes.tolist(), counts.tolist()
    held: list[int] = []
    open_ = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
    by_size = open_[np.argsort(sizes[open_], kind="stable")]
    back = set(by_size[np.linspace(0, len(by_size) - 1, min(LANDING, len(by_size))).astype(int)].tolist()) if land else set()
    for unit in open_.tolist():
        if unit in back:
            continue
        held.append(unit)
        while len(held) >= 2:
            i, j = held[-2:]
            if x[i] == x[j] and y[i] == y[j]:
                at, step = (i, j), (1.0, -1.0)
            elif len(held) >= 3:
                i, j, k = at = tuple(held[-3:])
                step = (x[j] * y[k] - x[k] * y[j], x[k] * y[i] - x[i] * y[k], x[i] * y[j] - x[j] * y[i])
                if not any(step):  # all three in proportion
                    at, step = (i, j), (y[j] or 1.0, -(y[i] or 1.0))
            else:
                break
            most = min((1 - p[a]) / s if s > 0 else p[a] / -s for a, s in zip(at, step, strict=True) if s)
            least = min(p[a] / s if s > 0 else (1 - p[a]) / -s for a, s in zip(at, step, strict=True) if s)
            move = most if rng.random() * (most + least) < least else -least
            for a, s in zip(at, step, strict=True):
                p[a] = min(1.0, max(0.0, p[a] + move * s))
                p[a] = round(p[a]) if not NEAR < p[a] < 1 - NEAR else p[a]
            held = [a for a in held if NEAR < p[a] < 1 - NEAR]
    held += sorted(back)
    if land and held:
        ways = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
        error = np.abs((ways - p[held]) @ sizes[held]) + np.abs((ways - p[held]) @ counts[held])
        p[held] = ways[error.argmin()]
    return p


def _flown(land: bool, seed: int) -> Callable[[pa.Table], pa.Table]:
    def fly(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("order", "doc_id", "size", "t")])
        name = f"{seed}:{block['source'][0].as_py()!r}:{block['block'][0].as_py()}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name.encode()))
        p = flight(block["p"].to_numpy(), block["size"].to_numpy(), np.ones(len(block)), rng, land)
        return block.set_column(block.column_names.index("p"), "p", pa.array(p))

    return fly


def _small(per_source: DataFrame) -> DataFrame:
    """One row for each source, stored; to be broadcast if they are few, so that a hot source isn't shuffled by its name."""
    per_source = written(per_source)
    return F.broadcast(per_source) if per_source.count() <= FEW else per_source


def decided(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """From (doc_id, source, size, t, n): the same with source_size, target and copies, of all n rows together."""
    per = _small(targets(sizes, weights, share, cap).withColumnRenamed("source", "of"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sizes.join(per, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rate", rate)
    due = F.col("n") * F.col("rate")
    part = due - F.floor(due)
    part = F.when(part < NEAR, 0.0).otherwise(part)
    units = units.select(*sizes.columns, "source_size", "target", (F.floor(due) + (part > 1 - NEAR).cast("long")).alias("base"), F.when(part > 1 - NEAR, 0.0).otherwise(part).alias("p"))
    done, level, open_ = [], 0, units
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        done.append(open_.where(~undecided))
        open_ = open_.where(undecided)
        counts = _small(open_.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / block).alias("blocks")))
        land = (counts.agg(F.max("blocks")).first()[0] or 1) == 1
        open_ = open_.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("order", F.xxhash64("doc_id", "t", F.lit(seed + level)))
        open_ = open_.withColumn("block", F.pmod(F.col("order"), F.col("blocks"))).drop("of", "blocks")
        flown = open_.groupBy("source", "block").applyInArrow(_flown(land, seed + level), open_.schema)
        open_ = written(flown.drop("order", "block"))
        level += 1
        if land:
            done.append(open_)
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select(*sizes.columns, "source_size", "target", (F.col("base") + F.round("p")).cast("long").alias("copies"))


def sizes(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words, t (a hash of the text) and n, the number of such rows; stored once."""
    t = text_of(f"`{text}`")
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.size(words(t)).cast("long").alias("size"), F.xxhash64(t).alias("t"))
    return written(rows.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("n")))


def _share(place: str) -> Column:
    """The copies of one of n rows, which is at that place (from 0) among them."""
    return F.expr(f"int(copies div n + int({place} < copies % n))")


def taken(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target and copies."""
    rows = repeated(written(decided(sizes(docs, id_column=id_column, text=text, source=source), **how)), "n", "row")
    return rows.withColumn("copies", _share("row")).drop("row", "n", "t")


def mix(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it."""
    names = ["k_id", "k_no_id", "k_source", "k_no_source", "k_t"]
    key = lambda i, s, t: [c.alias(k) for k, c in zip(names, (F.coalesce(i, F.lit(0)), F.isnull(i), F.coalesce(s, F.lit("")), F.isnull(s), t), strict=True)]
    chosen = decided(sizes(docs, id_column=id_column, text=text, source=source), **how).where("copies > 0")
    chosen = written(chosen.select("n", "copies", *key(F.col("doc_id"), F.col("source"), F.col("t"))))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(doc, *key(F.col(f"`{id_column}`"), F.col(f"`{source}`"), F.xxhash64(text_of(f"`{text}`"))))
    rows = keyed.join(chosen.where("copies % n = 0"), names).select("doc", F.expr("int(copies div n)").alias("copies"))
    uneven = chosen.where("copies % n <> 0")
    if uneven.limit(1).count():
        # Repeated rows are numbered within each file that holds them, behind those of earlier files.
        found = written(keyed.join(uneven, names).withColumn("at", F.monotonically_increasing_id())).withColumn("file", F.shiftright("at", 33))
        files = found.groupBy(*names, "file").agg(F.count("*").alias("held"))
        before = F.coalesce(F.sum("held").over(Window.partitionBy(*names).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = found.withColumn("place", F.row_number().over(Window.partitionBy(*names, "file").orderBy("at")) - 1)
        numbered = numbered.join(files.select(*names, "file", before.alias("before")), [*names, "file"])
        rows = rows.unionByName(numbered.select("doc", _share("place + before").alias("copies")))
    rows = rows.where("copies > 0").select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
