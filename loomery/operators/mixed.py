"""The mix by largest deficit: each document comes from the source furthest behind its share of the tokens served so far.

What a pick is depends on all picks before it, so the stream can't be cut as it stands. But
two walks over the same documents that start from slightly different states soon meet: once
each source has served the same documents in both, all that follows is the same. And no
source is ever further from its share than some documents, so its place at any point of the
stream is known to within a bounded slack. So the stream is cut into blocks of tokens. Each
block is walked by a task of its own, from a guessed state some way ahead of it, over those
documents alone that it can reach. Then each block's first state is compared with the last
state of the block before it. Blocks that began wrongly are walked again from that state,
until none did. The result is exactly the sequential one; a task holds a block's metadata.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.mix import n_tokens
from loomery.operators.order import even_bucket, running_total
from loomery.session import stored

BLOCK = 1 << 26


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The weights as whole numbers in the same proportions, as their decimals are written."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    scale = lcm(*[w.denominator for w in exact.values()])
    return {k: int(w * scale) for k, w in exact.items()}


class Fluid:
    """The mix of sources that could be cut anywhere: when each has served how much."""

    def __init__(self, weights: list[int], totals: list[int]) -> None:
        n, done, at = len(weights), [0.0] * len(weights), 0.0
        alive = [k for k in range(n) if totals[k] > 0]
        self.at, self.served, rates = [0.0], [list(done)], [0.0] * n
        while alive:
            all_ = sum(weights[k] for k in alive)
            step = min((totals[k] - done[k]) * all_ / weights[k] for k in alive)
            at += step
            for k in alive:
                rates[k] = weights[k] / all_
                done[k] += step * rates[k]
            dry = [k for k in alive if totals[k] - done[k] <= 1e-6 * totals[k]]
            for k in dry:
                done[k] = float(totals[k])
            alive = [k for k in alive if k not in dry]
            self.at.append(at)
            self.served.append(list(done))
        self.rates = rates  # at which each source serves its last documents

    def state(self, at: float) -> list[float]:
        return [float(np.interp(at, self.at, [s[k] for s in self.served])) for k in range(len(self.rates))]

    def when(self, k: int, served: np.ndarray) -> np.ndarray:
        """The point of the stream where a source has served so much; carried on beyond its end, and before its start."""
        own = np.array([s[k] for s in self.served])
        rising = np.r_[True, np.diff(own) > 0]
        own, at = own[rising], np.array(self.at)[rising]
        found = np.interp(served, own, at)
        past = served > own[-1]
        return np.where(past, at[-1] + (served - own[-1]) / max(self.rates[k], 1e-12), found)


def walk(documents: list[tuple[np.ndarray, np.ndarray]], weights: list[int], totals: list[int], served: list[int], alive: list[bool], until: int) -> Iterator[tuple[int, int, int] | None]:
    """Picks (source, place in its documents, tokens served by all before), until so many are served; None if a document isn't among those given.

    documents: of each source, in order, what it has served before each and the tokens of each. served and alive are kept up to date.
    """
    place = [int(np.searchsorted(before, s)) for (before, _), s in zip(documents, served, strict=True)]
    before, n = [d[0].tolist() for d in documents], [d[1].tolist() for d in documents]
    all_ = sum(served)
    while all_ < until and any(alive):
        live = [k for k, a in enumerate(alive) if a]
        tokens, share = sum(served[k] for k in live), sum(weights[k] for k in live)
        best = max(live, key=lambda k: weights[k] * tokens - share * served[k])  # the first of equals
        at = place[best]
        if served[best] >= totals[best]:
            alive[best] = False
        elif at >= len(n[best]) or before[best][at] != served[best]:
            yield None
            return
        else:
            yield best, at, all_
            served[best] += n[best][at]
            all_ += n[best][at]
            place[best] += 1


FOUND = "block long, i long, part int, doc_id long, pass int, n long, at long, first array<long>, last array<long>, missing boolean"


def _walked(rows: pa.Table, starts: pa.Table, weights: list[int], totals: list[int], size: int) -> pa.Table:
    """The picks of one block, and a last row with its states; starts has the state to begin with, known or guessed."""
    names = FOUND.replace(",", "").split()[::2]
    schema = pa.schema([(c, t) for c, t in zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()], strict=True)])
    if not starts.num_rows:
        return schema.empty_table()
    block, begin, known = starts["block"][0].as_py(), starts["state"][0].as_py(), starts["known"][0].as_py()
    rows = rows.sort_by([("part", "ascending"), ("before", "ascending")])
    part = rows["part"].to_numpy()
    cuts = np.searchsorted(part, np.arange(len(weights) + 1))
    before, n = rows["before"].to_numpy(), rows["n"].to_numpy()
    documents = [(before[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    served, alive = begin[: len(weights)], [bool(x) for x in begin[len(weights) :]]
    if not known:  # the next document that begins there or later
        for k, (own, _) in enumerate(documents):
            at = int(np.searchsorted(own, served[k]))
            served[k] = int(own[at]) if at < len(own) else min(served[k], totals[k])
    missing, first, taken = False, None, []
    if known:
        first = [*served, *map(int, alive)]
    state = lambda: [*served, *map(int, alive)]
    for until in ((block * size,) if not known else ()) + ((block + 1) * size,):
        for pick in walk(documents, weights, totals, served, alive, until):
            if pick is None:
                missing = True
                break
            if first is not None:
                taken.append((cuts[pick[0]] + pick[1], pick[2]))
        if missing:
            break
        first = first or state()
    where, at = np.array([t[0] for t in taken], np.int64), [t[1] for t in taken]
    picked = rows.take(pa.array(where))
    m = len(taken)
    return pa.table(
        [
            pa.array([block] * (m + 1), pa.int64()), pa.array([*range(m), -1], pa.int64()),
            *[pa.array([*picked[c].to_pylist(), None], schema.field(c).type) for c in ("part", "doc_id", "pass", "n")],
            pa.array([*at, None], pa.int64()), pa.array([None] * m + [first or state()], pa.list_(pa.int64())), pa.array([None] * m + [state()], pa.list_(pa.int64())),
            pa.array([None] * m + [missing], pa.bool_()),
        ],
        schema=schema,
    )


def mixed_stream(docs: DataFrame, weights: Mapping[str, float], key: str = "lang", *, epochs: Mapping[str, int] | None = None, max_tokens: int | None = None, block: int = BLOCK, max_rounds: int = 1000) -> DataFrame:
    """position, key, doc_id, pass, n and at (tokens served before) of each pick, sources' documents in order of id.

    Each document comes from the source, of those that aren't dry, whose share of their tokens so far exceeds what it
    has served by most; of equals, from the first by name. A source with epochs is gone through so many times. One that
    is picked when it has nothing left drops out, and the others' shares grow. With max_tokens, the last pick is
    the one that brings the total there. Rows of other sources, or without id, are left out; texts count as bytes and one.
    """
    names = sorted(weights)
    scaled = whole_weights(weights)
    shares, passes = [scaled[k] for k in names], [max(1, (epochs or {}).get(k, 1)) for k in names]
    part = F.array_position(F.array(*map(F.lit, names)), F.col(key)).cast("int") - 1
    docs = docs.where(F.col(key).isin(*names) & F.col("doc_id").isNotNull()).select(part.alias("part"), "doc_id", n_tokens().alias("n")).where("n IS NOT NULL")
    docs = stored(running_total(docs, "n", ["doc_id"], even_bucket(docs, "doc_id"), ["part"], "before"))
    once, longest = [0] * len(names), 1
    for r in docs.groupBy("part").agg(F.sum("n").alias("n"), F.max("n").alias("longest")).collect():  # as many rows as weights
        once[r.part], longest = r.n, max(longest, r.longest)
    totals = [n * p for n, p in zip(once, passes, strict=True)]
    fluid, k = Fluid(shares, totals), len(names)
    slack = 2 * k * longest
    size = max(block, 2 * slack)
    blocks = -(-min(sum(totals), max_tokens if max_tokens is not None else sum(totals)) // size)
    spark = docs.sparkSession
    # A pass begins where the last one ended.
    turns = F.element_at(F.array(*map(F.lit, passes)), F.col("part") + 1)
    ahead = F.element_at(F.array(*[F.lit(n).cast("long") for n in once]), F.col("part") + 1)
    docs = docs.withColumn("pass", F.explode(F.sequence(F.lit(0), turns - 1))).withColumn("before", F.col("before") + F.col("pass") * ahead)

    def reached(batches: Iterator[pa.RecordBatch], slack: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, before, n = (batch[c].to_numpy() for c in ("part", "before", "n"))
            low, high = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p in np.unique(part):
                own = part == p
                low[own] = np.maximum(0, fluid.when(p, np.maximum(0, before[own] - slack)) // size)
                high[own] = np.minimum(blocks - 1, (fluid.when(p, before[own] + n[own] + slack) + 2 * slack) // size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], [*batch.schema.names, "low", "high"])

    def near(slack: int) -> DataFrame:
        rows = docs.select("part", "doc_id", F.col("pass").cast("int").alias("pass"), "n", "before")
        rows = rows.mapInArrow(lambda b: reached(b, slack), "part int, doc_id long, pass int, n long, before long, low long, high long")
        return rows.where("low <= high").withColumn("block", F.explode(F.sequence("low", "high"))).drop("low", "high")

    def guessed(batches: Iterator[pa.RecordBatch], slack: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for b in batch["id"].to_pylist():
                served = fluid.state(max(0, b * size - slack)) if b else [0.0] * k
                states.append([*map(int, served), *[int(s < t or not b) for s, t in zip(served, totals, strict=True)]])
            yield pa.record_batch([batch["id"], pa.array(states, pa.list_(pa.int64())), pa.array([b == 0 for b in batch["id"].to_pylist()])], ["block", "state", "known"])

    starts = spark.range(blocks).mapInArrow(lambda b: guessed(b, slack), "block long, state array<long>, known boolean")
    walks, ends = [], None
    for turn in range(max_rounds):
        rows = near(slack)
        if ends is not None:
            rows = rows.join(starts.select("block"), "block", "left_semi")
        run = rows.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(lambda r, s: _walked(r, s, shares, totals, size), FOUND)
        walks.append(stored(run).withColumn("turn", F.lit(turn)))
        now = walks[-1].where("i < 0").select("block", "first", "last", "missing", "turn")
        ends = stored(now if ends is None else now.unionByName(ends.join(now, "block", "left_anti")))
        before = ends.select((F.col("block") + 1).alias("block"), F.col("last").alias("state"), F.col("missing").alias("lacking"))
        wrong = ends.join(before, "block", "left").where("missing OR (NOT lacking AND first <> state)")
        # A block that lacked documents with a known state, or the first, begins again as it did; one after a block that lacks some has to wait.
        starts = wrong.where("lacking IS NULL OR NOT lacking").select("block", F.coalesce("state", "first").alias("state"), F.lit(True).alias("known"))
        starts = stored(starts)
        if starts.isEmpty():
            break
        slack *= 1 if ends.where("missing").isEmpty() else 4
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    found = walks[0]
    for more in walks[1:]:
        found = found.unionByName(more)
    found = found.where("i >= 0").join(ends.select("block", "turn"), ["block", "turn"])
    if max_tokens is not None:
        found = found.where(F.col("at") < max_tokens)
    found = running_total(found.select("block", "i", "part", "doc_id", "pass", "n", "at"), F.lit(1).cast("long"), ["block", "i"], F.col("block"), name="position")
    return found.select("position", F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1).alias(key), "doc_id", "pass", "n", "at")


def served_shares(picks: DataFrame, every: int, key: str = "lang") -> DataFrame:
    """For each `every` tokens of a mixed stream: how many tokens of each source are served by then."""
    sums = picks.groupBy(key, F.floor((F.col("at")) / every).alias("mark")).agg(F.sum("n").alias("tokens"), F.count("*").alias("n_docs"))
    return running_total(sums, "tokens", ["mark"], F.floor(F.col("mark") / 1000), [key], "earlier").select(key, "mark", "n_docs", (F.col("earlier") + F.col("tokens")).alias("served"))
