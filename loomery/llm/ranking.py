"""Ranked lexical search: the best documents of each item, through posting lists in geometric blocks.

Each posting list is cut into blocks of documents that are alike: every document goes to
the two of CENTRES documents, drawn by hash, whose term weights are most like its own,
documents are put in order of these two, and runs of BLOCK of them hold the blocks of all
lists. A block of a list has a summary, the largest weight that any of its documents gives
each term that some item holds along with the list's own. A list that holds over one in
WIDE of a run's documents has the run's summary. So the items' terms, weighted by a
summary, bound the scores of all documents of the block from above.

A search goes through the runs of the index with the items and keeps each item's best
documents so far. A run whose own bound doesn't reach the item's last place is skipped;
so are the lists of the weakest terms which together don't reach it, as no document
without other terms can; then each block whose bound doesn't. Documents of the blocks
that are left are scored in full, in whole numbers. Bounds are exact, so the result is
that of scoring everything. Each task passes on each item's best; these are merged.

Terms that no item holds are counted, but not listed. Items are taken in groups, by hash,
of about MOST different terms at most, since a group's terms, weights and items go to all
tasks; each group reads the documents anew.

Defined results: a null or empty text has no terms and isn't counted; an item without
terms or without a document has no rows; documents with one id are ranked each; equal
scores go by id, null ids first; repeated items are ranked each, under their one id; only
ids and texts are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import shuffles, text_of, written

BEST, CENTRES, BLOCK, WIDE, MOST, PIECE = 20, 256, 256, 8, 1 << 14, 1 << 20
#: Letters and digits, A-Z as a-z, and all bytes that aren't ASCII make terms; the rest separates them.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, in lists of bounded size."""
    text, at = text.translate(TO_TERMS), 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Items:
    """A group of items: its terms, and each item's terms (numbers, in order) with how often it holds them."""

    terms: dict[bytes, int]
    ids: np.ndarray
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[tuple[int, bytes]]) -> Items:
        held = [(i, Counter(t for part in pieces(text) for t in part)) for i, text in texts]
        held = [(i, c) for i, c in held if c]
        terms = {t: k for k, t in enumerate(sorted({t for _, c in held for t in c}))}
        rows = [sorted((terms[t], n) for t, n in c.items()) for _, c in held]
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
        return cls(terms, np.array([i for i, _ in held], np.int64), np.cumsum([0, *map(len, rows)]), flat[:, 0], flat[:, 1])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each item's term, the pairs of it and each of the item's terms: where they start, their place in keys, and the times; and the sorted keys, term * terms + term."""
        v, size = len(self.terms), np.diff(self.start)
        own = np.repeat(np.arange(len(size)), size)
        starts = np.cumsum(np.r_[0, size[own]])
        place = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.start[own], size[own])
        key = np.repeat(self.term, size[own]) * v + self.term[place]
        keys, where = np.unique(key, return_inverse=True)
        return starts[:-1], where, self.times[place], keys


def counted(docs: DataFrame, terms: dict[bytes, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n (terms), term and tf (arrays, of the given terms) of each document that has a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.__contains__
        for batch in batches:
            sizes, found, often = [], [], []
            for value in batch["text"]:
                n, tf = 0, Counter()
                for part in pieces(value.as_py()):
                    n += len(part)
                    tf.update(filter(known, part))
                held = sorted((terms[t], c) for t, c in tf.items())
                sizes.append(n)
                found.append([h[0] for h in held])
                often.append([h[1] for h in held])
            yield pa.record_batch([batch["row"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], ["row", "doc_id", "n", "term", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_of(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(count, "row long, doc_id long, n long, term array<int>, tf array<long>").where("n > 0")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of arrays."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def weighed(counts: DataFrame, n_docs: int, total: int, weights: np.ndarray, centres: np.ndarray) -> DataFrame:
    """row, doc_id, term, part (what each term adds to a score), and near and next, the two centres most alike."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, term = _flat(batch["term"])
            _, tf = _flat(batch["tf"])
            m = 100 - 25 + 25 * batch["n"].to_numpy() * n_docs // total
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes)))
            near, ends = np.zeros((batch.num_rows, 2), np.int64), np.cumsum(sizes)
            for k, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                like = part[a:b].astype(float) @ centres[term[a:b]]
                near[k] = np.argsort(-like, kind="stable")[:2] if len(like) > 1 else 0
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(x))
            yield pa.record_batch([batch["row"], batch["doc_id"], lists(term.astype(np.int32)), lists(part), pa.array(near[:, 0]), pa.array(near[:, 1])], ["row", "doc_id", "term", "part", "near", "next"])

    return counts.where(F.size("term") > 0).mapInArrow(weigh, "row long, doc_id long, term array<int>, part array<long>, near long, next long")


def _summed_up(docs: np.ndarray, term: np.ndarray, part: np.ndarray, n: int, keys: np.ndarray, v: int) -> tuple[np.ndarray, ...]:
    """Of a run of n documents with their (docs, term, part) triples: its terms, their largest parts, and each pair (place in keys) of a list that has its own summary, with its largest part."""
    here, column = np.unique(term, return_inverse=True)
    table = np.zeros((n, len(here)), np.int64)
    table[docs, column] = part
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(len(here) + 1))
    place, largest = [], []
    for k, t in enumerate(here.tolist()):
        members = docs[order[cuts[k] : cuts[k + 1]]]
        if len(members) * WIDE > n:
            continue
        own = np.arange(*np.searchsorted(keys, (t * v, t * v + v)))  # the pairs of this term, in order of the other
        with_ = keys[own] - t * v
        at = np.searchsorted(here, with_)
        there = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == with_)
        most = table[members[:, None], at[there][None, :]].max(axis=0)
        place.append(own[there][most > 0])
        largest.append(most[most > 0])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return here, table.max(axis=0), join(place), join(largest)


def index(rows: DataFrame, items: Items) -> DataFrame:
    """The index of rows of `weighed`, one row for each run of documents: their ids, parts by document, and the summaries."""
    keys, v = items.pairs()[3], len(items.terms)
    schema = "row array<long>, doc_id array<long>, size array<int>, term array<int>, part array<long>, here array<int>, most array<long>, pair array<int>, pair_most array<long>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
            whole = rows.num_rows // BLOCK * BLOCK
            yield from map(one, (r.slice(at, BLOCK) for r in rows.slice(0, whole).combine_chunks().to_batches() for at in range(0, r.num_rows, BLOCK)))
            rest = rows.slice(whole).combine_chunks().to_batches()
        yield from map(one, rest)

    def one(run: pa.RecordBatch) -> pa.RecordBatch:
        sizes, term = _flat(run["term"])
        _, part = _flat(run["part"])
        here, most, pair, pair_most = _summed_up(np.repeat(np.arange(run.num_rows), sizes), term, part, run.num_rows, keys, v)
        columns = (run["row"], run["doc_id"], sizes.astype(np.int32), term.astype(np.int32), part, here.astype(np.int32), most, pair.astype(np.int32), pair_most)
        return pa.record_batch([pa.array([c], pa.list_(c.type)) if isinstance(c, pa.Array) else pa.array([c]) for c in columns], [c.split()[0] for c in schema.split(", ")])

    n = shuffles(rows.sparkSession)
    ordered = rows.repartitionByRange(n, "near", "next", "row").sortWithinPartitions("near", "next", "row")
    return ordered.select("row", "doc_id", "term", "part").mapInArrow(build, schema)


class Search:
    """The best documents of each item so far, as runs of an index go by."""

    def __init__(self, items: Items, best: int = BEST) -> None:
        self.items, self.best = items, best
        self.pair_start, self.pair_at, self.pair_times, self.keys = items.pairs()
        self.list_of = np.searchsorted(items.start, np.arange(len(items.term)), "right") - 1
        self.found = [np.zeros((0, 3), np.int64) for _ in items.ids]  # score, doc_id (null: the least number), row
        self.last = np.ones(len(items.ids), np.int64)  # the score that a document needs
        self.scored = self.passed = 0

    def add(self, run: dict[str, np.ndarray]) -> None:
        items, v = self.items, len(self.items.terms)
        if not len(items.ids):
            return
        most = np.zeros(v, np.int64)
        most[run["here"]] = run["most"]
        adds = most[items.term] * items.times
        bound = np.add.reduceat(adds, items.start[:-1])
        wanted = np.flatnonzero(bound >= self.last)
        self.passed += (len(items.ids) - len(wanted)) * len(run["size"])
        if not len(wanted):
            return
        # The bound of each list's block, for each item: by its own summary, or the run's where it has none.
        summary = np.zeros(len(self.keys), np.int64)
        summary[run["pair"]] = run["pair_most"]
        listed = np.add.reduceat(summary[self.pair_at] * self.pair_times, self.pair_start)
        listed = np.where((listed == 0) & (adds > 0), bound[self.list_of], listed)
        # By term: the documents of its list, and by document: its parts.
        docs = np.repeat(np.arange(len(run["size"])), run["size"])
        order = np.argsort(run["term"], kind="stable")
        cuts = np.searchsorted(run["term"][order], np.arange(v + 1))
        for i in wanted[np.argsort(-bound[wanted], kind="stable")].tolist():
            own = slice(items.start[i], items.start[i + 1])
            term, times, add, block = items.term[own], items.times[own], adds[own], listed[own]
            weak = np.argsort(add, kind="stable")
            needed = weak[np.cumsum(add[weak]) >= self.last[i]]
            needed = needed[block[needed] >= self.last[i]]
            if not len(needed):
                self.passed += len(run["size"])
                continue
            chosen = np.zeros(len(run["size"]), bool)
            for t in term[needed].tolist():
                chosen[docs[order[cuts[t] : cuts[t + 1]]]] = True
            score = np.zeros(len(run["size"]), np.int64)
            for t, n in zip(term.tolist(), times.tolist(), strict=True):
                at = order[cuts[t] : cuts[t + 1]]
                score[docs[at]] += n * run["part"][at]
            self.scored += int(chosen.sum())
            self.passed += int((~chosen).sum())
            self._keep(i, np.flatnonzero(chosen & (score >= self.last[i])), score, run)

    def _keep(self, i: int, places: np.ndarray, score: np.ndarray, run: dict[str, np.ndarray]) -> None:
        if not len(places):
            return
        rows = np.concatenate([self.found[i], np.stack([score[places], run["doc_id"][places], run["row"][places]], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.best]
        self.found[i] = rows
        if len(rows) == self.best:
            self.last[i] = max(1, rows[-1, 0])


NO_ID = -(1 << 63)


def _searched(runs: DataFrame, items: Items, best: int) -> DataFrame:
    """item (place in items), doc_id, row and score: each task's best for each item."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, best)
        for batch in batches:
            for k in range(batch.num_rows):
                values = {c: batch[c][k].values for c in batch.schema.names}
                search.add({c: x.cast(pa.int64()).fill_null(NO_ID).to_numpy() for c, x in values.items()})
        for i, rows in enumerate(search.found):
            ids = pa.array(rows[:, 1], mask=rows[:, 1] == NO_ID)
            yield pa.record_batch([pa.array(np.full(len(rows), i)), ids, pa.array(rows[:, 2]), pa.array(rows[:, 0])], ["item", "doc_id", "row", "score"])

    return runs.mapInArrow(go, "item long, doc_id long, row long, score long")


def _group(docs: DataFrame, items: Items, best: int, id_column: str, text: str) -> DataFrame:
    spark, v = docs.sparkSession, len(items.terms)
    counts = written(counted(docs, items.terms, id_column, text))
    n_docs, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch["term"])[1], minlength=v)
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], ["term", "df"])

    weights = np.zeros(v, np.int64)
    for r in counts.select("term").mapInArrow(tallied, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        weights[r.term] = weight(n_docs, r.df)
    drawn = counts.where(F.size("term") > 1).orderBy(F.xxhash64("term", "tf", "row")).limit(CENTRES).select("term", "tf").collect()
    centres = np.zeros((v, len(drawn)))
    for k, r in enumerate(drawn):
        centres[r.term, k] = weights[r.term] * (np.array(r.tf) / (np.array(r.tf) + 1.0))
    centres /= np.maximum(1e-9, np.sqrt((centres**2).sum(axis=0)))
    runs = written(index(written(weighed(counts, n_docs, max(1, total), weights, centres)), items))
    found = _searched(runs, items, best)
    turn = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    found = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= best)
    ids = spark.createDataFrame([(k, None if i == NO_ID else i) for k, i in enumerate(items.ids.tolist())], "item long, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # a group's items, bounded by MOST


def ranked(docs: DataFrame, items: DataFrame, *, best: int = BEST, most: int = MOST, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's `best` highest-scoring documents with a score above 0."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), text_of(f"`{item_text}`").alias("text"))
    # Bytes bound terms: a term and what follows it take two bytes at least, some seven on average.
    groups = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (most * 7))
    out = []
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        own = Items.of([(NO_ID if r.item_id is None else r.item_id, r.text.encode()) for r in own])
        if len(own.ids):
            out.append(_group(docs, own, best, id_column, text))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
