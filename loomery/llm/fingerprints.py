"""Document fingerprints by consistent weighted sampling.

The terms of a document are its words, weighted w = 1 + ln(count). Each of DRAWS draws looks
at every term: r and c from Gamma(2, 1) and beta from U(0, 1), all from the term's hash and
the draw's number alone, give

    t = floor(ln w / r + beta),   ln a = ln c - r * (t - beta + 1),

and the term of the least a is drawn. Two documents draw the same (term, t) with a
probability equal to their generalised Jaccard similarity, the sum of the minima of their
weights over the sum of the maxima. The likeness of two fingerprints is the share of equal
draws, so it is unbiased for texts of any length, and its standard error is
sqrt(J * (1 - J) / DRAWS).

A draw is kept as a 32-bit hash of its a, which depends on the term, t and the draw only.
The draws are plain minima over one row for each term, so that Spark compiles them, and
they are folded before they are shuffled: one short row for each text.

Only DataFrame and SQL functions are used.

Defined results: a null text is empty; an empty text draws nothing, and two of these are
alike (1.0), but not like any other (0.0); repeated rows have equal fingerprints; other
columns are kept by `fingerprints` under their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import repeated, shuffles, text_of, written

DRAWS = 32
_WORDS = r"array_remove(split({}, '[\\x20\\x09-\\x0D]+'), '')"
_KEY = ["k_none", "k", "h"]


def _terms(rows: DataFrame, text: str) -> DataFrame:
    """The other columns of rows, one row for each distinct word of the text: its hash, the log of its weight, and first, whether it is the text's first row.

    A text without words has one row with nulls. The steps are separate projections so that each array is made once.
    """
    keep = [c for c in rows.columns if c != text]
    step = rows.select(*keep, F.expr(f"sort_array(transform({_WORDS.format(text)}, x -> xxhash64(x)))").alias("_h"))
    # Where each run of equal hashes begins; its length is the word's count.
    step = step.select(*keep, "_h", F.expr("CASE WHEN size(_h) > 0 THEN filter(sequence(0, size(_h) - 1), k -> k = 0 OR _h[k] <> _h[k - 1]) END").alias("_at"))
    step = step.select(*keep, F.expr("transform(_at, (p, i) -> struct(_h[p] AS h, coalesce(get(_at, i + 1), size(_h)) - p AS n))").alias("_t"))
    step = step.select(*keep, F.posexplode_outer("_t").alias("_i", "_t"))
    return step.select(*keep, F.col("_t.h").alias("_term"), F.log1p(F.log(F.col("_t.n").cast("double"))).alias("_log_w"), (F.coalesce("_i", F.lit(0)) == 0).alias("_first"))


def _draw(d: int) -> Column:
    """ln a of the term that draw d takes; null if there is none. Uniform numbers are the middles of cells of 21, 22 and 32 bits."""
    x, y = f"xxhash64(_term, {2 * d})", f"xxhash64(_term, {2 * d + 1})"
    r = f"(-ln((shiftrightunsigned({x}, 43) + 0.5D) * ((shiftrightunsigned({x}, 22) & {(1 << 21) - 1}L) + 0.5D) / {1 << 42}D))"
    beta = f"((({x} & {(1 << 22) - 1}L) + 0.5D) / {1 << 22}D)"
    c = f"(-ln((shiftrightunsigned({y}, 32) + 0.5D) * (({y} & {(1 << 32) - 1}L) + 0.5D) / {1 << 64}D))"
    return F.expr(f"min(CASE WHEN _term IS NOT NULL THEN ln({c}) - {r} * (floor(_log_w / {r} + {beta}) - {beta} + 1D) END)")


def signatures(rows: DataFrame, key: Sequence[str], text: str, draws: int = DRAWS) -> DataFrame:
    """For each key, of one text: the key, n_rows (how many rows have it) and signature, an array of `draws` ints, empty for no words."""
    drawn = _terms(rows.select(*key, text), text).groupBy(*key).agg(F.count_if("_first").alias("n_rows"), *[_draw(d).alias(f"_d{d}") for d in range(draws)])
    all_ = F.array(*[F.shiftright(F.xxhash64(f"_d{d}"), 32).cast("int") for d in range(draws)])
    return drawn.select(*key, "n_rows", F.when(F.isnull("_d0"), F.expr("CAST(array() AS array<int>)")).otherwise(all_).alias("signature"))


def written_out(signature: str | Column) -> Column:
    """A signature as a string: eight hexadecimal digits for each draw."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """The estimated similarity of two columns of signatures, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(same / most)


def fingerprints(docs: DataFrame, *, text: str = "text", name: str = "signature", draws: int = DRAWS) -> DataFrame:
    """docs with their signatures in a column of that name. Copies of a text are drawn from once in each task."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_of(f"`{text}`").alias("t"))
    rows = rows.select("doc", "t", F.xxhash64("t").alias("h1"), F.xxhash64("t", F.lit(1)).alias("h2"))
    found = signatures(rows, ["h1", "h2"], "t", draws).select("h1", "h2", "signature")
    joined = rows.drop("t").join(found, ["h1", "h2"])
    return joined.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("signature").alias(name))


def _numbered(keys: DataFrame) -> DataFrame:
    """keys with `number`, from 0, by falling id (nulls last, ties by falling hash of the text).

    The rows are dealt by ranges of all three, so that neither many rows without id nor many
    of one id are one task's; then each range is numbered behind those before it.
    """
    order = [F.col("k_none"), F.desc("k"), F.desc("h")]
    dealt = written(keys.repartitionByRange(shuffles(keys.sparkSession), *order).withColumn("range", F.spark_partition_id()))
    held = dealt.groupBy("range").agg(F.count("*").alias("held"))  # as many rows as shuffle partitions
    before = held.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    rows = dealt.withColumn("place", place).join(F.broadcast(before), "range")
    return written(rows.select(*keys.columns, (F.col("place") + F.col("before")).alias("number")))


def compared(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", draws: int = DRAWS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like it these and the next document's are.

    The next document is the one that follows in descending order of ids (nulls last, ties
    by falling hash of the text), the first one's after the last. The edited text has the last
    third of its characters replaced by the first as many of the next document. Returns doc_id,
    n_chars, edited_sha256, signature, edited_signature, near_edited, near_next.

    Rows alike in id and text are one row until the end: the next of all but one of them is
    the same text. The documents are shuffled once; of the next ones only the part that is needed moves on.
    """
    k = F.col(f"`{id_column}`").cast("long")
    t = text_of(f"`{text}`")
    rows = docs.select(F.isnull(k).alias("k_none"), F.coalesce(k, F.lit(0)).alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))
    found = written(signatures(rows.withColumn("n", F.length("t")), [*_KEY, "n"], "t", draws))
    total, most = found.agg(F.count("*"), F.max("n_rows")).first()
    numbered = _numbered(found.select(*_KEY, "n", "n_rows"))

    other = [f"next_{c}" for c in _KEY]
    next_ = numbered.select(*[F.col(c).alias(o) for c, o in zip(_KEY, other, strict=True)], F.pmod(F.col("number") - 1, F.lit(max(total, 1))).alias("number"))
    turns = numbered.join(next_, "number").select(*_KEY, *other, "n", F.lit(1).cast("long").alias("times"))
    copies = numbered.where("n_rows > 1").select(*_KEY, *[F.col(c).alias(o) for c, o in zip(_KEY, other, strict=True)], "n", (F.col("n_rows") - 1).alias("times"))
    turns = turns.unionByName(copies)

    texts = rows.dropDuplicates(_KEY)
    cut = F.floor(F.col("n") / 3).cast("int")
    there = lambda df: df.select(*[F.col(c).alias(o) for c, o in zip(_KEY, other, strict=True)], *[c for c in df.columns if c not in _KEY])
    heads = there(texts).join(turns, other).select(*_KEY, *other, "n", "times", F.substring("t", F.lit(1), cut).alias("head"))
    edited = F.concat(F.substring("t", F.lit(1), F.col("n") - cut), F.col("head"))
    pairs = texts.join(heads, _KEY).select(*_KEY, *other, "n", "times", edited.alias("edited"))
    pairs = pairs.select("*", F.sha2("edited", 256).alias("sha"))
    drawn = signatures(pairs, [*_KEY, *other, "n", "times", "sha"], "edited", draws).drop("n_rows").withColumnRenamed("signature", "edited_signature")

    own = found.select(*_KEY, "signature")
    drawn = drawn.join(own, _KEY).join(there(own).withColumnRenamed("signature", "next_signature"), other)
    out = repeated(drawn, "times", "copy", most or 0)
    return out.select(
        F.when(~F.col("k_none"), F.col("k")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), "signature", "edited_signature",
        likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "next_signature").alias("near_next"),
    )
