"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document. The ledger keeps the measurements
and one bit for each failed rule. A policy is a versioned mask over those bits, so
a new policy, or the effect of leaving a rule out, needs no second look at a text.

Everything here is DataFrame functions; no shuffle is needed to fill a ledger.

Defined results: a null or empty text has no words and fails `few_words`; repeated
rows get one ledger row each; columns besides the id and the text are ignored by
`ledger` and kept, whatever their names, by `screen`; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import text_of, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_doubled")

#: Name of each rule, by its bit, and the SQL condition on which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "upper_case": "10 * n_upper > 4 * word_chars",
    "doubled_words": "10 * n_doubled > 5 * n_words",
}

#: Versions of the policy: the rules that each of them enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str | tuple[str, ...], rules: Mapping[str, str] = RULES) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << list(rules).index(name) for name in names)


def _starts_of_repeats(ranked: str) -> Column:
    """From (hash, place) pairs in order: the places, in order, of hashes that occur twice or more."""
    return F.expr(
        f"""array_sort(transform(filter(sequence(0, size({ranked}) - 1), k ->
              (k > 0 AND {ranked}[k - 1].h = {ranked}[k].h)
              OR (k < size({ranked}) - 1 AND {ranked}[k + 1].h = {ranked}[k].h)),
            k -> {ranked}[k].i))"""
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs: `doc`, a struct of all its columns, and MEASURES.

    The steps are separate projections so that each array is made once.
    """
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_of(f"`{text}`").alias("t"))
    step = step.select("doc", "t", words(F.col("t")).alias("w"))
    step = step.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.expr("CASE WHEN size(w) > 1 THEN size(filter(sequence(1, size(w) - 1), i -> w[i] = w[i - 1])) ELSE 0 END").cast("long").alias("n_doubled"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr(f"CASE WHEN size(w) > {WINDOW} THEN transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) END").alias("windows"),
    )
    kept = ["doc", "n_words", "word_chars", "n_symbols", "n_upper", "n_doubled"]
    step = step.select(
        *kept,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END").alias("ranked"),
    )
    kept += ["n_lines", "n_dup_lines"]
    step = step.select(*kept, F.when(F.col("ranked").isNotNull(), _starts_of_repeats("ranked")).alias("at"))
    covered = f"{WINDOW} + aggregate(sequence(1, size(at) - 1), 0, (n, k) -> n + least({WINDOW}, at[k] - at[k - 1]))"
    step = step.select(*kept, F.expr(f"CASE WHEN at IS NULL THEN 0 ELSE {covered} END").cast("long").alias("n_repeat_words"))
    # A filter on a measurement must not be moved below these projections, where each array
    # would be written out anew for each use. It isn't moved past a row number, which is never negative.
    numbers = F.when(F.monotonically_increasing_id() >= 0, F.struct(*MEASURES)).alias("m")
    return step.select("doc", numbers).select("doc", *[F.col("m").getField(c).alias(c) for c in MEASURES])


def _bits(rules: Mapping[str, str]) -> Column:
    return F.expr(" + ".join(f"CASE WHEN {sql} THEN {1 << k}L ELSE 0L END" for k, sql in enumerate(rules.values())))


def ledger(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that the document fails."""
    docs = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return measured(docs).select("doc.doc_id", *MEASURES, _bits(rules).alias("failed"))


def verdicts(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with `kept`: no rule of this policy failed."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(mask(policy)) == 0)


def screen(docs: DataFrame, *, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of docs, with their columns, that pass the policy."""
    passed = measured(docs, text).where(_bits(RULES).bitwiseAND(mask(policy)) == 0)
    return passed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def ablation(ledger: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, fail it alone, and are kept with and without it.

    The ledger is first reduced to one row for each pattern of bits, of which there
    are 2 ** len(rules) at most, so any number of policies costs one pass.
    """
    spark = ledger.sparkSession
    patterns = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    grid = [(p, r, mask(tuple(names), rules), 1 << list(rules).index(r)) for p, names in policies.items() for r in names]
    grid = spark.createDataFrame(grid, "policy string, rule string, all_bits long, bit long")
    pairs = patterns.crossJoin(F.broadcast(grid))  # a few dozen rows on either side
    hit = F.col("failed").bitwiseAND(F.col("all_bits"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return pairs.groupBy("policy", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_failed_alone"),
        count(hit == 0).alias("n_kept"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
