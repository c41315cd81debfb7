"""Personal data, by fixed patterns and by bootstrapped contextual extraction.

Four kinds are found by pattern: email, ip, card, phone. These matches are seed entities; a
fifth kind, secret, has seeds only: keys in the form of a digest in hexadecimal digits. Every
match, and every other candidate, is an occurrence of an instance in lexical patterns: the
three words before it, two words before and one after, and, for candidates of one form, two
words before, or one on either side. Candidates are the other tokens that hold a digit or an
at sign, up to eight of them if only blanks or brackets part them.

Patterns and instances are scored in rounds: a pattern by the share of its distinct
instances that are known to be of a kind, an instance by all trusted patterns that vouch for
it, and those of high score become known. Known sets only grow and scores only rise, on a
grid of six digits, so the rounds come to an end; they go on until nothing changes. Then
the candidates whose pattern and instance are both trusted become spans. They are added to
the matches and never replace one. So seeds of the fifth kind are spans only in a trusted context.

Only DataFrame and SQL functions are used. The texts are read once; what follows works on
occurrences, which are few, one row each, and is reduced by aggregates, so that a context or
a value that is very common is never collected in one place. Places, overlaps and unions
are running sums and maxima, and texts are masked in blocks, so that the work grows with
a text's length and matches, not with their square.

Defined results: a null text is empty and has no spans; repeated rows get one result
row each; a null doc_id is kept; other columns are ignored by `find` and kept by `mask`
whatever their names; an empty table gives none. Overlapping spans of different kinds
all count; `mask` covers their union and names it after the span that begins first. A word of
over CONTEXT characters ends a context, as does a match of the same kind; digits of contexts are all 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# A match can't begin right after a character that it could have begun with, unless the
# last match ended there; saying so, and giving nothing back, keeps the search linear.
LOCAL = r"[A-Za-z0-9._%+-]"
BREAK = r"""\s,;|"'()<>\[\]{}"""
TOKEN = rf"(?=[^{BREAK}0-9@]*+[0-9@])[^{BREAK}]++"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Chains of fewer digits than a card has can't pass, at whichever digit they begin.
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?:\((?=[0-9]++\))|(?<![^{BREAK}])){TOKEN}(?:[\x20()]{{1,2}}{TOKEN}){{0,7}}+",
}
HINT = {"email": "t LIKE '%@%'", "ip": "digits", "card": "digits", "phone": "digits AND t LIKE '%+%'", "token": "digits OR t LIKE '%@%'"}
#: Seeds of secrets, and words in whose company such digits are no secret.
SECRET = "^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
OPEN = "(commit|revision|checksum|digest|sha1|sha256|md5|blob|etag|uuid)"

SEEDS, PATTERN_SCORE, INSTANCE_SCORE, CONTEXT, CUT = 3, 0.6, 0.7, 256, 4096
_KEY = ["no_id", "id", "h"]


def _valid(kind: str, v: str) -> str:
    """SQL for a match that counts."""
    if kind == "ip":
        return rf"forall(split({v}, '[.]'), x -> try_cast(x AS double) <= 255)"
    if kind == "phone":
        return f"length(regexp_replace({v}, '[^0-9]', '')) BETWEEN 10 AND 15"
    if kind == "card":
        n = f"regexp_replace({v}, '[ -]', '')"
        digit = f"int(substr({n}, -1 - k, 1))"
        luhn = f"aggregate(sequence(0, length({n}) - 1), 0L, (a, k) -> a + CASE WHEN k % 2 = 0 THEN {digit} ELSE (2 * {digit}) % 10 + (2 * {digit}) div 10 END)"
        return f"CASE WHEN length({n}) BETWEEN 14 AND 19 THEN {luhn} % 10 = 0 ELSE false END"
    return f"length({v}) > 0"


def scanned(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs, read once and stored: row, doc_id, h (a hash of the text) and found.

    found holds all matches of all patterns, in order for each: p (the pattern's number), i, g (the
    characters since the last one), n (its characters), v, ok (whether it counts), and `left` and
    `right`, the text on either side as far as the next match of the pattern, CONTEXT characters at most.
    """
    t = text_of(f"`{text}`")
    step = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("t"))
    step = step.select("*", F.expr("t RLIKE '[0-9]'").alias("digits"))
    quoted = {k: rx.replace("\\", "\\\\").replace("'", "\\'") for k, rx in PATTERNS.items()}
    step = step.select("*", *[F.expr(f"CASE WHEN {HINT[k]} THEN regexp_extract_all(t, '{rx}', 0) END").alias(f"m_{k}") for k, rx in quoted.items()])
    step = step.select("doc_id", "h", *[f"m_{k}" for k in quoted], *[F.expr(f"CASE WHEN size(m_{k}) > 0 THEN split(t, '{rx}', -1) END").alias(f"g_{k}") for k, rx in quoted.items()])
    # A cut word at the far end of a context is dropped.
    left = r"CASE WHEN length({g}[i]) > " + str(CONTEXT) + r" THEN regexp_replace(right({g}[i], " + str(CONTEXT) + r"), '^\\S+', '') ELSE {g}[i] END"
    right = r"CASE WHEN length({g}[i + 1]) > " + str(CONTEXT) + r" THEN regexp_replace(left({g}[i + 1], " + str(CONTEXT) + r"), '\\S+$', '') ELSE {g}[i + 1] END"
    # A token is taken without the punctuation that ends it.
    value = {k: "regexp_replace(m, '[.:!?]+$', '')" if k == "token" else "m" for k in quoted}
    none = "CAST(array() AS array<struct<p: int, i: int, g: int, n: int, v: string, ok: boolean, left: string, right: string>>)"
    each = [
        f"""coalesce(transform(m_{k}, (m, i) -> named_struct('p', {p}, 'i', i, 'g', length(g_{k}[i]), 'n', length(m), 'v', {value[k]}, 'ok', {_valid(k, value[k])},
            'left', {left.format(g=f'g_{k}')}, 'right', {right.format(g=f'g_{k}')})), {none})"""
        for p, k in enumerate(quoted)
    ]
    return written(step.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", F.expr(f"concat({', '.join(each)})").alias("found")))


def occurrences(scan: DataFrame) -> DataFrame:
    """From scanned texts, stored: row, doc_id, h, s, e, v, kind (null for candidates), patterns.

    Places are running sums over the matches of one pattern and text. Candidates that touch a
    match are left out: those that begin before the running maximum of ends, or end after the next start.
    """
    rows = scan.where("size(found) > 0").select("row", "doc_id", "h", F.explode("found").alias("x")).repartition("row")
    so_far = Window.partitionBy("row", "x.p").orderBy("x.i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum(F.col("x.g") + F.col("x.n")).over(so_far).cast("int") - F.col("x.n")).where("x.ok")
    rows = rows.select("row", "doc_id", "h", "s", (F.col("s") + F.length("x.v")).alias("e"), F.col("x.v").alias("v"), F.get(F.array(*map(F.lit, BASE)), F.col("x.p")).alias("kind"), "x.left", "x.right")
    base = F.isnotnull("kind")
    # At one place matches come before candidates, whichever way the text is gone through.
    rows = rows.withColumn("before", F.max(F.when(base, F.col("e"))).over(Window.partitionBy("row").orderBy("s", F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.min(F.when(base, F.col("s"))).over(Window.partitionBy("row").orderBy(F.desc("s"), F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(base | ((F.coalesce("before", F.lit(0)) <= F.col("s")) & F.coalesce(F.col("after") >= F.col("e"), F.lit(True))))
    words = lambda c: F.array_remove(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"\s+"), "")
    rows = rows.withColumn("l", F.slice(F.reverse(words(F.col("left"))), 1, 3)).withColumn("r", F.get(words(F.col("right")), 0))
    form = F.expr(r"CASE WHEN v LIKE '%@%' THEN '@' WHEN v RLIKE '^[0-9 ().+-]*$' THEN '0' ELSE 'x' END")
    two = F.concat_ws(" ", F.get("l", 1), F.get("l", 0))
    patterns = F.array(
        F.when(F.size("l") >= 3, F.concat(F.get("l", 2), F.lit(" "), two, F.lit(" _"))),
        F.when(F.size("l") >= 2, F.concat(two, F.lit(" _ "), F.col("r"))),
        F.when(F.size("l") >= 2, F.concat(two, F.lit(" _|"), form)),
        F.when(F.size("l") >= 1, F.concat(F.get("l", 0), F.lit(" _ "), F.col("r"), F.lit("|"), form)),
    )
    patterns = F.filter(F.array_distinct(F.array_compact(patterns)), lambda p: p.rlike(r"^[^|]*\p{L}"))  # punctuation alone says nothing
    return written(rows.select("row", "doc_id", "h", "s", "e", "v", "kind", patterns.alias("patterns")))


def bootstrapped(seen: DataFrame, *, seeds: int = SEEDS, pattern_score: float = PATTERN_SCORE, instance_score: float = INSTANCE_SCORE) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, score) and known instances (v, kind, score) of occurrences (v, kind, patterns).

    A pattern needs `seeds` known instances at least, and its score is the share of
    known ones, by their own scores, among its distinct instances. An instance's score is the
    chance that not all of its trusted patterns are wrong. Seeds have the score 1 and keep their kind.
    """
    kind = F.coalesce("kind", F.when(F.col("v").rlike(SECRET) & F.col("v").rlike("[0-9]") & F.col("v").rlike("[a-f]"), "secret"))
    edges = seen.select("v", kind.alias("kind"), F.explode("patterns").alias("pattern")).groupBy("pattern", "v").agg(F.min("kind").alias("kind"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= seeds)  # no others can ever be trusted
    edges = written(edges.join(sizes, "pattern"))
    base = written(edges.where("kind IS NOT NULL").groupBy("v").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    known, links = base, edges.select("pattern", "v", "n")
    while True:
        support = links.join(known, "v").groupBy("pattern", "kind", "n").agg(F.count("*").alias("k"), F.sum("score").alias("sum"))
        support = support.where(~((F.col("kind") == "secret") & F.col("pattern").rlike(OPEN)))
        best = support.where(F.col("k") >= seeds).withColumn("score", F.round(F.col("sum") / F.col("n"), 6)).where(F.col("score") >= pattern_score)
        patterns = written(best.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b")).select("pattern", "b.kind", "b.score"))
        doubt = F.log(1 - F.least("score", F.lit(0.99)))
        vouched = links.select("pattern", "v").join(patterns, "pattern").groupBy("v", "kind").agg(F.round(1 - F.exp(F.sum(doubt)), 6).alias("score")).where(F.col("score") >= instance_score)
        vouched = vouched.groupBy("v").agg(F.max(F.struct("score", "kind")).alias("b")).select("v", "b.kind", "b.score")
        after = written(base.unionByName(vouched.join(base, "v", "left_anti")))
        changed = after.join(known, ["v", "kind", "score"], "left_anti").limit(1).count()
        known = after
        if not changed:
            return patterns, known


def added(seen: DataFrame, **how) -> DataFrame:
    """Spans that the patterns don't hold and the contexts give: row, doc_id, h, s, e, kind, each once."""
    patterns, known = bootstrapped(seen, **how)
    free = seen.where("kind IS NULL").select("row", "doc_id", "h", "s", "e", "v", F.explode("patterns").alias("pattern"))
    found = free.join(patterns.select("pattern", "kind"), "pattern").join(known.select("v", "kind"), ["v", "kind"])
    return found.groupBy("row", "doc_id", "h", "s", "e").agg(F.min("kind").alias("kind"))


_ORDER = f"array_sort(transform({{}}, x -> struct(x.s AS s, array_position(array{KINDS}, x.kind) AS k, x.e AS e)))"
_LIST = f"array_join(transform({{}}, x -> concat_ws(':', element_at(array{KINDS}, int(x.k)), x.s, x.e)), ',')"


def _spans(scan: DataFrame, **how) -> DataFrame:
    """row, doc_id, h, s, e, kind, base: all spans of scanned texts."""
    seen = occurrences(scan)
    columns = ["row", "doc_id", "h", "s", "e", "kind"]
    matches = seen.where("kind IS NOT NULL").select(*columns, F.lit(True).alias("base"))
    return matches.unionByName(added(seen, **how).select(*columns, F.lit(False).alias("base")))


def find(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, base (matches), spans (matches and added spans): arrays of s, e, k, in order; base_list and span_list.

    k numbers the kind from 1. The lists write each span as kind:start:end.
    """
    scan = scanned(docs, id_column=id_column, text=text)
    span = F.struct("s", "e", "kind")
    lists = _spans(scan, **how).groupBy("row").agg(F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(span).alias("spans"))  # of one text
    none = "CAST(array() AS array<struct<s: int, e: int, kind: string>>)"
    rows = scan.select("row", "doc_id").join(lists, "row", "left")
    rows = rows.select("doc_id", *[F.expr(_ORDER.format(f"coalesce({c}, {none})")).alias(c) for c in ("base", "spans")])
    return rows.select("*", F.expr(_LIST.format("base")).alias("base_list"), F.expr(_LIST.format("spans")).alias("span_list"))


def _key(doc_id: Column, h: Column) -> list[Column]:
    return [F.isnull(doc_id).alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), h.alias("h")]


def _unions(spans: DataFrame) -> DataFrame:
    """From spans (_KEY, s, e, kind): their unions, in order, named after the first of each: _KEY, s, e, kind."""
    order = Window.partitionBy(*_KEY).orderBy("s", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("new", F.coalesce(F.col("s") >= F.max("e").over(before), F.lit(True)))
    spans = spans.withColumn("u", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*_KEY, "u").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("new"), F.col("kind"))).alias("kind")).drop("u")


def mask(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, with their columns; in the text each span is replaced by its kind, as in <EMAIL>.

    A text is gone through in blocks of CUT characters, each with what covers it.
    """
    spans = _spans(scanned(docs, id_column=id_column, text=text), **how)
    spans = _unions(spans.select(*_key(F.col("doc_id"), F.col("h")), "s", "e", "kind").distinct())
    blocks = F.explode(F.sequence(F.floor(F.col("s") / CUT), F.floor((F.col("e") - 1) / CUT))).alias("b")
    parts = spans.select(*_KEY, "s", "e", "kind", blocks)
    start = F.col("b") * CUT
    part = F.struct(
        F.greatest(F.col("s") - start, F.lit(0)).cast("int").alias("s"), F.least(F.col("e") - start, F.lit(CUT)).cast("int").alias("e"),
        F.when(F.col("s") >= start, F.concat(F.lit("<"), F.upper("kind"), F.lit(">"))).otherwise("").alias("name"),
    )
    parts = parts.groupBy(*_KEY, F.col("b").cast("int").alias("b")).agg(F.sort_array(F.collect_list(part)).alias("parts"))  # CUT at most
    parts = parts.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("b", "parts"))).alias("by_block"))  # of one text
    doc_id, t = F.col(f"`{id_column}`"), text_of(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_key(doc_id, F.xxhash64(t)), t.alias("t"))
    rows = rows.join(parts, _KEY, "left")
    # From left to right: what lies between the spans of a block, and their names.
    block = """aggregate(concat(by_block[b], array(struct(length(chunk) AS s, length(chunk) AS e, '' AS name))), struct(0 AS at, '' AS out),
          (a, x) -> struct(x.e AS at, concat(a.out, substr(chunk, a.at + 1, x.s - a.at), x.name) AS out), a -> a.out)"""
    clean = F.expr(
        f"""CASE WHEN by_block IS NULL THEN t ELSE array_join(transform(regexp_extract_all(t, '(?s).{{1,{CUT}}}', 0),
          (chunk, b) -> CASE WHEN by_block[b] IS NULL THEN chunk ELSE {block} END), '') END"""
    )
    rows = rows.select("doc", F.when(F.isnull(F.col("doc").getField(text)), F.lit(None)).otherwise(clean).alias("clean"))
    return rows.select(*[F.col("clean").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])


def recounted(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with n_chars, if it is a column, counted anew (null for a null text)."""
    if n_chars not in docs.columns:
        return docs
    kind = docs.schema[n_chars].dataType
    return docs.withColumn(n_chars, F.length(f"`{text}`").cast(kind))
