"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import chat, codes, fingerprints, likelihood, mixing, packing, pii, quality, ranking, simhash, substrings, toxicity, vectors
from loomery.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k + 1)).cast("long").alias(f"n_{pii.BASE[k]}")
    return rows.select("doc_id", *[count(k) for k in range(len(pii.BASE))], F.sha2("base_list", 256).alias("base_sha256"), F.col("span_list").alias("spans"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.scores(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compared(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.written_out("signature").alias("fingerprint"),
        fingerprints.written_out("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(*chat.as_calls(table(spark, sf_dir, "conversations")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")))
    base_failed = F.col("failed").bitwiseAND(quality.mask("base")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), "n_lines", "n_upper", "n_doubled", "failed",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to documents, from the ledger's bits."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classified(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"), "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"quality_ablation": quality_ablation}


WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
s AS (SELECT r, i FROM g JOIN (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
n AS (SELECT r, count(DISTINCT i + j) AS n FROM s, generate_series(0, 7) AS o(j) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
    len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_doubled
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) AS d LEFT JOIN n USING (r)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
  + 8 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT + 16 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT
  + 32 * (10 * n_upper > 4 * word_chars)::INT + 64 * (10 * n_doubled > 5 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, failed = 0 AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper, CAST(n_doubled AS BIGINT) AS n_doubled, failed
FROM f"""
#: Each version of the policy with its rules' bits, written out; masks are their sums.
ABLATION = f"""WITH q AS ({QUALITY}), c AS (SELECT failed, count(*) AS n FROM q GROUP BY failed),
p(policy, rule, bit, mask) AS (VALUES ('base', 'few_words', 1, 3), ('base', 'repeated_windows', 2, 3),
  ('v1', 'few_words', 1, 15), ('v1', 'repeated_windows', 2, 15), ('v1', 'symbols', 4, 15), ('v1', 'word_length', 8, 15),
  ('v2', 'few_words', 1, 127), ('v2', 'repeated_windows', 2, 127), ('v2', 'symbols', 4, 127), ('v2', 'word_length', 8, 127),
  ('v2', 'repeated_lines', 16, 127), ('v2', 'upper_case', 32, 127), ('v2', 'doubled_words', 64, 127))
SELECT policy, rule, CAST(coalesce(sum(n) FILTER (failed & bit <> 0), 0) AS BIGINT) AS n_failed, CAST(coalesce(sum(n) FILTER (failed & mask = bit), 0) AS BIGINT) AS n_failed_alone,
  CAST(coalesce(sum(n) FILTER (failed & mask = 0), 0) AS BIGINT) AS n_kept, CAST(coalesce(sum(n) FILTER (failed & (mask - bit) = 0), 0) AS BIGINT) AS n_kept_without
FROM c, p GROUP BY policy, rule"""


GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND {GOOD.replace("embedding", "x")} AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM g AS a JOIN g AS b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
c AS (SELECT r, r AS o FROM g UNION SELECT c.r, l.b FROM c JOIN l ON c.o = l.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a),
m AS (SELECT c.r, min(v.vec_id) AS m FROM c JOIN v ON v.r = c.o GROUP BY c.r)
SELECT vec_id, coalesce(n.n, 0) AS n_links, CASE WHEN m.r IS NULL THEN vec_id ELSE m.m END AS component_id,
  vec_id IS NOT DISTINCT FROM CASE WHEN m.r IS NULL THEN vec_id ELSE m.m END AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = f"""
WITH q AS (SELECT item_id, i, unnest({TERMS}) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
d AS (SELECT r, doc_id, {TERMS} AS terms FROM (SELECT *, row_number() OVER () AS r FROM documents)),
s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (SELECT r, doc_id, term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * p.n * s.n) // s.l)))) AS part FROM p JOIN w USING (term), s),
y AS (SELECT i, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY i, item_id, r, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS INTEGER) AS rank, doc_id, score FROM y
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) <= 20"""


def _vector_codes() -> str:
    """Four rounds written out: a0 to a4 are the assignments, b0 to b4 the codebooks."""
    steps = []
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, part, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
  FROM p JOIN b{k} AS b USING (part) GROUP BY r, part)""")
        if k < 4:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.v, b.v) AS v FROM b{k} AS b LEFT JOIN (
  SELECT part, e, list(c ORDER BY i) AS v FROM (SELECT part, e, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c
    FROM (SELECT part, m.e AS e, unnest(p.v) AS c, generate_subscripts(p.v, 1) AS i FROM a{k} JOIN p USING (r, part)) GROUP BY part, e, i) GROUP BY part, e) AS n USING (part, e))""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {GOOD}),
p AS MATERIALIZED (SELECT r, vec_id, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] AS v FROM k, range(4) AS t(part)),
b0 AS MATERIALIZED (SELECT part, e, v FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, v) - 1 AS e, v FROM p) WHERE e < 256),
{', '.join(steps)},
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, i)) AS h FROM (SELECT part, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256, label FROM k JOIN c USING (r), h"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
s AS (SELECT r, i FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
p AS (SELECT r, list(DISTINCT i + j) AS gone FROM s, generate_series(0, 34) AS o(j) GROUP BY r),
k AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)
  ANTI JOIN (SELECT r, unnest(gone) AS i FROM p) AS q USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
        "op6_chat_formatting": r"""
WITH m AS (
  SELECT conv_id, turn, role, text, coalesce(text, '') AS t, 'u' || turn AS me, 'u' || (turn - 1) AS asked, 'u' || (turn - 2) AS needs
  FROM conversations),
c AS (
  SELECT *, CASE WHEN length(t) < 100 THEN 'expand' ELSE 'reply' END AS name, len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    CASE WHEN contains(t, chr(10)) THEN length(t) - length(replace(t, chr(10), '')) + 1 END AS lines
  FROM m WHERE role = 'user'),
chain AS (SELECT conv_id, turn, turn - 2 * (row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) - 1) AS start FROM c),
lv AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, start ORDER BY turn) - 1 AS level FROM chain),
calls AS (
  SELECT c.*, lv.level, a.turn IS NOT NULL AS linked,
    CASE WHEN name = 'expand' AND lines IS NOT NULL THEN ['unknown lines'] WHEN name = 'reply' AND lines IS NULL THEN ['missing lines'] ELSE CAST([] AS VARCHAR[]) END AS errors
  FROM c JOIN lv USING (conv_id, turn) LEFT JOIN m AS a ON a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn = c.turn + 1)
SELECT conv_id, turn, 'assistant' AS role, CAST(1 AS BIGINT) AS n_calls, CAST(linked AS BIGINT) AS n_linked, CAST(len(errors) = 0 AS BIGINT) AS n_valid, 'calls' AS status, CAST(level AS INTEGER) AS level,
  '{"content":null,"role":"assistant","tool_calls":[{"arguments":{' || coalesce('"lines":' || lines || ',', '') || '"words":' || words || '},"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"id":"' || me
  || '","level":' || CASE WHEN linked THEN CAST(level AS VARCHAR) ELSE 'null' END || ',"name":"' || name || '","status":"' || CASE WHEN linked THEN 'linked' ELSE 'open' END || '"}]}' AS line
FROM calls
UNION ALL
SELECT m.conv_id, m.turn, 'tool', 0, 0, 0, CASE WHEN lv.turn IS NULL THEN 'orphan' ELSE 'linked' END, CAST(coalesce(lv.level + 1, -1) AS INTEGER),
  CAST(to_json({'content': text, 'role': 'tool', 'tool_call_id': asked}) AS VARCHAR)
FROM m LEFT JOIN lv ON lv.conv_id = m.conv_id AND lv.turn = m.turn - 1 WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, role, 0, 0, 0, 'plain', 0, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) FROM m WHERE role NOT IN ('user', 'assistant')""",
        "op8_quality_rules": QUALITY,
        "op11_embedding_dedup": EMBEDDING_DEDUP,
        "op12_ranked_search": RANKED,
        "op13_vector_codes": _vector_codes(),
        "quality_ablation": ABLATION,
    }
