"""Queries over exact mixes and tokens of more than a byte, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import tokens
from loomery.operators import chats, masks, mixed, schedule
from loomery.sources import adapters
from loomery.sources.tables import table

QUERIES, ORACLE = {}, {}
#: Weights in hundredths, passes over small sources, and tokens between two marks.
WEIGHTS, EPOCHS, EVERY = {"de": 28, "en": 42, "es": 12, "fr": 18}, {"es": 2}, 50_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The greedy walk, one pick (or one source found dry) a step: s is what each source has served, alive which are left.
PICKS = f"""
WITH RECURSIVE e AS (SELECT lang, pass, doc_id, strlen(text) + 1 AS n FROM documents, range(2) AS p(pass) WHERE lang IN {tuple(WEIGHTS)} AND (pass = 0 OR lang = 'es')),
d AS MATERIALIZED (SELECT list_position({sorted(WEIGHTS)}, lang) AS k, lang, pass, doc_id, n,
  CAST(coalesce(sum(n) OVER (PARTITION BY lang ORDER BY pass, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM e),
r AS (
  SELECT CAST(-1 AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS pass, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_,
    [CAST(0 AS BIGINT), 0, 0, 0] AS s, [true, true, true, true] AS alive
  UNION ALL
  SELECT CASE WHEN d.k IS NULL THEN c.position ELSE c.position + 1 END, d.lang, d.doc_id, d.pass, coalesce(d.n, 0), CAST(list_sum(c.s) AS BIGINT),
    list_transform(c.s, lambda x, i: CASE WHEN i = c.best THEN x + coalesce(d.n, 0) ELSE x END), list_transform(c.alive, lambda x, i: x AND NOT (i = c.best AND d.k IS NULL))
  FROM (
    SELECT *, list_position(behind, list_max(behind)) AS best FROM (
      SELECT *, list_transform({[WEIGHTS[k] for k in sorted(WEIGHTS)]}, lambda w, i: CASE WHEN alive[i] THEN
        w * list_sum(list_transform(s, lambda x, j: CASE WHEN alive[j] THEN x ELSE 0 END))
        - s[i] * list_sum(list_transform({[WEIGHTS[k] for k in sorted(WEIGHTS)]}, lambda v, j: CASE WHEN alive[j] THEN v ELSE 0 END)) END) AS behind
      FROM r WHERE list_contains(alive, true))) AS c
  LEFT JOIN d ON d.k = c.best AND d.before = c.s[c.best])"""


@query(PICKS + " SELECT position, lang, doc_id, CAST(pass AS INTEGER) AS pass, n, at_ AS at FROM r WHERE doc_id IS NOT NULL")
def mixed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The exact mix of documents by largest deficit."""
    return mixed.mixed_stream(table(spark, d, "documents"), WEIGHTS, epochs=EPOCHS)


@query(
    PICKS
    + f""", m AS (SELECT lang, at_ // {EVERY} AS mark, sum(n) AS tokens, count(*) AS n_docs FROM r WHERE doc_id IS NOT NULL GROUP BY lang, mark)
SELECT lang, CAST(mark AS BIGINT) AS mark, n_docs, CAST(sum(tokens) OVER (PARTITION BY lang ORDER BY mark) AS BIGINT) AS served FROM m"""
)
def mixed_shares(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source served by each mark of the exact mix."""
    return mixed.served_shares(mixed_stream(spark, d), EVERY)


#: A public vocabulary; its folder is a parameter. Bytes a token and tokens a piece in the check of masks, tokens a piece else.
VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
WIDTH, PIECE, WINDOW = 3, 40, 1024


@query("""SELECT doc_id, sha256(text) AS decoded_sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents""")
def bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each text after encoding and decoding, and the bytes of its tokens: all of it."""
    vocabulary = tokens.read_vocabulary(VOCABULARY)
    rows = table(spark, d, "documents").select("doc_id", tokens.encoded(F.col("text"), vocabulary).alias("ids"))
    n_bytes = F.aggregate(tokens.lengths(F.col("ids"), vocabulary), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("doc_id", F.sha2(tokens.decoded(F.col("ids"), vocabulary), 256).alias("decoded_sha256"), n_bytes.alias("n_bytes"))


@query()
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    """Each text's number of tokens, and the tokens by a digest, with a public vocabulary."""
    ids = tokens.encoded(F.col("text"), tokens.read_vocabulary(VOCABULARY))
    rows = table(spark, d, "documents").select("doc_id", "source", ids.alias("ids"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


#: Tokens of WIDTH bytes. p has each mark's place in bytes, w goes from mark to mark: those that begin in a token of the one before are passed over.
MASKS = f"""
WITH RECURSIVE t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || text, chr(10) ORDER BY turn) AS t FROM conversations WHERE role <> 'system' GROUP BY conv_id),
b AS (SELECT conv_id, hex(encode(t)) AS x, strlen(t) AS n FROM t),
q AS (SELECT conv_id, piece, n, x[2 * {WIDTH * PIECE} * piece + 1:2 * {WIDTH * PIECE} * (piece + 1)] AS x, least({WIDTH * PIECE}, n - {WIDTH * PIECE} * piece) AS bytes
  FROM b, LATERAL (SELECT unnest(generate_series(0, greatest(0, (n - 1) // {WIDTH * PIECE}))) AS piece)),
m AS MATERIALIZED (SELECT conv_id, piece, at_ // 2 // {WIDTH} AS first, (at_ // 2 + size - 1) // {WIDTH} + 1 AS after, learnt, row_number() OVER (PARTITION BY conv_id, piece ORDER BY at_) AS k FROM (
  SELECT conv_id, piece, i AS at_, CASE WHEN x[i + 1:i + 20] = '{b"ASSISTANT:".hex().upper()}' THEN 10 ELSE 5 END AS size, x[i + 1:i + 20] = '{b"ASSISTANT:".hex().upper()}' AS learnt
  FROM q, LATERAL (SELECT unnest(generate_series(0, 2 * bytes - 2, 2)) AS i) WHERE x[i + 1:i + 20] = '{b"ASSISTANT:".hex().upper()}' OR x[i + 1:i + 10] = '{b"USER:".hex().upper()}')),
w AS (SELECT conv_id, piece, k, true AS used, first, after, learnt FROM m WHERE k = 1 UNION ALL
  SELECT m.conv_id, m.piece, m.k, m.first >= w.after, m.first, CASE WHEN m.first >= w.after THEN m.after ELSE w.after END, CASE WHEN m.first >= w.after THEN m.learnt ELSE w.learnt END FROM w JOIN m ON m.conv_id = w.conv_id AND m.piece = w.piece AND m.k = w.k + 1),
u AS (SELECT conv_id, piece, first, after, learnt, lead(first) OVER (PARTITION BY conv_id, piece ORDER BY k) AS next FROM w WHERE used),
l AS (SELECT conv_id, piece, arg_max(learnt, first) AS last, min(first) AS head, sum(CASE WHEN learnt AND next IS NOT NULL THEN next - after ELSE 0 END) AS inner_, max(CASE WHEN next IS NULL AND learnt THEN after END) AS open_ FROM u GROUP BY conv_id, piece),
s AS (SELECT q.conv_id, q.piece, (bytes + {WIDTH - 1}) // {WIDTH} AS n_tokens, l.head, l.inner_, l.open_, coalesce(last_value(l.last IGNORE NULLS) OVER (PARTITION BY q.conv_id ORDER BY q.piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS state
  FROM q LEFT JOIN l USING (conv_id, piece))
SELECT conv_id, CAST(piece AS INTEGER) AS piece, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(CASE WHEN state THEN coalesce(head, n_tokens) ELSE 0 END + coalesce(inner_, 0) + coalesce(n_tokens - open_, 0) AS BIGINT) AS n_learnt FROM s"""


@query(MASKS)
def token_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    """Tokens learnt from in each piece of a conversation, by role marks, for tokens of three bytes."""
    rows = chats.user_assistant(table(spark, d, "conversations")).withColumn("n", F.octet_length("rendered"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / (WIDTH * PIECE)).cast("int") - 1))))
    rows = rows.select("conv_id", "piece", F.expr(f"substr(cast(rendered AS binary), {WIDTH * PIECE} * piece + 1, {WIDTH * PIECE})").alias("bytes"))
    size = F.octet_length("bytes")
    before = F.ceil(size / WIDTH).cast("int") - 1
    sizes = F.concat(F.array_repeat(F.lit(WIDTH), before), F.array(size - before * WIDTH))
    return masks.loss_masks(rows, "conv_id", "piece", F.col("bytes"), F.when(size > 0, sizes)).select("conv_id", "piece", "n_tokens", "n_learnt")


@query()
def bpe_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    """Tokens learnt from in each piece of a conversation, by role marks, with a public vocabulary."""
    vocabulary = tokens.read_vocabulary(VOCABULARY)
    rows = chats.user_assistant(table(spark, d, "conversations"))
    rows = masks.cut(rows.select("conv_id", tokens.encoded(F.col("rendered"), vocabulary).alias("ids")), "ids", WINDOW)
    # The bytes of a piece may begin or end within a letter.
    return masks.loss_masks(rows, "conv_id", "piece", tokens.joined_bytes(F.col("ids"), vocabulary), tokens.lengths(F.col("ids"), vocabulary)).select("conv_id", "piece", "n_tokens", "n_learnt")


MODELS = ["base", "tuned", "preferred"]


@query(f"""SELECT conv_id, model, CAST(s AS INTEGER) AS sample, s = 0 AS greedy FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest({MODELS}) AS model), range(3) AS t(s)""")
def generation_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is to be generated: each conversation with each model and sample."""
    return schedule.generations(table(spark, d, "conversations").select("conv_id").distinct(), MODELS, 2)


#: Messages of trees from conversations: a third of the turns answers an earlier one, and every seventh message is marked as deleted or blank.
NODES = """n AS (SELECT conv_id || '-' || lpad(turn::VARCHAR, 6, '0') AS message_id, CASE WHEN turn = 0 THEN NULL ELSE conv_id || '-' || lpad((CASE WHEN turn % 3 = 0 THEN turn - 3 ELSE turn - 1 END)::VARCHAR, 6, '0') END AS parent_id,
  CASE WHEN role = 'assistant' THEN role ELSE 'prompter' END AS role, CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN ' ' ELSE text END AS text, CASE WHEN conv_id % 9 = 0 THEN 'de' ELSE 'en' END AS lang,
  CASE WHEN turn % 4 = 1 THEN NULL ELSE CAST(ascii(md5(conv_id || ':' || turn)) AS DOUBLE) END AS rank, conv_id % 5 = 0 AND turn = 3 AS deleted FROM conversations)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    name = lambda turn: F.concat(F.col("conv_id"), F.lit("-"), F.lpad(turn.cast("string"), 6, "0"))
    turn, conv = F.col("turn"), F.col("conv_id")
    return table(spark, d, "conversations").select(
        name(turn).alias("message_id"), F.when(turn > 0, name(F.when(turn % 3 == 0, turn - 3).otherwise(turn - 1))).alias("parent_id"),
        F.when(F.col("role") == "assistant", "assistant").otherwise("prompter").alias("role"), F.when((conv % 7 == 3) & (turn == 2), " ").otherwise(F.col("text")).alias("text"),
        F.when(conv % 9 == 0, "de").otherwise("en").alias("lang"), F.when(turn % 4 == 1, None).otherwise(F.ascii(F.md5(F.concat_ws(":", "conv_id", "turn"))).cast("double")).alias("rank"), ((conv % 5 == 0) & (turn == 3)).alias("deleted"),
    )


@query(f"""WITH RECURSIVE {NODES},
e AS (SELECT parent_id, arg_min(message_id, (rank IS NULL, coalesce(rank, 0), message_id)) AS message_id FROM n WHERE lang = 'en' AND parent_id IS NOT NULL GROUP BY parent_id),
t AS (SELECT message_id AS root, 0 AS depth, message_id FROM n WHERE lang = 'en' AND parent_id IS NULL UNION ALL SELECT t.root, t.depth + 1, e.message_id FROM t JOIN e ON e.parent_id = t.message_id)
SELECT root, string_agg(CASE WHEN role = 'prompter' THEN 'USER: ' ELSE 'ASSISTANT: ' END || text, chr(10) ORDER BY depth) AS text FROM t JOIN n USING (message_id) GROUP BY root""")
def adapter_ranked_threads(spark: SparkSession, d: str) -> DataFrame:
    """Best-ranked threads, as the older loader takes them."""
    return adapters.ranked_threads(_nodes(spark, d))


@query(f"""WITH RECURSIVE {NODES}, g AS (SELECT * FROM n WHERE lang = 'en' AND NOT deleted),
e AS (SELECT parent_id, role, arg_min(message_id, (coalesce(rank, 1e9), message_id)) AS message_id FROM g WHERE parent_id IS NOT NULL GROUP BY parent_id, role),
t AS (SELECT message_id AS root, 0 AS depth, message_id, role FROM g WHERE parent_id IS NULL AND role = 'prompter' UNION ALL SELECT t.root, t.depth + 1, e.message_id, e.role FROM t JOIN e ON e.parent_id = t.message_id AND e.role <> t.role),
k AS (SELECT * FROM (SELECT *, max(depth) OVER (PARTITION BY root) AS m FROM t) WHERE m >= 1 AND (depth < m OR role = 'assistant'))
SELECT string_agg(CASE WHEN k.role = 'prompter' THEN 'USER: ' ELSE 'ASSISTANT: ' END || text, chr(10) ORDER BY depth) AS text FROM k JOIN n USING (message_id) GROUP BY root HAVING bool_and(trim(text) <> '')""")
def adapter_threads(spark: SparkSession, d: str) -> DataFrame:
    """Best-ranked threads in which roles take turns, none of whose messages is deleted or blank."""
    return adapters.threads(_nodes(spark, d))
