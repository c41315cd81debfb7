"""Queries over streams, adapters, listings and records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import shards
from loomery.sources import adapters, sinks, tables
from loomery.sources.tables import table

QUERIES, ORACLE = {}, {}
SIZE, MOST, LENGTH, BACK, WINDOWS = 4096, 1_500_000, 64, 200, 20


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, strlen(text) + 1 AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS fill, false AS ended
UNION ALL SELECT d.k, d.doc_id, d.n, w.start + w.n, CASE WHEN w.fill > 0 AND w.fill + d.n > {SIZE} THEN shard + 1 ELSE shard END,
  CASE WHEN w.fill > 0 AND w.fill + d.n > {SIZE} THEN d.n ELSE w.fill + d.n END, d.n <= {SIZE} AND w.start + w.n + d.n >= {MOST} FROM w JOIN d ON d.k = w.k + 1 WHERE NOT w.ended)
SELECT doc_id, n, start, shard FROM w WHERE k > 0""")
def shard_stream(spark: SparkSession, d: str) -> DataFrame:
    return shards.cut_stream(table(spark, d, "documents"), SIZE, MOST)


@query(f"""WITH m AS (SELECT event_id AS at_, event_type AS state FROM events WHERE event_type IN ('signup', 'error')), w AS (SELECT DISTINCT event_id // {LENGTH} + 1 AS window_id FROM events UNION SELECT max(event_id + {BACK}) // {LENGTH} FROM events
UNION SELECT max(event_id) // {LENGTH} + 2 FROM events UNION SELECT max(event_id) // {LENGTH} + 3 FROM events)
SELECT window_id, arg_max(state, at_) AS state FROM w JOIN m ON at_ < window_id * {LENGTH} AND at_ >= window_id * {LENGTH} - {BACK} GROUP BY window_id""")
def look_back(spark: SparkSession, d: str) -> DataFrame:
    """What was said last before each window of a stream of events."""
    markers = table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    return shards.state_before(markers.select(F.col("event_id").alias("at"), F.col("event_type").alias("state")), LENGTH, BACK)


@query(f"""WITH o AS (SELECT doc_id, strlen(text) + 1 AS n, sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1 AS start FROM documents)
SELECT CAST(k AS BIGINT) AS window_id, doc_id, CAST(least((k + 1) * {SIZE}, start + n) - greatest(k * {SIZE}, start) AS BIGINT) AS n_tokens
FROM o, LATERAL (SELECT unnest(generate_series(CAST(start // {SIZE} AS BIGINT), CAST((start + n - 1) // {SIZE} AS BIGINT))) AS k) WHERE k < {WINDOWS}""")
def evaluation_windows(spark: SparkSession, d: str) -> DataFrame:
    """The fixed windows of every evaluation: their documents and tokens of each."""
    return shards.evaluation_slice(shards.pieces(table(spark, d, "documents"), SIZE), WINDOWS).select("window_id", "doc_id", "n_tokens")


TURNS = "t AS (SELECT conv_id, list(text ORDER BY turn) AS said, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))  # one conversation
    return rows.withColumn("data", F.transform("m", lambda x: x.text)).withColumn("conversation", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))))


@query(f"""WITH {TURNS} SELECT array_to_string([CASE WHEN i % 2 = 1 THEN 'USER: ' ELSE 'ASSISTANT: ' END || said[i] FOR i IN generate_series(1, len(said))], chr(10)) AS text FROM t""")
def adapter_alternating(spark: SparkSession, d: str) -> DataFrame:
    return adapters.alternating(_turns(spark, d))


@query(f"""WITH {TURNS} SELECT array_to_string([CASE WHEN roles[i] = 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || said[i] FOR i IN generate_series(1, len(said)) IF said[i] <> ''], chr(10)) AS text FROM t WHERE conv_id % 3 > 0""")
def adapter_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumn("language", F.when(F.col("conv_id") % 3 > 0, "English").otherwise("German"))
    return adapters.messages(rows)


@query("""SELECT 'USER: ' || q || chr(10) || 'ASSISTANT: ' || text AS text FROM (SELECT CASE WHEN item_id % 5 = 0 THEN '' ELSE 'item ' || item_id END AS q, text FROM benchmark) WHERE q <> '' AND text <> ''""")
def adapter_question_answer(spark: SparkSession, d: str) -> DataFrame:
    question = F.when(F.col("item_id") % 5 == 0, "").otherwise(F.concat(F.lit("item "), F.col("item_id").cast("string")))
    return adapters.question_answer(table(spark, d, "benchmark").withColumn("question", question), response="text")


@query(f"""WITH {TURNS} SELECT trim(string_agg(CASE WHEN i % 2 = 1 THEN chr(10) || 'USER: ' ELSE chr(10) || 'ASSISTANT: ' END || said[i], '' ORDER BY i), chr(10) || ' ') AS text
FROM (SELECT conv_id, said, unnest(generate_series(1, len(said))) AS i FROM t) GROUP BY conv_id""")
def adapter_human_assistant(spark: SparkSession, d: str) -> DataFrame:
    said = F.transform("data", lambda x, i: F.concat(F.when(i % 2 == 0, "\n\nHuman: ").otherwise("\n\nAssistant: "), x))
    return adapters.human_assistant(_turns(spark, d).select(F.array_join(said, "").alias("chosen")))


@query("SELECT text FROM documents WHERE text <> ''")
def adapter_plain(spark: SparkSession, d: str) -> DataFrame:
    return adapters.plain(table(spark, d, "documents"))


#: Records of downloads, from documents: an old one and its update, in which every third source has a new revision.
RECORDS = """s AS (SELECT source, count(*) AS n, ascii(right(source, 1)) AS a, CAST(sum(n_chars) AS DOUBLE) AS chars FROM documents GROUP BY source),
old AS (SELECT source, '1' AS revision, chars / 2 AS source_tokens, 1 AS n_files, a FROM s),
new AS (SELECT source, CASE WHEN a % 3 = 0 THEN '2' ELSE '1' END AS revision, CASE WHEN a % 4 = 1 THEN NULL ELSE chars / (1 + a % 4) END AS source_tokens, 2 + a % 2 AS n_files, a FROM s WHERE a % 5 > 0)"""


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("chars")).withColumn("a", F.ascii(F.right("source", F.lit(1))))
    of = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat("source", F.lit("/"), i.cast("string")))
    old = s.select("source", F.lit("1").alias("revision"), (F.col("chars") / 2).alias("source_tokens"), of(F.lit(1)).alias("files"))
    tokens = F.when(F.col("a") % 4 != 1, F.col("chars") / (1 + F.col("a") % 4))
    new = s.where(F.col("a") % 5 > 0).select("source", F.when(F.col("a") % 3 == 0, "2").otherwise("1").alias("revision"), tokens.alias("source_tokens"), of(2 + F.col("a") % 2).alias("files"))
    return old, new


@query(f"""WITH {RECORDS} SELECT o.source, coalesce(n.revision, '1') AS revision,
CASE WHEN n.source IS NULL THEN o.source_tokens WHEN n.revision = '2' OR n.source_tokens IS NULL THEN n.source_tokens ELSE greatest(o.source_tokens, n.source_tokens) END AS source_tokens,
CAST(coalesce(n.n_files, 1) AS INTEGER) AS n_files FROM old o LEFT JOIN new n USING (source)""")
def download_records(spark: SparkSession, d: str) -> DataFrame:
    return sinks.merged_records(*_records(spark, d)).select("source", "revision", "source_tokens", F.size("files").alias("n_files"))


@query(f"WITH {RECORDS} SELECT n.source, n.source_tokens, s.chars / 2 AS need FROM new n JOIN s USING (source) WHERE n.source_tokens < 0.999 * s.chars / 2")
def short_downloads(spark: SparkSession, d: str) -> DataFrame:
    _, new = _records(spark, d)
    need = table(spark, d, "documents").groupBy("source").agg((F.sum("n_chars").cast("double") / 2).alias("need"))
    return sinks.short_of_need(new.join(need, "source")).select("source", "source_tokens", "need")


@query("""SELECT source || '/' || doc_id AS path, n_chars AS size FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 11 = 0 AND n_chars > 0)""")
def listing_short_files(spark: SparkSession, d: str) -> DataFrame:
    """Recorded files that are missing (every seventh) or of another size (every eleventh)."""
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    present = docs.where("doc_id % 7 > 0").select(path, F.when(F.col("doc_id") % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"))
    return tables.short_files(docs.select(path, F.col("n_chars").alias("size")), present).select("path", "size")
