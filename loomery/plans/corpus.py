"""Queries over documents: filters, mixing, budgets, shards and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import filters, mix, schedule, shards
from loomery.operators.order import shuffle_key
from loomery.sources.tables import table

WEIGHTS = {"en": 0.42, "de": 0.28, "fr": 0.18, "es": 0.12}
BUDGET, LENGTH, SHARD, SEED = 250_000, 4096, 65_536, 7
EPOCHS = {"es": 3, "de": 2}
SHARES = [3, 1, 2]

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


CASE_WEIGHT = "CASE lang " + " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in WEIGHTS.items()) + " END"
STRIDE = f"""
WITH d AS (SELECT doc_id, lang, strlen(text) + 1 AS n, md5('{SEED}:' || doc_id) AS shuffled, {CASE_WEIGHT} AS w FROM documents WHERE lang IN {tuple(WEIGHTS)}),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY shuffled, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / w AS stride FROM d)"""
NUMBERED = "row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1"
START = "CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
PIECES = f"""
o AS (SELECT doc_id, strlen(text) + 1 AS n, {START} AS start FROM documents),
p AS (SELECT CAST(k AS BIGINT) AS window_id, doc_id, greatest(k * {LENGTH}, start) - k * {LENGTH} AS place, greatest(k * {LENGTH}, start) - start AS first,
  least((k + 1) * {LENGTH}, start + n) - greatest(k * {LENGTH}, start) AS n_tokens
  FROM o, LATERAL (SELECT unnest(generate_series(start // {LENGTH}, (start + n - 1) // {LENGTH})) AS k))"""


@query(STRIDE + " SELECT doc_id, lang, CAST(n AS BIGINT) AS n, round(stride, 6) AS stride FROM s")
def mix_stride_order(spark: SparkSession, d: str) -> DataFrame:
    return mix.stride_order(table(spark, d, "documents"), WEIGHTS).select("doc_id", "lang", "n", F.round("stride", 6).alias("stride"))


@query(
    STRIDE
    + f""", b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY stride, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
g AS (SELECT lang, sum(n) AS tokens, count(*) AS n_rows, any_value(w) AS w FROM b WHERE before < {BUDGET} GROUP BY lang)
SELECT lang, CAST(tokens AS BIGINT) AS tokens, n_rows, round(CAST(100 AS DOUBLE) * tokens / sum(tokens) OVER (), 6) AS pct, round(100 * w / {sum(WEIGHTS.values())}, 6) AS target,
  abs(round(CAST(100 AS DOUBLE) * tokens / sum(tokens) OVER (), 6) - round(100 * w / {sum(WEIGHTS.values())}, 6)) > 2 AS off_target FROM g"""
)
def mix_share_report(spark: SparkSession, d: str) -> DataFrame:
    taken = mix.take_budget(mix.stride_order(table(spark, d, "documents"), WEIGHTS), BUDGET)
    return mix.share_report(taken, WEIGHTS)


@query("SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens, count(*) AS n_rows FROM documents GROUP BY source")
def tokens_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(mix.n_tokens()).alias("tokens"), F.count("*").alias("n_rows"))


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, round(CAST(sum(length(text)) AS DOUBLE) / sum(sum(length(text))) OVER (), 9) AS share FROM documents GROUP BY source")
def char_share(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    total = per.agg(F.sum("chars").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("source", "chars", F.round(F.col("chars") / F.col("total"), 9).alias("share"))


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY k, source) - 1 AS BIGINT) AS position FROM (SELECT doc_id, source, {NUMBERED} AS k FROM documents)")
def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    return mix.round_robin(table(spark, d, "documents")).select("doc_id", "position")


@query("SELECT doc_id, lang, CAST(e AS INT) AS epoch FROM documents, LATERAL (SELECT unnest(generate_series(0, CASE lang WHEN 'es' THEN 2 WHEN 'de' THEN 1 ELSE 0 END)) AS e)")
def epoch_repeat(spark: SparkSession, d: str) -> DataFrame:
    return mix.repeated(table(spark, d, "documents"), EPOCHS).select("doc_id", "lang", "epoch")


@query(f"""SELECT doc_id, source, CAST(k AS BIGINT) AS seq FROM (SELECT doc_id, source, {NUMBERED} AS k, count(*) OVER (PARTITION BY source) AS c FROM documents)
WHERE k >= CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN c // 2 ELSE 0 END""")
def continuation_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    taken = docs.where(F.ascii(F.right("source", F.lit(1))) % 2 == 0).groupBy("source").agg(F.floor(F.count("*") / 2).alias("taken"))
    return mix.continued(docs, taken).select("doc_id", "source", "seq")


@query("""SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality >= 1 AND coalesce(lang NOT IN ('de'), true) AND coalesce(toxic NOT IN (1), true)""")
def row_filter_min_exclude(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.where(filters.row_filter({"quality": 1}, {"lang": ["de"], "toxic": [1]})).select("doc_id", "lang", "quality", "toxic")


@query("""SELECT source, CAST(count(*) FILTER (quality >= 1 AND text <> '') AS BIGINT) AS n_kept, count(*) AS n_drawn, CAST(trunc(median(length(text)) FILTER (quality >= 1 AND text <> '')) AS BIGINT) AS median_chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def source_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kept = filters.row_filter({"quality": 1}) & filters.has_text()
    return rows.groupBy("source").agg(F.count_if(kept).alias("n_kept"), F.count("*").alias("n_drawn"), F.floor(F.median(F.when(kept, F.length("text")))).alias("median_chars"))


@query("SELECT DISTINCT d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l USING (doc_id) WHERE x.source = d.source AND l.toxic = 1)")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    produced = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return filters.never_seen(docs.select("source").distinct(), produced)


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, '')) AS label FROM documents")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("given", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")))
    return docs.select("doc_id", filters.source_label("given", "source").alias("label"))


@query("""SELECT source, doc_id, CAST(before AS BIGINT) AS before FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER
(PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000""")
def char_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return mix.char_prefix(table(spark, d, "documents"), 20_000, ["source"]).select("source", "doc_id", "before")


@query("""WITH f AS (SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS size FROM documents GROUP BY lang, source),
g AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY lang ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(size) OVER (PARTITION BY lang) AS total FROM f)
SELECT lang, source, size FROM g WHERE 5 * before < 2 * total OR before = 0""")
def file_prefix_choice(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size"))
    total = files.groupBy("lang").agg(F.sum("size").alias("total"))
    return mix.file_prefix(files.join(total, "lang"), F.col("total") * 2 / 5, "lang", "source").select("lang", "source", "size")


@query(f"SELECT doc_id, shuffled FROM (SELECT doc_id, md5('{SEED}:' || doc_id) AS shuffled FROM documents) ORDER BY shuffled, doc_id LIMIT 100")
def seeded_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", shuffle_key(SEED, "doc_id").alias("shuffled"))
    return rows.orderBy("shuffled", "doc_id").limit(100)


@query("""SELECT lang, split, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1
< floor(CAST(0.9 AS DOUBLE) * count(*) OVER (PARTITION BY lang)) THEN 'train' ELSE 'val' END AS split FROM documents) GROUP BY lang, split""")
def split_90_10(spark: SparkSession, d: str) -> DataFrame:
    return mix.split_prefix(table(spark, d, "documents"), 0.9, ["lang"]).groupBy("lang", "split").agg(F.count("*").alias("n_rows"), F.sum("doc_id").alias("ids"))


@query("""SELECT lang, doc_id, md5(substr(text, 1, CAST(50000 - before AS BIGINT))) AS part_md5 FROM (SELECT *, coalesce(sum(length(text)) OVER
(PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 50000""")
def tokenizer_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = mix.char_prefix(table(spark, d, "documents"), 50_000, ["lang"], F.length("text"))
    return rows.select("lang", "doc_id", F.md5(F.substring("text", F.lit(1), (F.lit(50_000) - F.col("before")).cast("int"))).alias("part_md5"))


@query(f"""WITH RECURSIVE m AS (SELECT doc_id, strlen(text) + 1 AS n, doc_id // 1000 AS lane, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS r FROM documents),
c AS (SELECT doc_id, n, lane, r, CAST(0 AS BIGINT) AS shard, n AS fill FROM m WHERE r = 1
UNION ALL SELECT m.doc_id, m.n, m.lane, m.r,
  c.shard + CASE WHEN c.fill > {SHARD} OR c.fill + m.n > {SHARD} THEN 1 ELSE 0 END,
  CASE WHEN c.fill > {SHARD} OR c.fill + m.n > {SHARD} THEN m.n ELSE c.fill + m.n END
  FROM c JOIN m ON m.lane = c.lane AND m.r = c.r + 1)
SELECT doc_id, CAST(n AS BIGINT) AS n, lane, shard FROM c""")
def shard_next_fit(spark: SparkSession, d: str) -> DataFrame:
    return shards.cut_shards(table(spark, d, "documents"), SHARD)


@query("""WITH s AS (SELECT doc_id // 100 AS shard_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS n FROM documents GROUP BY 1)
SELECT split, count(*) AS n_shards, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY shard_id DESC) <= 2 THEN 'val' ELSE 'train' END AS split FROM s) GROUP BY split""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("shard_id")).agg(F.sum(mix.n_tokens()).alias("n"))
    return shards.hold_out(per, 2).groupBy("split").agg(F.count("*").alias("n_shards"), F.sum("n").alias("tokens"))


@query(f"SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n, CAST({START} AS BIGINT) AS start FROM documents")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return shards.offsets(table(spark, d, "documents"))


@query(f"""WITH s AS (SELECT doc_id // 100 AS shard_id, sum(strlen(text) + 1) AS n FROM documents GROUP BY 1),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT CAST(w.k AS BIGINT) AS window_id, o.shard_id, CAST(w.k * {LENGTH} - o.start AS BIGINT) AS "offset" FROM
(SELECT unnest(generate_series(0, CAST((SELECT sum(n) - 1 FROM s) AS BIGINT) // {LENGTH})) AS k) w ASOF JOIN o ON w.k * {LENGTH} >= o.start""")
def window_to_shard_asof(spark: SparkSession, d: str) -> DataFrame:
    rows = shards.offsets(table(spark, d, "documents"))
    spans = rows.groupBy(F.floor(F.col("doc_id") / 100).alias("shard_id")).agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    return shards.window_starts(spans, LENGTH)


@query(f"""WITH {PIECES.strip()},
w AS (SELECT window_id, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
  string_agg(substr(hex(text) || '00', CAST(first * 2 + 1 AS BIGINT), CAST(n_tokens * 2 AS BIGINT)), '' ORDER BY place) AS x FROM p JOIN documents USING (doc_id) GROUP BY window_id)
SELECT window_id, n_docs, n_tokens, md5(x) AS x_md5, substr(coalesce(lead(x) OVER (ORDER BY window_id), first_value(x) OVER (ORDER BY window_id)), 1, 2) AS next_token FROM w""")
def packed_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = shards.packed_windows(table(spark, d, "documents"), LENGTH)
    return rows.select("window_id", "n_docs", "n_tokens", F.md5("x").alias("x_md5"), "next_token")


@query(f"WITH {PIECES.strip()} SELECT window_id, doc_id, CAST(place AS BIGINT) AS place, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(row_number() OVER (PARTITION BY window_id ORDER BY place) - 1 AS INT) AS segment FROM p")
def segment_ids(spark: SparkSession, d: str) -> DataFrame:
    return shards.segments(table(spark, d, "documents"), LENGTH).select("window_id", "doc_id", "place", "n_tokens", "segment")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "documents").agg(F.sum(mix.n_tokens()).alias("total"))
    return total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / LENGTH))).alias("window_id"))


WINDOWS = f"(SELECT unnest(generate_series(0, CAST((SELECT sum(strlen(text) + 1) - 1 FROM documents) AS BIGINT) // {LENGTH})) AS k)"


@query(f"SELECT CAST(k AS BIGINT) AS window_id, CAST(k % 4 AS INT) AS rank FROM {WINDOWS}")
def rank_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("window_id", shards.rank_of(F.col("window_id"), [1, 1, 1, 1]).alias("rank"))


@query(f"SELECT CAST(k AS BIGINT) AS window_id, CASE WHEN k % 6 < 3 THEN 0 WHEN k % 6 < 4 THEN 1 ELSE 2 END AS rank FROM {WINDOWS}")
def rank_windows_unequal(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("window_id", shards.rank_of(F.col("window_id"), SHARES).alias("rank"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a step of a run."""
    return table(spark, d, "events").select(F.col("event_id").alias("step"))


@query("""WITH s AS (SELECT event_id AS step, CASE WHEN event_id < 300 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) * least(CAST(1 AS DOUBLE), (event_id - 300 + 1) / CAST(200 AS DOUBLE)) END AS f FROM events),
a AS (SELECT step, f, CAST(round_even(f * 9, 0) AS BIGINT) AS anneal FROM s)
SELECT step, round(f, 9) AS fraction, anneal, 9 - anneal AS main,
  CAST(coalesce(sum(anneal) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS anneal_at,
  CAST(coalesce(sum(9 - anneal) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS main_at FROM a""")
def anneal_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedule.anneal_blend(_steps(spark, d), batch=9, start=300, ramp=200, fraction=0.5)


@query("""SELECT step, CAST(p AS INT) AS place, CASE WHEN p < 6 THEN 'chat' ELSE 'plain' END AS stream, CASE WHEN p < 6 THEN step * 6 + p ELSE step * 2 + p - 6 END AS window_id
FROM (SELECT event_id AS step, p FROM events, range(8) b(p))""")
def replay_blend(spark: SparkSession, d: str) -> DataFrame:
    return schedule.replay_blend(_steps(spark, d), batch=8, fraction=0.25)


@query("""WITH s AS (SELECT event_id AS step, least(CAST(1 AS DOUBLE), (event_id - 800) / CAST(200 AS DOUBLE)) AS t, least(CAST(1 AS DOUBLE), (event_id - 100) / CAST(900 AS DOUBLE)) AS c FROM events),
b AS (SELECT *, CASE WHEN step < 100 THEN CAST(0.001 AS DOUBLE) * (step + 1) / 100 WHEN step < 800 THEN CAST(0.001 AS DOUBLE) END AS base FROM s)
SELECT step, round(coalesce(base, 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * t))), 12) AS cosine, round(coalesce(base, 0.0001 + 0.0009 * (1 - t)), 12) AS linear,
  round(coalesce(base, 0.0001 + 0.0009 * (1 - sqrt(greatest(t, 0)))), 12) AS sqrt, round(CASE WHEN step < 100 THEN CAST(0.001 AS DOUBLE) * (step + 1) / 100 ELSE CAST(0.001 AS DOUBLE) * (0.1 + 0.45 * (1 + cos(pi() * c))) END, 12) AS classic FROM b""")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    at, how = F.col("step"), {"total": 1000, "warmup": 100, "decay": 0.2, "peak": 0.001, "least": 0.1}
    shapes = {"cosine": "cosine", "linear": "linear", "sqrt": "1-sqrt"}
    rates = [F.round(schedule.warm_stable_decay(at, shape=s, **how), 12).alias(k) for k, s in shapes.items()]
    return _steps(spark, d).select("step", *rates, F.round(schedule.warm_cosine(at, total=1000, warmup=100, peak=0.001), 12).alias("classic"))


@query("""WITH s AS (SELECT source, sum(strlen(text) + 1) AS tokens, count(*) AS n_docs, max(doc_id) % 5 = 0 AS whole, CASE WHEN max(doc_id) % 3 = 0 THEN CAST(2 AS DOUBLE) END AS bytes_per_token FROM documents GROUP BY source),
w AS (SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS weight FROM s)
SELECT source, round(CASE WHEN NOT whole THEN weight * 1e9 * coalesce(bytes_per_token, 3.5) * 1.3 END, 3) AS need_bytes, greatest(1, CAST(tokens // 4096 AS BIGINT)) AS total_steps,
  CAST(floor(greatest(1, CAST(tokens // 4096 AS BIGINT)) * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT) AS decay_start, CAST(n_docs * 100 // 4096 AS BIGINT) AS milestone_steps FROM w""")
def build_plan(spark: SparkSession, d: str) -> DataFrame:
    """For each source: the bytes to fetch for its share of a build, and the steps of a run over it."""
    docs = table(spark, d, "documents")
    kinds = F.when(F.max("doc_id") % 3 == 0, F.lit(2.0)).alias("bytes_per_token")
    per = docs.groupBy("source").agg(F.sum(mix.n_tokens()).alias("tokens"), F.count("*").alias("n_docs"), (F.max("doc_id") % 5 == 0).alias("whole"), kinds)
    all_ = per.agg(F.sum("tokens").alias("all_tokens"))
    rows = per.crossJoin(F.broadcast(all_))  # one row
    need = schedule.need_bytes(F.col("tokens").cast("double") / F.col("all_tokens"), F.lit(1e9), F.col("bytes_per_token"), F.col("whole"))
    return rows.select("source", F.round(need, 3).alias("need_bytes"), *schedule.step_counts(F.col("tokens"), F.lit(4096), 0.15, F.col("n_docs") * 100))


@query("""WITH e AS (SELECT user_id % 8 AS rank, round(sum(abs(value)), 3) AS speed FROM events GROUP BY 1),
x AS (SELECT *, greatest(CAST(1 AS DOUBLE), 64 * speed / sum(speed) OVER ()) AS exact FROM e),
y AS (SELECT *, CAST(floor(exact) AS BIGINT) AS share, row_number() OVER (ORDER BY exact - floor(exact) DESC, rank) AS turn FROM x)
SELECT rank, share + CASE WHEN turn <= 64 - sum(share) OVER () THEN 1 ELSE 0 END AS share FROM y""")
def dealt_shares(spark: SparkSession, d: str) -> DataFrame:
    speeds = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("rank")).agg(F.round(F.sum(F.abs("value")), 3).alias("speed"))
    return schedule.dealt_shares(speeds, 64).select("rank", "share")
