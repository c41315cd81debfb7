"""Further queries: records, sampling filters, checks of builds and runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.operators import guard, mix, records, sampling, telemetry
from loomery.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT source, sum(strlen(text) + 1) AS n FROM documents GROUP BY source),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(100 AS DOUBLE) * sum(n) FILTER (source = 'src1') / sum(n) AS chat, CAST(100 AS DOUBLE) * sum(n) FILTER (source LIKE 'src1%') / sum(n) AS code FROM s)
SELECT total, round(chat, 6) AS chat, round(code, 6) AS code, concat_ws('; ', CASE WHEN total < 1000000 THEN 'too few tokens' END, CASE WHEN chat < 6 THEN 'too little chat' END, CASE WHEN code < 40 THEN 'too little code' END) AS problems FROM t""")
def anneal_check(spark: SparkSession, d: str) -> DataFrame:
    n = mix.n_tokens()
    share = lambda when: F.round(F.lit(100.0) * F.sum(F.when(when, n)) / F.sum(n), 6)
    rows = table(spark, d, "documents").agg(F.sum(n).alias("total"), share(F.col("source") == "src1").alias("chat"), share(F.col("source").like("src1%")).alias("code"))
    problems = [F.when(F.col("total") < 1_000_000, "too few tokens"), F.when(F.col("chat") < 6, "too little chat"), F.when(F.col("code") < 40, "too little code")]
    return rows.withColumn("problems", F.concat_ws("; ", *problems))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), f AS (SELECT w, count(*) AS n FROM w GROUP BY w),
p AS (SELECT substr(w, CAST(i AS BIGINT), 2) AS pair, n FROM f, LATERAL (SELECT unnest(generate_series(1, length(w) - 1)) AS i))
SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY pair""")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair of characters is adjacent in words: over distinct words and their counts."""
    words = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.where(F.length("w") > 1).select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substr(w, i, 2))")).alias("pair"), "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


@query("""SELECT doc_id, CAST(i AS INT) AS part, substr(text, CAST(i * 1500 + 1 AS BIGINT), 1500) AS chunk FROM documents, LATERAL (SELECT unnest(generate_series(0, (length(text) - 1) // 1500)) AS i) WHERE text <> ''""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text <> ''").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1500).cast("int"))))
    return rows.selectExpr("doc_id", "part", "substr(text, part * 1500 + 1, 1500) AS chunk")


@query("""SELECT doc_id, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % (length(text) - 64) AS start, substr(text, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % (length(text) - 64) + 1, 65) AS x FROM documents WHERE length(text) > 64""")
def random_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window of each document at a seeded random place, with the character after it for the shifted target."""
    rows = table(spark, d, "documents").where(F.length("text") > 64)
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.length("text") - 64)
    return rows.select("doc_id", start.alias("start"), F.substring("text", (start + 1).cast("int"), F.lit(65)).alias("x"))


@query("""WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
a AS (SELECT doc_id FROM c WHERE k < n // 2), b AS (SELECT doc_id FROM c WHERE k >= n // 2)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT (SELECT * FROM a UNION SELECT * FROM b))) AS n_missing""")
def continuation_cover(spark: SparkSession, d: str) -> DataFrame:
    """That a build and its continuation share nothing and leave nothing out."""
    docs = table(spark, d, "documents")
    half = docs.groupBy("source").agg(F.floor(F.count("*") / 2).alias("taken"))
    second = mix.continued(docs, half).select("doc_id")
    first = mix.numbered(docs, ["source"]).join(half, "source").where("seq < taken").select("doc_id")
    both = first.intersect(second).agg(F.count("*").alias("n_both"))
    return both.crossJoin(docs.select("doc_id").subtract(first.union(second)).agg(F.count("*").alias("n_missing")))


@query("""SELECT l.doc_id, list_position([0, 1], quality) - 1 AS answer FROM labels l WHERE list_position([0, 1], quality) > 0 AND toxic = 0""")
def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").where("toxic = 0").withColumn("labels", F.array(F.lit(0), F.lit(1)))
    rows = rows.select("doc_id", records.answer_index("labels", "quality").cast("int").alias("answer"))
    return rows.where("answer IS NOT NULL")


@query("""WITH p AS (SELECT conv_id, max(text) FILTER (turn = 0) AS prompt, max(text) FILTER (turn = 1 AND role = 'assistant') AS chosen, max(text) FILTER (turn = 3 AND role = 'assistant') AS rejected FROM conversations GROUP BY conv_id)
SELECT conv_id FROM p WHERE prompt <> '' AND chosen <> '' AND rejected <> ''""")
def pref_validity(spark: SparkSession, d: str) -> DataFrame:
    at = lambda turn, role=F.lit(True): F.max(F.when((F.col("turn") == turn) & role, F.col("text")))
    assistant = F.col("role") == "assistant"
    pairs = table(spark, d, "conversations").groupBy("conv_id").agg(at(0).alias("prompt"), at(1, assistant).alias("chosen"), at(3, assistant).alias("rejected"))
    return pairs.where(records.has_pair("prompt", "chosen", "rejected")).select("conv_id")


@query("""WITH b AS (SELECT item_id, row_number() OVER (ORDER BY md5('3:' || item_id), item_id) AS number FROM benchmark),
g AS (SELECT number FROM b WHERE item_id % 7 <> 0 UNION ALL SELECT number FROM b WHERE item_id % 11 = 0)
SELECT number, coalesce(x.n, 0) AS n_grades, coalesce(y.n, 0) AS n_keys FROM (SELECT number, count(*) AS n FROM g GROUP BY number) x FULL JOIN (SELECT number, count(*) AS n FROM b GROUP BY number) y USING (number) WHERE coalesce(x.n, 0) <> 1 OR coalesce(y.n, 0) <> 1""")
def blind_grades(spark: SparkSession, d: str) -> DataFrame:
    keys = records.blind_order(table(spark, d, "benchmark"), 3, "item_id")
    grades = keys.where("item_id % 7 <> 0").unionByName(keys.where("item_id % 11 = 0"))
    return records.unmatched(grades, keys).withColumn("number", F.col("number").cast("long"))


@query(r"""WITH r AS (SELECT item_id, '===MODEL===' || chr(10) || 'm' || item_id || chr(10) || '===REPLY===' || chr(10) || text || chr(10) || '===END===' AS value FROM benchmark)
SELECT item_id, regexp_extract(value, '(?s)===MODEL===\n(.*?)(?:\n===|\z)', 1) AS model, trim(regexp_extract(value, '(?s)===REPLY===\n(.*?)(?:\n===|\z)', 1)) AS reply FROM r""")
def transcript_records(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit("===MODEL===\nm"), F.col("item_id").cast("string"), F.lit("\n===REPLY===\n"), F.col("text"), F.lit("\n===END==="))
    return records.transcript(table(spark, d, "benchmark").select("item_id", value.alias("value")), ["MODEL", "REPLY"]).drop("value")


@query("""WITH t AS (SELECT event_id AS at_, user_id AS token, event_type <> 'view' AS learnt FROM events), n AS (SELECT count(*) AS n FROM t)
SELECT CAST(a.at_ // 64 AS BIGINT) AS window_id, a.at_ AS "at", a.token AS x, CASE WHEN b.learnt THEN b.token ELSE -100 END AS y FROM t a JOIN t b ON b.at_ = a.at_ + 1, n WHERE a.at_ // 64 < ((n - 1) // 256) * 4""")
def masked_windows(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "events").select(F.col("event_id").alias("at"), F.col("user_id").alias("token"), (F.col("event_type") != "view").alias("learnt"))
    return records.masked_windows(tokens, 64, 4)


@query("""WITH a AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), m AS (SELECT greatest(8, max(len(ids))) AS longest FROM a)
SELECT conv_id, array_to_string(list_transform(generate_series(1, longest), lambda i: CAST(coalesce(ids[i], -1) AS VARCHAR)), ' ') AS ids FROM a, m""")
def padded_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("int"))).alias("ids"))
    return records.padded_to_longest(rows, "ids", -1, least=8).select("conv_id", F.array_join("ids", " ").alias("ids"))


@query("""WITH m AS (SELECT event_type, 0.1 * ((-value + 50) - (-(event_id % 97) + 40)) AS m FROM events)
SELECT event_type, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 9) AS loss, round(avg(CASE WHEN m > 0 THEN 1 ELSE 0 END), 9) AS accuracy, round(avg(m), 9) AS margin, count(*) AS n FROM m GROUP BY event_type""")
def reward_statistics(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "events").select("event_type", (-F.col("value")).alias("chosen"), F.lit(-50.0).alias("ref_chosen"), (-(F.col("event_id") % 97)).cast("double").alias("rejected"), F.lit(-40.0).alias("ref_rejected"))
    rows = records.reward_statistics(pairs, 0.1, ["event_type"])
    return rows.select("event_type", *[F.round(c, 9).alias(c) for c in ("loss", "accuracy", "margin")], "n")


@query("""WITH p AS (SELECT page_id, page_id % 10 AS query, CASE WHEN contains(url, '.org') THEN 0 ELSE 1 END AS tier FROM pages)
SELECT query, page_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, page_id) AS place FROM p) WHERE place <= 3""")
def trusted_first(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", (F.col("page_id") % 10).alias("query"), F.when(F.col("url").contains(".org"), 0).otherwise(1).alias("tier"))
    return records.by_trust(pages, "query", "tier", "page_id", 3).select("query", "page_id", "place")


@query("""SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN lang <> '' THEN '[lang] ' || left(lang, 200) END, CASE WHEN text <> '' THEN '[text] ' || left(text, 200) END, 'Question: ' || source) AS prompt FROM documents""")
def grounded_prompt(spark: SparkSession, d: str) -> DataFrame:
    prompt = records.grounded_prompt(F.col("source"), [("lang", F.col("lang")), ("text", F.col("text"))], 200)
    return table(spark, d, "documents").select("doc_id", prompt.alias("prompt"))


LOGITS = "l AS (SELECT user_id AS context, event_id AS token, round(value / 20, 4) AS logit FROM events)"


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("context"), F.col("event_id").alias("token"), F.round(F.col("value") / 20, 4).alias("logit"))


@query(f"WITH {LOGITS} SELECT context, token, logit FROM (SELECT *, rank() OVER (PARTITION BY context ORDER BY logit DESC) AS r FROM l) WHERE r <= 5")
def top_k_logits(spark: SparkSession, d: str) -> DataFrame:
    return sampling.top_k(_logits(spark, d), 5)


@query(f"""WITH {LOGITS}, m AS (SELECT *, max(logit) OVER (PARTITION BY context) AS m FROM l), p AS (SELECT context, token, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY context) AS p FROM m),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY context ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT context, token, round(p, 9) AS p FROM c WHERE b <= 0.9""")
def nucleus_filter(spark: SparkSession, d: str) -> DataFrame:
    return sampling.nucleus(_logits(spark, d), 0.9).select("context", "token", F.round("p", 9).alias("p"))


@query(f"WITH {LOGITS} SELECT context, token, round(CASE WHEN token % 3 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END ELSE logit END, 9) AS logit FROM l")
def repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    logits = _logits(spark, d)
    return sampling.penalised(logits, logits.where("token % 3 = 0"), 1.3).select("context", "token", F.round("logit", 9).alias("logit"))


@query("""WITH r AS (SELECT event_type AS variant, max(event_id) AS step, avg(value) FILTER (r <= 3) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) GROUP BY event_type),
b AS (SELECT loss AS base FROM r WHERE variant = 'view')
SELECT variant, round(loss, 6) AS loss, step >= (SELECT max(event_id) FROM events) - 100 AS finished, loss = min(loss) OVER () AS winner, round((base - loss) / base, 6) AS gain, loss = min(loss) OVER () AND (base - loss) / base >= 0.005 AS adopted FROM r, b""")
def ab_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    loss = telemetry.last_rows(rows, "event_type", "event_id", 3).groupBy("event_type").agg(F.avg("value").alias("loss"))
    per = rows.groupBy("event_type").agg(F.max("event_id").alias("step")).join(loss, "event_type")
    base = loss.where("event_type = 'view'").select(F.col("loss").alias("base"))
    best = loss.agg(F.min("loss").alias("best"))
    last = rows.agg(F.max("event_id").alias("last"))
    per = per.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best)).crossJoin(F.broadcast(last))  # one row each
    gain = (F.col("base") - F.col("loss")) / F.col("base")
    winner = F.col("loss") == F.col("best")
    return per.select(F.col("event_type").alias("variant"), F.round("loss", 6).alias("loss"), (F.col("step") >= F.col("last") - 100).alias("finished"), winner.alias("winner"), F.round(gain, 6).alias("gain"), (winner & (gain >= 0.005)).alias("adopted"))


@query("""SELECT user_id % 4 AS device, round(avg(TRY_CAST(u AS DOUBLE)), 6) AS util, round(sum(TRY_CAST(u AS DOUBLE)), 4) AS power, max(TRY_CAST(u AS DOUBLE)) AS temp, count(*) AS n FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'N/A' ELSE CAST(value AS VARCHAR) END AS u FROM events) GROUP BY 1""")
def device_rollup(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("value").cast("string")).try_cast("double")
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("device"))
    return rows.agg(F.round(F.avg(said), 6).alias("util"), F.round(F.sum(said), 4).alias("power"), F.max(said).alias("temp"), F.count("*").alias("n"))


@query("""SELECT user_id % 2 AS split, event_type, round(avg(value), 9) AS loss, round(exp(least(20, avg(value) / 20)), 6) AS ppl FROM events GROUP BY 1, 2""")
def loss_by_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("split"), "event_type").agg(F.avg("value").alias("l"))
    return rows.select("split", "event_type", F.round("l", 9).alias("loss"), F.round(F.exp(F.least(F.lit(20.0), F.col("l") / 20)), 6).alias("ppl"))


@query("""WITH r AS (SELECT event_type, event_id, event_id - lag(event_id) OVER w AS steps, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / CAST(1000000 AS DOUBLE) AS seconds FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, event_id, round(steps / seconds, 6) AS rate, round(CAST(100 AS DOUBLE) * event_id / 20000, 6) AS pct, round((20000 - event_id) / (steps / seconds), 3) AS eta FROM r WHERE seconds > 0""")
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """Each row's speed since the one before, how far it is of 20,000 steps, and the seconds left at that speed."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").withColumn("steps", F.col("event_id") - F.lag("event_id").over(w)).withColumn("seconds", (micros - F.lag(micros).over(w)) / F.lit(1e6))
    rate = F.col("steps") / F.col("seconds")
    return rows.where("seconds > 0").select("event_type", "event_id", F.round(rate, 6).alias("rate"), F.round(F.lit(100.0) * F.col("event_id") / 20_000, 6).alias("pct"), F.round((20_000 - F.col("event_id")) / rate, 3).alias("eta"))


@query("""WITH f AS (SELECT event_type, regr_intercept(value, ln(event_id)) AS a, regr_slope(value, ln(event_id)) AS b, max(event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 1500 AND event_id > 0 GROUP BY event_type)
SELECT event_type, CAST(i AS INT) AS point, round(last + (2 * last - last) * i / CAST(79 AS DOUBLE), 4) AS step, round(a + b * ln(last + (2 * last - last) * i / CAST(79 AS DOUBLE)), 4) AS value FROM f, range(80) t(i)""")
def trend_projection(spark: SparkSession, d: str) -> DataFrame:
    """The log fit of each kind carried on to twice its last step, in 80 points."""
    rows = table(spark, d, "events")
    fit = telemetry.log_line(rows, "event_type", "event_id", "value").join(rows.groupBy("event_type").agg(F.max("event_id").alias("last")), "event_type")
    fit = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(79))))
    step = F.col("last") + F.col("last") * F.col("point") / F.lit(79.0)
    return fit.select("event_type", "point", F.round(step, 4).alias("step"), F.round(F.col("a") + F.col("b") * F.log(step), 4).alias("value"))


@query("""SELECT date_trunc('hour', ts) AS hour, CAST(count(*) FILTER (value >= 50) AS BIGINT) AS loaded, round(sum(value), 4) AS total, arg_min(value, event_id) AS processor FROM events GROUP BY 1""")
def plot_series(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"))
    return rows.agg(F.count_if(F.col("value") >= 50).alias("loaded"), F.round(F.sum("value"), 4).alias("total"), F.min_by("value", "event_id").alias("processor"))


@query("""WITH RECURSIVE s AS (SELECT CAST(user_id % 4 AS VARCHAR) AS box, epoch_us(ts) // 3600000000 * 60.0 AS t, value % 100 AS temp, event_type = 'view' AS busy, user_id % 3 = 0 AS idle FROM events),
g AS (SELECT box, CAST(t AS DOUBLE) AS t, max(temp) AS hot, avg(temp) FILTER (idle) AS idle, count(*) FILTER (busy) AS loaded, row_number() OVER (PARTITION BY box ORDER BY t) AS k FROM s GROUP BY box, t),
w AS (SELECT DISTINCT box, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS ts, 'armed' AS state, CAST([] AS DOUBLE[]) AS firsts, CAST(NULL AS DOUBLE) AS base, CAST(0 AS DOUBLE) AS paused, CAST([] AS DOUBLE[]) AS trips, CAST(NULL AS VARCHAR) AS event FROM g
UNION ALL SELECT box, k, t, CASE WHEN event LIKE 'trip%' THEN 'pausing' WHEN event = 'cooling' THEN 'cooling' WHEN event = 'stopped' THEN 'stopped' WHEN event = 'resumed' THEN 'armed' ELSE state END,
  firsts, base, CASE WHEN event LIKE 'trip%' THEN t ELSE paused END, CASE WHEN event LIKE 'trip%' THEN list_append(trips, t) ELSE trips END, event
  FROM (SELECT *, CASE
      WHEN state = 'pausing' AND (loaded = 0 OR t - paused >= 300) THEN 'cooling'
      WHEN state = 'cooling' AND loaded = 0 AND coalesce(rise <= 2, true) AND hot <= 80 THEN CASE WHEN len(list_filter(trips, lambda x: t - x < 3600)) >= 3 THEN 'stopped' ELSE 'resumed' END
      WHEN state = 'armed' AND hot >= 99.5 THEN 'trip: device' WHEN state = 'armed' AND rise >= 8 THEN 'trip: room' END AS event
    FROM (SELECT *, idle - base AS rise FROM (SELECT *, CASE WHEN old IS NULL AND len(firsts) >= 3 THEN list_aggregate(firsts, 'avg') ELSE old END AS base
      FROM (SELECT w.box, g.k, g.t, g.hot, g.idle, g.loaded, w.state, w.paused, w.trips, w.base AS old, CASE WHEN w.base IS NULL AND g.idle IS NOT NULL THEN list_append(w.firsts, g.idle) ELSE w.firsts END AS firsts
        FROM w JOIN g ON g.box = w.box AND g.k = w.k + 1)))))
SELECT box, ts, event FROM w WHERE event IS NOT NULL""")
def thermal_guard(spark: SparkSession, d: str) -> DataFrame:
    """What the guard would do, with devices from events: four boxes, hours as times."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 60
    samples = table(spark, d, "events").select(
        (F.col("user_id") % 4).alias("box"), at.alias("ts"), F.col("user_id").alias("device"), (F.col("value") % 100).alias("temp"),
        F.when(F.col("event_type") == "view", 100.0).otherwise(0.0).alias("util"), (F.col("user_id") % 3 == 0).alias("idle"),
        F.lit(False).alias("slowed"), F.lit(None).cast("double").alias("processor"),
    )
    return guard.guarded(samples, hottest=99.5, resume_hottest=80.0)
