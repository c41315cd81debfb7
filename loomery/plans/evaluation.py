"""Queries over scores and telemetry derived from events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import scores, telemetry
from loomery.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Scores of four choices for each question, from events: value is the score, the id the length.
SCORES = "s AS (SELECT CAST((event_id // 4) % 5 AS BIGINT) AS task, event_id // 4 AS q, event_id % 4 AS idx, -value AS logp, 1 + event_id % 17 AS n_bytes, ((event_id // 4) * 7) % 4 AS answer FROM events)"
OUTCOMES = f"""{SCORES},
o AS (SELECT task, q, arg_min(idx, (-logp, idx)) = any_value(answer) AS correct, arg_min(idx, (-logp / greatest(1, n_bytes), idx)) = any_value(answer) AS correct_norm FROM s GROUP BY task, q)"""
ACC = "a AS (SELECT task, count(*) AS n, avg(correct::INT) AS acc, avg(correct_norm::INT) AS acc_norm FROM o GROUP BY task), r AS (SELECT *, sqrt(greatest(acc * (1 - acc), 1e-12) / n) AS se FROM a)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    q = F.floor(F.col("event_id") / 4)
    return table(spark, d, "events").select(
        (q % 5).alias("task"), q.alias("q"), (F.col("event_id") % 4).alias("idx"), (-F.col("value")).alias("logp"), (1 + F.col("event_id") % 17).alias("n_bytes"), ((q * 7) % 4).alias("answer")
    )


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return scores.choice_outcomes(_scores(spark, d))


@query(f"WITH {OUTCOMES}, {ACC} SELECT task, n, round(acc, 9) AS acc, round(acc_norm, 9) AS acc_norm, round(se, 9) AS se FROM r")
def mc_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.accuracy(_outcomes(spark, d))
    return rows.select("task", "n", *[F.round(c, 9).alias(c) for c in ("acc", "acc_norm", "se")])


@query(f"WITH {OUTCOMES}, {ACC} SELECT count(*) AS n_tasks, round(avg(acc_norm), 9) AS average, round(sqrt(sum(se * se)) / count(*), 9) AS error FROM r")
def suite_average(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.suite_average(scores.accuracy(_outcomes(spark, d)))
    return rows.select("n_tasks", F.round("average", 9).alias("average"), F.round("error", 9).alias("error"))


@query(f"WITH {SCORES} SELECT task, round(-sum(logp) / greatest(1, sum(n_bytes)), 9) AS nll, round(exp(least(20, -sum(logp) / greatest(1, sum(n_bytes)))), 6) AS ppl FROM s GROUP BY task")
def token_perplexity(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.perplexity(_scores(spark, d).withColumnRenamed("n_bytes", "n_tokens"), ["task"])
    return rows.select("task", F.round("nll", 9).alias("nll"), F.round("ppl", 6).alias("ppl"))


@query(f"""WITH {OUTCOMES} SELECT task, count(*) AS n, round(avg(correct_norm::INT - correct::INT), 9) AS delta, round(sqrt(var_samp(correct_norm::INT - correct::INT) / count(*)), 9) AS se,
CAST(count(*) FILTER (correct_norm AND NOT correct) AS BIGINT) AS b_wins, CAST(count(*) FILTER (correct AND NOT correct_norm) AS BIGINT) AS a_wins FROM o GROUP BY task""")
def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.paired(_outcomes(spark, d))
    return rows.select("task", "n", F.round("delta", 9).alias("delta"), F.round("se", 9).alias("se"), "b_wins", "a_wins")


@query(f"""WITH {OUTCOMES},
p AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY q) - 1 AS place, correct_norm::INT - correct::INT AS d FROM o), z AS (SELECT task, count(*) AS n FROM p GROUP BY task),
w AS (SELECT task, n, b, unnest(range(n)) AS j FROM z, range(2000) t(b)),
x AS (SELECT task, b, CAST('0x' || substr(md5('0:' || task || ':' || b || ':' || (j // 4)), 8 * (j % 4) + 1, 8) AS BIGINT) % n AS place FROM w),
m AS (SELECT task, b, avg(d) AS mean FROM x JOIN p USING (task, place) GROUP BY task, b),
k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY mean, b) - 1 AS at_ FROM m)
SELECT task, round(max(mean) FILTER (at_ = 49), 9) AS low, round(max(mean) FILTER (at_ = 1949), 9) AS high FROM k GROUP BY task""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.bootstrap(_outcomes(spark, d), 2000)
    return rows.select("task", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("""SELECT model, category, CAST(sum(grade) AS BIGINT) AS points, count(*) AS n FROM (SELECT CASE user_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model, event_type AS category, CASE WHEN value > 50 THEN 1 ELSE 0 END AS grade FROM events)
GROUP BY GROUPING SETS ((model, category), (model))""")
def grade_tally_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("model"), F.col("event_type").alias("category"), F.when(F.col("value") > 50, 1).otherwise(0).alias("grade"))
    return scores.tally(rows)


@query("""WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'base' ELSE event_type END AS arm, user_id % 4 AS seed, round(avg(value) / 100, 6) AS loss, round(avg(value % 10) / 10, 6) AS suite FROM events GROUP BY 1, 2),
b AS (SELECT count(*) AS n, avg(loss) AS l, avg(suite) AS s, greatest(stddev_samp(loss), 0.001) AS ln, greatest(stddev_samp(suite), 0.005) AS sn FROM r WHERE arm = 'base'),
a AS (SELECT arm, arg_min(loss, seed) AS loss, arg_min(suite, seed) AS suite FROM r WHERE arm <> 'base' GROUP BY arm),
v AS (SELECT arm, loss, suite, CASE WHEN n < 3 THEN 'too few base seeds' WHEN arm = 'signup' THEN CASE WHEN suite - s > 2 * sn THEN 'adopt' ELSE 'suite gain within noise' END
  WHEN l - loss <= 2 * ln THEN 'loss gain within noise' WHEN suite - s < -2 * sn THEN 'suite fell' ELSE 'adopt' END AS why FROM a, b)
SELECT *, why = 'adopt' AS adopt FROM v""")
def proxy_verdict(spark: SparkSession, d: str) -> DataFrame:
    arm = F.when(F.col("event_type") == "view", "base").otherwise(F.col("event_type"))
    runs = table(spark, d, "events").groupBy(arm.alias("arm"), (F.col("user_id") % 4).alias("seed"))
    runs = runs.agg(F.round(F.avg("value") / 100, 6).alias("loss"), F.round(F.avg(F.col("value") % 10) / 10, 6).alias("suite"))
    return scores.adopted(runs, ("signup",))


@query("""SELECT event_type AS variant, max(event_id) AS step, arg_max(value, event_id) AS loss, round(avg(value) FILTER (r <= 3), 9) AS last_mean, CAST(count(*) FILTER (value > 200) AS BIGINT) AS n_over
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) GROUP BY event_type""")
def ab_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    last = telemetry.last_rows(rows, "event_type", "event_id", 3).groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("last_mean"))
    per = rows.groupBy("event_type").agg(F.max("event_id").alias("step"), F.max_by("value", "event_id").alias("loss"), F.count_if(F.col("value") > 200).alias("n_over"))
    return per.join(last, "event_type").select(F.col("event_type").alias("variant"), "step", "loss", "last_mean", "n_over")


WINDOWS = """e AS (SELECT ts, count(*) FILTER (value >= 50) AS loaded, max(value) AS hottest, sum(value) AS total, arg_min(value, event_id) AS first_, count(*) FILTER (event_type = 'error') AS flagged FROM events GROUP BY ts),
w AS (SELECT CAST(floor((epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS "window", CAST(round_even(avg(loaded), 0) AS INT) AS loaded, max(hottest) AS hottest,
  round(avg(total), 6) AS total, round(avg(first_), 6) AS "first", round(avg(flagged), 6) AS n_flagged FROM e GROUP BY 1)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("ts", F.col("event_id").alias("seq"), F.col("value").alias("load"), F.col("value").alias("reading"), (F.col("event_type") == "error").alias("flagged"))
    return telemetry.sample_windows(rows, 3600)


@query(f"WITH {WINDOWS} SELECT * FROM w")
def thermal_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


@query(f"""WITH {WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY loaded ORDER BY "window" DESC) AS r FROM w)
SELECT loaded, round(avg(hottest), 6) AS hottest, round(avg(total), 6) AS total FROM r WHERE r <= 2 GROUP BY loaded""")
def plateau_last2(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.plateau(_windows(spark, d))


RUNS = """SELECT user_id, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, f ORDER BY event_id) AS i
FROM (SELECT user_id, event_id, {flag} AS f FROM events)) WHERE f GROUP BY user_id, i"""


@query(RUNS.format(flag="value > 60") + " HAVING count(*) >= 2")
def consecutive_runs(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.runs(table(spark, d, "events"), F.col("value") > 60, "user_id", "event_id").where("n >= 2")


@query(RUNS.format(flag="event_type = 'error'"))
def throttle_runs(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.runs(table(spark, d, "events"), F.col("event_type") == "error", "user_id", "event_id")


@query("""WITH r AS (SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 500),
c AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM r GROUP BY 1)
SELECT event_type, round(regr_slope(value, event_id), 6) AS slope, round(regr_intercept(value, event_id), 4) AS intercept, count(*) AS n FROM r JOIN c USING (event_type) WHERE abs(value - m) <= 2.5 * s GROUP BY event_type""")
def trend_linear_trim(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.trimmed_line(table(spark, d, "events"), "event_type", "event_id", "value")
    return rows.select("event_type", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("""SELECT event_type, round(regr_intercept(value, ln(event_id)), 4) AS a, round(regr_slope(value, ln(event_id)), 6) AS b FROM
(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 1500 AND event_id > 0 GROUP BY event_type""")
def trend_log(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.log_line(table(spark, d, "events"), "event_type", "event_id", "value")
    return rows.select("event_type", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"))


@query("SELECT event_type, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY event_type")
def latest_per_event(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latest(table(spark, d, "events"), "event_type", "event_id", "ts", "value")


NAMES = "n AS (SELECT source AS series, CASE WHEN doc_id % 50 = 7 THEN 'final.pt' ELSE 'step_' || doc_id || '.pt' END AS name FROM documents), p AS (SELECT DISTINCT series, name, TRY_CAST(nullif(regexp_extract(name, '(\\d+)\\.\\w+$', 1), '') AS BIGINT) AS step FROM n)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 50 == 7, "final.pt").otherwise(F.concat(F.lit("step_"), F.col("doc_id").cast("string"), F.lit(".pt")))
    return table(spark, d, "documents").select(F.col("source").alias("series"), name.alias("name")).distinct()


@query(f"WITH {NAMES} SELECT series, name, step, CAST(row_number() OVER (PARTITION BY series ORDER BY step IS NULL, step, name) AS INT) AS place FROM p")
def checkpoint_order(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.checkpoint_order(_names(spark, d))


@query(f"WITH {NAMES} SELECT series, name FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step DESC, name DESC) AS r FROM p WHERE step IS NOT NULL) WHERE r > 3")
def checkpoint_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.checkpoint_order(_names(spark, d)).withColumn("permanent", F.isnull("step"))
    return telemetry.prunable(rows, 3).select("series", "name")


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS k FROM events WHERE isfinite(value)),
w AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS step, CAST([] AS DOUBLE[]) AS usual, CAST('inf' AS DOUBLE) AS level, 0 AS high, 0 AS extreme, false AS halted, CAST(NULL AS VARCHAR) AS event FROM e
UNION ALL SELECT run, k, step, CASE WHEN warm OR v <= 3 * l THEN list_append(usual, v)[greatest(1, len(usual) - 198):] ELSE usual END, l, hi, ex, halted OR ex >= 3,
  CASE WHEN ex >= 3 AND NOT halted THEN 'halt' WHEN hi = 2 THEN 'alert' END
  FROM (SELECT *, CASE WHEN NOT warm AND v > 3 * l THEN high + 1 ELSE 0 END AS hi, CASE WHEN NOT warm AND v > 6 * l THEN extreme + 1 ELSE 0 END AS ex
    FROM (SELECT w.run, e.k, e.step, e.v, usual, high, extreme, halted, len(usual) < 20 AS warm, CASE WHEN len(usual) < 20 THEN level ELSE least(level, list_aggregate(usual, 'median')) END AS l
      FROM w JOIN e ON e.run = w.run AND e.k = w.k + 1)))
SELECT run, step, event FROM w WHERE event IS NOT NULL""")
def gradient_watch(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.watched(table(spark, d, "events"), "user_id", "event_id", "value", alert=(3.0, 2), halt=(6.0, 3), window=200, least=20)
