"""Statistics of evaluations over tables of scores."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def standard_error(p: Column, n: Column) -> Column:
    """Of a share p of n; 0 for none."""
    return F.when(n == 0, 0.0).otherwise(F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) / n))


def choice_outcomes(scores: DataFrame, per: str = "n_bytes") -> DataFrame:
    """From (task, q, idx, logp, n_bytes, answer): whether the best choice is right, by the score and by the score per byte.

    The first choice wins ties.
    """
    best = lambda s: F.min_by("idx", F.struct(-s, F.col("idx")))
    raw, each = F.col("logp"), F.col("logp") / F.greatest(F.lit(1), F.col(per))
    rows = scores.groupBy("task", "q").agg(best(raw).alias("raw"), best(each).alias("each"), F.first("answer").alias("answer"))
    return rows.select("task", "q", (F.col("raw") == F.col("answer")).alias("correct"), (F.col("each") == F.col("answer")).alias("correct_norm"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """task, n, acc, acc_norm, se."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    rows = outcomes.groupBy("task").agg(F.count("*").alias("n"), share("correct").alias("acc"), share("correct_norm").alias("acc_norm"))
    return rows.withColumn("se", standard_error(F.col("acc"), F.col("n")))


def suite_average(results: DataFrame, value: str = "acc_norm", error: str = "se") -> DataFrame:
    """The mean over tasks and its error."""
    rows = results.agg(F.count("*").alias("n_tasks"), F.avg(value).alias("average"), F.sum(F.col(error) * F.col(error)).alias("s"))
    return rows.select("n_tasks", "average", (F.sqrt("s") / F.col("n_tasks")).alias("error"))


def perplexity(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Token-weighted negative log-likelihood and its perplexity, at most exp(20)."""
    rows = scores.groupBy(*groups).agg((-F.sum("logp") / F.greatest(F.lit(1), F.sum("n_tokens"))).alias("nll"))
    return rows.withColumn("ppl", F.exp(F.least(F.lit(20.0), "nll")))


def paired(outcomes: DataFrame, a: str = "correct", b: str = "correct_norm") -> DataFrame:
    """task, n, delta (b over a), se, wins of each, of two outcomes on the same questions."""
    d = F.col(b).cast("int") - F.col(a).cast("int")
    rows = outcomes.groupBy("task").agg(F.count("*").alias("n"), F.avg(d.cast("double")).alias("delta"), F.var_samp(d.cast("double")).alias("v"), F.count_if(d > 0).alias("b_wins"), F.count_if(d < 0).alias("a_wins"))
    return rows.select("task", "n", "delta", F.when(F.col("n") > 1, F.sqrt(F.col("v") / F.col("n"))).otherwise(0.0).alias("se"), "b_wins", "a_wins")


#: Resamples that are drawn from one copy of an evaluation set, digests that are made at once, and questions of a part of a set.
BLOCK, AT_ONCE, PART = 32, 1 << 13, 1 << 16
#: Stands for a difference that isn't known.
UNKNOWN = 2
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digests(prefix: bytes, first: int, last: int) -> np.ndarray:
    """The md5 of prefix and each number from first to before last, which have as many digits, as four big-endian quarters: an array of four rows."""
    width = len(str(first))
    if len(prefix) + width > 55:  # more than one block
        found = b"".join(hashlib.md5(prefix + str(k).encode()).digest() for k in range(first, last))
        return np.ascontiguousarray(np.frombuffer(found, ">u4").reshape(-1, 4).T.astype(np.uint32))
    block = np.zeros((64, last - first), np.uint8)
    block[: len(prefix)] = np.frombuffer(prefix, np.uint8)[:, None]
    rest = np.arange(first, last)
    for place in reversed(range(width)):
        rest, digit = np.divmod(rest, 10)
        block[len(prefix) + place] = digit + 48
    block[len(prefix) + width] = 0x80
    block[56:64] = np.frombuffer((8 * (len(prefix) + width)).to_bytes(8, "little"), np.uint8)[:, None]
    words = [sum(block[4 * k + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4)) for k in range(16)]
    same = [int(w[0]) if not len(prefix) - 4 < 4 * k < len(prefix) + width else None for k, w in enumerate(words)]
    a, b, c, d = (np.full(last - first, x, np.uint32) for x in _STATE)
    for i in range(64):
        turn = i // 16
        f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | ~d))[turn]
        k = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        f = f + a
        f += np.uint32((_SINES[i] + (same[k] or 0)) & 0xFFFFFFFF)
        if same[k] is None:
            f += words[k]
        left = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(left) | f >> np.uint32(32 - left))
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _STATE, strict=True)]).byteswap()


def drawn_mean(differences: np.ndarray, prefix: bytes) -> float | None:
    """The mean of as many draws as there are differences (see `bootstrap`), without the UNKNOWN ones; None if all are."""
    n, total, known = len(differences), 0, 0
    quarters, first = -(-n // 4), 0
    while first < quarters:
        last = min(first + AT_ONCE, quarters, 10 ** len(str(first)))
        places = digests(prefix, first, last).T.reshape(-1)[: n - 4 * first] % np.uint32(n)
        drawn = differences[places]
        drawn = drawn[drawn != UNKNOWN]
        total, known = total + int(drawn.sum(dtype=np.int64)), known + len(drawn)
        first = last
    return total / known if known else None


def bootstrap(outcomes: DataFrame, times: int, seed: int = 0, a: str = "correct", b: str = "correct_norm") -> DataFrame:
    """task, low, high: the 95 % interval of the mean difference over `times` resamples.

    Draws 4 k to 4 k + 3 of a resample are the four quarters of the md5 of seed, task, resample
    and k, modulo the number of questions. The resamples are spread over the cluster in blocks
    of BLOCK, each of which has the task's differences once, a byte each; a task is one evaluation set, whose size is bounded.
    A question without an outcome may be drawn and doesn't count in the mean.
    """
    d = F.coalesce(F.col(b).cast("int") - F.col(a).cast("int"), F.lit(UNKNOWN)).cast("tinyint").alias("d")
    place = F.row_number().over(Window.partitionBy("task").orderBy("q")) - 1
    rows = outcomes.select("task", place.alias("place"), d)
    parts = rows.groupBy("task", F.floor(F.col("place") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "d"))).alias("all"))
    parts = parts.select("task", F.col("task").cast("string").alias("name"), "part", F.transform("all", lambda x: x.d).alias("d"))
    blocks = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((times - 1) // BLOCK))))
    # With a number of partitions: they are small, but long to compute, and AQE would join them by their bytes.
    blocks = blocks.repartition(int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task", "block")

    def draw(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group["part"].to_numpy())
        differences = np.concatenate([group["d"][int(i)].values.to_numpy() for i in order])
        said = "" if key[0].as_py() is None else f"{group['name'][0].as_py()}:"  # as concat_ws leaves it out
        first = key[1].as_py() * BLOCK
        b = range(first, min(first + BLOCK, times))
        means = [drawn_mean(differences, f"{seed}:{said}{x}:".encode()) for x in b]
        return pa.table({"task": pa.array([key[0].as_py()] * len(b), group["task"].type), "b": pa.array(b, pa.int32()), "mean": pa.array(means, pa.float64())})

    kind = rows.schema["task"].dataType
    means = blocks.groupBy("task", "block").applyInArrow(draw, StructType([StructField("task", kind), StructField("b", IntegerType()), StructField("mean", DoubleType())]))
    at = F.row_number().over(Window.partitionBy("task").orderBy("mean", "b")) - 1
    ranked = means.withColumn("at", at)
    pick = lambda f: F.max(F.when(F.col("at") == int(f * (times - 1)), F.col("mean")))
    return ranked.groupBy("task").agg(pick(0.025).alias("low"), pick(0.975).alias("high"))


def tally(grades: DataFrame) -> DataFrame:
    """Sums and counts by model and category, and by model over all categories (category null)."""
    view = grades.select("model", "category", "grade")
    return view.groupingSets([["model", "category"], ["model"]], "model", "category").agg(F.sum("grade").cast("long").alias("points"), F.count("*").alias("n"))


#: Fixed values of the decision rule: the least noise of losses and of averages, and how many noises a gain must exceed.
LOSS_NOISE, SUITE_NOISE, NOISES, SEEDS = 0.001, 0.005, 2.0, 3


def adopted(runs: DataFrame, suite_only: tuple[str, ...] = ()) -> DataFrame:
    """From (arm, seed, loss, suite), with the arm `base`: whether each other arm's first run is adopted, and why."""
    base = runs.where("arm = 'base'").agg(
        F.count("loss").alias("n_loss"), F.count("suite").alias("n_suite"), F.avg("loss").alias("base_loss"), F.avg("suite").alias("base_suite"),
        F.greatest(F.stddev_samp("loss"), F.lit(LOSS_NOISE)).alias("loss_noise"), F.greatest(F.stddev_samp("suite"), F.lit(SUITE_NOISE)).alias("suite_noise"),
    )
    arms = runs.where("arm <> 'base'").groupBy("arm").agg(F.min_by(F.struct("loss", "suite"), "seed").alias("r")).select("arm", "r.loss", "r.suite")
    rows = arms.crossJoin(F.broadcast(base))  # one row
    only = F.col("arm").isin(*suite_only) if suite_only else F.lit(False)
    gain, suite_gain = F.col("base_loss") - F.col("loss"), F.col("suite") - F.col("base_suite")
    why = (
        F.when((F.col("n_loss") < SEEDS) | (F.col("n_suite") < SEEDS), "too few base seeds")
        .when(F.isnull("suite") | (F.isnull("loss") & ~only), "not finished")
        .when(only, F.when(suite_gain > NOISES * F.col("suite_noise"), "adopt").otherwise("suite gain within noise"))
        .when(gain <= NOISES * F.col("loss_noise"), "loss gain within noise")
        .when(suite_gain < -NOISES * F.col("suite_noise"), "suite fell")
        .otherwise("adopt")
    )
    return rows.select("arm", "loss", "suite", why.alias("why"), (why == "adopt").alias("adopt"))
