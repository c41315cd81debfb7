"""Conversations: validity, rendering, supervision, trees and preference pairs.

A conversation is rendered from its turns, which are few; these are the only groups collected.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import stored

#: The marks of a turn, and the roles of older texts.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLES = ("system", "user", "assistant")
USER, ASSISTANT = "USER: ", "ASSISTANT: "


def valid(turns: DataFrame) -> DataFrame:
    """conv_id, valid: every role is known and no text blank, the last turn an assistant's, and a user speaks."""
    good = F.coalesce(F.col("role").isin(*ROLES) & F.col("text").rlike(r"\S"), F.lit(False))
    return turns.groupBy("conv_id").agg((F.every(good) & (F.max_by("role", "turn") == "assistant") & F.some(F.col("role") == "user")).alias("valid"))


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def body(text: Column) -> Column:
    return F.concat(text, F.lit(CLOSE + "\n"))


def joined(turns: DataFrame, part: Column, sep: str = "") -> DataFrame:
    """conv_id, rendered: a part of each turn, in order."""
    parts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda x: x.part), sep).alias("rendered"))


def chatml(turns: DataFrame) -> DataFrame:
    return joined(turns, F.concat(header(F.col("role")), body(F.col("text"))))


def user_assistant(turns: DataFrame) -> DataFrame:
    """The older rendering, without system turns."""
    name = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    return joined(turns.where("role <> 'system'"), F.concat(name, F.col("text")), "\n")


def supervision(turns: DataFrame) -> DataFrame:
    """Byte tokens of each conversation and how many are learnt from: an assistant's text and its end mark."""
    head, rest = F.octet_length(header(F.col("role"))), F.octet_length(body(F.col("text")))
    return turns.groupBy("conv_id").agg(F.sum(head + rest).cast("long").alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", rest).otherwise(0)).cast("long").alias("n_supervised"))


def marker_mask(rendered: DataFrame, text: str = "rendered") -> DataFrame:
    """rendered with n_bytes and n_learnt: bytes after an ASSISTANT: mark and before the next mark of either kind."""
    rows = rendered.withColumn("_marks", F.regexp_extract_all(text, F.lit("(USER:|ASSISTANT:)"), F.lit(1))).withColumn("_parts", F.split(text, "USER:|ASSISTANT:", -1))
    learnt = F.expr("aggregate(sequence(0, size(_marks)), 0L, (n, i) -> n + CASE WHEN i > 0 AND get(_marks, i - 1) = 'ASSISTANT:' THEN octet_length(_parts[i]) ELSE 0 END)")
    return rows.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_learnt", learnt).drop("_marks", "_parts")


def truncated(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns of each conversation that fit the budget of byte tokens, with what they and all later ones take."""
    n = F.octet_length(F.concat(header(F.col("role")), body(F.col("text"))))
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("n_after", F.sum(n).over(later)).where(F.col("n_after") <= budget)


def first_children(nodes: DataFrame) -> DataFrame:
    """The best child of each role of each parent: the lowest rank, none last, then the first."""
    best = F.min(F.struct(F.coalesce("rank", F.lit(1e9)).alias("r"), "seq", "message_id"))
    return nodes.where("parent_id IS NOT NULL").groupBy("parent_id", "role").agg(best.alias("b")).select("parent_id", "role", F.col("b.message_id").alias("message_id"))


def best_threads(nodes: DataFrame) -> DataFrame:
    """root, depth, message_id of the best-ranked thread from each user root; roles take turns and an unanswered prompt at the end goes.

    Each step joins all threads to their next message at once; there are as many steps as the longest thread has messages.
    A thread that comes back to a message of its own raises an error.
    """
    nodes = nodes.select("message_id", "parent_id", "role", "rank", "seq")
    edges = stored(first_children(nodes))
    thread = front = nodes.where("parent_id IS NULL AND role = 'user'").select(F.col("message_id").alias("root"), F.lit(0).alias("depth"), "message_id", "role")
    for depth in count(1):
        turn = "assistant" if depth % 2 else "user"
        front = front.join(edges.where(F.col("role") == turn).select(F.col("parent_id").alias("message_id"), F.col("message_id").alias("next")), "message_id")
        front = front.select("root", F.lit(depth).alias("depth"), F.col("next").alias("message_id"), F.lit(turn).alias("role"))
        front = stored(front)
        if not front.limit(1).count():
            break
        thread = thread.unionByName(front)
        if depth >= 4 and depth & (depth - 1) == 0 and thread.groupBy("root", "message_id", "role").count().where("count > 1").limit(1).count():
            raise RuntimeError(f"a thread of messages is a cycle, seen at depth {depth}")
    last = thread.groupBy("root").agg(F.max("depth").alias("deepest"))
    kept = thread.join(last, "root").where((F.col("depth") < F.col("deepest")) | (F.col("role") == "assistant"))
    return kept.where("deepest >= 1").select("root", "depth", "message_id", "role")


def ranked_paths(nodes: DataFrame) -> DataFrame:
    """root, depth, message_id: from each message without a parent to its best child, whatever the roles: the lowest rank, else the first.

    Each step joins all paths to their next message at once. Messages that no root leads to, as those of a cycle, aren't there.
    """
    best = F.min(F.struct(F.isnull("rank").alias("unranked"), "rank", "seq", "message_id"))
    edges = stored(nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(best.alias("b")).select(F.col("parent_id").alias("message_id"), F.col("b.message_id").alias("next")))
    path = front = nodes.where("parent_id IS NULL").select(F.col("message_id").alias("root"), F.lit(0).alias("depth"), "message_id")
    for depth in count(1):
        front = stored(front.join(edges, "message_id").select("root", F.lit(depth).alias("depth"), F.col("next").alias("message_id")))
        if front.isEmpty():
            return path
        path = path.unionByName(front)


def pair_ids(prompt: Column, response: Column, length: int) -> tuple[Column, Column]:
    """Of a preference pair: tokens of the response, cut to length - 1, and of the prompt, cut on the left to fit."""
    n_response = F.least(F.octet_length(F.concat(response, F.lit(CLOSE + "\n"))), F.lit(length - 1))
    return n_response, F.least(F.octet_length(prompt), F.lit(length) - n_response)
