"""Adapters from the shapes of public chat and text sets to a column `text`, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import strip
from loomery.operators.chats import ASSISTANT, USER, best_threads, ranked_paths, valid

#: Fixed value: what stands between two documents of a joined text.
SEPARATOR = "\n\n###\n\n"


def plain(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(F.col(text) != "").select(F.col(text).alias("text"))


def alternating(rows: DataFrame, turns: str = "data") -> DataFrame:
    """An array of turns in which a user speaks first and the two take turns."""
    said = F.transform(turns, lambda x, i: F.concat(F.when(i % 2 == 0, USER).otherwise(ASSISTANT), x))
    return rows.where(F.size(turns) > 0).select(F.array_join(said, "\n").alias("text"))


def question_answer(rows: DataFrame, question: str = "question", response: str = "response") -> DataFrame:
    full = (F.col(question) != "") & (F.col(response) != "")
    return rows.where(full).select(F.concat(F.lit(USER), question, F.lit("\n" + ASSISTANT), response).alias("text"))


def messages(rows: DataFrame, column: str = "conversation", language: str | None = "English") -> DataFrame:
    """An array of messages with role and content, of one language; empty messages are left out."""
    said = F.transform(F.filter(column, lambda m: m.content != ""), lambda m: F.concat(F.when(m.role == "user", USER).otherwise(ASSISTANT), m.content))
    rows = rows.where(F.size(column) > 0)
    rows = rows.where(F.col("language") == language) if language else rows
    return rows.select(F.array_join(said, "\n").alias("text"))


def human_assistant(rows: DataFrame, column: str = "chosen") -> DataFrame:
    """Transcripts with Human: and Assistant: paragraphs."""
    text = F.replace(F.replace(F.col(column), F.lit("\n\nHuman:"), F.lit("\nUSER:")), F.lit("\n\nAssistant:"), F.lit("\nASSISTANT:"))
    return rows.where(F.col(column) != "").select(strip(text).alias("text"))


def threads(rows: DataFrame, language: str = "en") -> DataFrame:
    """Trees of messages: the best-ranked thread of each root; deleted messages and those without an id are left out.

    A thread that isn't valid, as with a blank message, is left out as a whole.
    """
    nodes = rows.where((F.col("lang") == language) & ~F.coalesce("deleted", F.lit(False)) & (F.col("message_id") != ""))
    nodes = nodes.withColumn("role", F.when(F.col("role") == "prompter", "user").otherwise(F.col("role"))).withColumn("seq", F.col("message_id"))
    said = best_threads(nodes).join(nodes.select("message_id", "text"), "message_id")
    good = valid(said.select(F.col("root").alias("conv_id"), F.col("depth").alias("turn"), "role", "text")).where("valid")
    said = said.join(good.select(F.col("conv_id").alias("root")), "root", "left_semi")
    line = F.concat(F.when(F.col("role") == "user", USER).otherwise(ASSISTANT), "text")
    parts = said.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("depth", line.alias("line")))).alias("parts"))
    return parts.select(F.array_join(F.transform("parts", lambda p: p.line), "\n").alias("text"))


def ranked_threads(rows: DataFrame, language: str = "en") -> DataFrame:
    """Trees of messages, as the older loader takes them: from each root to the best-ranked child, or the first, to the end.

    Roles needn't take turns, an unanswered prompt at the end stays, blank messages stay, and it doesn't matter what is marked as deleted.
    """
    nodes = rows.where(F.col("lang") == language)
    seq = F.col("seq") if "seq" in rows.columns else F.col("message_id")
    path = ranked_paths(nodes.select("message_id", "parent_id", "rank", seq.alias("seq")))
    line = F.concat(F.when(F.col("role") == "prompter", USER).otherwise(ASSISTANT), F.coalesce("text", F.lit("")))
    said = path.join(nodes.select("message_id", line.alias("line")), "message_id")
    parts = said.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("depth", "line"))).alias("parts"))
    return parts.select("root", F.array_join(F.transform("parts", lambda p: p.line), "\n").alias("text"))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (plain, alternating, question_answer, messages, human_assistant, threads, ranked_threads)}


def joined(texts: Column) -> Column:
    """An array of texts as one, for a tokenizer's sample."""
    return F.array_join(texts, SEPARATOR)


def head(rows: DataFrame, n: int, groups: list[str], order: str) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return rows.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")
