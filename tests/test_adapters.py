"""Adapters on rows of each shape."""

from pyspark.sql import functions as F

from loomery.sources import adapters


def texts(rows):
    return sorted(r.text for r in rows.collect())


def test_shapes(spark):
    rows = spark.createDataFrame([(["q", "a", "r"],), ([],)], "data array<string>")
    assert texts(adapters.alternating(rows)) == ["USER: q\nASSISTANT: a\nUSER: r"]
    rows = spark.createDataFrame([("q", "a"), ("", "a"), ("q", None)], "question string, response string")
    assert texts(adapters.question_answer(rows)) == ["USER: q\nASSISTANT: a"]
    rows = spark.createDataFrame([([("user", "q"), ("assistant", ""), ("assistant", "a")], "English"), ([("user", "x")], "French")], "conversation array<struct<role: string, content: string>>, language string")
    assert texts(adapters.messages(rows)) == ["USER: q\nASSISTANT: a"]
    rows = spark.createDataFrame([("\n\nHuman: q\n\nAssistant: a",), ("",)], "chosen string")
    assert texts(adapters.human_assistant(rows)) == ["USER: q\nASSISTANT: a"]
    assert texts(adapters.plain(spark.createDataFrame([("x",), ("",), (None,)], "text string"))) == ["x"]


def test_threads(spark):
    nodes = [("a", None, "prompter", "q", "en", None, False), ("b", "a", "assistant", "bad", "en", 1.0, False), ("c", "a", "assistant", "good", "en", 0.0, None), ("d", "c", "prompter", "more", "en", None, False), ("e", "a", "assistant", "gone", "en", -1.0, True), ("f", None, "prompter", "q", "de", None, False)]
    rows = spark.createDataFrame(nodes, "message_id string, parent_id string, role string, text string, lang string, rank double, deleted boolean")
    assert texts(adapters.threads(rows)) == ["USER: q\nASSISTANT: good"]


def test_blank_threads(spark):
    """A thread with a blank message is left out, whatever else it holds."""
    nodes = [(f"{k}{i}", f"{k}{i - 1}" if i else None, "assistant" if i % 2 else "prompter", text, "en", None, False) for k, said in (("x", ["q", "a", " \n", "b"]), ("y", ["q", None]), ("z", ["q", "a"])) for i, text in enumerate(said)]
    rows = spark.createDataFrame(nodes, "message_id string, parent_id string, role string, text string, lang string, rank double, deleted boolean")
    assert texts(adapters.threads(rows)) == ["USER: q\nASSISTANT: a"]


def test_head_and_join(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "task string, seq int")
    assert sorted((r.task, r.seq) for r in adapters.head(rows, 2, ["task"], "seq").collect()) == [("a", 0), ("a", 1), ("b", 9)]
    assert spark.range(1).select(adapters.joined(F.array(F.lit("x"), F.lit("y")))).first()[0] == "x\n\n###\n\ny"


def test_ranked_threads(spark):
    """The older loader: ranks, else the first child; no roles, no trimming, deleted messages stay."""
    nodes = [("a", None, "prompter", "q", "en", None, False), ("b", "a", "prompter", "again", "en", 1.0, True), ("c", "a", "assistant", "worse", "en", 2.0, None), ("d", "b", "assistant", "x", "en", None, None), ("e", "b", "assistant", "y", "en", None, None), ("f", "d", "prompter", None, "en", None, None), ("g", None, "assistant", "alone", "en", None, None), ("h", None, "prompter", "q", "de", None, False)]
    rows = spark.createDataFrame(nodes, "message_id string, parent_id string, role string, text string, lang string, rank double, deleted boolean")
    assert texts(adapters.ranked_threads(rows)) == ["ASSISTANT: alone", "USER: q\nUSER: again\nASSISTANT: x\nUSER: "]
