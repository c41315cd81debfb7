"""Tool calls: links, order, checks and canonical lines."""

import json
import random

from loomery.llm import chat

CALL = lambda *calls: json.dumps({"content": None, "tool_calls": list(calls)})
ANSWER = lambda i, c: json.dumps({"tool_call_id": i, "content": c})


def test_links(spark):
    rows = [
        (1, 0, "user", 'say "é"\n'),
        (1, 1, "assistant", CALL({"id": "a", "name": "f", "arguments": {"z": 1, "b": {"y": 2, "x": "é"}, "q": "s"}}, {"id": "b", "name": "f", "arguments": '{"q": 5}', "after": ["a", "gone"]})),
        (1, 2, "tool", ANSWER("a", "ok")), (1, 3, "tool", ANSWER("b", "ok2")), (1, 4, "tool", ANSWER("zz", "?")), (1, 5, "tool", ANSWER("a", "again")),
        (2, 0, "assistant", CALL({"id": "x", "name": "g", "arguments": {}, "after": ["y"]}, {"id": "y", "name": "g", "arguments": [1], "after": ["x"]}, {"name": "g", "arguments": {}})),
        (3, 0, "assistant", "{bad json"), (3, 1, "tool", "plain"), (3, 2, "assistant", CALL({"id": "a", "name": "f", "arguments": "no json"})), (None, None, None, None),
        (4, 0, "assistant", CALL({"id": "r", "name": "f", "arguments": {"q": "1"}})), (4, 1, "assistant", CALL({"id": "r", "name": "f", "arguments": {"q": "2"}})), (4, 2, "tool", ANSWER("r", "1")),
        (5, 0, "user", "same"), (5, 0, "user", "same"),
    ]
    tools = spark.createDataFrame([("f", "q", "string", True), ("f", "z", "integer", False), ("f", "b", "object", False)], chat.TOOLS)
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS line", "1 AS level", "2 AS pos")
    got = {(r.conv_id, r.turn): r for r in chat.formatted(messages, tools).collect()}
    assert chat.formatted(messages, tools).count() == len(rows)
    assert got[1, 0].line == '{"content":"say \\"é\\"\\n","role":"user"}'
    calls = json.loads(got[1, 1].line)["tool_calls"]
    assert [(c["id"], c["level"], c["status"], c["errors"]) for c in calls] == [("a", 0, "linked", []), ("b", 1, "linked", ["type of q"])]
    assert '"arguments":{"b":{"x":"é","y":2},"q":"s","z":1}' in got[1, 1].line
    assert [(got[1, t].status, got[1, t].level) for t in (2, 3, 4, 5)] == [("linked", 1), ("linked", 2), ("orphan", -1), ("repeated", -1)]
    assert [c["status"] for c in json.loads(got[2, 0].line)["tool_calls"]] == ["cyclic", "cyclic", "invalid"]
    assert got[3, 0].status == got[3, 1].status == "plain" and json.loads(got[3, 2].line)["tool_calls"][0]["errors"] == ["not an object"]
    assert json.loads(got[4, 0].line)["tool_calls"][0]["status"] == "linked" and json.loads(got[4, 1].line)["tool_calls"][0]["status"] == "repeated"
    assert got[None, None].line == '{"content":null,"role":null}'


def test_long_chain(spark):
    rows = [(7, i, "assistant", CALL({"id": str(i), "name": "f", "arguments": {}, "after": [str(i - 1)]})) for i in range(6)] + [(7, 10 + i, "tool", ANSWER(str(i), "x")) for i in range(6)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.turn: r.level for r in got.collect() if r.role == "assistant"} == {i: i for i in range(6)}
    order = [(r.role, r.turn) for r in chat.linked(got).collect()]
    assert all(order.index(("assistant", i)) < order.index(("tool", 10 + i)) for i in range(6))


def brute_levels(calls):
    """Level of each call by the definition, from {id: needs}; None for what waits for itself."""
    level = {}
    for _ in range(len(calls) + 1):
        for i, needs in calls.items():
            inner = [n for n in needs if n in calls]
            if all(n in level for n in inner):
                level[i] = max((level[n] + 1 for n in inner), default=0)
    return level


def test_levels_against_brute_force(spark):
    rows, want = [], {}
    for conv in range(40):
        r = random.Random(conv)
        n = r.randint(1, 14)
        calls = {str(i): [str(r.randrange(-1, i + (conv % 4 == 0) * 3 + 1) - 0) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for i in range(n)}
        rows += [(conv, i, needs) for i, needs in calls.items()]
        want |= {(conv, i): v for i, v in brute_levels(calls).items()}
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, id string, after array<string>")).collect()
    assert {(r.conv_id, r.id): r.level for r in got} == want and len(got) == len(want)


def test_thousand_links(spark):
    calls = spark.range(1000).selectExpr("1L AS conv_id", "string(id) AS id", "array(string(id - 1)) AS after")
    assert {int(r.id): r.level for r in chat.levels(calls).collect()} == {i: i for i in range(1000)}


def test_from_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a b"), (1, 2, "assistant", "x"), (1, 3, "user", "c\nd"), (1, 4, "assistant", "y" * 100_000), (1, 6, "assistant", "z"), (1, 7, "user", "w " * 80), (2, 1, "user", None), (2, 1, "user", None), (2, 2, "assistant", None), (2, 2, "assistant", None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.formatted(*chat.as_calls(messages)).collect()
    seen = sorted((r.conv_id, r.turn, r.role, r.status, r.level, r.n_linked, r.n_valid) for r in got)
    assert seen == [
        (1, 0, "system", "plain", 0, 0, 0), (1, 1, "assistant", "calls", 0, 1, 1), (1, 2, "tool", "linked", 1, 0, 0), (1, 3, "assistant", "calls", 1, 1, 0), (1, 4, "tool", "linked", 2, 0, 0),
        (1, 6, "tool", "orphan", -1, 0, 0), (1, 7, "assistant", "calls", 0, 0, 0), (2, 1, "assistant", "calls", 0, 0, 1), (2, 1, "assistant", "calls", 0, 1, 1),
        (2, 2, "tool", "linked", 1, 0, 0), (2, 2, "tool", "repeated", -1, 0, 0),
    ]
    assert any(len(r.line) > 100_000 and json.loads(r.line)["content"] == "y" * 100_000 for r in got)


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
