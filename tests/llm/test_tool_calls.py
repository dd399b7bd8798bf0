"""Tool-call linking on a small fixture."""

import json

import pytest

from ampersift.llm import toolcalls

SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True), ("say", "opts", "object", False)]
CALLS = [
    (1, 0, "x", "add", '{"b": 1.5, "a": 2}', []),
    (1, 2, "y", "say", '{"text": "q\\"é", "opts": {"z": [1], "k": null}}', ["x", "x", None]),
    (2, 0, "x", "add", '{"a": "2"}', []),
    (2, 1, "y", "add", "[1]", ["x"]),
    (2, 2, "z", "fly", "{}", ["x"]),
    (2, 3, "w", "say", '{"txt": 1}', None),
    (2, 4, "v", "say", None, []),
    (3, 0, "p", "add", '{"a": 1}', ["q"]),
    (3, 1, "q", "add", '{"a": 1}', ["r"]),
    (3, 2, "r", "add", '{"a": 1}', []),
    (3, 3, "s", "add", '{"a": 1}', ["absent"]),
    (4, 0, "p", "add", '{"a": 1}', ["q"]),
    (4, 1, "q", "add", '{"a": 1}', ["p"]),
    (4, 2, "o", "add", '{"a": 1}', ["p"]),
    (4, 3, "n", "add", '{"a": 1}', []),
    (5, 0, "d", "add", '{"a": 1}', []),
    (5, 1, "d", "add", '{"a": 2}', []),
    (None, 0, "x", "add", "{}", []),
    (6, 0, None, "add", "{}", []),
]
RESULTS = [(1, 1, "x", "3.5"), (1, 3, "y", None), (1, 4, "x", "late"), (3, 4, "p", "ok"), (3, 5, "q", "ok"), (9, 0, "x", "stray")]
CALL_SCHEMA = "conv_id long, turn long, call_id string, tool string, arguments string, depends array<string>"
RESULT_SCHEMA = "conv_id long, turn long, call_id string, content string"
RULE_SCHEMA = "tool string, name string, kind string, required boolean"


@pytest.fixture(scope="module")
def linked(llm):
    frames = [llm.createDataFrame(*x) for x in ((CALLS, CALL_SCHEMA), (RESULTS, RESULT_SCHEMA), (SCHEMAS, RULE_SCHEMA))]
    return {(r["conv_id"], r["call_id"]): r for r in toolcalls.link_calls(*frames).collect()}


def test_status_and_level(linked):
    assert {k: (r["status"], r["level"]) for k, r in linked.items()} == {
        (1, "x"): ("ok", 0),
        (1, "y"): ("ok", 0),
        (2, "x"): ("bad_arguments", 0),
        (2, "y"): ("bad_arguments", 0),
        (2, "z"): ("unknown_tool", 0),
        (2, "w"): ("bad_arguments", 0),
        (2, "v"): ("bad_arguments", 0),
        (3, "p"): ("ok", 2),
        (3, "q"): ("ok", 1),
        (3, "r"): ("no_result", 0),
        (3, "s"): ("missing_dependency", 0),
        (4, "p"): ("circular", None),
        (4, "q"): ("circular", None),
        (4, "o"): ("circular", None),
        (4, "n"): ("no_result", 0),
        (5, "d"): ("no_result", 0),
    }


def test_canonical_json(linked):
    assert linked[1, "x"]["json"] == (
        '{"after":[],"arguments":{"a":2,"b":1.5},"id":"x","level":0,"name":"add","result":"3.5","status":"ok"}'
    )
    for r in linked.values():
        value = json.loads(r["json"])
        assert r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(linked[1, "y"]["json"])["after"] == ["x"]


def test_empty_tables(llm):
    frames = [llm.createDataFrame([], s) for s in (CALL_SCHEMA, RESULT_SCHEMA, RULE_SCHEMA)]
    assert toolcalls.link_calls(*frames).count() == 0
