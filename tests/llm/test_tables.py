"""Operators on conversations and pages."""

import json
import math

import pytest

CALLS = "conv_id long, turn long, call_id string, parent_id string, tool string, arguments map<string,string>, position string, level string"
RESULTS = "call_id string, turn long, content string, status string"
SCHEMAS = "tool string, argument string, type string, required boolean, values array<string>"


def link(spark, calls, results, schemas):
    from tallyframe.llm.toolcalls import link_tool_calls

    return link_tool_calls(spark.createDataFrame([(*c, "x", "y") for c in calls], CALLS), spark.createDataFrame([(*r, "z") for r in results], RESULTS),
                           spark.createDataFrame(schemas, SCHEMAS))


def test_calls(spark):
    rules = [("add", "a", "integer", True, None), ("add", "b", "number", False, None), ("add", "mode", "string", False, ["fast", "slow"]), (None, None, None, None, None)]
    calls = [
        (1, 5, "c", "b", "add", {"a": "1", "b": "-2.5e3"}), (1, 3, "b", "a", "add", {"a": "x"}), (1, 1, "a", None, "add", {"a": "01", "z": None}),
        (1, 2, "p", "gone", "add", {"a": "0", "mode": "odd"}), (1, 9, "u", "v", "add", {"a": "1"}), (1, 9, "v", "u", "add", {"a": "1"}), (1, 9, "w", "v", "add", {"a": "1"}),
        (2, 1, "q", None, "none", None), (2, 2, "dup", None, "add", {"a": "1"}), (2, 1, "dup", None, "add", {"a": "2"}), (None, None, "n", None, None, {}),
        (3, 1, None, None, "add", {"a": "1"})]
    results = [("c", 6, 'say "é"\n\t\\ \u0001'), ("b", 4, None), ("a", 2, "r"), ("p", 3, ""), ("lost", 7, "x"), ("dup", 9, "later"), ("dup", 8, "first"), (None, 1, "who")]
    rows = link(spark, calls, results, rules).collect()
    got = {r.call_id: r for r in rows if r.call_id}
    assert len(rows) == 13
    assert [got[x].level for x in "abcp"] == [0, 1, 2, 0] and [got[x].level for x in "uvw"] == [None] * 3
    assert [got[x].position for x in "apbc"] == [0, 1, 2, 3]
    assert {x: (got[x].status, got[x].errors) for x in got} == {
        "a": ("invalid", ["type:a", "unknown:z"]), "b": ("invalid", ["type:a"]), "c": ("ok", []), "p": ("invalid", ["value:mode"]), "u": ("cycle", []), "v": ("cycle", []),
        "w": ("cycle", []), "q": ("no_result", ["tool"]), "dup": ("ok", ["repeated_call", "repeated_result"]), "n": ("no_result", ["tool"]), "lost": ("orphan", [])}
    assert got["c"].json == '{"arguments":{"a":"1","b":"-2.5e3"},"call_id":"c","result":"say \\"é\\"\\n\\t\\\\ \\u0001","tool":"add"}'
    assert json.loads(got["dup"].json) == {"arguments": {"a": "2"}, "call_id": "dup", "result": "first", "tool": "add"}
    assert json.loads(got["a"].json)["arguments"] == {"a": "01", "z": None}
    loose = sorted(((r.status, json.loads(r.json)["result"]) for r in rows if r.call_id is None), key=str)
    assert loose == [("no_result", None), ("orphan", "who")]


def test_structured_arguments(spark):
    """Arguments as JSON text: types and nesting stay, keys are in order at each level, all types are checked."""
    from tallyframe.llm.toolcalls import link_tool_calls

    rules = [("t", "o", "object", True, None), ("t", "l", "array", False, None), ("t", "i", "integer", False, ["1", "3", "100"]), ("t", "n", "number", False, None),
             ("t", "b", "boolean", False, None), ("t", "s", "string", False, ["a"]), ("odd", "x", "strnig", False, None), ("any", "x", None, False, None)]
    given = {
        "ok": ("t", '{"s":"a", "o": {"z": [1, {"y": 1.50, "x": null}], "a": {"c": "2.0,", "b": "\\\\\\"1.0}"}}, "n":-2.5e0,"l":[2.0, "é"],"i":1e2,"b":true}',
               '{"b":true,"i":100,"l":[2,"é"],"n":-2.5,"o":{"a":{"b":"\\\\\\"1.0}","c":"2.0,"},"z":[1,{"x":null,"y":1.5}]},"s":"a"}', []),
        "texts": ("t", '{"o":"{}","l":"[]","i":"1","n":"1","b":"true","s":1}', None, ["type:b", "type:i", "type:l", "type:n", "type:o", "type:s"]),
        "swapped": ("t", '{"o":[],"l":{},"i":1.5,"n":true,"b":0,"s":null,"u":1}', None, ["type:b", "type:i", "type:l", "type:n", "type:o", "unknown:u"]),
        "values": ("t", '{"o":{},"i":2,"s":"b"}', None, ["value:i", "value:s"]), "none": ("t", '{"o":null}', None, ["missing:o"]),
        "broken": ("t", '{"o":', '"{\\"o\\":"', ["json"]), "list": ("t", "[1.0, 2]", "[1,2]", ["json"]), "null": ("t", None, "{}", ["missing:o"]),
        "odd": ("odd", '{"x":"a"}', None, ["schema:x"]), "any": ("any", '{"x":[]}', '{"x":[]}', []), "tool": ("gone", "{}", "{}", ["tool"])}
    calls = spark.createDataFrame([(1, i, k, None, v[0], v[1]) for i, (k, v) in enumerate(given.items())], CALLS.split(", position")[0].replace("map<string,string>", "string"))
    results = spark.createDataFrame([(k, 99, "r") for k in given], "call_id string, turn long, content string")
    got = {r.call_id: r for r in link_tool_calls(calls, results, spark.createDataFrame(rules, SCHEMAS)).collect()}
    for k, (_, text, want, errors) in given.items():
        assert (got[k].errors, got[k].status) == (errors, "invalid" if errors else "ok"), k
        if want:
            assert got[k].json == f'{{"arguments":{want},"call_id":"{k}","result":"r","tool":"{given[k][0]}"}}'
        else:
            assert json.loads(got[k].json)["arguments"] == json.loads(text)
    texts = link(spark, [(1, i, k, None, "t", {"o": v, "l": w}) for i, (k, v, w) in enumerate([("a", '{"b": 1}', "[1]"), ("b", "[1]", "x")])] + [
        (1, 5, "c", None, "odd", {"x": "a"})], [(k, 9, "r", ) for k in "abc"], rules).collect()
    assert {r.call_id: r.errors for r in texts} == {"a": [], "b": ["type:l", "type:o"], "c": ["schema:x"]}


def test_no_calls(spark):
    assert link(spark, [], [], []).collect() == []


def test_long_chain(spark):
    """A conversation of one chain of calls, in any order."""
    n = 700
    calls = [(1, n - i, f"k{i}", f"k{i - 1}" if i else None, "t", {"x" * 50000: "y"} if i == 3 else {}) for i in range(n)]
    got = {r.call_id: (r.level, r.position) for r in link(spark, calls, [], []).collect()}
    assert got == {f"k{i}": (i, i) for i in range(n)}


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def judged(spark, urls, rules=RULES, **more):
    from tallyframe.llm.urls import judge_urls

    pages = spark.createDataFrame([(i, u, "a", 1.0, "c") for i, u in enumerate(urls)], "page_id long, url string, host string, depth double, rule string")
    return {r.page_id: r for r in judge_urls(pages, rules, **more).collect()}


URLS = [None, "", "no scheme", "http://A.NET/x", "http://net", "http://net/", "https://b.Example.NET/en/1", "https://example.net/english", "http://notexample.com/de/",
        "http://example.com/de/1?x=/fr/", "ftp://x.org/fr/", "http://x.org/FR/", "http://org/fr/a#b", "://", "x://y?z", "http://a.net?q=1", "http://h/" + "p" * 100000, "http://ü.net/ß",
        "http://a.net/x", "http://a.net/x"]
WANT = [None, None, None, "net/", None, "net/", "example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, "org/fr/", None, None, None, None, "net/", "net/", "net/"]


def test_url_rules(spark):
    got = judged(spark, URLS)
    assert [got[i].rule for i in range(len(URLS))] == WANT
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 3, 6, 9, 13, 14, 15)] == [
        ("", ""), ("", ""), ("", ""), ("a.net", "/x"), ("b.example.net", "/en/1"), ("example.com", "/de/1"), ("", ""), ("y", ""), ("a.net", "")]
    action = {r: a for a, r in RULES}
    assert all(got[i].verdict == action[w] for i, w in enumerate(WANT) if w) and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert judged(spark, []) == {}


def test_url_labels_of_one_kind(spark):
    assert {r.verdict for r in judged(spark, ["http://a.net/x", "http://b.org/y"], (("block", "net/"),)).values()} == {"block"}
    assert {r.verdict for r in judged(spark, ["http://a.net/x", "http://b.org/y"], ()).values()} == {"allow"}


def test_trees_learn_from_rules(spark):
    """Held-out hosts whose URLs look like the labelled ones get the same verdict."""
    good = [f"https://site{i % 7}.org/fr/page{i % 13}" for i in range(200)]
    bad = [f"http://s-{i * 7919 % 1000003}-x.net/a/b/c/d?id={i}&q={i * 31}&z=%20%31{i}" for i in range(200)]
    held_good = [f"https://news{i % 5}.com/about{i % 11}" for i in range(60)]
    held_bad = [f"http://t-{i * 104729 % 1000003}-y.com/a/b/c/e?id={i}&q={i * 17}&z=%21%3{i}" for i in range(60)]
    got = judged(spark, good + bad + held_good + held_bad)
    right = [got[i].verdict == ("allow" if i < 460 else "block") for i in range(400, 520)]
    assert sum(right) >= 0.95 * len(right)


def test_entropy(spark):
    from pyspark.sql import functions as F

    from tallyframe.llm.urls import entropy

    texts = ["", "a", "aab", "http://x.y", "日本日"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(entropy(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        assert g == pytest.approx(-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0, abs=1e-5)
