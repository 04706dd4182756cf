"""JSON inside texts: what Spark's patterns find against a plain scan with Python's decoder."""

import json
import random

from docsheaf.functions.embedded import OBJECT, OBJECT_OR_LIST, first_embedded
from docsheaf.operators import dialogue, regions

ENVELOPE = '{"tool_calls":[{"name":"inspect_visual","arguments":{"name":"a.png","task":"find stamp"}}]}'
SAME = [("inspect_visual", {"name": "a.png", "task": "find stamp"})]
TOOLS = ["inspect_visual", "read_attachment"]


def first_value(text, opening):
    for k, c in enumerate(text):
        if c in opening:
            try:
                _, end = json.JSONDecoder().raw_decode(text, k)
                return text[k:end]
            except ValueError:
                continue
    return None


def odd_texts(n, seed):
    rng, pieces = random.Random(seed), ['{"a": 1}', "{", "}", "[", "]", '"', '\\"', "\\", '{"b": ["x}", {"c": "\\"]"}]}', " text ", ",", '"k": ', "[1, 2]", "é{}", '{"d": {"e": {"f": []}}}', "\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_first_value_in_a_text(spark):
    texts = odd_texts(600, 1) + ['{"a":' * 3000, "[" * 5000, '{"x": "' + "\\u00e9" * 5000 + '"} tail', '{"x": [' + ", ".join(['{"y": "z"}'] * 3000) + "]}", '"unclosed {"a": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: (r.o, r.v) for r in df.select("k", first_embedded(df.text, OBJECT).alias("o"), first_embedded(df.text, OBJECT_OR_LIST).alias("v")).collect()}
    assert got == {k: (first_value(t, "{"), first_value(t, "{[")) for k, t in enumerate(texts)}
    assert sum(o is not None for o, _ in got.values()) > 200


def calls(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    return [([(c.name, json.loads(c.arguments)) for c in r.calls], r.rest) for r in dialogue.extract_tool_calls(df, TOOLS, "k").orderBy("k").collect()]


def test_calls_in_several_shapes(spark):
    texts = [
        ENVELOPE, f"```json\n{ENVELOPE}\n```", f"I will check.\n{ENVELOPE}", '<tool_call>{"name":"inspect_visual","arguments":{"name":"a.png","task":"find stamp"}}</tool_call>',
        '{"name":"inspect_visual","arguments":"{\\"name\\":\\"a.png\\",\\"task\\":\\"find stamp\\"}"}', '{"function":{"name":"inspect_visual","args":{"name":"a.png","task":"find stamp"}}}',
        '<tool_call id="1">\n[{"tool":"inspect_visual","parameters":{"task":"find stamp","name":"a.png"}}]\n</tool_call>', '{x} {"name": "inspect_visual", "arguments": {"name": "a.png", "task": "find stamp"}}',
    ]
    got = calls(spark, texts)
    assert [c for c, _ in got] == [SAME] * len(texts)
    assert [rest for _, rest in got] == ["", "", "I will check.", "", "", "", "", "{x}"]


def test_what_is_no_call_stays_as_it_is(spark):
    texts = ['{"name":"BRACKET","qty":4}', '{"tool_calls":[{"name":"delete_everything","arguments":{}}]}', "No JSON here.", "", '{"name": "BRACKET", "arguments": {"qty": 4}]}', '"inspect_visual" alone']
    assert calls(spark, texts) == [([], t) for t in texts]


def test_calls_from_broken_envelopes(spark):
    broken = '{"tool_calls": [{"name": "inspect_visual", "arguments": {"name": "sheet", "page": 1, "task": "mark"}} ]} ]}'
    open_ = '{"tool_calls": [{"name": "inspect_visual", "arguments": {"name": "sheet", "page": 1, "task": "mark"}]} ]}'
    two = '{"tool_calls": [{"name": "inspect_visual", {"tool": "read_attachment", "args": {"n": 1}, {"name": "inspect_visual", "args": 5, "arguments": {"n": 2}}'
    cut = '{"tool_calls": [{"name": "read_attachment", "arguments": {"name": "a.pd'
    want = [("inspect_visual", {"name": "sheet", "page": 1, "task": "mark"})]
    assert calls(spark, [broken, open_, two, cut]) == [(want, "]}"), (want, ""), ([("inspect_visual", {"n": 1}), ("read_attachment", {"n": 1})], ""), ([], cut)]
    df = spark.createDataFrame([(1, cut), (2, open_), (3, "text"), (4, '{"name": "BRACKET", "qty": 4}')], "k int, content string")
    assert [r.k for r in dialogue.flag_malformed_envelopes(df, TOOLS, "k").collect()] == [1]


def test_regions_of_odd_replies(spark):
    texts = odd_texts(300, 2) + ['{"text": 5, "regions": [{"label": "a"}, 7, null, {"bbox": [1, 2, 3, 4]}]}', '{"regions": "none"}', 'x [{"label": "b"}] {"regions": []}', '{"text": "t"}', None, "3600", '"none"', "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, reply string")
    got = {r.k: (r.structured, r.text, len(r.regions)) for r in regions.parse_regions(df, "k").collect()}
    for k, text in enumerate(texts):
        raw, value = (text or "").strip(), None
        try:
            value = json.loads(raw)
        except ValueError:
            pass
        if not isinstance(value, dict | list):
            found = first_value(raw, "{[")
            value = json.loads(found) if found else None
        whole = {"regions": value} if isinstance(value, list) else value
        listed = whole.get("regions") if whole is not None else None
        n = sum(isinstance(x, dict) for x in listed) if isinstance(listed, list) else 0
        assert got[k] == (value is not None, str(whole.get("text") or "") if value is not None else raw, n), text
