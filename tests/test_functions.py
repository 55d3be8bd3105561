"""Text, literal and validation functions row by row."""

import pytest
from pyspark.sql import functions as F

from calltrail.functions import prompts, pyliteral, text
from calltrail.functions import validation as val
from calltrail.plans import catalog as cat

GOLDEN = [
    ('{"a": 1, "b": 2}', "", ""),
    ("x", "timeout", "timeout"),
    (" {} ", "", "Empty response from API"),
    (None, "", "Empty response from API"),
    ("\u00a0\n", "", "Empty response from API"),
    ("None", "", "Response is Python 'None' string"),
    ("%PDF-1.4", "", "Binary data is not supported in API response"),
    ("\x89PNG..", "", "Binary data is not supported in API response"),
    ("\x01" * 30 + "a" * 30, "", "Binary data is not supported in API response"),
    ("\x01" * 20 + "a" * 40, "", ""),
    ("<html><body>x", "", val.MARKUP),
    ("  <!DocType HTML>", "", val.MARKUP),
    ("<note>fine</note>", "", ""),
    ("No data found", "", "Explicit error message found: 'No data found'"),
    ("too many requests", "", "Rate limit exceeded"),
    ("{'us': {}}", "", "API returned single-key object with empty value"),
    ("{'us': 0}", "", ""),
    ('{"us": {"a": []}}', "", "API returned metadata and single empty key 'us'"),
    ('{"status": "OK", "count": 0}', "", "API returned only metadata/status fields with no content"),
    ('{"status": "OK", "data": {"x": []}}', "", "API returned metadata and single empty key 'data'"),
    ('{"status": "OK", "data": ["", ":"]}', "", ""),
    ('{"status": "OK", "data": {"a:\\"": [null, "", {}]}}', "", "API returned metadata and single empty key 'data'"),
    ('{"a": 1, "Error": "invalid key"}', "", "Invalid input"),
    ('{"a": 1, "error": "fine", "ERROR": "Forbidden here"}', "", "Access forbidden"),
    ('{"a": 1, "b": "y", "message": "' + "m" * 101 + ' invalid"}', "", "Invalid input"),
    ('{"a": 1, "detail": "Rate limit hit"}', "", "API error: Rate limit hit"),
    ('{"a": 1, "success": false}', "", "API failed: Unknown error"),
    ('{"a": 1, "success": false, "message": null}', "", "API failed: None"),
    ('{"a": 1, "Success": false, "MESSAGE": "no luck"}', "", "API failed: no luck"),
    ('{"a": 1, "b": 2, "status": 404}', "", "JSON 'status' is error code: 404"),
    ('{"a": 1, "b": 2, "code": "404"}', "", "JSON 'code' is error code: 404"),
    ('{"a": 1, "b": 2, "code": 404.9}', "", "JSON 'code' is error code: 404"),
    ('{"a": 1, "b": 2, "code": "404.9"}', "", ""),
    ('{"a": 1, "b": 2, "code": true}', "", ""),
    ('{"a": 1, "code": 0, "data": "No result for you"}', "", "JSON 'code' is 0 with no result"),
    ('{"a": 1, "b": 2, "meta": {"status": 401}}', "", "JSON 'meta.status' is error code: 401"),
    ('{"a": [], "b": []}', "", "API returned object with only empty arrays"),
    ('{"a": [], "b": 0}', "", "API returned object with only empty arrays"),
    ('{"a": [], "b": false}', "", "API returned object with only empty arrays"),
    ('{"a": [], "b": [1]}', "", ""),
    ('{"note": "the error term", "b": 2}', "", "API error"),
    ("[ ]", "", "API returned empty array instead of structured response"),
    ("{ }", "", "API returned empty object instead of structured response"),
    ('{"a": 1, "status": "error"}', "", "API failed: Unknown error"),
    ('{"a": 1, "b": 2, "ok": "false"}', "", "JSON 'ok' field is false"),
    ('{"a": 1, "b": 2, "success": "False"}', "", "JSON 'success' field is false"),
    ('{"a": 1, "b": 2, "code": "failed"}', "", "JSON 'code' indicates error: failed"),
    ('{"a": 1, "b": 2, "notice": "upgrade your plan"}', "", val.PLAN),
    ('{"a": 1, "detail": [{"msg": "bad"}]}', "", "Validation error: bad"),
    ('{"success": true, "data": {"results": [], "k": 1}}', "", "Empty results returned"),
    ('{"success": true, "results": [], "x": {"y": 1}}', "", "Empty results returned"),
    ('{"success": true, "data": {"results": [], "k": 1, "l": 2, "m": 3}, "x": 1}', "", ""),
    ("plain sunny text", "", ""),
    ("123", "", ""),
    ("{'a': None, 'b': (1, 2), 'c': 'it\\'s'}", "", ""),
    ("{'a': 1, 'b': 2, 'status': 500}", "", "JSON 'status' is error code: 500"),
    ('{"a": NaN, "b": 1, "status": 503}', "", "JSON 'status' is error code: 503"),
    ('{"a": 1, "b": 1, "status": 200, "status": 503}', "", "JSON 'status' is error code: 503"),
    ("{broken", "", ""),
    ("{broken error", "", "API error"),
]


def test_validation_golden_rows(spark):
    df = spark.createDataFrame(GOLDEN, "response string, error string, want string").repartition(2)
    for r in val.validate_responses(df).collect():
        assert r.reason == r.want, r.response
        assert r.is_valid == (r.want == "")


def test_every_list_entry_is_found_first(spark):
    """Expected by plain Python over the same lists."""
    texts = [f"Well, {e} it is" for e in val.EXPLICIT_ERRORS] + [f"So {k} it is" for k, _ in val.ERROR_KEYWORDS]
    wants = []
    for t in texts:
        explicit = [e for e in val.EXPLICIT_ERRORS if e in t]
        word = [r for k, r in val.ERROR_KEYWORDS if k in t.lower()]
        wants.append(f"Explicit error message found: '{explicit[0]}'" if explicit else word[0])
    df = spark.createDataFrame([(t, "", w) for t, w in zip(texts, wants)], "response string, error string, want string")
    assert all(r.reason == r.want for r in val.validate_responses(df).collect())


def test_every_list_entry_holds_a_stem():
    for entry in [*val.EXPLICIT_ERRORS, *[k for k, _ in val.ERROR_KEYWORDS]]:
        assert any(s in entry.lower() for s in val.STEMS), entry


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"q": "it\'s", "n": 1, "x": null, "y": true}', "t(q=\"it's\", n=1, x=None, y=True)"),
        ('{"l": [1, -2.5, {"a": "b"}]}', "t(l=[1, -2.5, {'a': 'b'}])"),
        ("{}", "t()"), ("not json", "t()"), ("[1]", "t()"), ('"text"', "t()"),
        ('{"big": 12345678901234567890, "e": 1e20}', "t(big=12345678901234567890, e=1e+20)"),
        ('{"nl": "a\\nb", "q": "\'\\""}', "t(nl='a\\nb', q='\\'\"')"),
    ],
)
def test_call_text(raw, want):
    assert pyliteral.call_text("t", raw) == want


def test_literal_and_json_text():
    assert pyliteral.literal_text('{"a": [true, null]}') == "{'a': [True, None]}"
    assert pyliteral.literal_text("plain") == "'plain'"
    assert pyliteral.json_text("{'a': None, 'b': float}") is None
    assert pyliteral.json_text("{'a': (1,), 2: nan}") is None
    assert pyliteral.json_text("{'a': None, 2: 'x'}") == '{"a": null, "2": "x"}'
    assert pyliteral.json_text("{'a', 'b'}") is None
    assert pyliteral.record_text("t", "free") == "{'function': 't', 'parameters': 'free'}"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Get  Weather--Now!", "get_weather_now"), ("2d map", "get_2d_map"), ("__x__", "x"), ("", ""), ("!!!", ""),
        ("a^b", "a^b"), ("天气 API", "天气_api"), ("___", ""),
    ],
)
def test_standardize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.standardize(F.col("s"))).head()[0] == want


def test_small_text_helpers(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).head()[0]
    assert show(text.standardize_category(F.lit("a____b, c/d"))) == "a__b_c_d"
    assert tuple(show(text.parse_full_name(F.lit("a-b-c")))) == ("a", "b", "c")
    assert tuple(show(text.parse_full_name(F.lit("a-b")))) == ("", "", "")
    assert tuple(show(text.parse_full_name(F.lit("a-b-c-d")))) == ("", "", "")
    assert show(text.preview(F.lit("x" * 201))) == "x" * 200 + "..."
    assert show(text.padded(F.lit(1234567), 5)) == "1234567"
    assert show(text.fenced_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert show(text.fenced_json(F.lit("nope"))) == "{}"
    assert show(text.strip(F.lit("\u3000\t x \x85"))) == "x"
    assert show(text.clip(F.lit(120), 0, 100)) == 100
    pairs = F.array(F.struct(F.lit("h1").alias("hash"), F.lit("a-b-c").alias("name")))
    assert show(text.replace_names(F.lit("use h1 then h1"), pairs)) == "use a-b-c then a-b-c"


def test_unique_ids_survive_collisions(spark):
    keys = spark.range(3000).withColumnRenamed("id", "key")
    out = text.unique_ids(keys, "key", 1, length=2)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000


def test_function_definition(spark):
    p = lambda n, t, d: {"name": n, "type": t, "description": d}
    df = spark.createDataFrame(
        [([p("a", "NUMBER", "one"), p("", "X", "gone")], [p("b", None, None), p("a", "STRING", "two")])],
        f"required array<{cat.PARAM}>, optional array<{cat.PARAM}>",
    )
    got = df.select(cat.function_definition(F.lit("n"), F.lit("d"), F.col("required"), F.col("optional"))).head()[0]
    assert got == (
        '{"name":"n","description":"d","parameters":{"type":"object","properties":'
        '{"a":{"type":"STRING","description":"two"},"b":{"type":"string","description":""}},"required":["a"]}}'
    )
    schema = df.select(cat.argument_schema(F.col("required"), F.col("optional"))).head()[0]
    assert [(e.name, e.type, e.description) for e in schema] == [("a", "str", "two\n"), ("", "str", "gone\n"), ("b", "str", "\n")]


def test_param_types(spark):
    rows = [(t,) for t, _ in cat.UPPER_TYPES] + [("nonsense",), ("TIME (24-hour HH:MM)",)]
    df = spark.createDataFrame(rows, "t string")
    got = {r.t: (r.p, r.c) for r in df.select("t", cat.python_type(F.lower("t")).alias("p"), cat.type_comment(F.col("t")).alias("c")).collect()}
    assert all(got[t][0] == name for t, name in cat.UPPER_TYPES)
    assert got["nonsense"] == ("str", "")
    assert got["TIME (24-hour HH:MM)"] == ("str", "time in the format of '24-hour HH:MM'")


def test_messages_leave_out_an_empty_system(spark):
    rows = spark.createDataFrame([("", "u", "a"), ("s", "u", "a")], "s string, u string, a string")
    got = rows.select(prompts.messages(F.col("s"), F.col("u"), F.col("a")).alias("m")).collect()
    assert [[m.role for m in r.m] for r in got] == [["user", "assistant"], ["system", "user", "assistant"]]


VALUES = [
    '{"a": 1, "b": "x"}', '{}', ' { "a" : [ 1 , 2.5, true ] , "k": {"z": null, "a=b": "c: d, e"} } ', '[]', '[1, "two", false]', '"s"', "7", "null",
    '{"a": "it\'s"}', '{"a": "q\\"q"}', '{"a": "ü"}', '{"a": 1.50}', '{"a": 1e5}', '{"a": -0}', '{"a": 0.00001}', '{"a": 0.0001}', '{"a": 12345678901234567890}',
    '{"a": 1, "a": 2}', '{"a": 1}{"b": 2}', "1, 2", "1 2", "", "free text", None, '{"a": NaN}', '{"a": -1.5, "b": -3, "c": 0.0, "d": -0.5}',
    '{"true": true, "null": "null, true: false"}', '{"a": {"b": {"c": [{"d": "e"}, [[]], {}]}}, "f": "g"}', '{"": "", "x": ""}', '{"a":\n1,\t"b":[{}]}',
    '{"a": "' + "x" * 5000 + '"}', '{"a": "back\\\\slash"}', '{"a": "tab\\t"}', '{"a": 01}', "{'a': 1}", '{"a": [1,]}', '["a:b", {"c,d": [":", ","]}]', '{"a": 1.0e3}', '{"a": 1.}',
]


def test_python_text_by_expressions_equals_python(spark):
    tools = ["t", "tool name", "it's", 'a"b', "ü", None, "back\\slash"]
    rows = [(i, t, v) for i, (t, v) in enumerate((t, v) for t in tools for v in VALUES)]
    df = spark.createDataFrame(rows, "i int, tool string, v string")
    got = df.select(
        "i", "tool", "v", pyliteral.to_call_text("tool", "v").alias("call"), pyliteral.to_record_text("tool", "v").alias("record"),
        pyliteral.to_literal_text("v").alias("literal"), pyliteral.is_plain(F.col("v")).alias("plain"),
    ).collect()
    for r in got:
        assert r.call == (None if r.tool is None else pyliteral.call_text(r.tool, r.v)), r
        assert r.record == (None if r.tool is None else pyliteral.record_text(r.tool, r.v)), r
        assert r.literal == pyliteral.literal_text(r.v), r
    assert {r.v for r in got if r.plain} >= set(VALUES[:8])
    assert not any(r.plain for r in got if r.v in VALUES[8:15] + VALUES[16:25])


def test_results_that_are_lists_or_tuples(spark):
    from calltrail.plans import workflows as wf
    from calltrail.sources import readers

    step = lambda result: f"[{{'tool': 't', 'tool_input': {{}}, 'log': '', 'tool_call_id': 'c'}}, {result}]"
    results = ["('one',)", "['one', 2, None]", "('one', 2)", "'text'", "{'error': '', 'response': 'r'}"]
    document = "{'query': 'q', 'api_use_chains': {'api_use_chain_1': {'chain_id': 'c', 'intermediate_steps': [" + ", ".join(map(step, results)) + "]}}, 'response': 'r'}"
    good, bad = readers.parse_workflows(spark.createDataFrame([("w", document)], "id string, text string"))
    assert bad.count() == 0
    got = [(r.result_kind, r.result) for r in wf.flatten_steps(good).orderBy("step_pos").collect()]
    assert got[:4] == [("text", "one"), ("text", "['one', 2, None]"), ("text", "('one', 2)"), ("text", "text")] and got[4][0] == "object"
