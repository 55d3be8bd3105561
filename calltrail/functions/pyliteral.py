"""JSON text and Python literal text.

Answers and tool pools are written as Python literals, and API responses often arrive as
such. Texts whose quoting is the same in both (printable ASCII without quotes and backslashes, numbers
that Python writes as they stand) are rewritten by column expressions. Only the others, and texts that
may be no JSON, are quoted by Python itself, one Arrow batch at a time: they alone are handed over, the
rest are nulls there, which pass untouched.
"""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def call_text(tool: str, tool_input: str | None) -> str:
    """name(arg=value, ...); anything but a JSON object as input gives name()."""
    try:
        arguments = json.loads(tool_input)
    except (TypeError, ValueError):
        return f"{tool}()"
    if not isinstance(arguments, dict):
        return f"{tool}()"
    return f"{tool}({', '.join(f'{k}={v!r}' for k, v in arguments.items())})"


def literal_text(json_text: str | None) -> str | None:
    """JSON text as Python literal text; text that is not JSON as a Python string."""
    if json_text is None:
        return None
    try:
        return repr(json.loads(json_text))
    except ValueError:
        return repr(json_text)


_STRING = r"[ !#-&(-\[\]-~]*"  # printable ASCII without " ' and backslash
_NUMBER = r"(?:-?[1-9][0-9]{0,14}|0|-?(?!0\.0000)(?:0|[1-9][0-9]{0,6})\.(?:0|[0-9]{0,6}[1-9]))(?![0-9.eE+-])"
_TOKENS = rf'^(?:"{_STRING}"|{_NUMBER}|true|false|null|[\[\]{{}},: \t\r\n]++)*+$'
_QUOTED = r'"[^"]*+"'
# a whole object on one level as json.dumps spaces it, its keys all different, with strings and numbers as values
_SHORT = rf'^\{{(?:(?:"({_STRING})": (?!.*"\1": )(?:"{_STRING}"|{_NUMBER})(?:, (?=")|(?=\}}\z)))++)?+\}}\z'
SHORTEST = 512  # texts that are looked at as short ones: each key is looked for in what follows it
LONGEST = 4096  # texts beyond go to Python, as the pattern's stack grows with the text


def is_plain(text: Column) -> Column:
    """Whether `text` is one JSON value that literal() can rewrite; false for null."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # a second value after the first would be read over
    single = F.size(F.try_variant_get(inside, "$", "array<variant>")) == 1
    return F.coalesce(F.when((F.length(text) <= LONGEST) & text.rlike(_TOKENS), single), F.lit(False))


def _outside(part: Column) -> Column:
    """What stands between two strings, in Python's spelling."""
    for word, said in (("true", "True"), ("false", "False"), ("null", "None"), (",", ", "), (":", ": ")):
        part = F.replace(part, F.lit(word), F.lit(said))
    return part


def _parts(text: Column) -> Column:
    """The text cut at its quotes: what is outside a string, without blanks, and what is inside, in turn."""
    return F.transform(F.split(text, '"', -1), lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"\s+", "")).otherwise(p))


def _nested_arguments(text: Column) -> Column:
    """arguments() where values may hold objects and lists, so that the depth of each key counts."""
    parts = _parts(text)
    spots = F.arrays_zip(parts.alias("p"), F.slice(parts, F.lit(2), F.size(parts)).alias("next"))

    def step(acc: Column, x: Column) -> Column:
        opened = F.length(F.translate(x["p"], "]}:,", "")) - F.length(F.translate(x["p"], "]}:,[{", ""))
        closed = F.length(F.translate(x["p"], "[{:,", "")) - F.length(F.translate(x["p"], "[{:,]}", ""))
        key = acc["inside"] & (acc["depth"] == 1) & F.coalesce(F.startswith(x["next"], F.lit(":")), F.lit(False))
        quoted = F.concat(F.lit("'"), x["p"], F.lit("'"))
        bare = F.concat(F.lit("="), _outside(F.substring(x["p"], F.lit(2), F.length(x["p"]))))
        said = F.when(acc["inside"], F.when(key, x["p"]).otherwise(quoted)).otherwise(F.when(acc["after_key"], bare).otherwise(_outside(x["p"])))
        return F.struct(
            F.concat(acc["text"], said).alias("text"), (acc["depth"] + F.when(acc["inside"], 0).otherwise(opened - closed)).alias("depth"),
            (~acc["inside"]).alias("inside"), key.alias("after_key"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("after_key"))
    return F.aggregate(spots, start, step, lambda acc: F.substring(acc["text"], F.lit(2), F.length(acc["text"]) - 2))


def _spaced(text: Column) -> Column:
    """The text without blanks outside strings, a space after every comma and colon there."""
    bare = F.regexp_replace(text, rf'\G([^"\s]*+(?:{_QUOTED}[^"\s]*+)*+)\s+', "$1")
    return F.regexp_replace(bare, rf'\G([^",:]*+(?:{_QUOTED}[^",:]*+)*+)([,:])', "$1$2 ")


def _worded(text: Column) -> Column:
    """Plain JSON text without blanks outside strings but after commas and colons, words in Python's spelling."""
    spaced = said = _spaced(text)
    for word, python in (("true", "True"), ("false", "False"), ("null", "None")):
        first = word[0]  # outside strings the letter begins this word only
        said = F.regexp_replace(said, rf'\G([^"{first}]*+(?:{_QUOTED}[^"{first}]*+)*+){word}', f"$1{python}")
    return F.when(text.rlike("true|false|null"), said).otherwise(spaced)


def literal(text: Column) -> Column:
    """Plain JSON text as a Python literal.

    A pattern goes on where its last match ended (\\G) and steps over strings whole, so it meets only what is outside.
    Expressions inside a condition are computed anew wherever they stand, so none stands twice on a way.
    """
    return F.translate(_worded(text), '"', "'")


def arguments(text: Column) -> Column:
    """A plain JSON object as the arguments of a call: its own keys bare and joined by =, all inside as in literal()."""
    inner = F.btrim(_worded(text), F.lit("{}"))
    named = F.regexp_replace(inner, rf'\G([^"]*+(?:{_QUOTED}(?!:)[^"]*+)*+)"([^"]*+)": ', "$1$2=")
    nested = text.rlike(r"\[|\{[^{]*\{")
    return F.when(nested, _nested_arguments(text)).otherwise(F.translate(named, '"', "'"))


def _plain(value):
    """A value that strict JSON can hold; what it cannot is kept as text."""
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k if isinstance(k, str) else str(k): _plain(v) for k, v in value.items()}
    return str(value)


def _unwrapped(value):
    """Step pairs [action, result] of a workflow document with a result that is a tuple of one taken out of it."""
    if isinstance(value, dict):
        return {k: _unwrapped(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) and len(value) == 2 and isinstance(value[1], tuple) and len(value[1]) == 1:
        return [_unwrapped(value[0]), value[1][0]]
    return [_unwrapped(v) for v in value] if isinstance(value, list) else value


def json_text(text: str | None, steps: bool = False) -> str | None:
    """JSON for a text that is lenient JSON or a Python list or dict, else null. `steps`: a workflow document."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        if not text.strip().startswith(("{", "[")):
            return None
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
    return json.dumps(_plain(_unwrapped(value) if steps else value)) if isinstance(value, (dict, list)) else None


def _on_values(fn, *columns: pd.Series) -> pd.Series:
    rows = [None if r[0] is None else fn(*r) for r in zip(*columns)]
    return pd.Series(rows, dtype=object, index=columns[0].index)


@F.pandas_udf(StringType())
def _call_text(tool: pd.Series, tool_input: pd.Series) -> pd.Series:
    return _on_values(call_text, tool, tool_input)


@F.pandas_udf(StringType())
def _literal_text(text: pd.Series) -> pd.Series:
    return _on_values(literal_text, text)


@F.pandas_udf(StringType())
def to_json_text(text: pd.Series) -> pd.Series:
    return _on_values(json_text, text)


@F.pandas_udf(StringType())
def to_document_text(text: pd.Series) -> pd.Series:
    """to_json_text for workflow documents: a step result that is a tuple of one counts as what is in it."""
    return _on_values(lambda t: json_text(t, steps=True), text)


def record_text(tool: str, tool_input: str | None) -> str:
    """A call as a Python dict literal of function and parameters."""
    try:
        parameters = json.loads(tool_input)
    except (TypeError, ValueError):
        parameters = tool_input
    return repr({"function": tool, "parameters": parameters})


@F.pandas_udf(StringType())
def _record_text(tool: pd.Series, tool_input: pd.Series) -> pd.Series:
    return _on_values(record_text, tool, tool_input)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_call_text(tool: Column | str, tool_input: Column | str) -> Column:
    """name(arg=value, ...); anything but a JSON object as input gives name()."""
    tool, tool_input = _column(tool), _column(tool_input)
    ready = is_plain(tool_input)
    inner = F.when(tool_input.rlike(r"^\s*\{"), arguments(tool_input)).otherwise("")
    by_python = _call_text(F.when(~ready, tool), F.when(~ready, tool_input))
    return F.coalesce(by_python, F.when(tool.isNotNull(), F.concat(tool, F.lit("("), inner, F.lit(")"))))


def is_short(tool_input: Column | str) -> Column:
    """Whether short_call_text() holds for the input of a call; false for null."""
    tool_input = _column(tool_input)
    return F.coalesce((F.length(tool_input) <= SHORTEST) & tool_input.rlike(_SHORT), F.lit(False))


def short_call_text(tool: Column | str, tool_input: Column | str) -> Column:
    """to_call_text() where is_short() holds, by one pattern and without Python."""
    tool, tool_input = _column(tool), _column(tool_input)
    inner = F.substring(tool_input, F.lit(2), F.length(tool_input) - 2)
    named = F.regexp_replace(inner, rf'\G([^"]*+(?:{_QUOTED}(?!:)[^"]*+)*+)"([^"]*+)": ', "$1$2=")
    return F.concat(tool, F.lit("("), F.translate(named, '"', "'"), F.lit(")"))


def to_literal_text(text: Column | str) -> Column:
    """JSON text as Python literal text; text that is not JSON as a Python string."""
    text = _column(text)
    return F.coalesce(_literal_text(F.when(~is_plain(text), text)), literal(text))


def to_record_text(tool: Column | str, tool_input: Column | str) -> Column:
    """A call as a Python dict literal of function and parameters."""
    tool, tool_input = _column(tool), _column(tool_input)
    ready = F.coalesce(is_plain(tool_input) & tool.rlike(f"^{_STRING}$"), F.lit(False))
    made = F.concat(F.lit("{'function': '"), tool, F.lit("', 'parameters': "), literal(tool_input), F.lit("}"))
    by_python = _record_text(F.when(~ready, tool), F.when(~ready, tool_input))
    return F.coalesce(by_python, F.when(tool.isNotNull(), made))
