"""Prompt texts and chat rendering."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from calltrail.functions.text import strip

# The prompt texts, which training samples and scores depend on word by word.
SYSTEM_PROMPT = """You are an expert in composing functions. You are given a question and a set of possible functions. Based on the question, you will need to make one or more function/tool calls to achieve the purpose.
If none of the functions can be used, point it out. If the given question lacks the parameters required by the function, also point it out.
"""
SYSTEM_PROMPT_PYTHON = """You are an expert in composing functions. You are given a question and a set of possible functions. Based on the question, you will need to make one or more function/tool calls to achieve the purpose.
If none of the functions can be used, point it out. If the given question lacks the parameters required by the function, also point it out.
You should only return the function calls in your response.

If you decide to invoke any of the function(s), you MUST put it in the format of [func_name1(params_name1=params_value1, params_name2=params_value2...), func_name2(params)]
You SHOULD NOT include any other text in the response.
"""
RESPONSE_SCHEMA = [{"function": "api_name", "parameters": {"param1": "value1", "param2": "value2"}}]
RETURN_SCHEMA = """The following is the response json schema you should follow:
```json
{response_json_schema}
```
"""
SELECTION_POOL = """The following is a list of apis in the library that you can use.
Each api is a JSON object with 'name', 'description' and 'parameters'.

```json
{selection_pool}
```
"""
JUDGE = """Task Overview:
You are tasked with evaluating the quality of a response to a user query. The response is ground on a tool use trace, which is a list of (api_use_request, api_response) tuples.
Your evaluation should produce a score between 0 and 100, based on how well the response addresses each aspect of the user query compared to the provided ground truth response.


Evaluation Criteria:
1. Coverage of Requests:
- User Requests Count: Identify the number of distinct requests or tasks contained in the user query.
- Response Count: Determine how many of these requests the response addresses.
- If a request is not addressed at all, that aspect should receive a score of 0.
2. Quality of Each Response:
- For each request/task that the request addresses, rate the quality of the response on a scale from 0 to 100.
- If all API calls related to the request are failed, then the score is 0.
- If there is successful API call related to the request, then the score can be greater than 0.
- socre = 100 means the response is 1) grounded on successful API call, 2) the response can respond to the user query similar to the ground truth response.
3. Final Score Calculation:
- Compute the final score by averaging the individual scores for each aspect of the query.
- For example, if the user query requests 5 tasks, the AI response only does 3 tasks, and the quality of the response is 80, 90, 70, then the final score is (80 + 90 + 70 + 0 + 0) / 5 = 48.

Input Data:
User query:
{query}

Tool use trace:
{tool_use_trace}

The response to evaluate:
{pred}

Ground truth response:
{gt}
"""
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>\n"


def base_prompt(output_format: str) -> str:
    if output_format == "python":
        return SYSTEM_PROMPT_PYTHON
    if output_format == "json":
        return SYSTEM_PROMPT + RETURN_SCHEMA.format(response_json_schema=json.dumps(RESPONSE_SCHEMA))
    raise ValueError(f"unsupported output format {output_format!r}")


def with_pool(output_format: str, pool: Column) -> Column:
    """System prompt naming the tools of `pool` (text of a Python list)."""
    head, tail = SELECTION_POOL.split("{selection_pool}")
    return F.concat(F.lit(base_prompt(output_format) + head), pool, F.lit(tail))


def judge_prompt(query: Column, trace: Column, pred: Column, truth: Column) -> Column:
    pattern = JUDGE.replace("%", "%%")
    for field in ("query", "tool_use_trace", "pred", "gt"):
        pattern = pattern.replace("{" + field + "}", "%s")
    return F.format_string(pattern, query, trace, pred, truth)


def messages(system: Column, user: Column, assistant: Column) -> Column:
    """Role and content of a sample; no system message when its text is empty."""
    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    every = F.array(turn("system", F.coalesce(system, F.lit(""))), turn("user", user), turn("assistant", assistant))
    return F.filter(every, lambda m: (m["role"] != "system") | (m["content"] != ""))


def turn_text(role: Column, content: Column, position: Column) -> Column:
    """A message's share of the rendered chat; shares in order make the whole text.

    `position` counts from 1. A leading system message opens the first user turn, so the
    user message after it (the only user message that can be second) adds no header.
    """
    name = F.when(role == "assistant", F.lit("model")).otherwise(role)
    body = F.concat(strip(content), F.lit(TURN_END))
    header = F.concat(F.lit(TURN_START), name, F.lit("\n"))
    return (
        F.when(role == "system", F.concat(F.lit(f"{TURN_START}user\n"), content, F.lit("\n\n")))
        .when((role == "user") & (position == 2), body)
        .otherwise(F.concat(header, body))
    )
