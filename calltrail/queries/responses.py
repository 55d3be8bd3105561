"""Response validation over documents and pages, last good steps and error details."""

from pyspark.sql import functions as F

from calltrail.functions import validation as val
from calltrail.functions.text import no_error_words
from calltrail.plans import workflows as wf
from calltrail.queries.base import query, selections, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def keyword_sql(lowered: str) -> str:
    """First matching error keyword of a lower-cased SQL text, null when none."""
    cases = "\n".join(f"WHEN contains({lowered}, {_quoted(w)}) THEN {_quoted(r)}" for w, r in val.ERROR_KEYWORDS)
    return f"CASE {cases} END"


SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
EXPLICIT_SQL = "\n".join(
    f"WHEN contains(bare, {_quoted(e)}) THEN {_quoted(f'Explicit error message found: {chr(39)}{e}{chr(39)}')}"
    for e in val.EXPLICIT_ERRORS
)
TAG_SQL = " OR ".join(f"starts_with(bare, {_quoted(p)})" for p in val.TAG_PREFIXES)
LOWER_TAG_SQL = " OR ".join(f"starts_with(lower(bare), {_quoted(p)})" for p in val.LOWER_TAG_PREFIXES)

TEXT_CASES = """
CASE doc_id % 8
  WHEN 1 THEN concat('Payment required. ', text)
  WHEN 2 THEN concat('  Too many requests: ', text)
  WHEN 3 THEN ' '
  WHEN 4 THEN concat('PNG', text)
  WHEN 5 THEN concat(text, ' The request timed out.')
  WHEN 6 THEN concat('No data found for ', source, ' ', text)
  WHEN 7 THEN concat('Upstream FORBIDDEN ', text)
  ELSE text END"""
ERROR_CASES = "CASE WHEN doc_id % 11 = 0 THEN concat('timeout of ', source) ELSE '' END"


@query("validated_responses", rf"""
WITH responses AS (
  SELECT 'doc' AS kind, doc_id AS id, {TEXT_CASES} AS response, {ERROR_CASES} AS error FROM documents
  UNION ALL SELECT 'page', page_id, html, '' FROM pages),
bared AS (SELECT *, regexp_replace(response, '^{SPACE}+|{SPACE}+$', '', 'g') AS bare FROM responses),
judged AS (
  SELECT kind, id, coalesce(CASE
    WHEN error <> '' THEN error
    WHEN bare IN ('', '{{}}', '[]') THEN 'Empty response from API'
    WHEN bare = 'None' THEN 'Response is Python ''None'' string'
    WHEN starts_with(response, 'PNG') OR starts_with(response, '%PDF') THEN 'Binary data is not supported in API response'
    WHEN length(response) > 50 AND length(regexp_replace(substr(response, 1, 100), '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) > 20
      THEN 'Binary data is not supported in API response'
    WHEN {TAG_SQL} OR {LOWER_TAG_SQL} THEN 'HTML/XML error page returned instead of JSON'
    {EXPLICIT_SQL}
    ELSE {keyword_sql('lower(bare)')} END, '') AS reason
  FROM bared)
SELECT kind, id, reason = '' AS is_valid, reason FROM judged""")
def validated_responses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
        F.expr(TEXT_CASES).alias("response"), F.expr(ERROR_CASES).alias("error"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.col("html").alias("response"), F.lit("").alias("error"),
    )
    return val.validate_responses(docs.unionByName(pages)).select("kind", "id", "is_valid", "reason")


# Structured responses around real values: (SQL text of the response, SQL text of the reason).
STRUCTURED = [
    ("""concat('{"text": ', quoted, ', "lang": "', lang, '"}')""", None),
    ("""concat('{''text'': None, ''lang'': ''', lang, ''', ''n'': ', n_chars, '}')""", "''"),
    ("""concat('{"status": "OK", "count": ', n_chars, '}')""",
     "'API returned only metadata/status fields with no content'"),
    ("""concat('{"text": ', quoted, ', "b": 2, "code": ', 400 + n_chars % 100, '}')""",
     "concat('JSON ''code'' is error code: ', 400 + n_chars % 100)"),
    ("""concat('{"text": ', quoted, ', "detail": [{"msg": "bad ', lang, '"}]}')""", "concat('Validation error: bad ', lang)"),
    ("""concat('{"', source, '": []}')""", "'API returned single-key object with empty value'"),
    ("""concat('{''', source, ''': {''x'': []}, ''status'': ''OK''}')""",
     "concat('API returned metadata and single empty key ''', source, '''')"),
    ("""concat('{"', lang, '": [], "', source, '": []}')""", "'API returned object with only empty arrays'"),
    ("""concat('{"text": ', quoted, ', "success": false, "message": "n=', n_chars, '"}')""", "concat('API failed: n=', n_chars)"),
    ("""concat('{"success": true, "x": ', quoted, ', "data": {"results": [], "k": "', lang, '"}}')""", "'Empty results returned'"),
    ("'[ ]'", "'API returned empty array instead of structured response'"),
    ("""concat('{"text": ', quoted, ', "x": 1, "meta": {"status": ', 500 + n_chars % 10, '}}')""",
     "concat('JSON ''meta.status'' is error code: ', 500 + n_chars % 10)"),
    ("""concat('{"text": ', quoted, ', "Error": "Invalid token for ', lang, '"}')""", "'Invalid input'"),
    ("""concat('[', quoted, ', {"n": ', n_chars, '}]')""", None),
    ("""concat('{"text": ', quoted, ', "x": 1, "success": "False", "y": 2}')""", "'JSON ''success'' field is false'"),
    ("""concat('{"text": ', quoted, ', "x": 1, "ok": false, "y": 2}')""", "'JSON ''ok'' field is false'"),
]


def _structured_cases(column: int, default: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN {row[column] if row[column] is not None else default}" for i, row in enumerate(STRUCTURED)
    )
    return f"CASE doc_id % {len(STRUCTURED)} {cases} END"


@query("validated_json_responses", f"""
WITH judged AS (
  SELECT doc_id, {_structured_cases(1, "coalesce(" + keyword_sql("lower(text)") + ", '')")} AS reason FROM documents)
SELECT doc_id, reason = '' AS is_valid, reason FROM judged""")
def validated_json_responses(spark, sf_dir):
    inner = F.to_json(F.array("text"))
    docs = table(spark, sf_dir, "documents").withColumn("quoted", F.substring(inner, F.lit(2), F.length(inner) - 2))
    made = docs.select("doc_id", F.expr(_structured_cases(0, "''")).alias("response"), F.lit("").alias("error"))
    return val.validate_responses(made).select("doc_id", "is_valid", "reason")


PROPOSAL_SIZE = 4  # documents that follow each other by id are the steps of one proposal


@query("response_errors", f"""
WITH judged AS (
  SELECT doc_id, doc_id // {PROPOSAL_SIZE} AS proposal, {_structured_cases(1, "coalesce(" + keyword_sql("lower(text)") + ", '')")} AS reason FROM documents)
SELECT proposal, count(*) AS n_steps, max(CASE WHEN reason = '' THEN doc_id END) AS last_success, CAST(0 AS BIGINT) AS part,
       CASE WHEN count(*) FILTER (reason = '') = 0 THEN string_agg('tool_' || CAST(doc_id % 3 AS VARCHAR) || ': ' || reason, ' | ' ORDER BY doc_id) END AS error_message
FROM judged GROUP BY proposal""")
def response_errors(spark, sf_dir):
    """Responses are judged; each proposal gets its last good step, or why all of its steps failed."""
    inner = F.to_json(F.array("text"))
    docs = table(spark, sf_dir, "documents").withColumn("quoted", F.substring(inner, F.lit(2), F.length(inner) - 2))
    made = docs.select(
        "doc_id", F.floor(F.col("doc_id") / PROPOSAL_SIZE).alias("proposal"), F.concat(F.lit("tool_"), (F.col("doc_id") % 3).cast("string")).alias("tool"),
        F.expr(_structured_cases(0, "''")).alias("response"), F.lit("").alias("error"),
    )
    return wf.response_outcomes(made, ["proposal"], "doc_id")


@query("plain_result_success", f"""
SELECT doc_id, NOT (contains(low, 'error') OR contains(low, 'failed') OR contains(low, 'access denied')) AS is_valid
FROM (SELECT doc_id, lower({TEXT_CASES} || CASE WHEN doc_id % 5 = 0 THEN ' Access Denied' ELSE '' END) AS low FROM documents)""")
def plain_result_success(spark, sf_dir):
    result = F.concat(F.expr(TEXT_CASES), F.when(F.col("doc_id") % 5 == 0, " Access Denied").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", no_error_words(result).alias("is_valid"))


def _proposal_steps(spark, sf_dir):
    """Events of one user on one day as the steps of a proposal."""
    e = selections(spark, sf_dir)
    bad = F.col("event_type") == "error"
    return e.select(
        "run", F.date_format("ts", "yyyy-MM-dd").alias("proposal"), "event_id",
        F.concat(F.lit("tool_"), (F.col("k") % 7).cast("string")).alias("tool"),
        (~bad & (F.col("value") <= 20)).alias("is_valid"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("rule "), F.col("k").cast("string"))).otherwise("").alias("validation_error"),
        F.when(bad & (F.col("k") % 4 == 1), "call error").otherwise("").alias("error"),
        F.when(F.col("k") % 4 == 2, F.repeat(F.lit("It FAILED. "), 25)).otherwise("odd result").alias("result_text"),
    )


PROPOSAL_SQL = """
sel AS (
  SELECT CAST(user_id AS VARCHAR) AS run, strftime(ts, '%Y-%m-%d') AS proposal, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
psteps AS (
  SELECT run, proposal, event_id, 'tool_' || CAST(k % 7 AS VARCHAR) AS tool, event_type <> 'error' AND value <= 20 AS is_valid,
         coalesce(CASE WHEN k % 4 = 0 THEN 'rule ' || CAST(k AS VARCHAR) END,
                  CASE WHEN event_type = 'error' AND k % 4 = 1 THEN 'call error' END,
                  CASE WHEN k % 4 = 2 THEN substr(repeat('It FAILED. ', 25), 1, 200) END) AS detail
  FROM sel)"""


@query("last_success_step", f"""WITH {PROPOSAL_SQL}
SELECT run, proposal, max(CASE WHEN is_valid THEN event_id END) AS last_success FROM psteps GROUP BY run, proposal""")
def last_success_step(spark, sf_dir):
    return wf.last_success(_proposal_steps(spark, sf_dir), ["run", "proposal"], "event_id", F.col("is_valid"))


@query("error_details", f"""WITH {PROPOSAL_SQL}
SELECT run, proposal, count(*) AS n_steps, CAST(0 AS BIGINT) AS part,
       coalesce(string_agg(tool || ': ' || detail, ' | ' ORDER BY event_id), 'All tool executions failed') AS error_message
FROM psteps GROUP BY run, proposal HAVING NOT bool_or(is_valid)""")
def error_details(spark, sf_dir):
    return wf.error_details(_proposal_steps(spark, sf_dir), ["run", "proposal"], "event_id", F.col("event_id"))
