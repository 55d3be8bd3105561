"""Training samples, messages and rendered chats."""

from pyspark.sql import functions as F

from calltrail.functions import prompts
from calltrail.functions.pyliteral import to_call_text, to_record_text
from calltrail.operators import draws
from calltrail.plans import sft
from calltrail.queries.base import (
    CATALOG_SQL, STEPS_SQL, STRICT_SQL, catalog, cut_sql, query, steps, table, workflows,
)
from calltrail.queries.sampling import POOL_SQL
from calltrail.session import scratch_dir
from calltrail.sources import writers


def definitions(spark, sf_dir):
    """Tool definitions as JSON text."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("api_"), F.col("p_partkey").cast("string")).alias("api"),
        F.to_json(
            F.struct(
                F.concat(F.lit("api_"), F.col("p_partkey").cast("string")).alias("name"),
                F.col("p_name").alias("description"),
                F.struct(
                    F.lit("object").alias("type"),
                    F.create_map(F.lit("quantity"), F.struct(F.lit("NUMBER").alias("type"), F.col("p_brand").alias("description"))).alias("properties"),
                    F.array(F.lit("quantity")).alias("required"),
                ).alias("parameters"),
            )
        ).alias("definition"),
    )


DEF_SQL = """defs AS (
  SELECT 'api_' || CAST(p_partkey AS VARCHAR) AS api,
         '{''name'': ''api_' || CAST(p_partkey AS VARCHAR) || ''', ''description'': ''' || p_name
         || ''', ''parameters'': {''type'': ''object'', ''properties'': {''quantity'': {''type'': ''NUMBER'', ''description'': '''
         || p_brand || '''}}, ''required'': [''quantity'']}}' AS text
  FROM part)"""


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HEAD, TAIL = prompts.SELECTION_POOL.split("{selection_pool}")
QUERY_SQL = "'Handle order ' || CAST(o_orderkey AS VARCHAR) || ' of priority ' || o_orderpriority"


# Answers from CTE `told`(workflow_id, text, rn), ten thousand texts to a part.
PARTS_SQL = """answers AS (
  SELECT workflow_id, CAST((rn - 1) // 10000 AS BIGINT) AS part,
         CASE WHEN (rn - 1) // 10000 = 0 THEN '[' ELSE ', ' END || string_agg(text, ', ' ORDER BY rn)
           || CASE WHEN ((rn - 1) // 10000 + 1) * 10000 >= n THEN ']' ELSE '' END AS answer
  FROM (SELECT *, count(*) OVER (PARTITION BY workflow_id) AS n FROM told) GROUP BY workflow_id, (rn - 1) // 10000, n)"""


@query("python_calls", f"""WITH {STEPS_SQL}
SELECT workflow_id, chain_pos, step_pos, call_text AS call,
       '{{''function'': ''' || tool || ''', ''parameters'': ' || replace(tool_input, '"', '''') || '}}' AS record
FROM steps""")
def python_calls(spark, sf_dir):
    return steps(spark, sf_dir).select(
        "workflow_id", "chain_pos", "step_pos", to_call_text("tool", "tool_input").alias("call"),
        to_record_text("tool", "tool_input").alias("record"),
    )


@query("sft_samples", f"""{POOL_SQL}, {DEF_SQL},
pools AS (
  SELECT workflow_id, string_agg(text, ', ' ORDER BY side, a, b, text) AS pool FROM pool JOIN defs USING (api) GROUP BY workflow_id),
told AS (
  SELECT workflow_id, call_text AS text, row_number() OVER (PARTITION BY workflow_id ORDER BY chain_pos, step_pos, call_text) AS rn
  FROM steps),
{PARTS_SQL}
SELECT o_orderkey AS sample_id, part,
       CASE WHEN part = 0 THEN {_text_sql(prompts.base_prompt('python') + HEAD)} || '[' || pool || ']' || {_text_sql(TAIL)} ELSE '' END AS system,
       CASE WHEN part = 0 THEN {QUERY_SQL} ELSE '' END AS user, answer AS assistant
FROM orders JOIN answers ON workflow_id = o_orderkey JOIN pools USING (workflow_id)
JOIN wanted USING (workflow_id) WHERE wanted >= 0""")
def sft_samples(spark, sf_dir, num_tools=10):
    every = steps(spark, sf_dir)
    called = every.select("workflow_id", F.col("tool").alias("api"))
    drawn = draws.negative_tools(called, catalog(spark, sf_dir), num_tools, 42)
    accepted = workflows(spark, sf_dir).join(drawn.accepted, "workflow_id", "left_semi")
    return sft.format_samples(accepted, every, drawn.tools, definitions(spark, sf_dir), num_tools, "python").drop("n_parts")


@query("sft_json_samples", f"""WITH {STEPS_SQL},
records AS (
  SELECT *, '{{''function'': ''' || tool || ''', ''parameters'': ' || replace(tool_input, '"', '''') || '}}' AS record FROM steps),
told AS (
  SELECT workflow_id, record AS text, row_number() OVER (PARTITION BY workflow_id ORDER BY step_pos, record) AS rn
  FROM records WHERE chain_pos = 0),
{PARTS_SQL}
SELECT o_orderkey AS sample_id, coalesce(part, 0) AS part,
       CASE WHEN coalesce(part, 0) = 0 THEN {_text_sql(prompts.base_prompt('json'))} ELSE '' END AS system,
       CASE WHEN coalesce(part, 0) = 0 THEN {QUERY_SQL} ELSE '' END AS user, coalesce(answer, '[]') AS assistant
FROM orders LEFT JOIN answers ON workflow_id = o_orderkey""")
def sft_json_samples(spark, sf_dir):
    return _json_samples(spark, sf_dir).drop("n_parts")


def _json_samples(spark, sf_dir):
    every = steps(spark, sf_dir)
    none = every.select("workflow_id", F.lit(0).alias("draw"), F.col("tool").alias("api")).limit(0)
    return sft.format_samples(
        workflows(spark, sf_dir), every, none, definitions(spark, sf_dir), -1, "json"
    )


@query("sample_messages", f"""WITH {STEPS_SQL},
records AS (
  SELECT *, '{{''function'': ''' || tool || ''', ''parameters'': ' || replace(tool_input, '"', '''') || '}}' AS record FROM steps),
whole AS (
  SELECT workflow_id, '[' || string_agg(record, ', ' ORDER BY step_pos, record) || ']' AS answer FROM records WHERE chain_pos = 0 GROUP BY workflow_id)
SELECT o_orderkey AS sample_id, 'system:' || {_text_sql(prompts.base_prompt('json'))} || '|user:' || {QUERY_SQL}
       || '|assistant:' || coalesce(answer, '[]') AS messages
FROM orders LEFT JOIN whole ON workflow_id = o_orderkey""")
def sample_messages(spark, sf_dir):
    """Samples as messages: the parts of an answer are one assistant message."""
    out = sft.sample_messages(_json_samples(spark, sf_dir))
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return out.select("sample_id", F.array_join(shown, "|").alias("messages"))


@query("message_pieces", f"""WITH {STEPS_SQL},
records AS (
  SELECT *, '{{''function'': ''' || tool || ''', ''parameters'': ' || replace(tool_input, '"', '''') || '}}' AS record FROM steps),
told AS (
  SELECT workflow_id, record AS text, row_number() OVER (PARTITION BY workflow_id ORDER BY step_pos, record) AS rn
  FROM records WHERE chain_pos = 0),
{PARTS_SQL}
SELECT o_orderkey AS sample_id, 0 AS message_no, CAST(0 AS BIGINT) AS piece_no, 'system' AS role, {_text_sql(prompts.base_prompt('json'))} AS content FROM orders
UNION ALL SELECT o_orderkey, 1, 0, 'user', {QUERY_SQL} FROM orders
UNION ALL SELECT o_orderkey, 2, coalesce(part, 0), 'assistant', coalesce(answer, '[]') FROM orders LEFT JOIN answers ON workflow_id = o_orderkey""")
def message_pieces(spark, sf_dir):
    """Samples in pieces, written sorted and read back."""
    path = scratch_dir(spark, "pieces")
    writers.write_pieces(sft.sample_pieces(_json_samples(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query("sft_negative_samples", f"""WITH RECURSIVE {STEPS_SQL}, {CATALOG_SQL}, {STRICT_SQL}, {DEF_SQL},
pools AS (
  SELECT workflow_id, string_agg(text, ', ' ORDER BY draw) AS pool FROM drawn JOIN defs USING (api) GROUP BY workflow_id)
SELECT CAST(o_orderkey AS VARCHAR) || '_neg' AS sample_id, CAST(0 AS BIGINT) AS part,
       {_text_sql(prompts.base_prompt('python') + HEAD)} || '[' || pool || ']' || {_text_sql(TAIL)} AS system,
       {QUERY_SQL} AS user, '[]' AS assistant
FROM orders JOIN pools ON workflow_id = o_orderkey WHERE o_orderkey IN {cut_sql('o_orderkey', 42, 0.2, 'orders')}""")
def sft_negative_samples(spark, sf_dir):
    _, sources = sft.choose_sources(workflows(spark, sf_dir), 0.2, 42)
    called = steps(spark, sf_dir).select("workflow_id", F.col("tool").alias("api"))
    called = called.join(sources.select("workflow_id"), "workflow_id", "left_semi")
    negatives = draws.strict_negatives(called, catalog(spark, sf_dir), 10, 42).tools
    return sft.negative_samples(sources, negatives, definitions(spark, sf_dir), "python").drop("n_parts")


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


@query("sft_messages", """
SELECT conv_id, CAST((rn - 1) // 10000 AS BIGINT) AS part, n AS n_total,
       string_agg(role || ':' || text, '|' ORDER BY rn) AS messages
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn,
             count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
GROUP BY conv_id, (rn - 1) // 10000, n""")
def sft_messages(spark, sf_dir):
    out = sft.conversation_messages(_turns(spark, sf_dir), "conv_id", "turn", F.col("turn"))
    shown = F.transform("items", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return out.select("conv_id", "part", "n_total", F.array_join(shown, "|").alias("messages"))


@query("column_messages", r"""
SELECT doc_id,
       'system:' || source || '|user:' || regexp_replace(text, '^[\t-\r\x1c-\x1f\x{85}\p{Z}]+|[\t-\r\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')
       || '|assistant:' || lang AS messages
FROM documents""")
def column_messages(spark, sf_dir):
    flat = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("  "), "source").alias("system"), F.col("text").alias("user"),
        F.concat("lang", F.lit("\n")).alias("assistant"),
    )
    shown = F.transform(
        sft.turns_from_columns(), lambda m: F.concat(m["role"], F.lit(":"), m["content"])
    )
    return flat.select("doc_id", F.array_join(shown, "|").alias("messages"))


ROLE_SQL = """
placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
firsts AS (SELECT conv_id, role = 'system' AS has_system FROM placed WHERE pos = 1),
judged AS (
  SELECT p.*, has_system, pos - CAST(has_system AS INTEGER) AS i FROM placed p JOIN firsts USING (conv_id)),
checks AS (
  SELECT conv_id, count(*) AS n_messages, any_value(has_system) AS has_system,
         count(*) FILTER (i > 0 AND (role = 'user') <> (i % 2 = 1)) AS n_breaches
  FROM judged GROUP BY conv_id)"""


BREACH = "conv_id % 3 = 0 AND turn % 4 = 1"  # turns whose role is turned round


@query("role_checks", f"""WITH {ROLE_SQL.replace('FROM conversations', f"FROM (SELECT conv_id, turn, text, CASE WHEN {BREACH} THEN CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END ELSE role END AS role FROM conversations)")}
SELECT conv_id, n_messages, has_system, n_breaches FROM checks""")
def role_checks(spark, sf_dir):
    """Some turns of every third conversation have the wrong role."""
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    turns = _turns(spark, sf_dir).withColumn("role", F.when(F.expr(BREACH), other).otherwise(F.col("role")))
    return sft.role_checks(turns, "conv_id", [F.col("turn")], F.col("turn"))


@query("chat_rendered", rf"""WITH {ROLE_SQL},
systems AS (SELECT conv_id, text AS system_text FROM placed WHERE pos = 1 AND role = 'system'),
told AS (
  SELECT j.conv_id, pos, n_messages, (pos - 1) // 10000 AS part,
         CASE WHEN pos = 1 AND role = 'system' THEN ''
              ELSE '<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END || chr(10)
                || CASE WHEN i = 1 AND j.has_system THEN system_text || chr(10) || chr(10) ELSE '' END
                || regexp_replace(j.text, '^[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')
                || '<end_of_turn>' || chr(10) END AS text
  FROM judged j JOIN checks USING (conv_id) LEFT JOIN systems ON systems.conv_id = j.conv_id WHERE n_breaches = 0)
SELECT conv_id, CAST(part AS BIGINT) AS part,
       CASE WHEN part = 0 THEN '<bos>' ELSE '' END || string_agg(text, '' ORDER BY pos)
         || CASE WHEN (part + 1) * 10000 >= n_messages THEN '<start_of_turn>model' || chr(10) ELSE '' END AS text
FROM told GROUP BY conv_id, part, n_messages""")
def chat_rendered(spark, sf_dir):
    return sft.rendered_chats(
        _turns(spark, sf_dir), "conv_id", "turn", F.col("turn"), generation_prompt=True
    )


@query("length_filter", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\t-\r\x1c-\x1f\x{85}\p{Z}]+')) AS INTEGER) AS n_tokens FROM documents
WHERE len(regexp_extract_all(text, '[^\t-\r\x1c-\x1f\x{85}\p{Z}]+')) <= 300""")
def length_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sft.within_length(docs, F.col("text"), 300).select("doc_id", "n_tokens")


@query("sample_records", f"""{POOL_SQL},
kept AS (SELECT workflow_id FROM wanted WHERE wanted >= 0),
chains AS (
  SELECT workflow_id, chain_pos, string_agg(tool, ',' ORDER BY step_pos, tool, tool_input) AS tools FROM steps GROUP BY workflow_id, chain_pos),
preds AS (
  SELECT workflow_id, string_agg('chain_' || CAST(chain_pos + 1 AS VARCHAR) || ':' || tools, ';' ORDER BY chain_pos) AS api_preds
  FROM chains GROUP BY workflow_id)
SELECT workflow_id, CAST(0 AS BIGINT) AS part, CAST(count(*) FILTER (side = 0) AS INTEGER) AS n_pos,
       CAST(count(*) FILTER (side = 1) AS INTEGER) AS n_neg, api_preds
FROM pool JOIN kept USING (workflow_id) JOIN preds USING (workflow_id) GROUP BY workflow_id, api_preds""")
def sample_records(spark, sf_dir):
    """Metadata records with the predicted calls, written as JSON lines and read back."""
    every = steps(spark, sf_dir).withColumn("chain_name", F.concat(F.lit("chain_"), (F.col("chain_pos") + 1).cast("string")))
    called = every.select("workflow_id", F.col("tool").alias("api"))
    drawn = draws.negative_tools(called, catalog(spark, sf_dir), 10, 42)
    kept = every.join(drawn.accepted, "workflow_id", "left_semi")
    records = sft.sample_records(sft.candidate_pool(kept, drawn.tools), definitions(spark, sf_dir), kept)
    path = scratch_dir(spark, "records")
    writers.write_json_records(records, path)
    back = spark.read.schema(records.schema).json(path)
    tools = F.transform(F.map_entries("api_preds"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda c: c["tool"]), ",")))
    return back.select(
        "workflow_id", "part", F.size("pos_tools").alias("n_pos"), F.size("neg_tools").alias("n_neg"), F.array_join(tools, ";").alias("api_preds")
    )


@query("sample_metadata", f"""{POOL_SQL}
SELECT workflow_id, CAST(count(*) FILTER (side = 0) AS INTEGER) AS n_pos, CAST(count(*) FILTER (side = 1) AS INTEGER) AS n_neg,
       coalesce(string_agg(api, ',' ORDER BY b) FILTER (side = 1), '') AS neg_tools
FROM pool WHERE workflow_id IN (SELECT workflow_id FROM wanted WHERE wanted >= 0) GROUP BY workflow_id""")
def sample_metadata(spark, sf_dir):
    every = steps(spark, sf_dir)
    called = every.select("workflow_id", F.col("tool").alias("api"))
    drawn = draws.negative_tools(called, catalog(spark, sf_dir), 10, 42)
    kept = every.join(drawn.accepted, "workflow_id", "left_semi")
    meta = sft.metadata(sft.candidate_pool(kept, drawn.tools), definitions(spark, sf_dir))
    names = F.transform("neg_tools", lambda d: F.get_json_object(d, "$.name"))
    return meta.select(
        "workflow_id", F.size("pos_tools").alias("n_pos"), F.size("neg_tools").alias("n_neg"),
        F.array_join(names, ",").alias("neg_tools"),
    )
