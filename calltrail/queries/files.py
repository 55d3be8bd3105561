"""Round trips through files written from the given tables."""

from pyspark.sql import functions as F

from calltrail.plans import sft
from calltrail.plans import workflows as wf
from calltrail.plans import traces as tr
from calltrail.queries.base import STEPS_SQL, query, selections, steps, table
from calltrail.session import scratch_dir
from calltrail.sources import readers, writers


def workflow_documents(spark, sf_dir):
    """One workflow document per order, as text: id, text.

    A document is one row, as in the original data, so its text holds all parts of its chains.
    """
    step = F.concat(
        F.lit('[{"tool": "'), F.col("tool"), F.lit('", "tool_input": '), F.col("tool_input"),
        F.lit(', "log": "Invoking", "type": "AgentActionMessageLog", "message_log": [], "tool_call_id": "c'),
        F.col("step_pos").cast("string"), F.lit('"}, '),
        F.when(F.col("step_pos") % 3 == 0, F.lit('"plain result"')).otherwise('{"error": "", "response": "ok"}'),
        F.lit("]"),
    )
    # one shuffle by workflow serves the three sums below
    told = steps(spark, sf_dir).repartition("workflow_id").select("workflow_id", "chain_pos", "step_pos", step.alias("text"))
    parts = wf.collect_parts(told, ["workflow_id", "chain_pos"], ["step_pos"], ["text"], F.col("step_pos"))
    piece = F.struct("part", F.array_join(F.transform("items", lambda i: i["text"]), ", ").alias("text"))
    chains = parts.groupBy("workflow_id", "chain_pos").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    body = F.concat(
        F.lit('"api_use_chain_'), (F.col("chain_pos") + 1).cast("string"), F.lit('": {"chain_id": "api_use_chain_'),
        (F.col("chain_pos") + 1).cast("string"), F.lit('", "intermediate_steps": ['),
        F.array_join(F.transform("pieces", lambda p: p["text"]), ", "), F.lit("]}"),
    )
    # open lines come first, so document order is not key order
    ordered = chains.select("workflow_id", F.struct(-F.col("chain_pos"), body.alias("body")).alias("c"))
    return ordered.groupBy("workflow_id").agg(F.sort_array(F.collect_list("c")).alias("cs")).select(
        F.col("workflow_id").cast("string").alias("id"),
        F.concat(
            F.lit('{"query": "Order '), F.col("workflow_id").cast("string"), F.lit('", "api_use_chains": {'),
            F.array_join(F.transform("cs", lambda c: c["body"]), ", "), F.lit('}, "response": "done"}'),
        ).alias("text"),
    )


@query("document_steps", f"""WITH {STEPS_SQL},
ranked AS (
  SELECT *, count(*) FILTER (chain_pos = 1) OVER (PARTITION BY workflow_id) > 0 AS has_open FROM steps)
SELECT CAST(workflow_id AS VARCHAR) AS workflow_id, 'chain_' || CAST(chain_pos + 1 AS VARCHAR) AS chain_name,
       CAST(CASE WHEN chain_pos = 1 OR NOT has_open THEN 0 ELSE 1 END AS INTEGER) AS chain_pos, tool,
       replace(replace(tool_input, ': ', ':'), ', ', ',') AS tool_input, 'c' || CAST(step_pos AS VARCHAR) AS tool_call_id,
       CASE WHEN step_pos % 3 = 0 THEN 'text' ELSE 'object' END AS result_kind,
       CASE WHEN step_pos % 3 <> 0 THEN 'ok' END AS response
FROM ranked""")
def document_steps(spark, sf_dir):
    """Workflow documents made of the line items, parsed back into steps."""
    good, _ = readers.parse_workflows(workflow_documents(spark, sf_dir))
    return wf.flatten_steps(good).select(
        "workflow_id", "chain_name", "chain_pos", "tool", "tool_input", "tool_call_id", "result_kind", "response"
    )


BROKEN = """CASE CAST(id AS BIGINT) % 7
  WHEN 1 THEN substr(text, 1, 40)
  WHEN 2 THEN replace(text, '"query": "Order', '"query": 1, "was": "Order')
  WHEN 3 THEN replace(text, '"response": "done"', '"reply": "done"')
  WHEN 4 THEN replace(text, '"chain_id": ', '"name": ')
  WHEN 5 THEN replace(text, '"intermediate_steps": [', '"intermediate_steps": [["no result"], ')
  ELSE text END"""


@query("malformed_rejects", f"""WITH {STEPS_SQL}, ids AS (SELECT DISTINCT workflow_id AS id FROM steps)
SELECT CAST(id AS VARCHAR) AS id, CASE id % 7 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'query is not a text'
       WHEN 3 THEN 'response is not a text' ELSE 'malformed chain' END AS reason
FROM ids WHERE id % 7 IN (1, 2, 3, 4, 5)""")
def malformed_rejects(spark, sf_dir):
    broken = workflow_documents(spark, sf_dir).select("id", F.expr(BROKEN).alias("text"))
    return readers.parse_workflows(broken)[1]


@query("file_roundtrip", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(doc_id % 97 * CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) AS BIGINT) AS digest
FROM documents GROUP BY ALL""")
def file_roundtrip(spark, sf_dir):
    """Samples written as train and test JSON lines with id lists, read back and matched."""
    folder = scratch_dir(spark, "roundtrip")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), "text", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split")
    )
    writers.write_split(docs, folder, ["sample_id", "text"])
    out = None
    for part in ("train", "test"):
        ids = readers.read_ids(spark, f"{folder}/{part}.txt").select(F.col("sample_id").cast("bigint"))
        rows = readers.read_jsonl(spark, f"{folder}/{part}.jsonl", "sample_id BIGINT, text STRING")
        both = sft.by_ids(ids, [rows]).withColumn("split", F.lit(part))
        out = both if out is None else out.unionByName(both)
    digest = F.sum(F.col("sample_id") % 97 * F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), digest.alias("digest"))


@query("merged_sets", """
SELECT doc_id AS sample_id, text, 'first' AS origin FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, lang, 'second' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def merged_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "sample_id")
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"))
    return sft.by_ids(ids, [
        docs.select("sample_id", "text", F.lit("first").alias("origin")),
        docs.select("sample_id", F.col("lang").alias("text"), F.lit("second").alias("origin")),
    ])


ITERATIONS_SQL = """
it AS (
  SELECT user_id AS seed, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS iteration, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("trace_files", f"""WITH {ITERATIONS_SQL}
SELECT seed, iteration, count(*) AS n_executions, count(*) FILTER (event_type <> 'error') AS n_success,
       count(*) FILTER (event_type = 'error') AS n_failed, CAST(sum(k % 4) AS BIGINT) AS n_tool_calls, CAST(count(*) AS INTEGER) AS n_proposals,
       CASE WHEN max_by(k, event_id) % 4 = 0 THEN 'create_new_chain' ELSE 'update_chain_api_use_chain_1' END AS action
FROM it GROUP BY seed, iteration""")
def trace_files(spark, sf_dir):
    """A trace document for each run, written, read back and summed up by iteration."""
    events = selections(spark, sf_dir).select(
        F.col("run").cast("bigint").alias("seed"), F.unix_date(F.to_date("ts")).alias("iteration"), F.col("event_id").alias("id"),
        (F.col("event_type") != "error").alias("success"), "k", "event_type",
    )
    name = F.col("id").cast("string")
    proposal = F.struct(name.alias("id"), F.col("event_type").alias("instruction"))
    step = F.when(F.col("success"), F.struct(F.concat(F.lit("tool_"), F.col("k").cast("string")).alias("tool"), F.lit("{}").alias("tool_input")))
    execution = F.struct(name.alias("proposal_id"), "success", (F.col("k") % 4).alias("num_tool_calls"), step.alias("api_call_step"))
    days = events.groupBy("seed", "iteration").agg(
        F.sort_array(F.collect_list(proposal)).alias("proposals"), F.sort_array(F.collect_list(execution)).alias("executions"),
        F.max_by("k", "id").alias("k"),
    )
    chain = F.struct(F.when(F.col("k") % 4 == 0, "-1").otherwise("api_use_chain_1").alias("which_chain"))
    iteration = F.struct("iteration", "proposals", "executions", chain.alias("selection"))
    documents = days.groupBy("seed").agg(F.count(F.lit(1)).alias("total_iterations"), F.sort_array(F.collect_list(iteration)).alias("iterations"))
    path = scratch_dir(spark, "traces")
    writers.write_documents(documents.withColumn("run", F.col("seed")), path, "run")
    rows = readers.read_traces(spark, path, packed=True).withColumn("run", F.col("seed"))
    counts = tr.execution_counts(rows.select("run", "iteration", F.explode("executions").alias("e")).select("run", "iteration", "e.*"))
    told = rows.select("run", "iteration", F.size("proposals").alias("n_proposals"), tr.selection_label(F.col("selection.which_chain")).alias("action"))
    return counts.join(told, ["run", "iteration"]).withColumnRenamed("run", "seed")


@query("run_metadata_files", f"""WITH {ITERATIONS_SQL}
SELECT seed, count(*) AS successful_requests, CAST(sum(k * 11) AS BIGINT) AS total_tokens, round(sum(k) / 100.0, 6) AS total_cost_usd,
       CAST(sum(k % 4) AS INTEGER) AS tool_call_count
FROM it GROUP BY seed""")
def run_metadata_files(spark, sf_dir):
    """Metadata of each run, in the one layout or the other, written and read back."""
    runs = selections(spark, sf_dir).groupBy(F.col("run").cast("bigint").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") % 4).alias("tool_call_count")
    )
    cost = F.struct((F.col("k") * 11).alias("total_tokens"), F.col("n").alias("successful_requests"), (F.col("k") / 100).alias("total_cost"))
    costs = F.struct((F.col("k") * 11).alias("total_tokens"), F.col("n").alias("successful_requests"), (F.col("k") / 100).alias("total_cost_usd"))
    old = F.col("seed") % 2 == 0
    documents = runs.select("seed", "tool_call_count", F.when(old, cost).alias("cost"), F.when(~old, costs).alias("llm_costs"), F.col("seed").alias("run"))
    path = scratch_dir(spark, "metadata")
    writers.write_documents(documents, path, "run")
    out = readers.read_run_metadata(spark, path, packed=True)
    return out.select("seed", "successful_requests", "total_tokens", F.round("total_cost_usd", 6).alias("total_cost_usd"), "tool_call_count")


@query("catalog_files", """
SELECT md5(p_name || p_partkey) AS hash, p_type AS category, p_brand AS tool, p_name || '#' || CAST(p_partkey AS VARCHAR) AS api FROM part""")
def catalog_files(spark, sf_dir):
    """The catalog as nested JSON documents and as hash maps, one of each for a category, read back and joined."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("tool"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("api"),
        F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("hash"),
    )
    lists = part.groupBy("category", "tool").agg(F.sort_array(F.collect_list("api")).alias("apis"))
    tools = lists.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("tool", "apis"))).alias("tools"))
    path = scratch_dir(spark, "catalog")
    one_each = lambda df, name: df.repartition("folder").write.partitionBy("folder").text(f"{path}/{name}")
    one_each(tools.select(F.md5("category").alias("folder"), F.to_json(F.create_map("category", "tools")).alias("value")), "nested")
    hashes = part.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("hash", "api"))).alias("names"))
    one_each(hashes.select(F.md5("category").alias("folder"), F.to_json("names").alias("value")), "names")
    nested = readers.read_nested_catalog(spark, f"{path}/nested/*")
    return nested.join(readers.read_name_map(spark, f"{path}/names/*", value="api"), "api").select("hash", "category", "tool", "api")


@query("training_files", """
SELECT 'system:' || lang || '|user:' || CAST(doc_id AS VARCHAR) || '|assistant:' || source AS messages, CAST(count(*) AS BIGINT) AS n
FROM documents GROUP BY ALL""")
def training_files(spark, sf_dir):
    """Half of the samples as messages, half as columns, written as JSON lines and read as one training set."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("system"), F.col("doc_id").cast("string").alias("user"), F.col("source").alias("assistant"), (F.col("doc_id") % 2 == 0).alias("flat")
    )
    turns = F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("content")) for c in ("system", "user", "assistant")])
    columns = [F.when(F.col("flat"), F.col(c)).alias(c) for c in ("system", "user", "assistant")]
    path = scratch_dir(spark, "training")
    writers.write_json_records(docs.select(F.when(~F.col("flat"), turns).alias("messages"), *columns), path)
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return readers.read_training_set(spark, path).groupBy(shown.alias("messages")).agg(F.count(F.lit(1)).alias("n"))
