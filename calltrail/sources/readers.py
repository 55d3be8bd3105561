"""Readers: documents, catalogs, traces, predictions and id lists as DataFrames.

Whole-document files are read by one scan per directory; ids and groups come from the path.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.functions.pyliteral import to_document_text
from calltrail.functions.text import strip
from calltrail.plans.catalog import PARAM
from calltrail.session import materialize

CHAIN = "STRUCT<chain_id: STRING, intermediate_steps: ARRAY<ARRAY<STRING>>>"
WORKFLOW = f"query STRING, api_use_chains MAP<STRING, {CHAIN}>, response STRING"
TRACE = """seed BIGINT, total_iterations INT, iterations ARRAY<STRUCT<
  iteration: INT, timestamp: STRING,
  proposals: ARRAY<STRUCT<id: STRING, instruction: STRING,
                          apis: ARRAY<STRUCT<name: STRING, description: STRING>>>>,
  executions: ARRAY<STRUCT<proposal_id: STRING, success: BOOLEAN, num_tool_calls: INT,
                           api_call_step: STRUCT<tool: STRING, tool_input: STRING, result_preview: STRING>,
                           error_message: STRING>>,
  selection: STRUCT<selected_id: STRING, action: STRING, which_chain: STRING, tool_used: STRING>,
  workflow_update: STRUCT<num_chains: INT, chains: MAP<STRING, INT>>>>"""
TOOL_CONFIG = f"""description STRING, api_list ARRAY<STRUCT<name: STRING, description: STRING,
  required_parameters: ARRAY<{PARAM}>, optional_parameters: ARRAY<{PARAM}>>>"""
COSTS = """STRUCT<total_tokens: BIGINT, prompt_tokens: BIGINT, prompt_tokens_cached: BIGINT,
  completion_tokens: BIGINT, reasoning_tokens: BIGINT, successful_requests: BIGINT,
  total_cost_usd: DOUBLE, total_cost: DOUBLE>"""
METADATA = f"""seed BIGINT, num_apis INT, iterations INT, num_proposals INT, config STRING,
  tool_call_count INT, time STRING, llm_costs {COSTS}, cost {COSTS}"""
SCORES = """STRUCT<tool_accuracy: STRUCT<precision: DOUBLE, recall: DOUBLE>, success_rate: DOUBLE, qor: DOUBLE>"""


def path_text(c: Column) -> Column:
    """A path as the file system spells it; in URIs a plus sign stands for itself."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json", packed: bool = False) -> DataFrame:
    """id (file stem), file, modified, text: one row per file; `packed`: per document of the packs of write_documents."""
    if packed:
        packs = spark.read.schema("id STRING, text STRING").parquet(path)
        return packs.select(
            "id", path_text(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_modification_time").alias("modified"), "text",
        )
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(
        F.regexp_extract(path_text(F.col("_metadata.file_name")), r"^(.*?)(\.[^.]*)?$", 1).alias("id"),
        path_text(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )


def _kind_at(v: Column, path: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def parse_workflows(documents: DataFrame):
    """documents(id, text) -> (workflows, rejects with a reason). judge_workflows also counts them.
"""
    judged, _ = judge_workflows(documents)
    good = judged.filter(F.col("reason").isNull()).select(F.col("id").alias("workflow_id"), "_doc.*")
    return good, judged.filter(F.col("reason").isNotNull()).select("id", "reason")


def judge_workflows(documents: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """documents(id, text) -> (id, reason, _doc) and the counts n_total, n_accepted, n_rejected.

    Every document is parsed once: the judged rows are written, counted by the same pass, and read by whoever
    wants the good ones or the rejects.

    Lenient parsing alone would turn a number into a text, so the types of the required
    fields are checked on the document itself.
    """
    read = documents.withColumn("_v", F.try_parse_json("text"))
    read = read.withColumn("_alt", to_document_text(F.when(F.col("_v").isNull(), F.col("text"))))
    is_json = F.coalesce(F.col("_alt"), F.col("text"))
    read = read.withColumn("_text", is_json).withColumn("_v", F.coalesce("_v", F.try_parse_json("_alt")))
    doc = read.withColumn("_doc", F.from_json("_text", WORKFLOW))
    chains = F.map_values("_doc.api_use_chains")
    bad_steps = F.exists(
        chains,
        lambda c: c["chain_id"].isNull()
        | F.coalesce(F.exists(c["intermediate_steps"], lambda s: F.size(s) != 2), F.lit(False)),
    )
    reason = (
        F.when(F.col("_v").isNull(), "not JSON")
        .when(F.coalesce(_kind_at(F.col("_v"), "$.query"), F.lit("")) != "STRING", "query is not a text")
        .when(F.coalesce(_kind_at(F.col("_v"), "$.response"), F.lit("")) != "STRING", "response is not a text")
        .when(
            # only an object is a map; its schema would be put together from all steps
            F.try_variant_get(F.col("_v"), "$.api_use_chains", "map<string,variant>").isNull(),
            "api_use_chains is not an object",
        )
        .when(F.col("_doc.api_use_chains").isNull() | bad_steps, "malformed chain")
    )
    judged = doc.withColumn("reason", reason).select("id", "reason", F.when(F.col("reason").isNull(), F.col("_doc")).alias("_doc"))
    seen = Observation("documents")
    counted = judged.observe(
        seen, F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("reason").isNull()).alias("n_accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("n_rejected"),
    )
    return materialize(counted, "judged-documents"), dict(seen.get)


def newest_documents(documents: DataFrame) -> DataFrame:
    """One document per id, the newest file. Found on id, time and file name; texts are filtered after."""
    version = F.max(F.struct("modified", "file")).alias("_v")
    newest = documents.groupBy("id").agg(version).select("id", "_v.*")
    return documents.join(newest, ["id", "modified", "file"], "left_semi")


def read_workflows(spark: SparkSession, path: str):
    """(workflows, rejects) of a directory; where an id comes twice the newest file counts."""
    return parse_workflows(newest_documents(read_documents(spark, path)))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip included."""
    return spark.read.schema(schema).json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "category STRING, tool STRING, api STRING")


def read_name_map(spark: SparkSession, path: str, key: str = "hash", value: str = "name") -> DataFrame:
    """A JSON object of texts as two columns."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias(key, value))


def read_nested_catalog(spark: SparkSession, path: str) -> DataFrame:
    """{category: {tool: [api]}} as rows."""
    whole = spark.read.text(path, wholetext=True)
    by_category = whole.select(
        F.explode(F.from_json("value", "MAP<STRING, MAP<STRING, ARRAY<STRING>>>")).alias("category", "_tools")
    )
    by_tool = by_category.select("category", F.explode("_tools").alias("tool", "_apis"))
    return by_tool.select("category", "tool", F.explode("_apis").alias("api"))


def read_tool_configs(spark: SparkSession, root: str) -> DataFrame:
    """All {root}/{category}/{tool}.json: one row per api entry, in list order."""
    docs = read_documents(spark, f"{root.rstrip('/')}/*/*.json")
    parts = docs.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+\.json$", 1).alias("category"),
        F.col("id").alias("tool"),
        F.from_json("text", TOOL_CONFIG).alias("_c"),
    )
    return parts.select(
        "category", "tool", F.col("_c.description").alias("tool_description"),
        F.posexplode("_c.api_list").alias("api_pos", "_api"),
    ).select(
        "category", "tool", "tool_description", "api_pos", "_api.name", "_api.description",
        F.col("_api.required_parameters").alias("required"), F.col("_api.optional_parameters").alias("optional"),
    )


def read_ids(spark: SparkSession, path: str, name: str = "sample_id") -> DataFrame:
    """One id per line; surrounding space and blank lines do not count."""
    return spark.read.text(path).select(strip(F.col("value")).alias(name)).filter(F.col(name) != "")


def trace_rejects(spark: SparkSession, path: str) -> DataFrame:
    """id, reason of the trace files that read_traces cannot take."""
    docs = read_documents(spark, path).withColumn("_v", F.try_parse_json("text"))
    reason = F.when(F.col("_v").isNull(), "not JSON").when(
        F.coalesce(_kind_at(F.col("_v"), "$.iterations"), F.lit("")) != "ARRAY", "iterations is not a list"
    )
    return docs.select("id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def read_traces(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One row per iteration; trace_rejects lists the files that have none to read."""
    docs = read_documents(spark, path, packed=packed).select(F.from_json("text", TRACE).alias("_t"))
    return docs.select("_t.seed", "_t.total_iterations", F.explode("_t.iterations").alias("_i")).select(
        "seed", "total_iterations", "_i.*"
    )


def read_run_metadata(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Run metadata in either layout; costs under `llm_costs` or `cost`."""
    docs = read_documents(spark, path, packed=packed).select("id", F.from_json("text", METADATA).alias("_m"))
    fields = ["total_tokens", "prompt_tokens", "prompt_tokens_cached", "completion_tokens",
              "reasoning_tokens", "successful_requests"]
    return docs.select(
        "id", F.coalesce("_m.seed", F.col("id").try_cast("bigint")).alias("seed"),
        "_m.num_apis", "_m.iterations", "_m.num_proposals", "_m.config", "_m.tool_call_count", "_m.time",
        *[F.coalesce(f"_m.llm_costs.{f}", f"_m.cost.{f}").alias(f) for f in fields],
        F.coalesce("_m.llm_costs.total_cost_usd", "_m.cost.total_cost_usd", "_m.cost.total_cost").alias("total_cost_usd"),
    )


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """{root}/{model}/{bench}/{sample_id}.json: keys, failed, stored scores, steps, text."""
    docs = read_documents(spark, f"{root.rstrip('/')}/*/*/*.json")
    path = r"([^/]+)/([^/]+)/[^/]+\.json$"
    stored = F.from_json("text", f"eval {SCORES}")["eval"]
    pred = F.from_json("text", "intermediate_steps ARRAY<ARRAY<STRING>>, error STRING")
    keys = F.json_object_keys("text")
    return docs.select(
        F.regexp_extract("file", path, 1).alias("model"),
        F.regexp_extract("file", path, 2).alias("bench"),
        F.col("id").alias("sample_id"),
        F.coalesce((F.size(keys) == 0) | F.array_contains(keys, "error"), F.lit(True)).alias("failed"),
        F.when(
            stored.isNotNull(),
            F.struct(
                stored["tool_accuracy"]["precision"].alias("precision"),
                stored["tool_accuracy"]["recall"].alias("recall"),
                stored["success_rate"].alias("success_rate"), stored["qor"].alias("qor"),
            ),
        ).alias("stored"),
        pred["intermediate_steps"].alias("steps"), "text",
    )


def prediction_calls(predictions: DataFrame) -> DataFrame:
    """model, sample_id, tool, error of every call. A text result fails by its words."""
    from calltrail.functions.text import no_error_words

    step = predictions.select("model", "sample_id", F.explode("steps").alias("_s"))
    result = F.try_element_at("_s", F.lit(2))
    parsed = step.withColumn("_r", F.from_json(result, "error STRING")).withColumn(
        "_object", F.coalesce(_kind_at(F.try_parse_json(result), "$") == "OBJECT", F.lit(False))
    )
    return parsed.select(
        "model", "sample_id", F.get_json_object(F.element_at("_s", 1), "$.tool").alias("tool"),
        F.when(F.col("_object"), F.col("_r.error"))
        .when(no_error_words(result), "").otherwise(result).alias("error"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, tool from sample metadata; `pos_tools` may be a list or an object."""
    docs = read_documents(spark, path)
    tools = F.coalesce(
        F.transform(F.from_json("text", "pos_tools ARRAY<STRUCT<name: STRING>>")["pos_tools"], lambda t: t["name"]),
        F.json_object_keys(F.get_json_object("text", "$.pos_tools")),
    )
    return docs.select(F.col("id").alias("sample_id"), F.explode(tools).alias("tool"))


def stream_sample(spark: SparkSession, path: str, sample_id) -> Iterator[tuple[str, str]]:
    """(role, content) of the pieces of one sample in order, one at a time; write_pieces has sorted them.

    File and row-group statistics leave a few files to read, and one partition at a time reaches the reader.
    """
    pieces = spark.read.parquet(path).filter(F.col("sample_id") == F.lit(sample_id))
    ordered = pieces.repartitionByRange("message_no", "piece_no").sortWithinPartitions("message_no", "piece_no")
    for row in ordered.select("role", "content").toLocalIterator():
        yield row.role, row.content


def _group_records(spark: SparkSession, path: str) -> DataFrame:
    """file, text, record (a variant, null if the text is no JSON) of every document and line of a directory."""
    local = path.removeprefix("file://")
    if "://" not in path and not os.path.isdir(local):
        raise FileNotFoundError(path)
    file = path_text(F.col("_metadata.file_name")).alias("file")
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(file, F.col("value").alias("text"))
    lines = spark.read.option("pathGlobFilter", "*.{jsonl,jsonl.gz}").text(path).select(file, F.col("value").alias("text"))
    return whole.unionByName(lines).filter(strip(F.col("text")) != "").withColumn("record", F.try_parse_json("text"))


def read_group(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All .json, .jsonl and .jsonl.gz of a directory as one DataFrame.

    Without a schema the fields of all records are united by one aggregation over them: numbers widen, and
    a field whose types do not agree between records comes as text (JSON where it is nested). A file that
    holds a list gives its items. Texts that are no JSON are left out here; group_rejects has them.
    """
    records = _group_records(spark, path).filter(F.col("record").isNotNull())
    is_list = F.schema_of_variant("record").startswith("ARRAY")
    items = F.variant_get("record", "$", "array<variant>")
    records = records.select(F.explode(F.when(is_list, items).otherwise(F.array("record"))).alias("record"))
    if schema is None:
        found = records.select(F.schema_of_variant_agg("record")).head()[0]
        if not found.startswith("OBJECT<"):
            raise ValueError(f"records of {path} are no objects: {found}")
        schema = found
    else:
        schema = f"OBJECT<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in T._parse_datatype_string(schema))}>"
    kind = re.sub(r"\bOBJECT<", "STRUCT<", re.sub(r"\b(VARIANT|VOID)\b", "STRING", schema)) if schema.startswith("OBJECT<") else schema
    return records.select(F.try_variant_get("record", "$", kind).alias("_r")).select("_r.*")


def group_rejects(spark: SparkSession, path: str) -> DataFrame:
    """file, text of the documents and lines of a directory that are no JSON."""
    return _group_records(spark, path).filter(F.col("record").isNull()).select("file", "text")


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines that hold `messages` or the columns system, user, assistant."""
    from calltrail.plans.sft import columns_to_messages

    turns = "ARRAY<STRUCT<role: STRING, content: STRING>>"
    rows = spark.read.schema(f"messages {turns}, system STRING, user STRING, assistant STRING").json(path)
    ready = rows.filter(F.col("messages").isNotNull()).select("messages")
    return ready.unionByName(columns_to_messages(rows.filter(F.col("messages").isNull())))
