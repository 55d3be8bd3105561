"""Workflow jobs: steps out of documents, tool lists, chains rebuilt from selection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.functions.pyliteral import to_literal_text
from calltrail.operators.ordering import SLICE, collect_parts, running_count, slices
from calltrail.plans.catalog import hash_to_name
from calltrail.session import materialize

ACTION = "tool STRING, tool_input STRING, log STRING, tool_call_id STRING"
RESULT = "error STRING, response STRING"
MAX_CHAINS = 10
CHAIN_PREFIX = "api_use_chain_"
EDGE_CHUNK = 100_000  # steps of a chain that one window holds


def flatten_steps(workflows: DataFrame) -> DataFrame:
    """One row per step, chains and steps in document order.

    workflows(workflow_id, api_use_chains MAP<STRING, STRUCT<chain_id, intermediate_steps>>).
    `tool_input` is JSON text. A result is an object or a text (`result_kind`); a list stands there as Python
    writes it.
    """
    chains = workflows.select(
        "workflow_id", F.posexplode("api_use_chains").alias("chain_pos", "chain_key", "_chain")
    )
    steps = chains.select(
        "workflow_id", "chain_pos", "chain_key", F.expr("substring(chain_key, 9)").alias("chain_name"),
        F.posexplode("_chain.intermediate_steps").alias("step_pos", "_step"),
    )
    result = F.try_element_at("_step", F.lit(2))
    parsed = steps.withColumn("_a", F.from_json(F.try_element_at("_step", F.lit(1)), ACTION)).withColumn(
        "_v", F.try_parse_json(result)
    )
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    parsed = parsed.withColumn("_kind", kind)
    is_object = F.col("_kind") == "OBJECT"
    as_list = to_literal_text(F.when(F.col("_kind") == "ARRAY", result))
    told = parsed.withColumn("_r", F.when(is_object, F.from_json(result, RESULT))).withColumn("_list", as_list)
    return told.select(
        "workflow_id", "chain_pos", "chain_key", "chain_name", "step_pos",
        "_a.tool", "_a.tool_input", "_a.log", "_a.tool_call_id",
        F.when(is_object, F.lit("object")).otherwise(F.lit("text")).alias("result_kind"),
        "_r.error", "_r.response", F.coalesce("_list", result).alias("result"),
        (F.size("_step") == 2).alias("well_formed"),
    )


def name_steps(steps: DataFrame, hashes: DataFrame) -> DataFrame:
    """Put names where hashes were: in the tool, its log and its result.

    Steps whose tool is neither a hash nor a name are dropped.
    """
    named = hash_to_name(steps, hashes, "tool").filter(F.col("name").isNotNull())
    swapped = {
        c: F.replace(F.col(c), F.col("tool"), F.col("name"))
        for c in ("log", "result", "error", "response")
        if c in steps.columns
    }
    return named.withColumns(swapped).withColumn("tool", F.col("name")).select(*steps.columns)


def chain_headers(workflows: DataFrame) -> DataFrame:
    """Chain ids without their steps, in document order."""
    return workflows.select(
        "workflow_id", F.posexplode("api_use_chains").alias("chain_pos", "chain_key", "_chain")
    ).select("workflow_id", "chain_pos", "chain_key", "_chain.chain_id",
             F.coalesce(F.size("_chain.intermediate_steps"), F.lit(0)).alias("n_steps"))


def renamed_chain(chain_pos: Column) -> Column:
    """chain_1.. by position; null beyond the tenth."""
    return F.when(chain_pos < MAX_CHAINS, F.concat(F.lit("chain_"), (chain_pos + 1).cast("string")))


def tool_lists(steps: DataFrame, order: list[str], by: Column, **limits) -> DataFrame:
    """Tools per workflow in call order, repeats kept, in parts (see collect_parts)."""
    parts = collect_parts(steps, ["workflow_id"], order, ["tool"], by, **limits)
    return parts.select("workflow_id", "part", "n_total", F.transform("items", lambda i: i["tool"]).alias("tools"))


def tool_counts(steps: DataFrame) -> DataFrame:
    """Calls and distinct tools per workflow."""
    per_tool = steps.groupBy("workflow_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    return per_tool.groupBy("workflow_id").agg(
        F.sum("n").alias("n_calls"), F.count(F.lit(1)).alias("n_tools")
    )


def place_selections(selections: DataFrame, order: list[Column], by: Column, max_chains: int = MAX_CHAINS,
                     hot_rows: int | None = None) -> DataFrame:
    """Replay a selection log: which chain each selection goes to, and why some do not.

    selections(run, which_chain, ...). '-1' and the first selection of a run open the next
    chain; other values name an existing chain. `outcome` is 'committed', 'saturated' (all
    chains in use) or 'unknown_chain'; `step_pos` counts from 1 inside the chain.
    """
    cut = slices(selections, ["run"], by, hot_rows)
    marked = cut.mark(selections)
    first = running_count(marked, ["run"], order, cut, "_at")
    opens = (F.col("which_chain") == "-1") | (F.col("_at") == 1)
    counted = running_count(
        first.withColumn("_opens", opens), ["run"], order, cut, "_opened",
        weight=F.col("_opens").cast("bigint"),
    )
    target = F.regexp_extract("which_chain", f"^{CHAIN_PREFIX}([0-9]+)$", 1).try_cast("bigint")
    in_use = F.least(F.col("_opened"), F.lit(max_chains))
    outcome = (
        F.when(F.col("_opens") & (F.col("_opened") > max_chains), "saturated")
        .when(F.col("_opens") | (target.between(1, in_use)), "committed")
        .otherwise("unknown_chain")
    )
    number = F.when(F.col("outcome") == "committed", F.when(F.col("_opens"), F.col("_opened")).otherwise(target))
    placed = (
        counted.withColumn("outcome", outcome)
        .withColumn("chain_number", number)
        .withColumn("chain_id", F.concat(F.lit(CHAIN_PREFIX), F.col("chain_number").cast("string")))
        .drop("_opens", "_opened", "_at")
    )
    # chain 0 stands for selections that go nowhere, so the count needs no second scan
    with_steps = running_count(
        placed.withColumn("_chain", F.coalesce("chain_number", F.lit(0))), ["run", "_chain"], order, cut, "_step"
    )
    return with_steps.withColumn(
        "step_pos", F.when(F.col("chain_number").isNotNull(), F.col("_step"))
    ).drop("_step", "_chain", SLICE)


def rebuild_chains(selections: DataFrame, order: list[Column], by: Column, max_chains: int = MAX_CHAINS,
                   hot_rows: int | None = None):
    """(committed steps, selections left out). The replay is written once for both."""
    placed = materialize(place_selections(selections, order, by, max_chains, hot_rows), "placed")
    good = F.col("outcome") == "committed"
    return placed.filter(good), placed.filter(~good)


def chain_sizes(chains: DataFrame) -> DataFrame:
    """Steps per chain."""
    return chains.groupBy("run", "chain_id").agg(F.count(F.lit(1)).alias("n_steps"))


def chain_io(chains: DataFrame, arguments: str, result: str) -> DataFrame:
    """Arguments of the first and result of the last step of each chain."""
    return chains.groupBy("run", "chain_id").agg(
        F.min_by(arguments, "step_pos").alias("input"), F.max_by(result, "step_pos").alias("output")
    )


def chain_edges(chains: DataFrame, node: str, chunk: int = EDGE_CHUNK) -> DataFrame:
    """Links from each step to the next of its chain.

    Each step looks at the one before it, in a window of `chunk` steps; the last step of a chunk also stands
    in the next one, so a chain of any length takes one shuffle and no window holds more.
    """
    at = F.floor((F.col("step_pos") - 1) / chunk)
    homes = F.when(F.col("step_pos") % chunk == 0, F.array(at, at + 1)).otherwise(F.array(at))
    spread = chains.select("run", "chain_id", "step_pos", F.col(node).alias("destination"), F.explode(homes).alias("_chunk"))
    order = Window.partitionBy("run", "chain_id", "_chunk").orderBy("step_pos")
    told = spread.withColumn("source", F.lag("destination").over(order)).withColumn("source_pos", F.lag("step_pos").over(order))
    return told.filter(F.col("source_pos").isNotNull()).select("run", "chain_id", "source_pos", "source", "destination")


def rightmost_chain(nodes: DataFrame, skip_root: bool = False) -> DataFrame:
    """From every root follow the last child down: tree, node, depth.

    nodes(tree, node, parent, ord), node unique in its tree, parent null at the root. Every last
    child points at its parent; pointers double until they reach a node that is no last child, so
    a path of n nodes takes log2(n) rounds. Nodes whose pointer ends at a root are on the path. A cycle has no
    root, so it is on no path and does not keep other trees waiting; cyclic_trees lists it.
    """
    state = _pointers(nodes)
    roots = nodes.filter(F.col("parent").isNull()).select("tree", "node")
    down = state.join(roots.select("tree", F.col("node").alias("above")), ["tree", "above"], "left_semi").select("tree", "node", "depth")
    return down if skip_root else roots.select("tree", "node", F.lit(0).alias("depth")).unionByName(down)


def cyclic_trees(nodes: DataFrame) -> DataFrame:
    """The trees in which last children form a cycle, each once."""
    state = _pointers(nodes)
    again = state.select("tree", F.col("node").alias("above"))
    return state.join(again, ["tree", "above"], "left_semi").select("tree").distinct()


def _pointers(nodes: DataFrame) -> DataFrame:
    """tree, node, above, depth of every last child: the first node up the path that is no last child; any node in a cycle."""
    last = nodes.filter(F.col("parent").isNotNull()).groupBy("tree", "parent").agg(F.max_by("node", "ord").alias("node"))
    state = materialize(last.select("tree", "node", F.col("parent").alias("above"), F.lit(1).alias("depth")), "last-child")
    for _ in range(state.count().bit_length() + 1):  # no path is longer, so what still moves then is a cycle
        up = state.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        if state.join(up, ["tree", "above"], "left_semi").isEmpty():
            return state
        state = materialize(
            state.join(up, ["tree", "above"], "left").select(
                "tree", "node", F.coalesce("next", "above").alias("above"),
                F.try_add(F.col("depth"), F.coalesce("more", F.lit(0))).alias("depth"),  # a cycle counts up without end
            ),
            "last-child",
        )
    return state


def last_success(steps: DataFrame, keys: list[str], position: str, valid: Column) -> DataFrame:
    """Position of the last valid step per proposal, null when none is."""
    return steps.groupBy(*keys).agg(F.max(F.when(valid, F.col(position))).alias("last_success"))


def error_details(steps: DataFrame, keys: list[str], position: str, by: Column, **limits) -> DataFrame:
    """Why the proposals without a valid step failed, details joined in step order.

    steps(keys..., position, tool, is_valid, validation_error, error, result_text). Comes in
    parts like every ordered list; the texts of a proposal's parts join with ' | '.
    """
    from calltrail.functions.text import MAX_PREVIEW

    has_error_word = F.lower("result_text").contains("error") | F.lower("result_text").contains("failed")
    detail = F.coalesce(
        F.when(F.col("validation_error") != "", F.col("validation_error")),
        F.when(F.col("error") != "", F.col("error")),
        F.when(has_error_word, F.substring("result_text", 1, MAX_PREVIEW)),
    )
    failed = (
        steps.groupBy(*keys)
        .agg(F.bool_or("is_valid").alias("_any"), F.count(F.lit(1)).alias("n_steps"))
        .filter(~F.col("_any"))
        .drop("_any")
    )
    told = steps.withColumn("detail", F.concat(F.col("tool"), F.lit(": "), detail)).filter(
        F.col("detail").isNotNull()
    ).join(failed, keys, "left_semi")
    parts = collect_parts(told, keys, [position], ["detail"], by, **limits).select(
        *keys, "part", F.array_join(F.transform("items", lambda i: i["detail"]), " | ").alias("error_message")
    )
    return failed.join(parts, keys, "left").select(
        *keys, "n_steps", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("error_message", F.lit("All tool executions failed")).alias("error_message"),
    )


def response_outcomes(steps: DataFrame, keys: list[str], position: str, **limits) -> DataFrame:
    """Per proposal: n_steps, last_success, and where no response is good why, in parts (part, error_message).

    steps(keys..., position BIGINT, tool, response, error): every response is judged, its reason is the detail
    of a failed step. The judged rows are written without the responses and read for both results.
    """
    from calltrail.functions.validation import validate_responses

    judged = validate_responses(steps).select(
        *keys, position, "tool", "is_valid", F.col("reason").alias("validation_error"), "error", F.substring("response", 1, 1000).alias("result_text")
    )
    judged = materialize(judged, "judged-responses")
    good = last_success(judged, keys, position, F.col("is_valid"))
    sizes = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps"))
    errors = error_details(judged, keys, position, F.col(position), **limits).drop("n_steps")
    joined = sizes.join(good, keys).join(errors, keys, "left")
    return joined.select(*keys, "n_steps", "last_success", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), "error_message")


def step_failures(proposals: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals of which no step survived."""
    return proposals.join(steps.select(*keys).distinct(), keys, "left_anti").withColumn(
        "error_message", F.lit("Execution produced no valid steps")
    )


def latest(df: DataFrame, key: str, version: Column) -> DataFrame:
    """One row per key, the newest version."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, version).alias("_r")).select("_r.*")
