"""Summaries of generation runs: iterations, tool calls, token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATION = ["run", "iteration"]
MAX_APIS = 3

# USD per million prompt and completion tokens, by model and by default.
PRICES = [
    ("gemini-2.5-flash-lite", 0.10, 0.40),
    ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-3-flash", 0.50, 3.00),
]
DEFAULT_PRICES = (1.0, 4.0)


def pool_bitmaps(pool: DataFrame, positions: DataFrame) -> DataFrame:
    """run, iteration, bucket, bitmap: the pools of pool(run, iteration, api) as bits at the catalog positions of their apis.

    positions(api, position) numbers the catalog from 0, a row an api. A bitmap covers 32,768 positions in 4 KB,
    so a pool is a few rows however many apis it has, and is summed up before the shuffle.
    """
    placed = pool.join(positions.select("api", (F.col("position") + 1).alias("_at")), "api")
    return placed.groupBy(*ITERATION, F.bitmap_bucket_number("_at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bitmap")
    )


def pool_masks(pool: DataFrame, positions: DataFrame) -> DataFrame:
    """run, iteration, _word, _mask: the pools as bits of BIGINTs, 64 positions each.

    As pool_bitmaps, but a row that is joined to proposals weighs 8 bytes instead of 4 KB, also for a pool of few apis.
    """
    placed = pool.join(positions.select("api", F.col("position").alias("_at")), "api")
    return placed.groupBy(*ITERATION, _word(F.col("_at")).alias("_word")).agg(F.bit_or(_bit(F.col("_at"))).alias("_mask"))


def _word(at: Column) -> Column:
    return F.shiftright(at.cast("bigint"), 6)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("bigint").bitwiseAND(63).cast("int"))


def has_bit(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def proposal_checks(proposals: DataFrame, pool: DataFrame | None = None, max_apis: int = MAX_APIS,
                    positions: DataFrame | None = None) -> DataFrame:
    """Per iteration: is the proposal set usable?

    proposals(run, iteration, proposal_id, api), one row per proposed api, a null api allowed. One
    proposal with too many apis, or one api outside `pool`(run, iteration, api), spoils the set. With
    `positions`(api, position), a numbered catalog, pools are bitmaps, and an api that it does not have is
    foreign; without it they are joined by name.
    """
    if pool is None:
        foreign, named = F.lit(False), proposals
    elif positions is None:
        known = pool.select(*ITERATION, "api").distinct().withColumn("_in", F.lit(True))
        named = proposals.join(known, [*ITERATION, "api"], "left")
        foreign = F.col("api").isNotNull() & F.col("_in").isNull()
    else:
        at = positions.select("api", F.col("position").alias("_at"))
        placed = proposals.join(at, "api", "left").withColumn("_word", _word(F.col("_at")))
        named = placed.join(pool_masks(pool, positions), [*ITERATION, "_word"], "left")
        inside = F.coalesce(F.col("_mask").bitwiseAND(_bit(F.col("_at"))) != 0, F.lit(False))
        foreign = F.col("api").isNotNull() & ~inside
    per_proposal = named.groupBy(*ITERATION, "proposal_id").agg(
        F.count(F.lit(1)).alias("n_apis"), F.count_if(foreign).alias("n_foreign")
    )
    return per_proposal.groupBy(*ITERATION).agg(
        F.count(F.lit(1)).alias("n_proposals"),
        F.count_if(F.col("n_apis") > max_apis).alias("n_too_many"),
        F.sum("n_foreign").alias("n_foreign"),
    ).withColumn("accepted", (F.col("n_too_many") == 0) & (F.col("n_foreign") == 0))


def execution_counts(executions: DataFrame) -> DataFrame:
    """executions(run, iteration, success, num_tool_calls) -> counts per iteration."""
    return executions.groupBy(*ITERATION).agg(
        F.count(F.lit(1)).alias("n_executions"),
        F.count_if("success").alias("n_success"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.sum("num_tool_calls").cast("bigint").alias("n_tool_calls"),
    )


def successful(executions: DataFrame) -> DataFrame:
    """The reports a selection may choose from."""
    return executions.filter("success")


def selection_label(which_chain: Column) -> Column:
    return F.when(which_chain == "-1", F.lit("create_new_chain")).otherwise(
        F.concat(F.lit("update_chain_"), which_chain)
    )


def selection_checks(selections: DataFrame, executions: DataFrame, chains: DataFrame) -> DataFrame:
    """Flag selections whose report or chain does not exist.

    selections(run, iteration, selected_id, which_chain); chains(run, iteration, chain_id) are
    the chains that exist before the iteration. A null id means the iteration is skipped.
    """
    reports = executions.select(*ITERATION, F.col("proposal_id").alias("selected_id")).distinct()
    present = chains.select(*ITERATION, F.col("chain_id").alias("which_chain")).distinct()
    return (
        selections.join(reports.withColumn("_r", F.lit(True)), [*ITERATION, "selected_id"], "left")
        .join(present.withColumn("_c", F.lit(True)), [*ITERATION, "which_chain"], "left")
        .select(
            *selections.columns,
            F.col("selected_id").isNull().alias("skipped"),
            (F.col("selected_id").isNull() | F.col("_r").isNotNull()).alias("report_known"),
            ((F.col("which_chain") == "-1") | F.col("_c").isNotNull()).alias("chain_known"),
        )
    )


def selected_tools(selections: DataFrame, executions: DataFrame) -> DataFrame:
    """Selection with its label and the tool of the report it names."""
    reports = executions.select(*ITERATION, F.col("proposal_id").alias("selected_id"), F.col("tool").alias("tool_used"))
    return selections.join(reports, [*ITERATION, "selected_id"], "left").select(
        *ITERATION, "selected_id", selection_label(F.col("which_chain")).alias("action"), "which_chain", "tool_used"
    )


def execution_summary(executions: DataFrame, result: str, error: str, limit: int = 200) -> DataFrame:
    """A call step for successes only, an error text for failures that have one."""
    from calltrail.functions.text import preview

    return executions.select(
        *ITERATION, "proposal_id", "success", "num_tool_calls",
        F.when(
            F.col("success"),
            F.struct("tool", "tool_input", preview(F.col(result), limit).alias("result_preview")),
        ).alias("api_call_step"),
        F.when(~F.col("success") & (F.col(error) != ""), F.col(error)).alias("error_message"),
    )


def proposal_summary(proposals: DataFrame) -> DataFrame:
    """run, iteration, proposal_id, instruction, apis: a row a proposal with its apis {name, description} in order.

    proposals(run, iteration, proposal_id, instruction, position, name, description), a row per proposed api;
    a missing description reads 'N/A'. A proposal without apis has one row with a null name and an empty list.
    """
    api = F.struct("position", "name", F.coalesce("description", F.lit("N/A")).alias("description"))
    listed = F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), api)))
    return proposals.groupBy(*ITERATION, "proposal_id").agg(
        F.max("instruction").alias("instruction"),
        F.transform(listed, lambda a: F.struct(a["name"].alias("name"), a["description"].alias("description"))).alias("apis"),
    )


def iteration_outcomes(iterations: DataFrame, max_iter: int | None = None) -> DataFrame:
    """What ended each iteration.

    iterations(run, iteration, has_proposals, n_success, has_selection, has_update): the first
    thing missing names the outcome.
    """
    outcome = (
        F.when(~F.col("has_proposals"), "skipped_proposer")
        .when(F.coalesce("n_success", F.lit(0)) == 0, "skipped_executor")
        .when(~F.col("has_selection"), "skipped_selector")
        .when(~F.col("has_update"), "skipped_updater")
        .otherwise("committed")
    )
    out = iterations.withColumn("outcome", outcome)
    if max_iter is not None:
        out = out.withColumn("in_limit", F.col("iteration") <= max_iter)
    return out


def run_totals(iterations: DataFrame) -> DataFrame:
    """Iterations, committed iterations and tool calls per run."""
    return iterations.groupBy("run").agg(
        F.count(F.lit(1)).alias("total_iterations"),
        F.count_if(F.col("outcome") == "committed").alias("n_committed"),
        F.sum("n_tool_calls").cast("bigint").alias("total_tool_calls"),
    )


def token_cost(usage: DataFrame, prices: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Token totals and USD cost per `keys`.

    usage(model, prompt_tokens, completion_tokens, cached_tokens); null prompt tokens mean a
    request without usage. Tokens are summed per model first; prices meet the few totals.
    """
    keys = keys or ["model"]
    spark = usage.sparkSession
    if prices is None:
        prices = spark.createDataFrame(PRICES, "model string, prompt_price double, completion_price double")
    totals = usage.groupBy(*dict.fromkeys([*keys, "model"])).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("prompt_tokens", "completion_tokens", "cached_tokens")
        ],
        F.count_if(F.col("prompt_tokens").isNotNull()).alias("successful_requests"),
    )
    priced = totals.join(prices, "model", "left")
    cost = (
        F.col("prompt_tokens") * F.coalesce("prompt_price", F.lit(DEFAULT_PRICES[0]))
        + F.col("completion_tokens") * F.coalesce("completion_price", F.lit(DEFAULT_PRICES[1]))
    ) / 1_000_000
    return priced.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")],
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.sum("successful_requests").alias("successful_requests"),
        F.sum(cost).alias("total_cost_usd"),
    )
