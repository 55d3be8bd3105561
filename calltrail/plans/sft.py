"""Chat training samples from workflows, catalog and drawn negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from calltrail.functions import prompts
from calltrail.functions.pyliteral import is_short, short_call_text, to_call_text, to_literal_text, to_record_text
from calltrail.functions.text import strip
from calltrail.operators.cuts import chosen, chosen_by_kind
from calltrail.operators.ordering import PART_SIZE, ROW_BYTES, SLICE, collect_parts, looked_up, running_count, slices
from calltrail.session import materialize

STEP_ORDER = ["chain_pos", "step_pos"]


def definition_texts(definitions: DataFrame) -> DataFrame:
    """definitions(api, definition JSON) -> api, text: the definition as a Python literal.

    A text takes far longer to make than to read, and a catalog lies in few files, so all cores get a share first.
    """
    cores = definitions.sparkSession.sparkContext.defaultParallelism
    return definitions.repartition(cores, "api").select("api", to_literal_text("definition").alias("text"))


def candidate_pool(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row per pool member: workflow_id, side, place, api.

    positives(workflow_id, chain_pos, step_pos, tool) keep the place of their first call;
    negatives(workflow_id, draw, api) follow in draw order.
    """
    first = positives.groupBy("workflow_id", F.col("tool").alias("api")).agg(
        F.min(F.struct(*STEP_ORDER)).alias("_at")
    )
    zero = F.lit(0).cast("bigint")
    return first.select(
        "workflow_id", F.lit(0).alias("side"),
        F.struct(F.col("_at.chain_pos").cast("bigint").alias("a"), F.col("_at.step_pos").cast("bigint").alias("b")).alias("place"),
        "api",
    ).unionByName(
        negatives.select(
            "workflow_id", F.lit(1).alias("side"),
            F.struct(zero.alias("a"), F.col("draw").cast("bigint").alias("b")).alias("place"), "api",
        )
    )


def merge_definitions(tools: DataFrame, keys: list[str], name: str, position: str) -> DataFrame:
    """One entry per name, at its first position, with the last definition given."""
    rest = [c for c in tools.columns if c not in (*keys, name, position)]
    return tools.groupBy(*keys, name).agg(
        F.min(position).alias(position), *[F.max_by(c, position).alias(c) for c in rest]
    )


def _defined(pool: DataFrame, definitions: DataFrame, text: str) -> DataFrame:
    """Pool members with the `text` of definitions(api, text), the rows of a workflow in one task.

    The definitions are written first and their bytes summed up on the way. Rows are dealt by workflow before any is
    gathered: a task meets few rows of a workflow before that, so gathering there would only sort them once more.
    """
    seen = Observation("definitions")
    size = F.sum(F.coalesce(F.octet_length("api"), F.lit(0)) + F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).alias("size")
    stored = materialize(definitions.select("api", text).observe(seen, size), "definitions")
    return pool.join(looked_up(stored, seen.get["size"] or 0), "api").repartition("workflow_id")


def pool_texts(pool: DataFrame, definitions: DataFrame) -> DataFrame:
    """Text of a Python list of the tool definitions of each pool.

    A pool never holds more than the requested number of tools, so the list is short.
    """
    placed = _defined(pool, definition_texts(definitions), "text")
    rows = F.sort_array(F.collect_list(F.struct("side", "place", "text")))
    return placed.groupBy("workflow_id").agg(
        F.concat(
            F.lit("["), F.array_join(F.transform(rows, lambda r: r["text"]), ", "), F.lit("]")
        ).alias("pool_text")
    )


def unknown_tools(pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pool members the catalog does not have."""
    return pool.join(catalog.select("api"), "api", "left_anti")


def answers(steps: DataFrame, output_format: str, by: Column | None = None, **limits) -> DataFrame:
    """Assistant text per workflow, in parts: workflow_id, part, n_parts, assistant.

    'python': every call of every chain as call text. 'json': the first chain only, as a
    Python list of dicts. The texts of the parts in order are the answer.
    """
    if output_format == "json":
        used = steps.filter(F.col("chain_pos") == 0)
        text = to_record_text("tool", "tool_input")
    else:
        used, text = steps, to_call_text("tool", "tool_input")
    if by is None:
        by = [F.col(c) for c in STEP_ORDER]
    size = limits.get("part_size") or PART_SIZE
    hot_rows = limits.get("hot_rows")
    cut = slices(used, ["workflow_id"], by, size if hot_rows is None else hot_rows)  # of the steps, before texts are made
    told = used.select("workflow_id", *STEP_ORDER, text.alias("text"))
    if output_format != "json":
        # only the others go through Python, of which short calls, most of all, are free
        short = is_short("tool_input")
        told = used.filter(~short).select("workflow_id", *STEP_ORDER, text.alias("text")).unionByName(
            used.filter(short).select("workflow_id", *STEP_ORDER, short_call_text("tool", "tool_input").alias("text"))
        )
    parts = collect_parts(told, ["workflow_id"], STEP_ORDER, ["text"], by, **limits, cut=cut)
    last = (F.col("part") + 1) * size >= F.col("n_total")
    joined = F.array_join(F.transform("items", lambda i: i["text"]), ", ")
    return parts.select(
        "workflow_id", "part", F.ceil(F.col("n_total") / size).alias("n_parts"),
        F.concat(
            F.when(F.col("part") == 0, "[").otherwise(", "), joined, F.when(last, "]").otherwise("")
        ).alias("assistant"),
    )


def format_samples(workflows: DataFrame, steps: DataFrame, negatives: DataFrame, definitions: DataFrame,
                   num_tools: int = 10, output_format: str = "python", by: Column | None = None,
                   **limits) -> DataFrame:
    """sample_id, part, n_parts, system, user, assistant of workflows(workflow_id, query).

    Pass the workflows whose pool fits (see draws.rejected). A sample is one row; only an
    answer longer than a part goes on in further rows, whose system and user are empty.
    """
    answer = answers(steps, output_format, by, **limits)
    if num_tools < 0:
        prompted = workflows.withColumn("system", F.lit(prompts.base_prompt(output_format)))
    else:
        kept = steps.join(workflows.select("workflow_id"), "workflow_id", "left_semi")
        pools = pool_texts(candidate_pool(kept, negatives), definitions)
        prompted = workflows.join(pools, "workflow_id", "left").withColumn(
            "system", prompts.with_pool(output_format, F.coalesce("pool_text", F.lit("[]")))
        )
    first = F.coalesce("part", F.lit(0)) == 0
    return prompted.join(answer, "workflow_id", "left").select(
        F.col("workflow_id").alias("sample_id"),
        F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
        F.when(first, F.col("system")).otherwise("").alias("system"),
        F.when(first, F.col("query")).otherwise("").alias("user"),
        F.coalesce("assistant", F.lit("[]")).alias("assistant"),
    )


def negative_samples(workflows: DataFrame, negatives: DataFrame, definitions: DataFrame,
                     output_format: str = "python") -> DataFrame:
    """Samples whose pool holds nothing useful and whose answer is empty; ids end in _neg."""
    pool = negatives.select(
        "workflow_id", F.lit(1).alias("side"),
        F.struct(F.lit(0).cast("bigint").alias("a"), F.col("draw").cast("bigint").alias("b")).alias("place"), "api",
    )
    return workflows.join(pool_texts(pool, definitions), "workflow_id").select(
        F.concat(F.col("workflow_id").cast("string"), F.lit("_neg")).alias("sample_id"),
        F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("n_parts"),
        prompts.with_pool(output_format, F.col("pool_text")).alias("system"),
        F.col("query").alias("user"),
        F.lit("[]").alias("assistant"),
    )


def whole_samples(samples: DataFrame) -> DataFrame:
    """sample_id, system, user, assistant: one row a sample, for samples that a row can hold.

    Samples of one part pass as they are; only the parts of longer ones are shuffled and joined in order.
    sample_pieces is the form for samples of any length.
    """
    columns = ["sample_id", "system", "user", "assistant"]
    first = F.col("part") == 0
    longer = samples.filter(F.col("n_parts") > 1).groupBy("sample_id").agg(
        F.max(F.when(first, F.col("system"))).alias("system"), F.max(F.when(first, F.col("user"))).alias("user"),
        F.sort_array(F.collect_list(F.struct("part", "assistant"))).alias("_pieces"),
    ).select("sample_id", "system", "user", F.array_join(F.transform("_pieces", lambda p: p["assistant"]), "").alias("assistant"))
    return samples.filter(F.col("n_parts") == 1).select(*columns).unionByName(longer)


def sample_pieces(samples: DataFrame) -> DataFrame:
    """sample_id, message_no, piece_no, role, content: messages in pieces, a row each; no row holds a whole long sample.

    Made in the rows of the parts, without a shuffle. The contents of a message's pieces in order are its
    content; a sample without system text has no message 0.
    """
    def turn(number: int, role: str) -> Column:
        return F.struct(F.lit(number).alias("message_no"), F.lit(role).alias("role"), F.coalesce(F.col(role), F.lit("")).alias("content"))

    turns = F.when(F.col("part") == 0, F.array(turn(0, "system"), turn(1, "user"), turn(2, "assistant"))).otherwise(F.array(turn(2, "assistant")))
    rows = samples.select("sample_id", "part", F.explode(turns).alias("m"))
    rows = rows.filter((F.col("m.role") != "system") | (F.col("m.content") != ""))
    return rows.select("sample_id", "m.message_no", F.col("part").alias("piece_no"), "m.role", "m.content")


def sample_messages(samples: DataFrame) -> DataFrame:
    """sample_id, messages: one training sample a row, however many parts its answer has."""
    return whole_samples(samples).select(
        "sample_id", prompts.messages(F.col("system"), F.col("user"), F.col("assistant")).alias("messages")
    )


def append_negatives(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both kinds of samples of each split, told apart by `is_negative`."""
    return positives.withColumn("is_negative", F.lit(False)).unionByName(negatives.withColumn("is_negative", F.lit(True)))


def test_ids(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """The test ids, each once, in order."""
    return samples.filter(F.col("split") == "test").select(key).distinct().orderBy(key)


def batch_totals(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """n_total, n_accepted, n_rejected of a batch, from its accepted ids and its rejects."""
    told = accepted.select(F.lit(1).alias("_good")).unionByName(rejected.select(F.lit(0).alias("_good")))
    return told.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_good") == 1).alias("n_accepted"), F.count_if(F.col("_good") == 0).alias("n_rejected")
    )


def turns_from_columns() -> Column:
    """Columns system, user and assistant, stripped, as an array of messages."""
    return F.array(
        *[F.struct(F.lit(r).alias("role"), strip(F.col(r)).alias("content")) for r in ("system", "user", "assistant")]
    )


def columns_to_messages(flat: DataFrame) -> DataFrame:
    """Flat samples as messages; other columns go."""
    return flat.select(turns_from_columns().alias("messages"))


def api_predictions(steps: DataFrame, limit: int = 10_000) -> DataFrame:
    """workflow_id, part, api_preds: the calls of each chain, by chain name, in parts of at most `limit` calls.

    steps(workflow_id, chain_pos, step_pos, chain_name, tool, tool_input). A workflow of ordinary length is one
    row whose map has all chains in order.
    """
    told = steps.withColumn("call", F.struct("tool", "tool_input"))
    parts = collect_parts(told, ["workflow_id"], STEP_ORDER, ["chain_name", "call"], [F.col(c) for c in STEP_ORDER], part_size=limit)
    names = F.array_distinct(F.transform("items", lambda i: i["chain_name"]))
    chains = F.transform(names, lambda n: F.transform(F.filter("items", lambda i: i["chain_name"] == n), lambda i: i["call"]))
    return parts.select("workflow_id", "part", F.map_from_arrays(names, chains).alias("api_preds"))


def sample_records(pool: DataFrame, definitions: DataFrame, steps: DataFrame) -> DataFrame:
    """workflow_id, part, pos_tools, neg_tools, api_preds: the record that is kept beside a sample.

    The tools stand in part 0; further parts of very long workflows hold only calls.
    """
    both = api_predictions(steps).join(metadata(pool, definitions), "workflow_id")
    none = F.array().cast("array<string>")
    return both.select(
        "workflow_id", "part", *[F.when(F.col("part") == 0, F.col(c)).otherwise(none).alias(c) for c in ("pos_tools", "neg_tools")], "api_preds"
    )


def metadata(pool: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions of positives and negatives per workflow."""
    rows = _defined(pool, definitions, "definition").groupBy("workflow_id").agg(
        F.sort_array(F.collect_list(F.struct("side", "place", "definition"))).alias("rows")
    )
    of = lambda side: F.filter("rows", lambda r: r["side"] == side)["definition"]
    return rows.select("workflow_id", of(0).alias("pos_tools"), of(1).alias("neg_tools"))


def pool_violations(pool: DataFrame, num_tools: int) -> DataFrame:
    """Pools of the wrong size, and pools with a tool on both sides; empty when all is well."""
    # the least and the greatest side tell as much as a distinct count, which would shuffle every row once more
    per_tool = pool.groupBy("workflow_id", "api").agg(F.min("side").alias("_low"), F.max("side").alias("_high"))
    checked = per_tool.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("n_tools"), F.count_if(F.col("_low") < F.col("_high")).alias("n_shared")
    )
    wrong_size = F.lit(False) if num_tools == -1 else F.col("n_tools") != num_tools
    return checked.filter(wrong_size | (F.col("n_shared") > 0))


def choose_sources(workflows: DataFrame, ratio: float = 0.2, seed: int = 42, in_place: bool = False):
    """(sources of positives, sources of negatives). In place, the second leave the first."""
    pick = chosen(workflows, "workflow_id", seed, ratio)
    return (workflows.filter(~pick) if in_place else workflows), workflows.filter(pick)


def split(samples: DataFrame, test_ratio: float = 0.0, seed: int = 42, key: str = "sample_id",
          kind: str | None = None, kinds: list | None = None) -> DataFrame:
    """Add `split`. With `kind`, every kind is cut by the same ratio on its own."""
    if kind is None:
        test = chosen(samples, key, seed, test_ratio)
    else:
        test = chosen_by_kind(samples, key, kind, kinds, seed, test_ratio)
    return samples.withColumn("split", F.when(test, "test").otherwise("train"))


def by_ids(ids: DataFrame, sets: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """The listed samples of every set, one after another; missing ones are skipped."""
    out = None
    for one in sets:
        found = one.join(ids, key, "left_semi")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def within_length(samples: DataFrame, text: Column, limit: int = 8000, counter=None) -> DataFrame:
    """Samples of at most `limit` tokens. The default counter counts runs of non-space."""
    count = F.regexp_count(text, F.lit(r"[^\t-\r\x1c-\x1f\x85\p{Z}]+")) if counter is None else counter(text)
    return samples.withColumn("n_tokens", count).filter(F.col("n_tokens") <= limit)


def role_checks(turns: DataFrame, key: str, order: list[Column], by: Column, hot_rows: int | None = None) -> DataFrame:
    """Do roles alternate user, assistant after an optional leading system message?

    Counts breaches under both readings (with and without a system message) and keeps the
    one that the first message calls for, so a conversation is one running count and one sum.
    """
    cut = slices(turns, [key], by, hot_rows)
    return _checks(running_count(cut.mark(turns), [key], order, cut, "position"), key)


def _checks(placed: DataFrame, key: str) -> DataFrame:
    odd = F.col("position") % 2 == 1
    is_user = F.col("role") == "user"
    return (
        placed.groupBy(key)
        .agg(
            F.min_by("role", "position").alias("first_role"),
            F.count(F.lit(1)).alias("n_messages"),
            F.count_if(is_user != odd).alias("_plain"),
            F.count_if((is_user == odd) & (F.col("position") > 1)).alias("_after_system"),
        )
        .select(
            key, "n_messages",
            (F.col("first_role") == "system").alias("has_system"),
            F.when(F.col("first_role") == "system", F.col("_after_system")).otherwise(F.col("_plain")).alias("n_breaches"),
        )
    )


def conversation_messages(turns: DataFrame, key: str, order: str, by: Column, **limits) -> DataFrame:
    """Ordered messages per conversation, in parts."""
    return collect_parts(turns, [key], [order], ["role", "content"], by, **limits)


def rendered_chats(turns: DataFrame, key: str, order: str, by: Column, bos: str = "<bos>",
                   generation_prompt: bool = False, **limits) -> DataFrame:
    """Chat text per conversation, in parts. Conversations with role breaches are left out."""
    hot_rows = limits.get("hot_rows")
    cut = slices(turns, [key], by, hot_rows)
    placed = running_count(cut.mark(turns), [key], [F.col(order)], cut, "position").drop(SLICE)
    broken = _checks(placed, key).filter(F.col("n_breaches") > 0).select(key)
    told = placed.join(broken, key, "left_anti").select(
        key, "position", prompts.turn_text(F.col("role"), F.col("content"), F.col("position")).alias("text")
    )
    parts = collect_parts(told, [key], ["position"], ["text"], by=F.col("position"), **limits)
    size = limits.get("part_size") or 10_000
    tail = f"{prompts.TURN_START}model\n" if generation_prompt else ""
    last = (F.col("part") + 1) * size >= F.col("n_total")
    return parts.select(
        key, "part",
        F.concat(
            F.when(F.col("part") == 0, bos).otherwise(""),
            F.array_join(F.transform("items", lambda i: i["text"]), ""),
            F.when(last, tail).otherwise(""),
        ).alias("text"),
    )
