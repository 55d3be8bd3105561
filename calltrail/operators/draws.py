"""Uniform draws without replacement from a catalog, leaving out some blocks per workflow.

The catalog is laid out on dense positions 0..M-1 with every family in one block. What a
workflow may not draw is a set of disjoint blocks. Drawing the r-th allowed position needs
no candidate list: r is drawn among the allowed count, then moved past the blocks before
it. So the work per workflow is (tools wanted) x (blocks left out), whatever M is, and it is
done inside the workflow's row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.operators.ordering import ROW_BYTES, SLICE, Slices, hot_keys, looked_up, lookup, running_count
from calltrail.session import materialize

SPELLED_OUT = 16  # draws of a workflow up to which each is an expression of its own


def _bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def lay_out(catalog: DataFrame) -> DataFrame:
    """catalog(api, family) -> api, family, position, family_start, family_size.

    Every family is cut into 256 slices by hash, and families are summed up by hash prefix,
    so neither a huge family nor a long list of families passes through one task.
    """
    inside = Slices(["family"], every=_bits(F.col("api").cast("string"), 2))
    ranked = running_count(
        inside.mark(catalog), ["family"], [F.md5(F.col("api").cast("string")), F.col("api")], inside, "_rank"
    ).drop(SLICE)
    sizes = catalog.groupBy("family").agg(F.count(F.lit(1)).alias("family_size"))
    across = Slices([], every=_bits(F.col("family"), 3))
    starts = running_count(
        across.mark(sizes), [], [F.md5("family"), F.col("family")], across, "_end",
        weight=F.col("family_size"),
    ).select("family", "family_size", (F.col("_end") - F.col("family_size")).alias("family_start"))
    return ranked.join(starts, "family").select(
        "api", "family", (F.col("family_start") + F.col("_rank") - 1).alias("position"),
        "family_start", "family_size",
    )


def _ranks(workflow: Column, wanted: Column, allowed: Column, seed: int) -> Column:
    """`wanted` distinct ranks in 0..allowed-1, in draw order; one rule for all sizes.

    Step i takes a rank of 0..m with m = allowed - wanted + i, or m itself if that rank is taken
    already (Floyd's method): every set of ranks is equally likely, and `wanted` steps always
    suffice. The ranks are then put in hash order.
    """
    text = F.concat(F.lit(f"{seed}|"), workflow.cast("string"), F.lit("|"))

    def pick(i: Column) -> Column:  # computed once, although the step below reads it twice
        m = allowed - wanted + i
        return F.struct(m.alias("m"), F.pmod(_bits(F.concat(text, i.cast("string")), 15), m + 1).alias("rank"))

    def step(taken: Column, p: Column) -> Column:
        return F.concat(taken, F.array(F.when(F.array_contains(taken, p["rank"]), p["m"]).otherwise(p["rank"])))

    picks = F.transform(F.sequence(F.lit(0).cast("bigint"), wanted - 1), pick)
    taken = F.aggregate(picks, F.array().cast("array<bigint>"), step)
    order = F.transform(taken, lambda r: F.struct(F.md5(F.concat(text, F.lit("r"), r.cast("string"))).alias("h"), r.alias("r")))
    return F.transform(F.sort_array(order), lambda s: s["r"])


def _ranked(able: DataFrame, most: int, seed: int) -> DataFrame:
    """Add `ranks`, those of _ranks; `wanted` is 1 to `most`.

    Few draws are spelled out step by step: lambdas are interpreted, and make the same ranks at more than twice the time.
    """
    wanted, allowed = F.col("wanted"), F.col("allowed")
    if most > SPELLED_OUT:
        return able.withColumn("ranks", _ranks(F.col("workflow_id"), wanted, allowed, seed))

    def each(value: Callable[[int], Column]) -> Column:
        return F.slice(F.array(*[F.when(F.lit(i) < wanted, value(i)) for i in range(max(most, 1))]), F.lit(1), wanted.cast("int"))

    def pick(i: int) -> Column:
        return F.pmod(_bits(F.concat("_text", F.lit(str(i))), 15), allowed - wanted + (i + 1))

    def step(taken: Column, rank: Column) -> Column:
        return F.concat(taken, F.array(F.when(F.array_contains(taken, rank), allowed - wanted + F.size(taken)).otherwise(rank)))

    def placed(i: int) -> Column:
        rank = F.get("_taken", F.lit(i))
        return F.struct(F.md5(F.concat("_text", F.lit("r"), rank.cast("string"))).alias("h"), rank.alias("r"))

    differ = F.size(F.array_distinct("_picks")) == F.size("_picks")  # then no step finds its rank taken
    taken = F.aggregate("_picks", F.array().cast("array<bigint>"), step)
    # a column each, as what stands in an expression more than once is computed more than once
    return (
        able.withColumn("_text", F.concat(F.lit(f"{seed}|"), F.col("workflow_id").cast("string"), F.lit("|")))
        .withColumn("_picks", each(pick))
        .withColumn("_taken", F.when(differ, F.col("_picks")).otherwise(taken))
        .withColumn("_placed", F.sort_array(each(placed)))
        .withColumn("ranks", F.col("_placed")["r"])
        .drop("_text", "_picks", "_taken", "_placed")
    )


def _profiles(blocks: DataFrame, tools: DataFrame, fits: Column, hot_rows: int | None) -> DataFrame:
    """Per workflow: n_blocks, blocked (positions left out) and the sorted distinct blocks.

    blocks(workflow_id, start, size) may repeat. Ordinary workflows take one shuffle. Those
    with very many calls are counted before their blocks are gathered, and gathered only if
    they fit, so no list outgrows what `fits` allows.
    """
    block = F.struct("start", "size")
    counted = [F.count(F.lit(1)).alias("n_blocks"), F.sum("size").alias("blocked")]
    hot = hot_keys(tools, ["workflow_id"], hot_rows)
    ordinary = (
        (blocks if hot is None else lookup(blocks, hot, ["workflow_id"], "left_anti"))
        .repartition("workflow_id")  # else every task would sort its blocks to gather the few of a workflow
        .groupBy("workflow_id")
        .agg(F.sort_array(F.collect_set(block)).alias("blocks"))
        .select(
            "workflow_id", F.size("blocks").cast("bigint").alias("n_blocks"),
            F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + b["size"]).alias("blocked"), "blocks",
        )
    )
    if hot is None:
        return ordinary
    heavy = lookup(blocks, hot, ["workflow_id"], "left_semi").distinct()
    sizes = heavy.groupBy("workflow_id").agg(*counted)
    lists = (
        heavy.join(sizes.filter(fits), "workflow_id", "left_semi")
        .groupBy("workflow_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    )
    return ordinary.unionByName(sizes.join(lists, "workflow_id", "left"))


def _judge(profiles: DataFrame, wanted: Column, n_catalog: int) -> DataFrame:
    """Add `wanted`, `allowed` and the `reason` why a workflow gets no tools (null if it does)."""
    allowed = F.lit(n_catalog).cast("bigint") - F.coalesce("blocked", F.lit(0))
    return profiles.withColumn("wanted", wanted.cast("bigint")).withColumn("allowed", allowed).withColumn(
        "reason",
        F.when(F.col("wanted") < 0, F.lit("more positive tools than requested")).when(
            F.col("wanted") > F.col("allowed"), F.lit("not enough candidates")
        ),
    )


def _draw(judged: DataFrame, positions: DataFrame, seed: int, most: int) -> DataFrame:
    """workflow_id, draw (from 0), api, family for every workflow without a reason; each wants at most `most`."""
    able = judged.filter(F.col("reason").isNull() & (F.col("wanted") > 0))
    # blocks are sorted, so stepping over them in order lands on the rank-th allowed position
    step = lambda at, b: F.when(b["start"] <= at, at + b["size"]).otherwise(at)
    places = F.transform("ranks", lambda r: F.aggregate(F.col("blocks"), r, step))
    drawn = _ranked(able, most, seed).select("workflow_id", F.posexplode(places).alias("draw", "position"))
    return drawn.join(positions.select("position", "api", "family"), "position").select(
        "workflow_id", "draw", "api", "family"
    )


def _with_idle(profiles: DataFrame, workflows: DataFrame | None) -> DataFrame:
    """Workflows that call nothing have nothing to leave out."""
    if workflows is None:
        return profiles
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    return workflows.select("workflow_id").join(profiles, "workflow_id", "left").withColumns(
        {
            "n_blocks": F.coalesce("n_blocks", F.lit(0)),
            "blocks": F.when(F.col("n_blocks").isNull(), none).otherwise(F.col("blocks")),
        }
    )


class Draws(NamedTuple):
    """What was drawn, who could not draw and why, and everyone else."""

    tools: DataFrame
    rejects: DataFrame
    accepted: DataFrame


def _finish(judged: DataFrame, positions: DataFrame, seed: int, most: int) -> Draws:
    """The judged workflows are written once; all three results read that small table."""
    judged = materialize(judged, "judged")
    refused = F.col("reason").isNotNull()
    return Draws(
        _draw(judged, positions, seed, most),
        judged.filter(refused).select("workflow_id", "wanted", "allowed", "reason"),
        judged.filter(~refused).select("workflow_id"),
    )


def catalog_positions(catalog: DataFrame) -> DataFrame:
    """The laid-out catalog, written once, as every draw reads it more than once."""
    return materialize(lay_out(catalog), "positions")


def _measured(positions: DataFrame) -> tuple[DataFrame, int]:
    """The laid-out catalog as a side of joins, and its number of rows."""
    texts = F.coalesce(F.octet_length(F.col("api").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("family").cast("string")), F.lit(0))
    seen = positions.agg(F.count(F.lit(1)).alias("n"), F.sum(texts + ROW_BYTES).alias("size")).head()
    return looked_up(positions, seen["size"] or 0), seen["n"]


def negative_tools(tools: DataFrame, catalog: DataFrame, num_tools: int, seed: int,
                   positions: DataFrame | None = None, workflows: DataFrame | None = None,
                   hot_rows: int | None = None) -> Draws:
    """Fill every workflow's pool up to `num_tools` with tools it does not use.

    tools(workflow_id, api): one row per call, all in the catalog. `num_tools` = -1 means no pool and so no negatives. Pass `workflows` to include those
    without calls.
    """
    positions, n_catalog = _measured(catalog_positions(catalog) if positions is None else positions)
    blocks = tools.join(positions.select("api", F.col("position").alias("start")), "api").select(
        "workflow_id", "start", F.lit(1).cast("bigint").alias("size")
    )
    fits = F.col("n_blocks") <= max(num_tools, 0)
    profiles = _with_idle(_profiles(blocks, tools, fits, hot_rows), workflows)
    wanted = F.lit(0) if num_tools == -1 else F.lit(num_tools) - F.col("n_blocks")
    return _finish(_judge(profiles, wanted, n_catalog), positions, seed, max(num_tools, 0))


def strict_negatives(tools: DataFrame, catalog: DataFrame, num_tools: int, seed: int,
                     positions: DataFrame | None = None, workflows: DataFrame | None = None,
                     hot_rows: int | None = None) -> Draws:
    """Draw `num_tools` tools from families of which the workflow uses no tool.

    As negative_tools, but a block is a whole family, so a workflow has at most as many
    blocks as the catalog has families.
    """
    positions, n_catalog = _measured(catalog_positions(catalog) if positions is None else positions)
    blocks = tools.join(positions.select("api", "family_start", "family_size"), "api").select(
        "workflow_id", F.col("family_start").alias("start"), F.col("family_size").alias("size")
    )
    wanted = max(num_tools, 0)
    fits = F.col("blocked") <= n_catalog - wanted
    judged = _judge(_with_idle(_profiles(blocks, tools, fits, hot_rows), workflows), F.lit(wanted), n_catalog)
    return _finish(judged, positions, seed, wanted)
