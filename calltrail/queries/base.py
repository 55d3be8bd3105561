"""Registry of queries and the roles the given tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def step_order() -> list[Column]:
    """The order of steps of a workflow as BIGINTs."""
    return [F.col(c) for c in ("chain_pos", "step_pos", "part_key")]


def event_order() -> list[Column]:
    """The order of events as BIGINTs: microseconds, then the id."""
    return [F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as workflow steps: shipped lines are chain 1, open ones chain 2."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("workflow_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).cast("bigint").alias("chain_pos"),
        F.col("l_linenumber").cast("bigint").alias("step_pos"),
        F.col("l_partkey").alias("part_key"),
        F.concat(F.lit("api_"), F.col("l_partkey").cast("string")).alias("tool"),
        F.concat(
            F.lit('{"quantity": '), F.col("l_quantity").cast("int").cast("string"),
            F.lit(', "flag": "'), F.col("l_returnflag"), F.lit('"}'),
        ).alias("tool_input"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools, brands as tool families."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("api_"), F.col("p_partkey").cast("string")).alias("api"), F.col("p_brand").alias("family")
    )


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflows with a query text."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("workflow_id"),
        F.concat(
            F.lit("Handle order "), F.col("o_orderkey").cast("string"), F.lit(" of priority "), F.col("o_orderpriority")
        ).alias("query"),
    )


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a selection log: a signup opens a chain, other events name one."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").cast("string").alias("run"),
        F.when(F.col("event_type") == "signup", "-1")
        .otherwise(F.concat(F.lit("api_use_chain_"), (k % 10 + 1).cast("string"))).alias("which_chain"),
        "ts", "event_id", "event_type", "value", k.alias("k"),
    )


# The same roles for the SQL side.
STEPS_SQL = """
steps AS (
  SELECT l_orderkey AS workflow_id,
         CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS chain_pos,
         CAST(l_linenumber AS BIGINT) AS step_pos, l_partkey AS part_key,
         'api_' || CAST(l_partkey AS VARCHAR) AS tool,
         '{"quantity": ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ', "flag": "' || l_returnflag || '"}' AS tool_input,
         'api_' || CAST(l_partkey AS VARCHAR) || '(quantity=' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
           || ', flag=''' || l_returnflag || ''')' AS call_text
  FROM lineitem)"""
CATALOG_SQL = """
cat AS (
  SELECT api, family,
         row_number() OVER (ORDER BY md5(family), family, md5(api), api) - 1 AS position,
         count(*) OVER (PARTITION BY family) AS family_size
  FROM (SELECT 'api_' || CAST(p_partkey AS VARCHAR) AS api, p_brand AS family FROM part)),
families AS (SELECT family, min(position) AS family_start, count(*) AS family_size FROM cat GROUP BY family)"""


def draws_sql(seed: int) -> str:
    """CTEs `sized` and `drawn` after CTEs `wanted`(workflow_id, wanted) and `blocks`."""
    return f"""
sized AS (
  SELECT workflow_id, wanted, (SELECT count(*) FROM cat) - coalesce(sum(size), 0) AS allowed
  FROM wanted LEFT JOIN blocks USING (workflow_id) GROUP BY workflow_id, wanted),
able AS (SELECT * FROM sized WHERE wanted > 0 AND wanted <= allowed),
floyd AS (
  SELECT workflow_id, wanted, allowed, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS picks FROM able
  UNION ALL
  SELECT workflow_id, wanted, allowed, i + 1, list_append(picks, CASE WHEN list_contains(picks, r) THEN CAST(allowed - wanted + i AS BIGINT) ELSE r END)
  FROM (SELECT *, CAST('0x' || substr(md5('{seed}|' || CAST(workflow_id AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT)
                  % CAST(allowed - wanted + i + 1 AS BIGINT) AS r
        FROM floyd WHERE i < wanted)),
ranked AS (
  SELECT workflow_id, r, row_number() OVER (PARTITION BY workflow_id ORDER BY
           md5('{seed}|' || CAST(workflow_id AS VARCHAR) || '|r' || CAST(r AS VARCHAR)), r) - 1 AS draw
  FROM (SELECT workflow_id, unnest(picks) AS r FROM floyd WHERE i = wanted)),
shifts AS (
  SELECT workflow_id, size,
         start - coalesce(sum(size) OVER (PARTITION BY workflow_id ORDER BY start
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_rank
  FROM blocks),
drawn AS (
  SELECT ranked.workflow_id, CAST(draw AS INTEGER) AS draw, api, family
  FROM (SELECT ranked.workflow_id, draw, r + coalesce(sum(size), 0) AS position
        FROM ranked LEFT JOIN shifts ON shifts.workflow_id = ranked.workflow_id AND at_rank <= r
        GROUP BY ranked.workflow_id, draw, r) ranked
  JOIN cat USING (position))"""


NEGATIVE_SQL = f"""
used AS (SELECT DISTINCT workflow_id, tool AS api FROM steps),
wanted AS (SELECT workflow_id, 10 - count(*) AS wanted FROM used GROUP BY workflow_id),
blocks AS (
  SELECT workflow_id, position AS start, 1 AS size
  FROM used JOIN cat USING (api)),
{draws_sql(42)}"""
STRICT_SQL = f"""
wanted AS (SELECT DISTINCT workflow_id, CAST(10 AS BIGINT) AS wanted FROM steps),
blocks AS (
  SELECT DISTINCT workflow_id, family_start AS start, families.family_size AS size
  FROM steps JOIN cat ON cat.api = steps.tool JOIN families USING (family)),
{draws_sql(42)}"""


def cut_sql(key: str, seed: int, ratio: float, source: str, partition: str = "") -> str:
    """A Boolean SQL expression's subquery: keys of `source` inside the cut."""
    over = f"PARTITION BY {partition} " if partition else ""
    by = f"OVER (PARTITION BY {partition})" if partition else "OVER ()"
    return f"""(SELECT {key} FROM (
      SELECT {key}, row_number() OVER ({over}ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) AS rn,
             floor(count(*) {by} * CAST({ratio} AS DOUBLE)) AS n FROM {source}) WHERE rn <= n)"""
