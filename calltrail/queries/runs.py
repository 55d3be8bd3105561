"""Chains, iterations, cost and durations over the event log; trees over customers."""

from pyspark.sql import functions as F

from calltrail.operators.ordering import rolling_mean
from calltrail.plans import traces as tr
from calltrail.plans import workflows as wf
from calltrail.queries.base import event_order, query, selections, table
from calltrail.session import scratch_dir
from calltrail.streaming.chains import stream_chains

ORDER = ["ts", "event_id"]

SELECTIONS_SQL = """
sel AS (
  SELECT CAST(user_id AS VARCHAR) AS run, ts, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
seq AS (
  SELECT *, row_number() OVER w = 1 OR event_type = 'signup' AS opens FROM sel
  WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
cnt AS (
  SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY run ORDER BY ts, event_id) AS opened FROM seq),
num AS (
  SELECT *, CASE WHEN opens THEN CASE WHEN opened <= 10 THEN opened END
                 WHEN k % 10 + 1 <= least(opened, 10) THEN k % 10 + 1 END AS chain_number FROM cnt),
placed AS (
  SELECT run, event_id, event_type, value, k, CAST(chain_number AS BIGINT) AS chain_number,
         'api_use_chain_' || CAST(CAST(chain_number AS BIGINT) AS VARCHAR) AS chain_id,
         CASE WHEN chain_number IS NOT NULL
              THEN row_number() OVER (PARTITION BY run, chain_number ORDER BY ts, event_id) END AS step_pos,
         CASE WHEN chain_number IS NOT NULL THEN 'committed' WHEN opens THEN 'saturated' ELSE 'unknown_chain' END AS outcome
  FROM num)"""


def _placed(spark, sf_dir):
    return wf.place_selections(
        selections(spark, sf_dir), [F.col(c) for c in ORDER], event_order()
    )


def _chains(spark, sf_dir):
    """Committed steps; they are read once, so the replay is not written."""
    return _placed(spark, sf_dir).filter(F.col("outcome") == "committed")


@query("rebuilt_chains", f"WITH {SELECTIONS_SQL} SELECT run, event_id, outcome, chain_id, step_pos FROM placed")
def rebuilt_chains(spark, sf_dir):
    return _placed(spark, sf_dir).select("run", "event_id", "outcome", "chain_id", "step_pos")


@query("chain_headers", f"""WITH {SELECTIONS_SQL}
SELECT run, chain_id, count(*) AS n_steps FROM placed WHERE outcome = 'committed' GROUP BY run, chain_id""")
def chain_headers(spark, sf_dir):
    return wf.chain_sizes(_chains(spark, sf_dir))


@query("chain_io", f"""WITH {SELECTIONS_SQL}
SELECT run, chain_id, min_by(k, step_pos) AS input, max_by(value, step_pos) AS output
FROM placed WHERE outcome = 'committed' GROUP BY run, chain_id""")
def chain_io(spark, sf_dir):
    return wf.chain_io(_chains(spark, sf_dir), "k", "value")


@query("chain_edges", f"""WITH {SELECTIONS_SQL}
SELECT run, chain_id, source_pos, source, destination FROM (
  SELECT run, chain_id, step_pos - 1 AS source_pos, event_id AS destination,
         lag(event_id) OVER (PARTITION BY run, chain_id ORDER BY step_pos) AS source
  FROM placed WHERE outcome = 'committed') WHERE source IS NOT NULL""")
def chain_edges(spark, sf_dir):
    return wf.chain_edges(_chains(spark, sf_dir), "event_id")


def _iterations(spark, sf_dir):
    """One day of a user is an iteration; each event is a proposal and its execution."""
    e = selections(spark, sf_dir)
    return e.select(
        "run", F.unix_date(F.to_date("ts")).alias("iteration"), F.col("event_id").alias("proposal_id"), "event_type", "value", "k",
        (F.col("event_type") != "error").alias("success"), (F.col("k") % 4).alias("num_tool_calls"),
    )


def _proposals(spark, sf_dir):
    """Proposals of one to four apis; those of four break the limit."""
    n = F.when(F.col("k") % 25 == 0, 4).otherwise(F.col("k") % 3 + 1).cast("int")
    rows = _iterations(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    return rows.select(
        "run", "iteration", "proposal_id", F.concat(F.lit("api_"), (F.col("k") + F.col("i")).cast("string")).alias("api")
    )


ITERATION_SQL = """
it AS (
  SELECT CAST(user_id AS VARCHAR) AS run, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS iteration, event_id AS proposal_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
summary AS (
  SELECT run, iteration, count(*) AS n_proposals, count(*) FILTER (k % 25 = 0) AS n_too_many,
         count(*) FILTER (event_type <> 'error') AS n_success, count(*) FILTER (event_type = 'error') AS n_failed,
         CAST(sum(k % 4) AS BIGINT) AS n_tool_calls,
         CASE WHEN count(*) FILTER (k % 25 = 0) > 0 THEN 'skipped_proposer'
              WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'skipped_executor'
              WHEN NOT bool_or(event_type IN ('signup', 'purchase')) THEN 'skipped_selector'
              WHEN max(value) > 60 THEN 'skipped_updater' ELSE 'committed' END AS outcome
  FROM it GROUP BY run, iteration)"""


def _summary(spark, sf_dir):
    events = _iterations(spark, sf_dir)
    checks = tr.proposal_checks(_proposals(spark, sf_dir))
    counts = tr.execution_counts(events)
    chosen = events.groupBy(*tr.ITERATION).agg(
        F.bool_or(F.col("event_type").isin("signup", "purchase")).alias("has_selection"),
        (F.max("value") <= 60).alias("has_update"),
    )
    joined = checks.join(counts, tr.ITERATION).join(chosen, tr.ITERATION).withColumnRenamed("accepted", "has_proposals")
    return tr.iteration_outcomes(joined, max_iter=31)


@query("iteration_summary", f"""WITH {ITERATION_SQL}
SELECT run, iteration, n_proposals, n_too_many, n_success, n_failed, n_tool_calls, outcome FROM summary""")
def iteration_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select(
        "run", "iteration", "n_proposals", "n_too_many", "n_success", "n_failed", "n_tool_calls", "outcome"
    )


@query("run_totals", f"""WITH {ITERATION_SQL}
SELECT run, count(*) AS total_iterations, count(*) FILTER (outcome = 'committed') AS n_committed,
       CAST(sum(n_tool_calls) AS BIGINT) AS total_tool_calls FROM summary GROUP BY run""")
def run_totals(spark, sf_dir):
    return tr.run_totals(_summary(spark, sf_dir))


def _selected(spark, sf_dir):
    """Per iteration the last event is the selection; every third one names no report."""
    events = _iterations(spark, sf_dir)
    last = events.groupBy(*tr.ITERATION).agg(F.max("proposal_id").alias("id"), F.max_by("k", "proposal_id").alias("k"))
    return last.select(
        *tr.ITERATION, F.when(F.col("k") % 3 != 0, F.col("id")).alias("selected_id"),
        F.when(F.col("k") % 4 == 0, "-1").otherwise(F.concat(F.lit("api_use_chain_"), (F.col("k") % 5).cast("string"))).alias("which_chain"),
    )


PICK_SQL = """
pick AS (
  SELECT run, iteration, CASE WHEN k % 3 <> 0 THEN id END AS selected_id,
         CASE WHEN k % 4 = 0 THEN '-1' ELSE 'api_use_chain_' || CAST(k % 5 AS VARCHAR) END AS which_chain
  FROM (SELECT run, iteration, max(proposal_id) AS id, max_by(k, proposal_id) AS k FROM it GROUP BY run, iteration))"""


@query("selected_tools", f"""WITH {ITERATION_SQL}, {PICK_SQL}
SELECT pick.run, pick.iteration, selected_id,
       CASE WHEN which_chain = '-1' THEN 'create_new_chain' ELSE 'update_chain_' || which_chain END AS action,
       which_chain, 'tool_' || CAST(k AS VARCHAR) AS tool_used
FROM pick LEFT JOIN it ON it.run = pick.run AND it.iteration = pick.iteration AND proposal_id = selected_id""")
def selected_tools(spark, sf_dir):
    executions = _iterations(spark, sf_dir).withColumn("tool", F.concat(F.lit("tool_"), F.col("k").cast("string")))
    return tr.selected_tools(_selected(spark, sf_dir), executions)


@query("selection_checks", f"""WITH {ITERATION_SQL}, {PICK_SQL},
known AS (SELECT DISTINCT run, iteration, 'api_use_chain_' || CAST(k % 3 AS VARCHAR) AS which_chain FROM it),
reports AS (SELECT run, iteration, proposal_id AS selected_id FROM it WHERE event_type <> 'error')
SELECT pick.run, pick.iteration, selected_id, pick.which_chain, selected_id IS NULL AS skipped,
       selected_id IS NULL OR reports.run IS NOT NULL AS report_known, pick.which_chain = '-1' OR known.run IS NOT NULL AS chain_known
FROM pick LEFT JOIN known USING (run, iteration, which_chain) LEFT JOIN reports USING (run, iteration, selected_id)""")
def selection_checks(spark, sf_dir):
    events = _iterations(spark, sf_dir)
    chains = events.select(
        *tr.ITERATION, F.concat(F.lit("api_use_chain_"), (F.col("k") % 3).cast("string")).alias("chain_id")
    )
    return tr.selection_checks(_selected(spark, sf_dir), tr.successful(events), chains)


@query("execution_summaries", f"""WITH {ITERATION_SQL}
SELECT run, iteration, proposal_id, event_type <> 'error' AS success, k % 4 AS num_tool_calls,
       CASE WHEN event_type <> 'error' THEN 'tool_' || CAST(k AS VARCHAR) END AS tool,
       CASE WHEN event_type <> 'error' THEN CASE WHEN k * 5 > 200 THEN repeat('r', 200) || '...' ELSE repeat('r', CAST(k * 5 AS BIGINT)) END END AS result_preview,
       CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'code ' || CAST(k AS VARCHAR) END AS error_message
FROM it""")
def execution_summaries(spark, sf_dir):
    events = _iterations(spark, sf_dir).select(
        "*", F.concat(F.lit("tool_"), F.col("k").cast("string")).alias("tool"), F.lit("{}").alias("tool_input"),
        F.repeat(F.lit("r"), (F.col("k") * 5).cast("int")).alias("result"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("code "), F.col("k").cast("string"))).otherwise("").alias("error"),
    )
    out = tr.execution_summary(events, "result", "error")
    return out.select(
        "run", "iteration", "proposal_id", "success", "num_tool_calls", "api_call_step.tool",
        "api_call_step.result_preview", "error_message",
    )


API_SQL = """
proposed AS (
  SELECT run, iteration, proposal_id, event_type, k, i, 'api_' || CAST(k + i AS VARCHAR) AS api
  FROM (SELECT *, unnest(range(1, CAST(CASE WHEN k % 25 = 0 THEN 4 ELSE k % 3 + 1 END AS BIGINT) + 1)) AS i FROM it)),
pool AS (SELECT DISTINCT run, iteration, api FROM proposed WHERE event_type <> 'view')"""


@query("proposal_summaries", f"""WITH {ITERATION_SQL}, {API_SQL}
SELECT run, iteration, proposal_id, 'Use ' || any_value(event_type) AS instruction,
       string_agg(api || '=' || CASE WHEN (k + i) % 4 <> 0 THEN 'About ' || event_type ELSE 'N/A' END, ',' ORDER BY i) AS apis
FROM proposed GROUP BY run, iteration, proposal_id""")
def proposal_summaries(spark, sf_dir):
    kinds = _iterations(spark, sf_dir).select("proposal_id", "event_type")
    number = F.substring("api", 5, 20).cast("bigint")
    rows = _proposals(spark, sf_dir).join(kinds, "proposal_id").select(
        "run", "iteration", "proposal_id", F.concat(F.lit("Use "), "event_type").alias("instruction"),
        number.alias("position"), F.col("api").alias("name"),
        F.when(number % 4 != 0, F.concat(F.lit("About "), "event_type")).alias("description"),
    )
    shown = F.transform("apis", lambda a: F.concat(a["name"], F.lit("="), a["description"]))
    return tr.proposal_summary(rows).withColumn("apis", F.array_join(shown, ","))


@query("pool_checks", f"""WITH {ITERATION_SQL}, {API_SQL},
checked AS (
  SELECT run, iteration, proposal_id, count(*) AS n_apis, count(*) FILTER (pool.api IS NULL) AS n_foreign
  FROM proposed p LEFT JOIN pool USING (run, iteration, api) GROUP BY run, iteration, proposal_id)
SELECT run, iteration, count(*) AS n_proposals, count(*) FILTER (n_apis > 3) AS n_too_many, CAST(sum(n_foreign) AS BIGINT) AS n_foreign,
       count(*) FILTER (n_apis > 3) = 0 AND sum(n_foreign) = 0 AS accepted
FROM checked GROUP BY run, iteration""")
def pool_checks(spark, sf_dir):
    """The pool of an iteration are the apis of its events that are no views; views propose foreign ones."""
    proposals = _proposals(spark, sf_dir)
    kinds = _iterations(spark, sf_dir).filter(F.col("event_type") != "view").select("proposal_id")
    pool = proposals.join(kinds, "proposal_id", "left_semi").select(*tr.ITERATION, "api")
    positions = proposals.select("api").distinct().select("api", F.substring("api", 5, 20).cast("bigint").alias("position"))
    return tr.proposal_checks(proposals, pool, positions=positions)


@query("token_cost", f"""WITH {ITERATION_SQL},
prices AS (SELECT * FROM (VALUES ('gemini-2.5-flash-lite', 0.10, 0.40), ('gemini-2.5-flash', 0.30, 2.50)) t(model, p, c)),
usage AS (
  SELECT run, CASE event_type WHEN 'click' THEN 'gemini-2.5-flash-lite' WHEN 'view' THEN 'gemini-2.5-flash' ELSE event_type END AS model,
         CASE WHEN event_type <> 'error' THEN k * 10 END AS prompt_tokens,
         CASE WHEN event_type <> 'error' THEN k END AS completion_tokens,
         CASE WHEN event_type <> 'error' THEN k // 2 END AS cached_tokens FROM it)
SELECT run, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
       CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached_tokens,
       CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens,
       count(prompt_tokens) AS successful_requests,
       round(coalesce(sum((prompt_tokens * coalesce(p, 1.0) + completion_tokens * coalesce(c, 4.0)) / 1000000), 0), 8) AS total_cost_usd
FROM usage LEFT JOIN prices USING (model) GROUP BY run""")
def token_cost(spark, sf_dir):
    used = F.col("event_type") != "error"
    usage = _iterations(spark, sf_dir).select(
        "run",
        F.when(F.col("event_type") == "click", "gemini-2.5-flash-lite")
        .when(F.col("event_type") == "view", "gemini-2.5-flash").otherwise(F.col("event_type")).alias("model"),
        F.when(used, F.col("k") * 10).alias("prompt_tokens"),
        F.when(used, F.col("k")).alias("completion_tokens"),
        F.when(used, F.floor(F.col("k") / 2)).alias("cached_tokens"),
    )
    return tr.token_cost(usage, keys=["run"]).withColumn("total_cost_usd", F.round("total_cost_usd", 8))


@query("rolling_duration", """
SELECT event_id, event_type, round(avg(value) OVER w, 8) AS rolling_avg, count(*) OVER w AS rolling_runs FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_duration(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    out = rolling_mean(e, ["event_type"], [F.col("ts"), F.col("event_id")], event_order(), "value")
    return out.select("event_id", "event_type", F.round("rolling_avg", 8).alias("rolling_avg"), "rolling_runs")


@query("rightmost_path", """
WITH RECURSIVE nodes AS (
  SELECT c_custkey AS tree, 'c' || CAST(c_custkey AS VARCHAR) AS node, NULL AS parent, 0 AS ord FROM customer
  UNION ALL SELECT o_custkey, 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR), o_orderkey FROM orders
  UNION ALL SELECT o_custkey, 'l' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(line AS VARCHAR), 'o' || CAST(l_orderkey AS VARCHAR), line
  FROM (SELECT DISTINCT l_orderkey, l_linenumber * 1000000 + l_partkey AS line FROM lineitem) JOIN orders ON o_orderkey = l_orderkey),
path AS (
  SELECT tree, node, 0 AS depth FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT path.tree, n.node, depth + 1
  FROM path JOIN (SELECT tree, parent, max_by(node, ord) AS node FROM nodes WHERE parent IS NOT NULL GROUP BY tree, parent) n
    ON n.tree = path.tree AND n.parent = path.node)
SELECT tree, depth, node FROM path""")
def rightmost_path(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("tree"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_partkey")).alias("ord"),
    ).distinct()
    label = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    nodes = (
        customers.select("tree", label("c", F.col("tree")).alias("node"), F.lit(None).cast("string").alias("parent"),
                         F.lit(0).cast("bigint").alias("ord"))
        .unionByName(orders.select("tree", label("o", F.col("o_orderkey")).alias("node"),
                                   label("c", F.col("tree")).alias("parent"), F.col("o_orderkey").alias("ord")))
        .unionByName(lines.join(orders, "o_orderkey").select(
            "tree", F.concat(label("l", F.col("o_orderkey")), F.lit("."), F.col("ord").cast("string")).alias("node"),
            label("o", F.col("o_orderkey")).alias("parent"), "ord",
        ))
    )
    return wf.rightmost_chain(nodes)


@query("stream_chains", f"WITH {SELECTIONS_SQL} SELECT run, event_id, outcome, chain_id, step_pos FROM placed")
def stream_chains_query(spark, sf_dir):
    """The log arrives in three deliveries of equal time spans; each is one micro-batch."""
    folder = scratch_dir(spark, "stream")
    log = selections(spark, sf_dir)
    day = F.unix_date(F.to_date("ts"))
    first, last = log.agg(F.min(day), F.max(day)).head()
    log = log.withColumn("delivery", F.floor((day - (first or 0)) * 3 / ((last or 0) - (first or 0) + 1)))
    for delivery in range(3):
        new = log.filter(F.col("delivery") == delivery)
        new.write.mode("append").parquet(f"{folder}/in")
        incoming = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
        stream_chains(incoming, folder, ORDER).awaitTermination()
    return spark.read.parquet(f"{folder}/placed").select("run", "event_id", "outcome", "chain_id", "step_pos")
