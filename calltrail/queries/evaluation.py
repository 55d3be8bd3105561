"""Tool lists, prediction scores and model comparison."""

from pyspark.sql import functions as F

from calltrail.plans import evaluation as ev
from calltrail.plans import workflows as wf
from calltrail.queries.base import STEPS_SQL, query, step_order, steps, table, workflows
from calltrail.session import scratch_dir
from calltrail.sources import bucketed, versions, writers
from calltrail.streaming import chains as st


@query("tool_lists", f"""WITH {STEPS_SQL}
SELECT workflow_id, CAST((rn - 1) // 10000 AS BIGINT) AS part, n AS n_total,
       string_agg(tool, ',' ORDER BY rn) AS tools
FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY chain_pos, step_pos, part_key) AS rn,
             count(*) OVER (PARTITION BY workflow_id) AS n FROM steps)
GROUP BY workflow_id, (rn - 1) // 10000, n""")
def tool_lists(spark, sf_dir):
    lists = wf.tool_lists(steps(spark, sf_dir), ["chain_pos", "step_pos", "part_key"], step_order())
    return lists.withColumn("tools", F.array_join("tools", ","))


@query("tool_counts", f"""WITH {STEPS_SQL}
SELECT workflow_id, count(*) AS n_calls, count(DISTINCT tool) AS n_tools FROM steps GROUP BY workflow_id""")
def tool_counts(spark, sf_dir):
    return wf.tool_counts(steps(spark, sf_dir))


SCORES_SQL = """
lines AS (
  SELECT l_orderkey AS sample_id, 'model_' || l_returnflag AS model, 'tool_' || CAST(l_suppkey % 10 AS VARCHAR) AS tool,
         l_linestatus, CASE WHEN l_discount < 0.05 THEN '' ELSE 'call failed' END AS error, l_tax, l_quantity, l_discount
  FROM lineitem),
predictions AS (
  SELECT model, sample_id, max(l_tax) >= 0.08 AS failed, min(l_quantity) <= 3 AS is_stored,
         max(l_discount) AS s_precision, max(l_tax) AS s_recall, min(l_quantity) / 100 AS s_success,
         count(*) + 1 AS num_requests,
         least(100.0, greatest(0.0, sum(CAST(l_quantity * 3 AS INTEGER)) / (count(*) + 1))) AS qor
  FROM lines GROUP BY model, sample_id),
called AS (
  SELECT model, sample_id, tool, max(CASE WHEN error = '' THEN 1 ELSE 0 END) AS ok
  FROM lines WHERE l_linestatus = 'O' GROUP BY model, sample_id, tool),
truth AS (SELECT DISTINCT sample_id, tool FROM lines WHERE l_linestatus = 'F'),
n_truth AS (SELECT sample_id, count(*) AS n_true FROM truth GROUP BY sample_id),
met AS (
  SELECT model, sample_id, count(*) AS n_pred, count(truth.tool) AS n_hit,
         coalesce(sum(CASE WHEN truth.tool IS NOT NULL THEN ok END), 0) AS n_ok
  FROM called LEFT JOIN truth USING (sample_id, tool) GROUP BY model, sample_id),
fresh AS (
  SELECT p.*, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(n_hit, 0) AS n_hit,
         CASE WHEN coalesce(n_pred, 0) > 0 THEN n_hit / n_pred ELSE 0.0 END AS precision,
         CASE WHEN coalesce(n_true, 0) > 0 THEN coalesce(n_hit, 0) / n_true ELSE 0.0 END AS recall,
         CASE WHEN coalesce(n_true, 0) > 0 THEN coalesce(n_ok, 0) / n_true ELSE 0.0 END AS success_rate
  FROM predictions p LEFT JOIN met USING (model, sample_id) LEFT JOIN n_truth USING (sample_id)),
scores AS (
  SELECT model, sample_id, failed,
         CASE WHEN is_stored THEN s_precision WHEN failed THEN 0.0 ELSE precision END AS precision,
         CASE WHEN is_stored THEN s_recall WHEN failed THEN 0.0 ELSE recall END AS recall,
         CASE WHEN is_stored THEN s_success WHEN failed THEN NULL ELSE success_rate END AS success_rate,
         CASE WHEN failed THEN 0.0 ELSE qor END AS qor
  FROM fresh),
long AS (
  SELECT model, sample_id, 'precision' AS metric, precision AS value FROM scores
  UNION ALL SELECT model, sample_id, 'recall', recall FROM scores
  UNION ALL SELECT model, sample_id, 'success_rate', success_rate FROM scores WHERE success_rate IS NOT NULL
  UNION ALL SELECT model, sample_id, 'qor', qor FROM scores)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        F.concat(F.lit("model_"), F.col("l_returnflag")).alias("model"),
        F.concat(F.lit("tool_"), (F.col("l_suppkey") % 10).cast("string")).alias("tool"),
        "l_linestatus",
        F.when(F.col("l_discount") < 0.05, "").otherwise("call failed").alias("error"),
        "l_tax", "l_quantity", "l_discount",
    )


def _inputs(spark, sf_dir):
    """Predictions and judge scores, calls, and true tools."""
    lines = _lines(spark, sf_dir)
    predictions = lines.groupBy("model", "sample_id").agg(
        (F.max("l_tax") >= 0.08).alias("failed"),
        F.when(
            F.min("l_quantity") <= 3,
            F.struct(
                F.max("l_discount").alias("precision"), F.max("l_tax").alias("recall"),
                (F.min("l_quantity") / 100).alias("success_rate"), F.lit(None).cast("double").alias("qor"),
            ),
        ).alias("stored"),
        (F.count(F.lit(1)) + 1).alias("num_requests"),
        F.array(F.sum((F.col("l_quantity") * 3).cast("int"))).alias("response_scores"),
    )
    calls = lines.filter(F.col("l_linestatus") == "O").select("model", "sample_id", "tool", "error")
    truth = lines.filter(F.col("l_linestatus") == "F").select("sample_id", "tool")
    return predictions, calls, truth


def scores(spark, sf_dir, overwrite=False):
    predictions, calls, truth = _inputs(spark, sf_dir)
    return ev.evaluate(predictions, calls, truth, overwrite=overwrite)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("tool_precision_recall", f"""WITH {SCORES_SQL}
SELECT model, sample_id, n_pred, n_true, n_hit, round(precision, 6) AS precision, round(recall, 6) AS recall FROM fresh""")
def tool_precision_recall(spark, sf_dir):
    predictions, calls, truth = _inputs(spark, sf_dir)
    out = ev.tool_scores(predictions.select("model", "sample_id"), calls, truth)
    return _rounded(out.drop("n_ok", "success_rate"), "precision", "recall")


@query("recalled_tool_success", f"""WITH {SCORES_SQL}
SELECT model, sample_id, round(success_rate, 6) AS success_rate FROM fresh""")
def recalled_tool_success(spark, sf_dir):
    predictions, calls, truth = _inputs(spark, sf_dir)
    out = ev.tool_scores(predictions.select("model", "sample_id"), calls, truth)
    return _rounded(out.select("model", "sample_id", "success_rate"), "success_rate")


@query("metric_summary", f"""WITH {SCORES_SQL}
SELECT model, metric, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std, count(*) AS count,
       round(sum(value), 4) AS sum, round(max_by(value, sample_id), 6) AS last
FROM long GROUP BY model, metric""")
def metric_summary(spark, sf_dir):
    out = ev.summarize(scores(spark, sf_dir))
    return _rounded(out, "avg", "std", "last").withColumn("sum", F.round("sum", 4))


@query("weighted_summary", f"""WITH {SCORES_SQL},
weighted AS (
  SELECT l.model, l.metric, l.value,
         CASE WHEN s.failed OR (p.is_stored AND l.metric <> 'qor') THEN 1 ELSE 2 END AS w
  FROM long l JOIN scores s USING (model, sample_id) JOIN predictions p USING (model, sample_id))
SELECT model, metric, round(sum(w * value) / sum(w), 6) AS avg, CAST(sum(w) AS BIGINT) AS count FROM weighted
GROUP BY model, metric""")
def weighted_summary(spark, sf_dir):
    out = ev.summarize(scores(spark, sf_dir), reference_weights=True)
    return _rounded(out.select("model", "metric", "avg", "count"), "avg")


@query("leaderboard", f"""WITH {SCORES_SQL}
SELECT model, round(avg(recall), 6) AS recall, round(avg(success_rate), 6) AS success_rate, round(avg(qor), 6) AS qor
FROM scores GROUP BY model""")
def leaderboard(spark, sf_dir):
    return _rounded(ev.leaderboard(scores(spark, sf_dir)), "recall", "success_rate", "qor")


PAIRED_SQL = f"""WITH {SCORES_SQL},
diffs AS (
  SELECT a.metric, a.value - b.value AS d FROM long a JOIN long b USING (sample_id, metric)
  WHERE a.model = 'model_A' AND b.model = 'model_N' AND metric <> 'precision')
SELECT metric, count(*) AS n, round(avg(d), 6) AS mean_diff,
       round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t_stat FROM diffs GROUP BY metric"""


def _pair(spark, sf_dir, with_p):
    out = ev.compare_models(scores(spark, sf_dir), "model_A", "model_N", with_p)
    return out.withColumn("mean_diff", F.round("mean_diff", 6)).withColumn("t_stat", F.round("t_stat", 4))


@query("paired_t_test", PAIRED_SQL)
def paired_t_test(spark, sf_dir):
    return _pair(spark, sf_dir, with_p=False)


# Student's density by Simpson's rule over 4,000 steps from 0 to |t|.
P_VALUES_SQL = f"""WITH {SCORES_SQL},
diffs AS (
  SELECT a.metric, a.value - b.value AS d FROM long a JOIN long b USING (sample_id, metric)
  WHERE a.model = 'model_A' AND b.model = 'model_N' AND metric <> 'precision'),
told AS (
  SELECT metric, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t_stat,
         avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t
  FROM diffs GROUP BY metric),
density AS (
  SELECT metric, (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * abs(t) / 12000
         * exp(lgamma(n / 2) - lgamma((n - 1) / 2) - 0.5 * ln((n - 1) * pi()) - n / 2 * ln(1 + (t * i / 4000) ** 2 / (n - 1))) AS f
  FROM told CROSS JOIN (SELECT CAST(unnest(range(0, 4001)) AS DOUBLE) AS i)),
mass AS (SELECT metric, sum(f) AS inside FROM density GROUP BY metric)
SELECT metric, n, mean_diff, t_stat, round(greatest(0.0, 1 - 2 * inside), 6) AS p_value FROM told JOIN mass USING (metric)"""


@query("paired_p_values", P_VALUES_SQL)
def paired_p_values(spark, sf_dir):
    return _rounded(_pair(spark, sf_dir, with_p=True), "p_value")


@query("judge_scores", """
SELECT doc_id, round(least(100.0, greatest(0.0, (quality * 80 + toxic * 20 + n_chars % 150 - 10) / (2 + toxic))), 6) AS qor
FROM documents JOIN labels USING (doc_id)""")
def judge_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    parts = F.array(F.col("quality") * 80 + F.col("toxic") * 20, (F.col("n_chars") % 150 - 10).cast("int"))
    return both.select("doc_id", F.round(ev.judge_score(F.col("toxic") + 2, parts), 6).alias("qor"))


@query("resume_evaluation", f"""WITH {SCORES_SQL},
tests AS (SELECT o_orderkey AS sample_id FROM orders WHERE o_orderstatus = 'F')
SELECT model, sample_id, failed, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(success_rate, 6) AS success_rate, round(qor, 6) AS qor
FROM scores WHERE sample_id IN (SELECT sample_id FROM tests)""")
def resume_evaluation(spark, sf_dir):
    tests = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sample_id"))
    out = ev.only_tests(scores(spark, sf_dir), tests).select("model", "sample_id", "failed", *ev.METRICS)
    return _rounded(out, *ev.METRICS)


def bucketed_inputs(spark, sf_dir):
    """Predictions, true tools and raw workflows as tables in buckets of sample_id, named for this run."""
    predictions, _, truth = _inputs(spark, sf_dir)
    raw = workflows(spark, sf_dir).select(F.col("workflow_id").alias("sample_id"), "query", F.lit("done").alias("response"))
    folder = scratch_dir(spark, "inputs")
    run = folder.rsplit("-", 1)[1]
    named = {"predictions": predictions.select("model", "sample_id", "failed", "num_requests"), "truth": truth, "raw": raw}
    return [bucketed.write_bucketed(df, f"{name}_{run}", path=f"{folder}/{name}") for name, df in named.items()]


@query("prediction_inputs", f"""WITH {SCORES_SQL}
SELECT p.model, p.sample_id, p.failed, CAST(p.num_requests AS BIGINT) AS num_requests, string_agg(tool, ',' ORDER BY tool) AS true_tools,
       'Handle order ' || CAST(p.sample_id AS VARCHAR) || ' of priority ' || o_orderpriority AS query, 'done' AS response
FROM predictions p JOIN truth USING (sample_id) JOIN orders ON o_orderkey = p.sample_id
GROUP BY p.model, p.sample_id, p.failed, p.num_requests, o_orderpriority""")
def prediction_inputs(spark, sf_dir):
    """The three-way join of an evaluation, from bucketed tables and without a shuffle."""
    out = bucketed.join_prediction_inputs(*bucketed_inputs(spark, sf_dir))
    return out.withColumn("true_tools", F.array_join("true_tools", ",")).select(
        "model", "sample_id", "failed", "num_requests", "true_tools", "query", "response"
    )


@query("saved_scores", f"""WITH {SCORES_SQL}
SELECT s.model, s.sample_id, s.failed,
       CASE WHEN NOT s.failed THEN s.precision WHEN p.is_stored THEN s_precision END AS precision,
       CASE WHEN NOT s.failed THEN s.recall WHEN p.is_stored THEN s_recall END AS recall,
       CASE WHEN NOT s.failed THEN s.success_rate WHEN p.is_stored THEN s_success END AS success_rate,
       CASE WHEN NOT s.failed THEN s.qor END AS qor
FROM (SELECT model, sample_id, failed, round(precision, 6) AS precision, round(recall, 6) AS recall,
             round(success_rate, 6) AS success_rate, round(qor, 6) AS qor FROM scores) s JOIN predictions p USING (model, sample_id)""")
def saved_scores(spark, sf_dir):
    """Scores written back into the table of predictions, twice: the second run reads what the first wrote."""
    path = scratch_dir(spark, "predictions")
    predictions, calls, truth = _inputs(spark, sf_dir)
    versions.write_version(predictions, path)
    counts = ev.written_counts(calls, truth)
    for _ in range(2):
        current = versions.read_version(spark, path)
        writers.write_scores(current, ev.evaluate(current, counts=counts), path)
    out = versions.read_version(spark, path).select("model", "sample_id", "failed", "stored.*")
    return _rounded(out, *ev.METRICS)


@query("stream_scores", """
WITH rows AS (
  SELECT 'model_' || l_returnflag AS model, l_orderkey AS sample_id, l_shipdate AS modified, l_quantity AS answer, l_linenumber % 3 AS delivery
  FROM lineitem),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, sample_id ORDER BY modified DESC, delivery, answer DESC) AS pick FROM rows)
SELECT model, sample_id, strftime(modified, '%Y-%m-%d') AS modified, round(answer / 50, 6) AS recall FROM ranked WHERE pick = 1""")
def stream_scores(spark, sf_dir):
    """Predictions in three deliveries, some older than what was scored before: the newest of each counts."""
    folder = scratch_dir(spark, "scores")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("model_"), F.col("l_returnflag")).alias("model"), F.col("l_orderkey").alias("sample_id"),
        F.col("l_shipdate").cast("timestamp").alias("modified"), F.col("l_quantity").alias("answer"), (F.col("l_linenumber") % 3).alias("delivery"),
    )
    rows = rows.groupBy("model", "sample_id", "modified", "delivery").agg(F.max("answer").alias("answer"))
    score = lambda batch: batch.select("model", "sample_id", (F.col("answer") / 50).alias("recall"))
    for delivery in range(3):
        rows.filter(F.col("delivery") == delivery).drop("delivery").write.mode("append").parquet(f"{folder}/in")
        incoming = spark.readStream.schema(rows.drop("delivery").schema).parquet(f"{folder}/in")
        st.evaluate_new(incoming, score, f"{folder}/scores", f"{folder}/checkpoint").awaitTermination()
    out = st.read_scores(spark, f"{folder}/scores")
    return out.select("model", "sample_id", F.date_format("modified", "yyyy-MM-dd").alias("modified"), F.round("recall", 6).alias("recall"))
