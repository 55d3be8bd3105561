"""Splits, cuts, catalog samples and negative tools."""

from pyspark.sql import functions as F

from calltrail.operators import draws
from calltrail.plans import catalog as cat
from calltrail.plans import sft
from calltrail.queries.base import (
    CATALOG_SQL, NEGATIVE_SQL, STEPS_SQL, STRICT_SQL, catalog, cut_sql, query, steps, table, workflows,
)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))


@query("train_test_split", f"""
SELECT o_orderkey AS sample_id,
       CASE WHEN o_orderkey IN {cut_sql('o_orderkey', 42, 0.2, 'orders')} THEN 'test' ELSE 'train' END AS split
FROM orders""")
def train_test_split(spark, sf_dir):
    return sft.split(_orders(spark, sf_dir), test_ratio=0.2, seed=42)


KIND_SQL = "(SELECT doc_id, CASE WHEN lang = 'en' THEN 'positive' ELSE 'negative' END AS kind FROM documents)"


def _samples_of_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    english = F.col("lang") == "en"
    positive = docs.filter(english).select("doc_id", F.lit("positive").alias("kind"))
    return positive.unionByName(docs.filter(~english).select("doc_id", F.lit("negative").alias("kind")))


def _stratified(spark, sf_dir):
    return sft.split(
        _samples_of_kinds(spark, sf_dir), 0.29, 7, key="doc_id", kind="kind", kinds=["positive", "negative"]
    )


@query("stratified_split", f"""
SELECT doc_id, kind,
       CASE WHEN doc_id IN {cut_sql('doc_id', 7, 0.29, KIND_SQL, 'kind')} THEN 'test' ELSE 'train' END AS split
FROM {KIND_SQL}""")
def stratified_split(spark, sf_dir):
    return _stratified(spark, sf_dir)


@query("split_counts", f"""
SELECT split, kind, count(*) AS n FROM (
  SELECT kind, CASE WHEN doc_id IN {cut_sql('doc_id', 7, 0.29, KIND_SQL, 'kind')} THEN 'test' ELSE 'train' END AS split
  FROM {KIND_SQL}) GROUP BY split, kind""")
def split_counts(spark, sf_dir):
    return _stratified(spark, sf_dir).groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("negative_fraction", f"""
SELECT o_orderkey AS workflow_id FROM orders WHERE o_orderkey IN {cut_sql('o_orderkey', 42, 0.2, 'orders')}""")
def negative_fraction(spark, sf_dir):
    return sft.choose_sources(workflows(spark, sf_dir), 0.2, 42)[1].select("workflow_id")


@query("in_place_negatives", f"""
SELECT o_orderkey AS workflow_id,
       CASE WHEN o_orderkey IN {cut_sql('o_orderkey', 42, 0.2, 'orders')} THEN 'negative' ELSE 'positive' END AS kind
FROM orders""")
def in_place_negatives(spark, sf_dir):
    positive, negative = sft.choose_sources(workflows(spark, sf_dir), 0.2, 42, in_place=True)
    return positive.select("workflow_id", F.lit("positive").alias("kind")).unionByName(
        negative.select("workflow_id", F.lit("negative").alias("kind"))
    )


@query("catalog_sample", """
SELECT p_partkey, p_name FROM part
ORDER BY md5('422|' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50""")
def catalog_sample(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return cat.sample_catalog(part, "p_partkey", num_apis=50, seed=42, step=2, max_iter=10)


@query("allowed_sample", """
SELECT p_partkey, p_name FROM part WHERE p_name IN ('small ring', 'red widget', 'blue bolt')
ORDER BY md5('420|' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 5""")
def allowed_sample(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    allowed = cat.allowed_only(part, "p_name", ["small ring", "red widget", "blue bolt"])
    return cat.sample_catalog(allowed, "p_partkey", num_apis=5, seed=42)


def _tools(spark, sf_dir):
    return steps(spark, sf_dir).select("workflow_id", F.col("tool").alias("api"))


@query("negative_tools", f"WITH RECURSIVE {STEPS_SQL}, {CATALOG_SQL}, {NEGATIVE_SQL} SELECT * FROM drawn")
def negative_tools(spark, sf_dir):
    return draws.negative_tools(_tools(spark, sf_dir), catalog(spark, sf_dir), 10, 42).tools


@query("negative_rejects", f"""WITH RECURSIVE {STEPS_SQL}, {CATALOG_SQL}, {NEGATIVE_SQL}
SELECT workflow_id, wanted, CAST(allowed AS BIGINT) AS allowed,
       CASE WHEN wanted < 0 THEN 'more positive tools than requested' ELSE 'not enough candidates' END AS reason
FROM sized WHERE wanted < 0 OR wanted > allowed""")
def negative_rejects(spark, sf_dir):
    return draws.negative_tools(_tools(spark, sf_dir), catalog(spark, sf_dir), 10, 42).rejects


@query("strict_negatives", f"WITH RECURSIVE {STEPS_SQL}, {CATALOG_SQL}, {STRICT_SQL} SELECT * FROM drawn")
def strict_negatives(spark, sf_dir):
    return draws.strict_negatives(_tools(spark, sf_dir), catalog(spark, sf_dir), 10, 42).tools


POOL_SQL = f"""WITH RECURSIVE {STEPS_SQL}, {CATALOG_SQL}, {NEGATIVE_SQL},
pool AS (
  SELECT workflow_id, 0 AS side, chain_pos AS a, step_pos AS b, tool AS api FROM (
    SELECT *, row_number() OVER (PARTITION BY workflow_id, tool ORDER BY chain_pos, step_pos) AS rn FROM steps)
  WHERE rn = 1
  UNION ALL SELECT workflow_id, 1, 0, draw, api FROM drawn)"""


@query("candidate_pool", f"""{POOL_SQL}
SELECT workflow_id, side, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, api FROM pool""")
def candidate_pool(spark, sf_dir):
    negatives = draws.negative_tools(_tools(spark, sf_dir), catalog(spark, sf_dir), 10, 42).tools
    pool = sft.candidate_pool(steps(spark, sf_dir), negatives)
    return pool.select("workflow_id", "side", "place.a", "place.b", "api")


@query("pool_violations", f"""{POOL_SQL}
SELECT workflow_id, count(*) AS n_tools, CAST(0 AS BIGINT) AS n_shared FROM (SELECT DISTINCT workflow_id, api FROM pool)
GROUP BY workflow_id HAVING count(*) <> 10""")
def pool_violations(spark, sf_dir):
    negatives = draws.negative_tools(_tools(spark, sf_dir), catalog(spark, sf_dir), 10, 42).tools
    return sft.pool_violations(sft.candidate_pool(steps(spark, sf_dir), negatives), 10)


@query("unknown_tools", f"""WITH {STEPS_SQL}
SELECT tool AS api, count(*) AS n FROM steps
WHERE tool NOT IN (SELECT 'api_' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_type <> 'PROMO') GROUP BY tool""")
def unknown_tools(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter(F.col("p_type") != "PROMO").select(
        F.concat(F.lit("api_"), F.col("p_partkey").cast("string")).alias("api")
    )
    # calls are counted per tool first, so the check joins one row per tool
    used = _tools(spark, sf_dir).groupBy("api").agg(F.count(F.lit(1)).alias("n"))
    return sft.unknown_tools(used, known)


@query("test_ids", f"""
SELECT doc_id FROM {KIND_SQL} WHERE doc_id IN {cut_sql('doc_id', 7, 0.29, KIND_SQL, 'kind')}""")
def test_ids(spark, sf_dir):
    return sft.test_ids(_stratified(spark, sf_dir), "doc_id")


@query("appended_negatives", f"""
SELECT split, kind, kind = 'negative' AS is_negative, count(*) AS n FROM (
  SELECT kind, CASE WHEN doc_id IN {cut_sql('doc_id', 7, 0.29, KIND_SQL, 'kind')} THEN 'test' ELSE 'train' END AS split FROM {KIND_SQL})
GROUP BY ALL""")
def appended_negatives(spark, sf_dir):
    """Each kind is split on its own; negatives then follow positives in both splits."""
    kinds = _samples_of_kinds(spark, sf_dir)
    positive, negative = (
        sft.split(kinds.filter(F.col("kind") == k), 0.29, 7, key="doc_id", kind="kind", kinds=[k]) for k in ("positive", "negative")
    )
    return sft.append_negatives(positive, negative).groupBy("split", "kind", "is_negative").agg(F.count(F.lit(1)).alias("n"))


@query("batch_totals", f"""WITH RECURSIVE {STEPS_SQL}, {CATALOG_SQL}, {NEGATIVE_SQL},
good AS (SELECT wanted >= 0 AND wanted <= allowed AS good FROM sized)
SELECT count(*) AS n_total, count(*) FILTER (good) AS n_accepted, count(*) FILTER (NOT good) AS n_rejected FROM good""")
def batch_totals(spark, sf_dir):
    tools = steps(spark, sf_dir).select("workflow_id", F.col("tool").alias("api"))
    drawn = draws.negative_tools(tools, catalog(spark, sf_dir), 10, 42)
    return sft.batch_totals(drawn.accepted, drawn.rejects)
