"""Queries over small tables built here."""

import datetime
import inspect
import pathlib

import pytest
from pyspark.sql import functions as F

from calltrail.functions import pyliteral
from calltrail.operators import draws, ordering
from calltrail.plans import evaluation as ev
from calltrail.plans import sft
from calltrail.plans import traces as tr
from calltrail.queries import catalogs, evaluation, files
from calltrail.sources import readers, writers
from calltrail.streaming import chains as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, folder, **rows):
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_tool_asks_for_every_api_of_its_category(spark, tmp_path):
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    rows = [(0, "a b", "T1", "X", 1, 1.0), (1, "c", "T2", "X", 2, 1.0), (2, "d", "T1", "X", 3, 1.0), (3, "c", "T1", "Y", 4, 1.0)]
    out = catalogs.api_config_lookup(spark, _tables(spark, tmp_path, part=(schema, rows))).collect()
    got = {(r.category, r.tool, r.api): (r.n_required, r.n_optional) for r in out}
    assert len(out) == len(got) and got == {
        ("X", "T1", "a_b"): (2, 1), ("X", "T1", "c"): (0, 0), ("X", "T1", "d"): (2, 1),
        ("X", "T2", "a_b"): (0, 0), ("X", "T2", "c"): (2, 2), ("X", "T2", "d"): (0, 0), ("Y", "T1", "c"): (2, 2),
    }


def test_literals_of_flat_texts_are_made_by_one_parse_and_no_lists(spark):
    plain = repr(pyliteral.is_plain(F.col("v")))
    assert plain.count("try_parse_json") == 1
    assert "transform" not in repr(pyliteral.literal(F.col("v")))
    rows = [('{"{a": "}", "b, c: d": ": ", "true": null}',), (' { "t" : "x: y, z" , "n":true } ',), ('{}',)]
    df = spark.createDataFrame(rows, "v string").select("v", pyliteral.to_call_text(F.lit("t"), "v").alias("c"))
    assert [r.c for r in df.collect()] == [pyliteral.call_text("t", v) for v, in rows]


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _events(runs):
    day = lambda i: datetime.datetime(2024, 1, 1 + i % 3)
    kinds = ["click", "view", "error", "signup"]
    return [(r * 4 + i, day(i), r, kinds[i], 1.0, f'{{"k": {i + r}}}') for r in range(runs) for i in range(4)]


@pytest.mark.parametrize("name, folder", [("trace_files", "traces"), ("run_metadata_files", "metadata")])
def test_documents_of_many_runs_lie_in_few_files(spark, tmp_path, name, folder):
    written = []
    make = files.scratch_dir
    files.scratch_dir = lambda s, n: written.append(f"{tmp_path}/{n}") or written[-1]
    try:
        sf = _tables(spark, tmp_path, events=(EVENTS, _events(300)))
        rows = getattr(files, name)(spark, sf).collect()
    finally:
        files.scratch_dir = make
    assert len({r.seed for r in rows}) == 300
    assert len([f for f in pathlib.Path(written[0]).rglob("*") if f.is_file()]) < 50


def test_documents_apart_and_packed_read_alike(spark, tmp_path):
    runs = spark.createDataFrame([(1, 5, "a"), (2, None, "a/b")], "seed bigint, tool_call_count int, run string")
    writers.write_documents(runs, f"{tmp_path}/packed", "run")
    writers.write_documents(runs, f"{tmp_path}/apart", "run", apart=True)
    told = lambda df: sorted(tuple(r) for r in df.select("seed", "tool_call_count").collect())
    packed = readers.read_run_metadata(spark, f"{tmp_path}/packed", packed=True)
    assert told(packed) == told(readers.read_run_metadata(spark, f"{tmp_path}/apart/*")) == [(1, 5), (2, None)]
    assert {r.id for r in readers.read_documents(spark, f"{tmp_path}/packed", packed=True).collect()} == {"a", "a/b"}


def test_violations_take_no_distinct_count(spark):
    pool = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (2, 1, "b"), (3, 0, "a"), (3, 0, "a")], "workflow_id bigint, side int, api string")
    bad = sft.pool_violations(pool, 2)
    assert plan(bad).count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, bad.collect())) == [(1, 1, 1), (3, 1, 0)]


def test_records_are_written_compressed(spark, tmp_path):
    writers.write_json_records(spark.range(5), f"{tmp_path}/r")
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "r").glob("part-*"))
    assert spark.read.schema("id bigint").json(f"{tmp_path}/r").count() == 5


def test_a_rank_is_hashed_once(spark):
    ranks = draws._ranks(F.col("w"), F.lit(3), F.lit(20), 1)
    assert repr(ranks).count("md5") == 2  # the pick and the place


def test_pools_of_few_apis_stay_small(spark):
    positions = spark.createDataFrame([("a", 0), ("b", 63), ("c", 64), ("d", 100_000)], "api string, position bigint")
    pool = spark.createDataFrame([("r", 1, a) for a in "abd"], "run string, iteration int, api string")
    masks = {r._word: r._mask for r in tr.pool_masks(pool, positions).collect()}
    assert masks == {0: 1 - 2**63, 100_000 // 64: 1 << 100_000 % 64}
    asked = spark.createDataFrame([("r", 1, "p", a) for a in ["a", "b", "c", "d", "e", None]], "run string, iteration int, proposal_id string, api string")
    assert tr.proposal_checks(asked, pool, positions=positions).head().n_foreign == 2
    assert "bitmap_construct_agg" not in plan(tr.proposal_checks(asked, pool, positions=positions))


def test_sorted_ranges_follow_the_bytes_of_the_texts(spark, tmp_path):
    pieces = spark.range(40).select(
        F.col("id").alias("sample_id"), F.lit(0).alias("message_no"), F.lit(0).cast("bigint").alias("piece_no"),
        F.lit("user").alias("role"), F.repeat(F.lit("x"), 1000).alias("content"),
    )
    kept, writers.RANGE_BYTES = writers.RANGE_BYTES, 10_000
    try:
        writers.write_pieces(pieces, f"{tmp_path}/p")
    finally:
        writers.RANGE_BYTES = kept
    assert len(list((tmp_path / "p").glob("part-*"))) >= 4
    assert spark.read.parquet(f"{tmp_path}/p").count() == 40


def test_a_document_is_gathered_by_one_shuffle(spark, tmp_path):
    schema = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_linestatus string, l_quantity double, l_returnflag string"
    rows = [(o, o, n, "F" if n % 2 else "O", 1.0, "A") for o in range(5) for n in range(3)]
    documents = files.workflow_documents(spark, _tables(spark, tmp_path, lineitem=(schema, rows)))
    assert plan(documents).count("Exchange") == 1
    assert documents.count() == 5


def test_a_batch_of_scores_leaves_few_files_in_a_bucket(spark, tmp_path):
    d = str(tmp_path)
    spark.range(3000).select(
        F.lit("m").alias("model"), "id", F.lit("2024-01-01").cast("timestamp").alias("modified"),
    ).withColumnRenamed("id", "sample_id").repartition(8).write.parquet(f"{d}/in")
    incoming = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).parquet(f"{d}/in")
    st.evaluate_new(incoming, lambda b: b.select("model", "sample_id", F.lit(1.0).alias("recall")), f"{d}/out", f"{d}/check").awaitTermination()
    assert st.read_scores(spark, f"{d}/out").count() == 3000
    assert len(list((tmp_path / "out").rglob("part-*"))) == st.BUCKETS


def test_chains_that_are_no_object_are_told_without_their_schema(spark):
    chains = ["", ', "api_use_chains": null', ', "api_use_chains": [1]', ', "api_use_chains": "x"', ', "api_use_chains": {}', ', "api_use_chains": {"a": 1}']
    documents = spark.createDataFrame([(i, '{"query": "q", "response": "r"%s}' % c) for i, c in enumerate(chains)], "id int, text string")
    _, bad = readers.parse_workflows(documents)
    assert {r.id: r.reason for r in bad.collect()} == {**{i: "api_use_chains is not an object" for i in range(4)}, 5: "malformed chain"}
    assert inspect.getsource(readers.judge_workflows).count("_kind_at") == 2  # of the query and the response


def test_few_draws_are_spelled_out_and_take_the_same_ranks(spark):
    rows = [(w, wanted, wanted + spare) for w in [*range(200), None] for wanted in (1, 3, 6) for spare in (0, 2, 50)]
    able = spark.createDataFrame(rows, "workflow_id bigint, wanted bigint, allowed bigint")
    told = lambda df: sorted(map(repr, df.select("workflow_id", "wanted", "allowed", "ranks").collect()))
    spelled, long = draws._ranked(able, 6, 42), draws._ranked(able, draws.SPELLED_OUT + 1, 42)
    assert told(spelled) == told(long)
    assert plan(spelled).count("lambda") < plan(long).count("lambda")
    assert "transform(" not in plan(spelled) and "transform(" in plan(long)


def test_a_catalog_that_is_not_small_is_hashed_by_each_task(spark):
    catalog = spark.createDataFrame([(f"t{i}", f"f{i % 7}") for i in range(60)], "api string, family string")
    tools = spark.createDataFrame([(w, f"t{w % 9}") for w in range(40)], "workflow_id int, api string")
    definitions = catalog.select("api", F.concat(F.lit('{"name": "'), "api", F.lit('"}')).alias("definition"))
    steps = tools.select("workflow_id", F.lit(0).cast("bigint").alias("chain_pos"), F.lit(1).cast("bigint").alias("step_pos"), F.col("api").alias("tool"))
    kept, results = ordering.BROADCAST_BYTES, []
    try:
        for limit in (kept, 0):
            ordering.BROADCAST_BYTES = limit
            drawn = draws.strict_negatives(tools, catalog, 5, 42).tools
            meta = sft.metadata(sft.candidate_pool(steps, drawn), definitions)
            results.append([sorted(map(repr, df.collect())) for df in (drawn, meta)])
            assert ("ShuffledHashJoin" in plan(drawn)) == (limit == 0) and "SortMergeJoin" not in plan(drawn)
    finally:
        ordering.BROADCAST_BYTES = kept
    assert results[0] == results[1] and len(results[0][1]) == 40


def test_pools_are_gathered_once(spark):
    pool = spark.createDataFrame([(1, 1, (0, 1), "b"), (1, 1, (0, 0), "a"), (1, 0, (0, 2), "c"), (2, 0, (0, 1), "a"), (2, 0, (0, 3), "x")],
                                 "workflow_id bigint, side int, place struct<a:bigint,b:bigint>, api string")
    definitions = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "api string, definition string")
    meta = sft.metadata(pool, definitions)
    assert plan(meta).count("collect_list(struct(") == plan(meta).count("collect_list(")
    assert repr(meta._jdf.queryExecution().optimizedPlan().toString()).count("collect_list(") == 1
    assert {r.workflow_id: (r.pos_tools, r.neg_tools) for r in meta.collect()} == {1: ([None], ["A", "B"]), 2: (["A"], [])}


def test_hot_keys_are_counted_by_bucket_first(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 40, None).when(F.col("id") < 140, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    written = []
    kept, ordering.materialize = ordering.materialize, lambda df, name: written.append(name) or kept(df, name)
    try:
        assert ordering.hot_keys(rows, ["k"], 100) is None and written == ["full-buckets"]
        assert sorted(map(tuple, ordering.hot_keys(rows, ["k"], 39).collect()), key=repr) == [(-1, 100), (None, 40)]
    finally:
        ordering.materialize = kept


def test_texts_of_definitions_are_made_by_all_cores(spark):
    definitions = spark.range(50).coalesce(1).select(F.concat(F.lit("t"), "id").alias("api"), F.format_string('{"a": %d}', "id").alias("definition"))
    texts = sft.definition_texts(definitions)
    assert texts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert {r.api: r.text for r in texts.collect()} == {f"t{i}": f"{{'a': {i}}}" for i in range(50)}


def test_short_calls_go_around_python_with_its_texts(spark):
    texts = [
        "{}", '{"a": 1}', '{"a": 1, "a": 2}', '{"a": "b", ": c": 1}', '{"a": ": x"}', '{", ": 1, "b": "x, y: z}"}', '{"a":1}', '{"a": 1.50}',
        '{"a": -0.5, "b": 1e5}', '{"a": "it\'s"}', '{"a": "\u00e9"}', '{"a": {"b": 1}}', '{"a": [1]}', '{"a": true}', '{"a": 1, }', '{"a": 1', "[1]",
        None, '{"a": 012}', '{"a": -0}', '{"": ""}', '{"a": "", "b": ""}', '{"a": 1}\n', '{"a": "b"}\r', '{"q": "x", "r": "q"}', '{"a": 1"b": 2}',
    ]
    steps = spark.createDataFrame([(i, 0, 1, "t", v) for i, v in enumerate(texts)], "workflow_id int, chain_pos bigint, step_pos bigint, tool string, tool_input string")
    short = {r.workflow_id for r in steps.filter(pyliteral.is_short("tool_input")).collect()}
    assert {0, 1, 3, 4, 5} <= short and not short & {2, 17, 22, 23}
    told = sft.answers(steps, "python")
    assert "Union" in plan(told) and plan(told).count("ArrowEvalPython") == 1
    assert {r.workflow_id: r.assistant for r in told.collect()} == {i: f"[{pyliteral.call_text('t', v)}]" for i, v in enumerate(texts)}


def test_saved_scores_match_calls_with_true_tools_once(spark, tmp_path):
    schema = "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    rows = [(o, s, 5.0 * s + 1, 0.04 * s, 0.02 * o, "AN"[s % 2], "FO"[(o + s) % 2]) for o in range(6) for s in range(4)]
    sf = _tables(spark, tmp_path, lineitem=(schema, rows))
    asked, kept = [], ev.tool_counts
    ev.tool_counts = lambda calls, truth: asked.append(1) or kept(calls, truth)
    try:
        saved = {(r.model, r.sample_id): r for r in evaluation.saved_scores(spark, sf).collect()}
    finally:
        ev.tool_counts = kept
    fresh = {(r.model, r.sample_id): r for r in evaluation._rounded(evaluation.scores(spark, sf), *ev.METRICS).collect()}
    assert len(asked) == 1 and saved.keys() == fresh.keys() and len(saved) == 12
    assert all(saved[k].recall == fresh[k].recall and saved[k].qor == fresh[k].qor for k in saved if not saved[k].failed)
