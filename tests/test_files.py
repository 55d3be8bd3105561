"""Readers, writers and streams over files written here."""

import datetime
import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from calltrail.plans import evaluation as ev
from calltrail.plans import traces as tr
from calltrail.plans import workflows as wf
from calltrail.sources import bucketed, readers, versions, writers
from calltrail.streaming import chains as st


def _step(tool, tool_input, result):
    return [{"tool": tool, "tool_input": tool_input, "log": f"Invoking {tool}", "type": "AgentActionMessageLog", "message_log": [], "tool_call_id": "c"}, result]


def _doc(chains, query="q"):
    return {"query": query, "api_use_chains": {k: {"chain_id": k, "intermediate_steps": s} for k, s in chains.items()}, "response": "r"}


# Shapes of the two kinds of example output: four chains of one step, and one chain of two text results.
FOUR = _doc({f"api_use_chain_{i}": [_step(f"Finance-tool_{i}-get", {"symbol": "AAPL"} if i < 4 else {}, {"error": "", "response": "[]" if i == 4 else "{'a': 1}"})] for i in range(1, 5)})
TEXTS = _doc({"api_use_chain_1": [_step("directory_tree", {"path": "."}, "([{'type': 'text'}])"), _step("read_file", "raw", "ENOENT error")]})
ORDERED = _doc({k: [_step("t", {"z": 1, "a": 2}, "x")] for k in ("api_use_chain_2", "api_use_chain_10", "api_use_chain_1")})


def _write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("flows"))
    for name, doc in {"four": FOUR, "texts": TEXTS, "ordered": ORDERED}.items():
        _write(d, f"{name}.json", doc)
    _write(d, "empty.json", _doc({"api_use_chain_1": [], "api_use_chain_2": None}))
    _write(d, "pretty.json", json.dumps(FOUR, indent=2))
    _write(d, "broken.json", '{"query": "q", ')
    _write(d, "typed.json", {**FOUR, "query": 1})
    _write(d, "missing.json", {k: v for k, v in FOUR.items() if k != "response"})
    _write(d, "tuple.json", _doc({"api_use_chain_1": [[{"tool": "t"}]]}))
    _write(d, "notes.txt", "not read")
    return d


def test_workflow_directory(spark, flows):
    good, bad = readers.read_workflows(spark, flows)
    assert {r.id: r.reason for r in bad.collect()} == {
        "broken": "not JSON", "typed": "query is not a text", "missing": "response is not a text", "tuple": "malformed chain",
    }
    steps = wf.flatten_steps(good).orderBy("workflow_id", "chain_pos", "step_pos").collect()
    by = {}
    for s in steps:
        by.setdefault(s.workflow_id, []).append(s)
    assert set(by) == {"four", "pretty", "texts", "ordered"}
    assert len(by["four"]) == 4 and len(by["texts"]) == 2
    assert [s.chain_name for s in by["ordered"]] == ["chain_2", "chain_10", "chain_1"]
    assert by["ordered"][0].tool_input == '{"z":1,"a":2}'
    assert [s.result_kind for s in by["four"]] == ["object"] * 4 and by["four"][3].response == "[]"
    assert [s.result_kind for s in by["texts"]] == ["text"] * 2 and by["texts"][1].tool_input == "raw"
    heads = {(r.workflow_id, r.chain_id): r.n_steps for r in wf.chain_headers(good).collect()}
    assert heads[("texts", "api_use_chain_1")] == 2 and heads[("empty", "api_use_chain_1")] == 0


def test_catalog_files(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "map.json", {"h1": "a-b-c", "h2": "a-b-d"})
    _write(d, "nested.json", {"Cat": {"tool": ["x", "y"]}, "Dog": {"tool": []}})
    _write(d, "ids.txt", " 0001 \n\n0002\n")
    with gzip.open(f"{d}/rows.jsonl.gz", "wt") as f:
        f.write('{"category": "c", "tool": "t", "api": "a"}\n')
    _write(d, "cfg/My Cat/tool one.json", {
        "description": None,
        "api_list": [{"name": "Get It", "description": "d" * 300, "required_parameters": [{"name": "p", "type": "STRING", "description": "x" * 300}], "optional_parameters": []},
                     {"name": "get_it", "description": "second", "required_parameters": [], "optional_parameters": []}],
    })
    assert sorted(map(tuple, readers.read_name_map(spark, f"{d}/map.json").collect())) == [("h1", "a-b-c"), ("h2", "a-b-d")]
    assert sorted(map(tuple, readers.read_nested_catalog(spark, f"{d}/nested.json").collect())) == [("Cat", "tool", "x"), ("Cat", "tool", "y")]
    assert [r.sample_id for r in readers.read_ids(spark, f"{d}/ids.txt").collect()] == ["0001", "0002"]
    assert tuple(readers.read_catalog(spark, f"{d}/rows.jsonl.gz").head()) == ("c", "t", "a")
    from calltrail.plans.catalog import api_args

    configs = readers.read_tool_configs(spark, f"{d}/cfg")
    refs = spark.createDataFrame([("My Cat", "tool one", "get_it"), ("My Cat", "tool one", "nope")], "category string, tool string, api string")
    got = {r.api: r for r in api_args(refs, configs).collect()}
    assert got["get_it"].description == "d" * 256 and len(got["get_it"].required[0].description) == 256
    assert got["nope"].description == "" and got["nope"].required == []


def test_groups_and_training_sets(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "g/a.json", '{\n "k": 1\n}')
    _write(d, "g/b.jsonl", '{"k": 2}\n{"k": 3}\n')
    with gzip.open(f"{d}/g/c.jsonl.gz", "wt") as f:
        f.write('{"k": 4}\n')
    assert sorted(r.k for r in readers.read_group(spark, f"{d}/g", "k INT").collect()) == [1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        readers.read_group(spark, f"{d}/none", "k INT")
    _write(d, "t.jsonl", json.dumps({"system": " s ", "user": "u\n", "assistant": "a", "x": 1}) + "\n" + json.dumps({"messages": [{"role": "user", "content": "hi"}]}) + "\n")
    rows = sorted([[(m.role, m.content) for m in r.messages] for r in readers.read_training_set(spark, f"{d}/t.jsonl").collect()])
    assert rows == [[("system", "s"), ("user", "u"), ("assistant", "a")], [("user", "hi")]]


def test_predictions_are_scored_from_files(spark, tmp_path):
    d = str(tmp_path)
    ok = {"error": "", "response": "x"}
    _write(d, "pred/m 1/b/s1.json", {"intermediate_steps": [_step("t", {}, {"error": "e", "response": ""}), _step("t", {}, ok), _step("x", {}, "it failed")], "response-base": "r"})
    _write(d, "pred/m 1/b/s2.json", {"intermediate_steps": [], "error": "boom"})
    _write(d, "pred/m 1/b/s3.json", {})
    _write(d, "pred/m 1/b/s4.json", {"intermediate_steps": [], "eval": {"tool_accuracy": {"precision": 0.5, "recall": 1.0}, "success_rate": 0.75, "qor": 30}})
    for s in ("s1", "s2", "s3"):
        _write(d, f"meta/{s}.json", {"pos_tools": [{"name": "t"}, {"name": "u"}]})
    _write(d, "meta/s4.json", {"pos_tools": {"t": {}, "u": {}}})
    pred = readers.read_predictions(spark, f"{d}/pred")
    truth = readers.read_truth(spark, f"{d}/meta")
    judge = spark.createDataFrame([], "model string, sample_id string, num_requests int, response_scores array<int>")
    got = {r.sample_id: (r.precision, r.recall, r.success_rate) for r in ev.evaluate(pred, readers.prediction_calls(pred), truth, judge).collect()}
    assert got == {"s1": (0.5, 0.5, 0.5), "s2": (0.0, 0.0, None), "s3": (0.0, 0.0, None), "s4": (0.5, 1.0, 0.75)}
    assert {r.model for r in pred.collect()} == {"m 1"}


# Counts of the recorded three-iteration trace: 9 proposals, 4 successes, 5 tool calls, 2 commits.
def _trace():
    def execution(p, ok, calls):
        step = {"tool": "t", "tool_input": {"path": "."}, "result_preview": "x"} if ok else None
        return {"proposal_id": p, "success": ok, "num_tool_calls": calls, "api_call_step": step, **({} if ok else {"error_message": "e"})}

    plan = [([(True, 1), (False, 1), (False, 0)], "-1", {"api_use_chain_1": 1}), ([(True, 1)] * 3, "api_use_chain_1", {"api_use_chain_1": 2}), ([(False, 0)] * 3, None, None)]
    its = []
    for i, (runs, which, update) in enumerate(plan, 1):
        its.append({
            "iteration": i, "timestamp": None,
            "proposals": [{"id": f"p{j}", "instruction": "do", "apis": [{"name": "t", "description": "N/A"}]} for j in range(3)],
            "executions": [execution(f"p{j}", ok, n) for j, (ok, n) in enumerate(runs)],
            "selection": None if which is None else {"selected_id": "p0", "action": "", "which_chain": which, "tool_used": "t"},
            "workflow_update": None if update is None else {"num_chains": 1, "chains": update},
        })
    return {"seed": 123, "total_iterations": 3, "iterations": its}


def test_trace_and_metadata_files(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "trace/00123.json", json.dumps(_trace(), indent=2))
    rows = readers.read_traces(spark, f"{d}/trace").select(F.col("seed").alias("run"), "*")
    executions = rows.select("run", "iteration", F.explode("executions").alias("e")).select("run", "iteration", "e.*")
    counts = {r.iteration: (r.n_executions, r.n_success, r.n_failed, r.n_tool_calls) for r in tr.execution_counts(executions).collect()}
    assert counts == {1: (3, 1, 2, 2), 2: (3, 3, 0, 3), 3: (3, 0, 3, 0)}
    judged = tr.iteration_outcomes(
        rows.select("run", "iteration", F.col("proposals").isNotNull().alias("has_proposals"), F.col("selection").isNotNull().alias("has_selection"),
                    F.col("workflow_update").isNotNull().alias("has_update"))
        .join(tr.execution_counts(executions), ["run", "iteration"])
    )
    assert [r.outcome for r in judged.orderBy("iteration").collect()] == ["committed", "committed", "skipped_executor"]
    assert tuple(tr.run_totals(judged).head()) == (123, 3, 2, 5)
    labels = [r[0] for r in rows.filter("selection is not null").orderBy("iteration").select(tr.selection_label(F.col("selection.which_chain"))).collect()]
    assert labels == ["create_new_chain", "update_chain_api_use_chain_1"]
    _write(d, "meta/00001.json", {"seed": 1, "num_apis": 50, "llm_costs": {"total_tokens": 7, "total_cost_usd": 0.5}, "tool_call_count": 5})
    _write(d, "meta/00002.json", {"cost": {"total_tokens": 8, "total_cost": 0.25}, "time": "2025-01-01T00:00:00", "config": {"a": 1}})
    meta = {r.seed: (r.total_tokens, r.total_cost_usd) for r in readers.read_run_metadata(spark, f"{d}/meta").collect()}
    assert meta == {1: (7, 0.5), 2: (8, 0.25)}


def test_split_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "train", True), ("a_neg", "y", "train", False), ("b", "z", "test", True)], "sample_id string, text string, split string, is_pos boolean")
    writers.write_split(rows, str(tmp_path), ["text"], positive="is_pos")
    assert [r.sample_id for r in readers.read_ids(spark, f"{tmp_path}/train.txt").collect()] == ["a"]
    assert sorted(r.text for r in readers.read_jsonl(spark, f"{tmp_path}/train.jsonl", "text STRING").collect()) == ["x", "y"]


def _deliver(spark, folder, rows, max_chains=4):
    schema = "run string, o bigint, which_chain string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    running = st.stream_chains(spark.readStream.schema(schema).parquet(f"{folder}/in"), folder, ["o"], max_chains)
    running.awaitTermination()
    return running


def _placed(spark, folder):
    return {(r.run, r.o): (r.outcome, r.chain_id, r.step_pos) for r in spark.read.parquet(f"{folder}/placed").collect()}


def test_streamed_chains_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path)
    names = ["-1", "api_use_chain_1", "api_use_chain_3", "api_use_chain_2", "what", None, "api_use_chain_99999999999999999999"]
    rows = [(f"r{i % 3 // 2}", i, names[i * 7 % 4 if i % 5 else i % 7]) for i in range(60)]
    for start in range(0, 60, 20):
        _deliver(spark, folder, rows[start: start + 20][::-1])  # inside a batch in any order
    batch = wf.place_selections(spark.createDataFrame(rows, "run string, o int, which_chain string"), [F.col("o")], F.col("o"), 4)
    assert _placed(spark, folder) == {(r.run, r.o): (r.outcome, r.chain_id, r.step_pos) for r in batch.collect()}


def test_a_batch_touches_the_state_of_its_runs_only_and_can_be_run_again(spark, tmp_path):
    folder = str(tmp_path)
    _deliver(spark, folder, [(f"r{i % 100:03}", i, "-1") for i in range(300)])
    progress = _deliver(spark, folder, [("r007", 1000, "api_use_chain_2")]).recentProgress
    states = [p["stateOperators"][0] for p in progress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in states] == [1] and states[0]["numRowsTotal"] == 100
    before = _placed(spark, folder)
    commits = sorted((f for f in os.listdir(f"{folder}/checkpoint/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):  # the batch is taken for not finished
        os.remove(f"{folder}/checkpoint/commits/{name}")
    _deliver(spark, folder, [("r007", 1001, "api_use_chain_2")])
    after = _placed(spark, folder)
    assert after == before | {("r007", 1001): ("committed", "api_use_chain_2", 3)}


def test_the_last_good_delivery_counts(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "in/one/00001.json", TEXTS)
    _write(d, "in/one/00004.json", "{")
    st.intake(spark, f"{d}/in/*", f"{d}/out", f"{d}/cp").awaitTermination()
    _write(d, "in/two/00001.json", FOUR)
    _write(d, "in/two/00002.json", TEXTS)
    _write(d, "in/two/00003.json", "{")
    _write(d, "in/two/00004.json", TEXTS)
    st.intake(spark, f"{d}/in/*", f"{d}/out", f"{d}/cp").awaitTermination()
    _write(d, "in/three/00002.json", "{")
    st.intake(spark, f"{d}/in/*", f"{d}/out", f"{d}/cp").awaitTermination()
    steps = st.read_intake(spark, f"{d}/out")
    assert {r.workflow_id: r["count"] for r in steps.groupBy("workflow_id").count().collect()} == {"00001": 4, "00002": 2, "00004": 2}
    assert sorted(r.id for r in spark.read.parquet(f"{d}/out/rejects").collect()) == ["00002", "00003", "00004"]


def test_only_new_predictions_are_scored_and_the_newest_counts(spark, tmp_path):
    d = str(tmp_path)
    schema = "model string, sample_id string, modified timestamp, answer string"
    calls = []

    def score(batch):
        calls.append(sorted((r.sample_id, r.answer) for r in batch.collect()))
        return batch.select("model", "sample_id", F.col("answer").alias("recall"))

    at = lambda hour: datetime.datetime(2026, 1, 1, hour)
    deliveries = [
        [("m", "a", at(1), "old"), ("m", "a", at(2), "new"), ("m", "a", at(2), "new"), ("m", "c", at(1), "x"), ("m", "c", at(1), "y")],
        [("m", "a", at(2), "new"), ("m", "b", at(1), "b")],
        [("m", "a", at(1), "older"), ("m", "b", at(3), "newer")],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
        st.evaluate_new(spark.readStream.schema(schema).parquet(f"{d}/in"), score, f"{d}/out", f"{d}/cp").awaitTermination()
    assert [c for c in calls if c][1:] == [[("b", "b")], [("b", "newer")]]
    assert calls[0][0] == ("a", "new")
    got = {r.sample_id: r.recall for r in st.read_scores(spark, f"{d}/out").collect()}
    assert got["a"] == "new" and got["b"] == "newer" and set(got) == {"a", "b", "c"}
    st.compact_scores(spark, f"{d}/out", f"{d}/table")
    assert {r.sample_id: r.recall for r in versions.read_version(spark, f"{d}/table").collect()} == got


def test_versions_are_switched_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    versions.write_version(spark.range(5), path)

    fail = F.udf(lambda i: 1 // (i - 7), "int")
    with pytest.raises(Exception):
        versions.write_version(spark.range(10).select("id", fail("id").alias("x")), path)
    assert versions.read_version(spark, path).count() == 5  # the write that died changed nothing
    # the new version reads the one that it replaces
    versions.write_version(versions.read_version(spark, path).union(spark.range(5, 8)), path)
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == list(range(8))
    versions.write_version(spark.range(2), path, keep=1)
    assert versions.read_version(spark, path).count() == 2
    assert len(versions.versions(spark, path)) == 2  # the current one and the one before it


def test_newest_file_wins(spark):
    rows = [("a", "t1", 1), ("a", "t2", 2), ("b", "t3", 1)]
    df = spark.createDataFrame(rows, "id string, text string, v int")
    assert sorted(tuple(r) for r in wf.latest(df, "id", F.col("v")).collect()) == [("a", "t2", 2), ("b", "t3", 1)]


def test_bucketed_inputs_join_without_a_shuffle(spark, tmp_path):
    d = str(tmp_path)
    predictions = spark.createDataFrame([("m", i % 7, i) for i in range(30)] + [("n", None, 0)], "model string, sample_id bigint, x int")
    truth = spark.createDataFrame([(i, t) for i in range(5) for t in "bab"], "sample_id bigint, tool string")
    raw = spark.createDataFrame([(i, f"q{i}", "r") for i in range(1, 9)], "sample_id bigint, query string, response string")
    named = {"predictions": predictions, "truth": truth, "raw": raw}
    tables = [bucketed.write_bucketed(df, f"t_{name}_{os.path.basename(d).replace('-', '_')}", buckets=4, path=f"{d}/{name}") for name, df in named.items()]
    joined = bucketed.join_prediction_inputs(*tables)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 3
    rows = joined.collect()
    assert sorted({r.sample_id for r in rows}) == [1, 2, 3, 4] and len(rows) == sum(i % 7 in (1, 2, 3, 4) for i in range(30))
    assert all(r.true_tools == ["a", "b"] and r["query"] == f"q{r.sample_id}" for r in rows)


def test_scores_are_written_back(spark, tmp_path):
    path = str(tmp_path / "p")
    score = "struct<precision:double,recall:double,success_rate:double,qor:double>"
    rows = [("m", "a", False, None), ("m", "b", True, None), ("m", "c", True, (0.5, 0.5, 0.5, 5.0))]
    versions.write_version(spark.createDataFrame(rows, f"model string, sample_id string, failed boolean, stored {score}"), path)
    scores = spark.createDataFrame([("m", "a", False, 1.0, 0.5, 0.25, 9.0), ("m", "b", True, 0.0, 0.0, None, 0.0)],
                                   "model string, sample_id string, failed boolean, precision double, recall double, success_rate double, qor double")
    for _ in range(2):
        writers.write_scores(versions.read_version(spark, path), scores, path)
    got = {r.sample_id: r.stored and tuple(r.stored) for r in versions.read_version(spark, path).collect()}
    assert got == {"a": (1.0, 0.5, 0.25, 9.0), "b": None, "c": (0.5, 0.5, 0.5, 5.0)}


def test_groups_need_no_schema(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "g/a.json", '{\n "k": 1, "only_a": {"x": [1, 2]}, "mixed": 5\n}')
    _write(d, "g/b.jsonl", '{"k": 2.5, "mixed": "text"}\n\n{"k": null, "mixed": {"deep": true}}\nnot json\n')
    _write(d, "g/list.json", '[{"k": 7}, {"k": 8, "Only_list": "y"}]')
    with gzip.open(f"{d}/g/c.jsonl.gz", "wt") as f:
        f.write('{"k": 4, "only_a": {"x": [3], "z": "w"}}\n')
    rows = readers.read_group(spark, f"{d}/g")
    assert set(rows.columns) == {"k", "only_a", "mixed", "Only_list"}
    got = {float(r.k) if r.k is not None else None: r for r in rows.collect()}
    assert set(got) == {1.0, 2.5, None, 4.0, 7.0, 8.0}
    assert [got[1.0].mixed, got[2.5].mixed, got[None].mixed] == ["5", "text", '{"deep":true}']
    assert list(got[1.0].only_a.x) == [1, 2] and (got[4.0].only_a.z, got[8.0].Only_list, got[7.0].Only_list) == ("w", "y", None)
    assert [(r.file, r.text) for r in readers.group_rejects(spark, f"{d}/g").collect()] == [("b.jsonl", "not json")]
    _write(d, "n/a.json", "3")
    with pytest.raises(ValueError, match="no objects"):
        readers.read_group(spark, f"{d}/n")


def test_documents_are_counted_where_they_are_judged(spark, tmp_path):
    rows = [("a", json.dumps(_doc({"c1": [_step("t", {}, "r")]}))), ("b", "{"), ("c", None), ("d", json.dumps({"query": 1}))]
    judged, counts = readers.judge_workflows(spark.createDataFrame(rows, "id string, text string"))
    assert counts == {"n_total": 4, "n_accepted": 1, "n_rejected": 3}
    assert {r.id: r.reason for r in judged.collect()} == {"a": None, "b": "not JSON", "c": "not JSON", "d": "query is not a text"}


def test_broken_traces_are_listed(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "t/1.json", json.dumps(_trace()))
    _write(d, "t/2.json", "{")
    _write(d, "t/3.json", '{"seed": 1}')
    assert {(r.id, r.reason) for r in readers.trace_rejects(spark, f"{d}/t").collect()} == {("2", "not JSON"), ("3", "iterations is not a list")}
    assert {r.seed for r in readers.read_traces(spark, f"{d}/t").collect()} == {123}
