"""Workflows, samples, scores and traces on small typed-in data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from calltrail.plans import catalog as cat
from calltrail.plans import evaluation as ev
from calltrail.plans import sft
from calltrail.plans import traces as tr
from calltrail.plans import workflows as wf


def _replay(rows, max_chains):
    """Selection log replayed one by one: (run, order, which) -> (outcome, chain, step)."""
    chains, out = {}, {}
    for run, o, which in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = chains.setdefault(run, {})
        if which == "-1" or not mine:
            if len(mine) >= max_chains:
                out[(run, o)] = ("saturated", None, None)
                continue
            name = f"api_use_chain_{len(mine) + 1}"
            mine[name] = 0
        elif which in mine:
            name = which
        else:
            out[(run, o)] = ("unknown_chain", None, None)
            continue
        mine[name] += 1
        out[(run, o)] = ("committed", name, mine[name])
    return out


@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_chains_are_replayed(spark, hot_rows):
    rng = random.Random(4)
    rows = [
        (rng.choice(["r", "r", "r", "s", "t"]), i, rng.choice(["-1", "api_use_chain_1", "api_use_chain_3", "api_use_chain_12", "?"]))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "run string, o int, which_chain string").repartition(4)
    placed = wf.place_selections(df, [F.col("o")], F.floor(F.col("o") / 9), 4, hot_rows)
    got = {(r.run, r.o): (r.outcome, r.chain_id, r.step_pos) for r in placed.collect()}
    assert got == _replay(rows, 4)


def test_chain_derivatives(spark):
    rows = [("r", 1, "-1", "a", "x"), ("r", 2, "api_use_chain_1", "b", "y"), ("r", 3, "api_use_chain_9", "c", "z")]
    df = spark.createDataFrame(rows, "run string, o int, which_chain string, arg string, res string")
    good, bad = wf.rebuild_chains(df, [F.col("o")], F.col("o"))
    assert [tuple(r) for r in wf.chain_sizes(good).collect()] == [("r", "api_use_chain_1", 2)]
    assert [tuple(r) for r in wf.chain_io(good, "arg", "res").collect()] == [("r", "api_use_chain_1", "a", "y")]
    edge = wf.chain_edges(good, "o").head()
    assert (edge.source, edge.destination) == (1, 2)
    assert [r.outcome for r in bad.collect()] == ["unknown_chain"]


def test_rightmost_chain(spark):
    nodes = [("t", "root", None, 0), ("t", "a", "root", 0), ("t", "b", "root", 1), ("t", "c", "b", 0), ("t", "d", "b", 1), ("u", "solo", None, 0)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, ord int")
    got = sorted((r.tree, r.depth, r.node) for r in wf.rightmost_chain(df).collect())
    assert got == [("t", 0, "root"), ("t", 1, "b"), ("t", 2, "d"), ("u", 0, "solo")]
    assert sorted(r.node for r in wf.rightmost_chain(df, skip_root=True).collect()) == ["b", "d"]


def test_rightmost_chain_is_whole_and_finds_cycles(spark):
    nodes = [("t", "n0", None, 0)] + [("t", f"n{i}", f"n{i - 1}", 1) for i in range(1, 300)] + [("t", f"m{i}", f"n{i}", 0) for i in range(299)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, ord int")
    assert sorted((r.depth, r.node) for r in wf.rightmost_chain(df).collect()) == [(i, f"n{i}") for i in range(300)]
    ring = spark.createDataFrame([("t", "a", "b", 0), ("t", "b", "a", 0)], "tree string, node string, parent string, ord int")
    assert wf.rightmost_chain(ring).count() == 0
    both = df.unionByName(ring.withColumn("tree", F.lit("ring")))
    assert wf.rightmost_chain(both).count() == 300  # the other tree is not held up
    assert [r.tree for r in wf.cyclic_trees(both).collect()] == ["ring"]


def test_messages_hold_all_parts(spark):
    flows, steps, negatives, defs = _sample_inputs(spark)
    parts = sft.format_samples(flows, steps, negatives, defs, 4, "python", part_size=2, hot_rows=2)
    assert parts.count() > flows.count()
    got = {r.sample_id: [(m.role, m.content) for m in r.messages] for r in sft.sample_messages(parts).collect()}
    whole = sft.format_samples(flows, steps, negatives, defs, 4, "python")
    assert got == {r.sample_id: [("system", r.system), ("user", r.user), ("assistant", r.assistant)] for r in whole.collect()}


def test_a_sample_of_any_length_is_streamed_in_pieces(spark, tmp_path):
    from calltrail.sources import readers, writers

    n = 25_000
    steps = spark.range(n).select(
        F.when(F.col("id") < n - 40, "long").otherwise(F.concat(F.lit("w"), (F.col("id") % 20).cast("string"))).alias("workflow_id"),
        F.lit(0).cast("bigint").alias("chain_pos"), F.col("id").alias("step_pos"), F.lit("t").alias("tool"),
        F.format_string('{"i": %d}', F.col("id")).alias("tool_input"),
    )
    flows = steps.select("workflow_id").distinct().withColumn("query", F.concat(F.lit("do "), "workflow_id"))
    none = steps.select("workflow_id", F.lit(0).alias("draw"), F.col("tool").alias("api")).limit(0)
    samples = sft.format_samples(flows, steps, none, none, -1, "python", part_size=2)
    writers.write_pieces(sft.sample_pieces(samples), str(tmp_path / "p"))
    pieces = spark.read.parquet(str(tmp_path / "p"))
    assert pieces.agg(F.max(F.length("content"))).head()[0] < 10_000 and pieces.filter("sample_id = 'long'").count() == 2 + (n - 40) // 2
    got = {}
    for role, content in readers.stream_sample(spark, str(tmp_path / "p"), "long"):
        got[role] = got.get(role, "") + content
    assert list(got) == ["system", "user", "assistant"] and got["user"] == "do long"
    assert got["assistant"] == "[" + ", ".join(f"t(i={i})" for i in range(n - 40)) + "]"


def test_ordinary_samples_are_not_shuffled_again(spark):
    rows = [("a", 0, 1, "s", "u", "x"), ("b", 0, 2, "s", "u", "["), ("b", 1, 2, "", "", "]")]
    samples = spark.createDataFrame(rows, "sample_id string, part bigint, n_parts bigint, system string, user string, assistant string")
    assert sorted(tuple(r) for r in sft.whole_samples(samples).collect()) == [("a", "s", "u", "x"), ("b", "s", "u", "[]")]
    plan = sft.whole_samples(samples)._jdf.queryExecution().optimizedPlan().toString()
    branch = plan[: plan.index("Aggregate")]
    assert "Union" in branch and "n_parts" in branch  # the first branch has no aggregate


def test_steps_get_names(spark):
    hashes = spark.createDataFrame([("h1", "a-b-c")], "hash string, name string")
    steps = spark.createDataFrame(
        [("h1", "call h1", '{"h1": "h1 x"}'), ("a-b-c", "as is", "r"), ("zz", "gone", "r")],
        "tool string, log string, result string",
    )
    got = sorted(tuple(r) for r in wf.name_steps(steps, hashes).collect())
    assert got == [("a-b-c", "as is", "r"), ("a-b-c", "call a-b-c", '{"a-b-c": "a-b-c x"}')]


@pytest.mark.parametrize("hot_rows", [2, 100_000])
def test_error_details(spark, hot_rows):
    rows = [
        ("p1", 0, "t", False, "", "", "It FAILED " + "x" * 300), ("p1", 1, "u", False, "rule", "err", ""), ("p1", 2, "v", False, "", "err", ""),
        ("p2", 0, "t", False, "", "", "odd"), ("p3", 0, "t", True, "", "", ""), ("p3", 1, "t", False, "rule", "", ""),
    ]
    df = spark.createDataFrame(rows, "p string, i int, tool string, is_valid boolean, validation_error string, error string, result_text string")
    got = {r.p: r.error_message for r in wf.error_details(df, ["p"], "i", F.col("i"), hot_rows=hot_rows).collect()}
    assert got == {
        "p1": "t: " + ("It FAILED " + "x" * 300)[:200] + " | u: rule | v: err", "p2": "All tool executions failed",
    }
    proposals = spark.createDataFrame([("p1",), ("p9",)], "p string")
    assert [r.p for r in wf.step_failures(proposals, df, ["p"]).collect()] == ["p9"]
    last = {r.p: r.last_success for r in wf.last_success(df, ["p"], "i", F.col("is_valid")).collect()}
    assert last == {"p1": None, "p2": None, "p3": 0}


def _sample_inputs(spark):
    steps = spark.createDataFrame(
        [("w1", 0, i, f"t{i % 2}", f'{{"i": {i}}}') for i in range(7)] + [("w1", 1, 0, "t9", "oops"), ("w2", 1, 0, "t1", "{}")],
        "workflow_id string, chain_pos bigint, step_pos bigint, tool string, tool_input string",
    )
    flows = spark.createDataFrame([("w1", "do one"), ("w2", "do two"), ("w3", "do none")], "workflow_id string, query string")
    negatives = spark.createDataFrame([("w1", 0, "n1"), ("w3", 1, "n2"), ("w3", 0, "n1")], "workflow_id string, draw int, api string")
    names = ["t0", "t1", "t9", "n1", "n2"]
    defs = spark.createDataFrame([(n, f'{{"name":"{n}","ok":true}}') for n in names], "api string, definition string")
    return flows, steps, negatives, defs


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 2, "part_size": 3}])
def test_python_samples(spark, limits):
    flows, steps, negatives, defs = _sample_inputs(spark)
    rows = sft.format_samples(flows, steps, negatives, defs, 4, "python", **limits).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r.part):
        s = text.setdefault(r.sample_id, ["", "", ""])
        s[0] += r.system
        s[1] += r.user
        s[2] += r.assistant
    calls = ", ".join(f"t{i % 2}(i={i})" for i in range(7))
    assert text["w1"][2] == f"[{calls}, t9()]"
    assert text["w2"][2] == "[t1()]" and text["w3"][2] == "[]"
    assert text["w1"][1] == "do one"
    pool = lambda names: "[" + ", ".join(f"{{'name': '{n}', 'ok': True}}" for n in names) + "]"
    assert pool(["t0", "t1", "t9", "n1"]) in text["w1"][0]
    assert pool(["n1", "n2"]) in text["w3"][0]


def test_json_samples_use_the_first_chain(spark):
    flows, steps, negatives, defs = _sample_inputs(spark)
    rows = {r.sample_id: r for r in sft.format_samples(flows, steps, negatives, defs, -1, "json").collect()}
    assert rows["w1"].assistant.startswith("[{'function': 't0', 'parameters': {'i': 0}}, {'function': 't1', 'parameters': {'i': 1}}")
    assert rows["w2"].assistant == "[]"
    assert "selection_pool" not in rows["w1"].system and '"function": "api_name"' in rows["w1"].system


def test_pool_checks_and_metadata(spark):
    _, steps, negatives, defs = _sample_inputs(spark)
    pool = sft.candidate_pool(steps, negatives)
    bad = {r.workflow_id: r.n_tools for r in sft.pool_violations(pool, 4).collect()}
    assert bad == {"w2": 1, "w3": 2}
    meta = {r.workflow_id: (len(r.pos_tools), len(r.neg_tools)) for r in sft.metadata(pool, defs).collect()}
    assert meta == {"w1": (3, 1), "w2": (1, 0), "w3": (0, 2)}
    twice = spark.createDataFrame([("w", "a", 0, "old"), ("w", "b", 1, "x"), ("w", "a", 2, "new")], "w string, name string, pos int, d string")
    assert sorted(tuple(r) for r in sft.merge_definitions(twice, ["w"], "name", "pos").collect()) == [("w", "a", 0, "new"), ("w", "b", 1, "x")]


TURNS = [
    ("ok", 0, "system", "Be kind"), ("ok", 1, "user", " hi "), ("ok", 2, "assistant", "yes\n"), ("ok", 3, "user", "more"),
    ("plain", 0, "user", "hi"), ("plain", 1, "assistant", "yes"), ("bad", 0, "user", "a"), ("bad", 1, "user", "b"),
    ("late", 0, "user", "a"), ("late", 1, "assistant", "b"), ("late", 2, "system", "c"),
]


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 1, "part_size": 2}])
def test_chats(spark, limits):
    df = spark.createDataFrame(TURNS, "c string, turn int, role string, content string")
    checks = {r.c: (r.n_messages, r.has_system, r.n_breaches) for r in sft.role_checks(df, "c", [F.col("turn")], F.col("turn"), limits.get("hot_rows")).collect()}
    assert checks == {"ok": (4, True, 0), "plain": (2, False, 0), "bad": (2, False, 1), "late": (3, False, 1)}
    text = {}
    for r in sorted(sft.rendered_chats(df, "c", "turn", F.col("turn"), generation_prompt=True, **limits).collect(), key=lambda r: r.part):
        text[r.c] = text.get(r.c, "") + r.text
    turn = lambda who, what: f"<start_of_turn>{who}\n{what}<end_of_turn>\n"
    tail = "<start_of_turn>model\n"
    assert text == {
        "ok": "<bos>" + turn("user", "Be kind\n\nhi") + turn("model", "yes") + turn("user", "more") + tail,
        "plain": "<bos>" + turn("user", "hi") + turn("model", "yes") + tail,
    }


def test_length_filter_takes_another_counter(spark):
    df = spark.createDataFrame([("a b　c",), ("abcdef",)], "t string")
    assert [r.n_tokens for r in sft.within_length(df, F.col("t"), 3).collect()] == [3, 1]
    assert [r.n_tokens for r in sft.within_length(df, F.col("t"), 5, counter=F.length).collect()] == [5]


def test_scores(spark):
    predictions = spark.createDataFrame(
        [("m", "none", False, None), ("m", "wrong", False, None), ("m", "retry", False, None), ("m", "failed", True, None),
         ("m", "partly", False, (0.25, 0.5, None, None)), ("m", "notruth", False, None)],
        "model string, sample_id string, failed boolean, stored struct<precision:double,recall:double,success_rate:double,qor:double>",
    )
    calls = spark.createDataFrame(
        [("m", "wrong", "x", ""), ("m", "retry", "t", "boom"), ("m", "retry", "t", ""), ("m", "retry", "u", "boom"), ("m", "retry", "x", ""),
         ("m", "partly", "t", ""), ("m", "notruth", "t", ""), ("m", "failed", "t", "")],
        "model string, sample_id string, tool string, error string",
    )
    truth = spark.createDataFrame(
        [(s, t) for s in ("none", "wrong", "retry", "failed", "partly") for t in ("t", "u")] + [("retry", "t")], "sample_id string, tool string"
    )
    judge = spark.createDataFrame(
        [("m", "none", 2, [120, 120]), ("m", "wrong", 1, [-5]), ("m", "retry", 5, [80, 90, 70]), ("m", "failed", 1, [90]),
         ("m", "partly", 1, [50]), ("m", "notruth", 0, [])],
        "model string, sample_id string, num_requests int, response_scores array<int>",
    )
    scored = ev.evaluate(predictions, calls, truth, judge)
    got = {r.sample_id: (r.precision, r.recall, r.success_rate, r.qor) for r in scored.collect()}
    assert got["none"] == (0.0, 0.0, 0.0, 100.0)
    assert got["wrong"] == (0.0, 0.0, 0.0, 0.0)
    assert got["retry"] == (pytest.approx(2 / 3), 1.0, 0.5, 48.0)
    assert got["failed"] == (0.0, 0.0, None, 0.0)
    assert got["partly"] == (0.25, 0.5, 0.5, 50.0)
    assert got["notruth"] == (0.0, 0.0, 0.0, 0.0)
    again = {r.sample_id: r.precision for r in ev.evaluate(predictions, calls, truth, judge, overwrite=True).collect()}
    assert again["partly"] == 1.0
    summary = {r.metric: r for r in ev.summarize(scored).collect()}
    assert summary["success_rate"]["count"] == 5
    assert summary["recall"].avg == pytest.approx(1.5 / 6)
    weighted = {r.metric: r for r in ev.summarize(scored, reference_weights=True).collect()}
    # four fresh samples count twice, the stored and the failed one once
    assert weighted["recall"]["count"] == 10 and weighted["recall"].avg == pytest.approx(2.5 / 10)
    saved = {r.sample_id: r.stored for r in ev.save_scores(predictions, scored).collect()}
    assert saved["failed"] is None and saved["partly"].qor == 50.0


@pytest.mark.parametrize("t, df, p", [(2.228138852, 10, 0.05), (0.0, 5, 1.0), (12.706204736, 1, 0.05), (3.290526731, 1e9, 0.001), (-1.724718243, 20, 0.1), (0.5, 1e11, 0.617075), (0.5, 2e6, 0.617075)])
def test_student_p(t, df, p):
    assert ev.student_p(t, df) == pytest.approx(p, rel=1e-5)


def test_paired_t_test(spark):
    def scores(model, values):
        return spark.createDataFrame(
            [(model, f"s{i}", 0.0, float(v), float(v) if i else None, 1.0) for i, v in enumerate(values)],
            "model string, sample_id string, precision double, recall double, success_rate double, qor double",
        )

    a, b = [1, 2, 3, 4, 5], [1, 1, 2, 2, 2]
    got = {r.metric: r for r in ev.compare(scores("a", a), scores("b", b)).collect()}
    d = [x - y for x, y in zip(a, b)]
    mean = sum(d) / 5
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 4)
    assert got["recall"].t_stat == pytest.approx(mean / (sd / math.sqrt(5)))
    assert got["recall"].p_value == pytest.approx(ev.student_p(got["recall"].t_stat, 4))
    assert got["success_rate"].n == 4
    assert got["qor"].t_stat is None and got["qor"].p_value is None
    one_table = scores("a", a).unionByName(scores("b", b))
    again = {r.metric: r for r in ev.compare_models(one_table, "a", "b").collect()}
    assert {m: (r.n, r.t_stat, r.p_value) for m, r in again.items()} == {m: (r.n, r.t_stat, r.p_value) for m, r in got.items()}


def test_traces(spark):
    proposals = spark.createDataFrame(
        [("r", 1, "p1", a) for a in ("a", "b", None)] + [("r", 2, "p1", a) for a in "abcd"] + [("r", 3, "p1", "z")],
        "run string, iteration int, proposal_id string, api string",
    )
    pool = spark.createDataFrame([("r", i, a) for i in (1, 2, 3) for a in "abcd"], "run string, iteration int, api string")
    got = {r.iteration: r.accepted for r in tr.proposal_checks(proposals, pool).collect()}
    assert got == {1: True, 2: False, 3: False}
    usage = spark.createDataFrame(
        [("gemini-2.5-flash", 1_000_000, 1_000_000, 10), ("other", 1_000_000, 0, 0), ("other", None, None, None)],
        "model string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint",
    )
    cost = {r.model: r for r in tr.token_cost(usage).collect()}
    assert cost["gemini-2.5-flash"].total_cost_usd == pytest.approx(2.80)
    assert cost["other"].total_cost_usd == pytest.approx(1.0) and cost["other"].successful_requests == 1


def test_catalog_joins(spark):
    rows = spark.createDataFrame([("c1", "t", "a", 0), ("c2", "t", "a", 1)], "category string, tool string, api string, pos int")
    assert cat.tool_category(rows, "pos").head().category == "c2"
    texts = spark.createDataFrame([("a_for_b_for_c",), ("a",), ("x_for_y",), ("_for_".join("abcdefghij"),)], "api_for_tool string")
    known = spark.createDataFrame([("a", "b_for_c"), ("a_for_b", "c")], "api string, tool string")
    got = {r.api_for_tool: (r.api, r.tool) for r in cat.split_api_for_tool(texts, known).collect()}
    assert got.pop("a_for_b_for_c") == ("a", "b_for_c")
    assert set(got.values()) == {(None, None)}
    with pytest.raises(ValueError):
        cat.sample_catalog(rows, "pos", 5, 1, strict=True)


def test_pools_are_bitmaps_of_any_size(spark):
    from calltrail.plans import traces as tr

    positions = spark.range(100_000).select(F.concat(F.lit("a"), "id").alias("api"), F.col("id").alias("position"))
    pool = positions.filter("position % 3 = 0").select(F.lit("r").alias("run"), F.lit(1).alias("iteration"), "api")
    asked = [("r", 1, p, a) for p, a in [("p1", "a0"), ("p1", "a32768"), ("p1", None), ("p2", "a99999"), ("p2", "a65535"), ("p3", "a1"), ("p3", "unknown"), ("p4", "a32769")]]
    asked += [("s", 1, "p1", "a0")]
    checks = tr.proposal_checks(spark.createDataFrame(asked, "run string, iteration int, proposal_id string, api string"), pool, positions=positions)
    got = {r.run: (r.n_proposals, r.n_too_many, r.n_foreign, r.accepted) for r in checks.collect()}
    wrong = [a for _, _, _, a in asked[:-1] if a is not None and (a == "unknown" or int(a[1:]) % 3)]
    assert got == {"r": (4, 0, len(wrong), False), "s": (1, 0, 1, False)}
    assert tr.pool_bitmaps(pool, positions).count() == 4
    bits = spark.createDataFrame([(bytes([0b101, 0x80]),)], "b binary")
    assert [bits.select(tr.has_bit(F.col("b"), F.lit(i))).head()[0] for i in (0, 1, 2, 15, 14)] == [True, False, True, True, False]


def test_chains_are_named_by_place_and_calls_kept_beside_samples(spark):
    assert [spark.range(1).select(wf.renamed_chain(F.lit(i))).head()[0] for i in (0, 9, 10)] == ["chain_1", "chain_10", None]
    rows = [("w", 0, i, "c1", f"t{i}", "{}") for i in range(5)] + [("w", 1, 0, "c2", "x", '{"a": 1}'), ("v", 0, 0, "c1", "y", "{}")]
    steps = spark.createDataFrame(rows, "workflow_id string, chain_pos bigint, step_pos bigint, chain_name string, tool string, tool_input string")
    got = {r.workflow_id: {k: [c.tool for c in v] for k, v in r.api_preds.items()} for r in sft.api_predictions(steps).collect()}
    assert got == {"w": {"c1": [f"t{i}" for i in range(5)], "c2": ["x"]}, "v": {"c1": ["y"]}}
    parts = sorted((r.part, {k: [c.tool for c in v] for k, v in r.api_preds.items()}) for r in sft.api_predictions(steps, 4).collect() if r.workflow_id == "w")
    assert [p for p, _ in parts] == [0, 1] and parts[1][1] == {"c1": ["t4"], "c2": ["x"]}


def test_edges_of_chains_longer_than_a_window(spark):
    rows = [("r", "c", i, f"n{i}") for i in range(1, 12)] + [("r", "d", 1, "x"), ("s", "c", 1, "y"), ("s", "c", 2, "z")]
    chains = spark.createDataFrame(rows, "run string, chain_id string, step_pos bigint, node string")
    for chunk in (1, 2, 5, 100):
        got = sorted((r.run, r.chain_id, r.source_pos, r.source, r.destination) for r in wf.chain_edges(chains, "node", chunk).collect())
        assert got == [("r", "c", i, f"n{i}", f"n{i + 1}") for i in range(1, 11)] + [("s", "c", 1, "y", "z")]
