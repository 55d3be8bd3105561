"""Operators against brute force, with thresholds so low that the hot paths run."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from calltrail.operators import cuts, draws
from calltrail.operators.ordering import SLICE, collect_parts, hot_keys, rolling_mean, running_count, slices


def _rows(n=400, seed=1):
    """Key 'a' holds most rows; many rows are copies."""
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "a", "a", "b", "c", "d"]), rng.randrange(40), rng.choice("xyz")) for _ in range(n)
    ]


@pytest.mark.parametrize("hot_rows", [5, 100_000])
def test_running_count(spark, hot_rows):
    rows = sorted(set(_rows()))
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    cut = slices(df, ["k"], F.floor(F.col("o") / 7), hot_rows)
    out = running_count(cut.mark(df), ["k"], [F.col("o"), F.col("v")], cut, "n", total="t").drop(SLICE)
    got = {(r.k, r.o, r.v): (r.n, r.t) for r in out.collect()}
    for key in "abcd":
        mine = [r for r in rows if r[0] == key]
        for i, r in enumerate(mine):
            assert got[r] == (i + 1, len(mine))


def test_running_count_of_whole_table(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "o int, w int")
    cut = slices(df, [], F.floor(F.col("o") / 10))
    out = running_count(cut.mark(df), [], [F.col("o")], cut, "n", weight=F.col("w"))
    total = 0
    got = {r.o: r.n for r in out.collect()}
    for o, w in sorted(rows):
        total += w
        assert got[o] == total


@pytest.mark.parametrize("hot_rows", [5, 100_000])
@pytest.mark.parametrize("part_size", [3, 10_000])
def test_collect_parts_keeps_every_copy(spark, hot_rows, part_size):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    out = collect_parts(df, ["k"], ["o"], ["v"], F.floor(F.col("o") / 9), part_size, hot_rows).collect()
    for key in "abcd":
        want = [r[2] for r in sorted(r for r in rows if r[0] == key)]
        parts = sorted((r.part, [i.v for i in r["items"]], r.n_total) for r in out if r.k == key)
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(len(p[1]) <= part_size and p[2] == len(want) for p in parts)
        assert sum((p[1] for p in parts), []) == want


@pytest.mark.parametrize("hot_rows", [5, 100_000])
def test_rolling_mean(spark, hot_rows):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, float(rng.randrange(50))) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(3)
    out = rolling_mean(df, ["k"], [F.col("o")], F.floor(F.col("o") / 10), "v", last=5, chunk=6, hot_rows=hot_rows)
    got = {r.o: (r.rolling_avg, r.rolling_runs) for r in out.collect()}
    assert len(got) == len(rows)
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        for i, r in enumerate(mine):
            last = [x[2] for x in mine[max(0, i - 4): i + 1]]
            assert got[r[1]] == (pytest.approx(sum(last) / len(last)), len(last))


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("ratio", [0.0, 0.29, 0.5, 1.0, 1.7, -2])
@pytest.mark.parametrize("boundary_rows", [1, 10_000])
def test_cut_is_exact(spark, ratio, boundary_rows):
    ids = list(range(100))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    picked = {r.id for r in df.filter(cuts.chosen(df, "id", 42, ratio, boundary_rows=boundary_rows)).collect()}
    n = int(100 * max(0.0, min(1.0, ratio)))
    assert picked == set(sorted(ids, key=lambda i: (_md5(f"42|{i}"), i))[:n])


def test_cut_count_out_of_range_takes_all(spark):
    df = spark.range(20)
    assert df.filter(cuts.chosen(df, "id", 1, count=50)).count() == 20
    assert df.filter(cuts.chosen(df, "id", 1, count=-1)).count() == 20
    assert df.filter(cuts.chosen(df, "id", 1, count=7)).count() == 7


def test_cut_does_not_depend_on_partitioning(spark):
    one = spark.range(500).repartition(1)
    eight = spark.range(500).repartition(8)
    a = {r.id for r in one.filter(cuts.chosen(one, "id", 9, 0.3)).collect()}
    assert a == {r.id for r in eight.filter(cuts.chosen(eight, "id", 9, 0.3)).collect()}
    assert len(a) == 150


def test_cut_by_kind(spark):
    df = spark.range(90).withColumn("kind", F.when(F.col("id") < 60, "p").otherwise("n"))
    hit = df.filter(cuts.chosen_by_kind(df, "id", "kind", ["p", "n"], 5, 0.21))
    assert {r.kind: r["count"] for r in hit.groupBy("kind").count().collect()} == {"p": 12, "n": 6}


def _catalog(n_families=12, per_family=5):
    return [(f"f{f}-{i}", f"f{f}") for f in range(n_families) for i in range(per_family + f % 3)]


def _calls(seed=2):
    rng = random.Random(seed)
    apis = [a for a, _ in _catalog()]
    calls = [(w, rng.choice(apis)) for w in range(30) for _ in range(rng.randrange(1, 9))]
    return calls + [(99, a) for a in apis] * 3 + [(98, "f1-0")] * 200


def test_layout_is_dense_and_keeps_families_together(spark):
    rows = _catalog()
    laid = draws.lay_out(spark.createDataFrame(rows, "api string, family string")).collect()
    assert sorted(r.position for r in laid) == list(range(len(rows)))
    for family in {f for _, f in rows}:
        mine = [r for r in laid if r.family == family]
        assert sorted(r.position for r in mine) == list(
            range(mine[0].family_start, mine[0].family_start + mine[0].family_size)
        )


@pytest.mark.parametrize("strict", [False, True])
def test_draws_are_whole_allowed_and_the_same_on_the_hot_path(spark, strict):
    catalog = spark.createDataFrame(_catalog(), "api string, family string")
    tools = spark.createDataFrame(_calls(), "workflow_id int, api string").repartition(5)
    draw = draws.strict_negatives if strict else draws.negative_tools
    results = []
    for hot_rows in (10, 100_000):
        drawn, rejects, _ = draw(tools, catalog, 6, 42, hot_rows=hot_rows)
        results.append((sorted(map(tuple, drawn.collect())), sorted(map(tuple, rejects.collect()))))
    assert results[0] == results[1]
    drawn, rejects = results[0]
    family = dict(_catalog())
    used = {}
    for w, a in _calls():
        used.setdefault(w, set()).add(a)
    got = {}
    for w, i, a, f in drawn:
        got.setdefault(w, []).append((i, a, f))
    rejected = {r[0] for r in rejects}
    assert 99 in rejected
    for w, pos in used.items():
        if strict:
            allowed = [a for a in family if family[a] not in {family[p] for p in pos}]
            wanted, bad = 6, len(allowed) < 6
        else:
            allowed = [a for a in family if a not in pos]
            wanted = 6 - len(pos)
            bad = wanted < 0 or wanted > len(allowed)
        assert (w in rejected) == bad
        mine = sorted(got.get(w, []))
        assert len(mine) == (0 if bad else wanted)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert len({m[1] for m in mine}) == len(mine)
        assert {m[1] for m in mine} <= set(allowed)


def test_draws_cover_the_catalog_evenly(spark):
    catalog = spark.createDataFrame([(f"t{i}", f"f{i % 7}") for i in range(400)], "api string, family string")
    tools = spark.range(3000).select(F.col("id").alias("workflow_id"), F.lit("t0").alias("api"))
    drawn, rejects, _ = draws.negative_tools(tools, catalog, 5, 7)
    assert rejects.count() == 0
    counts = [r["count"] for r in drawn.groupBy("api").count().collect()]
    assert sum(counts) == 3000 * 4 and len(counts) == 399
    expected = 3000 * 4 / 399
    chi2 = sum((c - expected) ** 2 / expected for c in counts)
    assert chi2 < 399 + 5 * (2 * 399) ** 0.5


def test_no_pool_and_idle_workflows(spark):
    catalog = spark.createDataFrame(_catalog(), "api string, family string")
    tools = spark.createDataFrame([(1, "f1-0")], "workflow_id int, api string")
    every = spark.createDataFrame([(1,), (2,)], "workflow_id int")
    drawn, rejects, _ = draws.negative_tools(tools, catalog, -1, 42)
    assert drawn.count() == 0 and rejects.count() == 0
    drawn, _, _ = draws.negative_tools(tools, catalog, 4, 42, workflows=every)
    assert {r.workflow_id: r["count"] for r in drawn.groupBy("workflow_id").count().collect()} == {1: 3, 2: 4}


def test_hot_keys_split_into_even_slices_whatever_their_hour(spark):
    """One key holds half of all rows, all of them inside one second, and half of these at one instant."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") < 20_000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        (1_700_000_000_000_000 + F.when(F.col("id") < 10_000, 7).otherwise(F.col("id") * 13 % 1_000_000)).alias("at"), "id",
    )
    cut = slices(rows, ["k"], [F.col("at"), F.col("id")], 1_000)
    sizes = cut.hot_rows(cut.mark(rows)).groupBy("k", SLICE).count().collect()
    assert {r["k"] for r in sizes} == {"hot"} and sum(r["count"] for r in sizes) == 20_000
    assert max(r["count"] for r in sizes) <= 1_000
    assert sorted(r["count"] for r in sizes)[len(sizes) // 2] >= max(r["count"] for r in sizes) / 2
    counted = running_count(cut.mark(rows), ["k"], [F.col("at"), F.col("id")], cut, "n", total="t")
    window = Window.partitionBy("k").orderBy("at", "id")
    wrong = counted.withColumn("want", F.row_number().over(window)).filter("n <> want or t <> if(k = 'hot', 20000, 40)")
    assert counted.count() == 40_000 and wrong.isEmpty()


def test_a_key_larger_than_one_cut_can_split(spark):
    rows = spark.range(9_000).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 7919 % 9_000).alias("at"))
    cut = slices(rows, ["k"], F.col("at"), 20)
    assert len(cut.levels) > 1
    assert cut.mark(rows).groupBy(SLICE).count().agg(F.max("count")).head()[0] <= 20
    counted = running_count(cut.mark(rows), ["k"], [F.col("at")], cut, "n")
    assert counted.filter("n <> at + 1").isEmpty()


def test_equal_rows_cannot_be_cut_and_nothing_hot_needs_no_cut(spark):
    rows = spark.range(50).select(F.lit("a").alias("k"), F.lit(1).alias("at"))
    cut = slices(rows, ["k"], F.col("at"), 5)
    assert not cut.levels and cut.hot is not None
    assert collect_parts(rows, ["k"], ["at"], ["at"], F.col("at"), part_size=20).count() == 3
    assert hot_keys(rows, ["k"], 50) is None and slices(rows.limit(0), ["k"], F.col("at"), 5).hot is None
    plan = running_count(slices(rows, ["k"], F.col("at")).mark(rows), ["k"], [F.col("at")], slices(rows, ["k"], F.col("at")), "n")
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_tables_are_removed_on_request(spark, tmp_path, monkeypatch):
    from calltrail import session

    monkeypatch.setattr(session, "_scratch_root", lambda _: f"{tmp_path}/application")
    assert session.materialize(spark.range(3), "x").count() == 3
    assert session.scratch_dir(spark, "x") != session.scratch_dir(spark, "x")
    assert len(list(tmp_path.iterdir())) == 1 and session.clear_scratch(spark)
    assert not list(tmp_path.iterdir())
