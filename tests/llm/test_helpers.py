import random

from calltrail.llm.components import components
from calltrail.llm.ranks import fresh, with_rank


def test_rank_counts_inside_groups_and_over_all(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, _row int")
    got = with_rank(df, ["v", "_row"], group="g", total="all").collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r] = (k, sum(q[0] == g for q in rows))
    assert {(r.g, r.v, r._row): (r["rank"], r["all"]) for r in got} == want
    whole = sorted(r["rank"] for r in with_rank(df, ["v"]).collect())
    assert whole == list(range(500))
    assert with_rank(df.limit(0), ["v"], group="g").count() == 0


def test_fresh_names_avoid_any_case(spark):
    assert fresh(spark.createDataFrame([(1, 2)], "_X int, _x_ int"), "_x") == "_x__"


def test_components_equal_union_find(spark):
    draw = random.Random(5)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (7, 9), (9, 7)]
    links += [(5000, 5001 + i) for i in range(100)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
