"""Near copies of vectors against brute force."""

import numpy as np
import pytest

from calltrail.llm import embeddings
from calltrail.llm.graph import Graph

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows, least=0.95):
    """vec_id -> (n_links, component), from all pairs."""
    ids = [r[0] for r in rows]
    vectors = []
    for _, v, *_ in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.asarray(np.asarray(v, np.float32), float) if good else None)
    links = [[] for _ in rows]
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            if i != j and x is not None and y is not None and len(x) == len(y):
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[i].append(j)
    component = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component[i] = min(ids[j] for j in seen)
    return {ids[i]: (len(links[i]), component[i]) for i in range(len(rows))}


def planted(seed, n, dim=16, groups=6):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        rows.append(rng.standard_normal(dim))
    for g in range(groups):
        base = rng.standard_normal(dim)
        rows += [base + 0.07 * rng.standard_normal(dim) for _ in range(3 ** (g % 5))]
        rows += [base] * g
    rng.shuffle(rows)
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)]


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_links_and_components_equal_brute_force(spark, shard_rows):
    rows = planted(3, 300)
    got = embeddings.similar_vectors(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == exact(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors_clashing_columns_and_empty_tables(spark):
    base = [1.0, 2.0, 3.0]
    rows = [
        (1, base), (2, base), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, -0.0, 0.0]), (7, [1.0, None, 3.0]),
        (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (None, base), (10, [1.0, 2.0]), (11, [0.5, 1.0]),
        (12, [-1.0, -2.0, -3.0]), (13, [3e38, 3e38, 3e38]), (14, [1e-40, 1e-40, 1e-40]),
    ]
    wide = [(i, v, "x", 1, 2) for i, v in rows]
    table = spark.createDataFrame(wide, "vec_id bigint, embedding array<float>, class string, id int, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.similar_vectors(table).collect()}
    assert got.pop(None) == (0, None)
    assert got == exact([r for r in rows if r[0] is not None])
    assert embeddings.similar_vectors(table.limit(0)).count() == 0


def test_doubles_and_repeated_ids(spark):
    table = spark.createDataFrame([(1, [1e200, 1.0]), (1, [1e200, 1.0]), (2, [1.0, 1e200])], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in embeddings.similar_vectors(table).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def _recall(spark, vectors, **kw):
    """Links of `vectors` by the operator, and by brute force."""
    unit = np.asarray(np.asarray(vectors, np.float32), float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    truth = unit @ unit.T >= kw.get("least", embeddings.LEAST)
    np.fill_diagonal(truth, False)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    return embeddings.similar_vectors(rows, **kw).agg({"n_links": "sum"}).head()[0], int(truth.sum())


def _given(spark):
    return np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)


def test_recall_of_near_copies_of_the_given_vectors(spark):
    """Copies with noise, so that most cosines are near the threshold, with the operator's own parameters but for the shards."""
    rng, vectors = np.random.default_rng(2), _given(spark)
    scale = 0.22 * np.linalg.norm(vectors, axis=1, keepdims=True) / 8
    copies = np.concatenate([vectors + scale * rng.standard_normal(vectors.shape) for _ in range(3)])
    found, wanted = _recall(spark, np.concatenate([vectors, copies]), shard_rows=2000)
    assert wanted > 5000 and 0.99 * wanted <= found <= wanted


def test_recall_of_links_far_below_the_threshold(spark):
    """At a cosine of 0.5 the given vectors link by chance only, the hardest case for a graph; a wider first beam finds them."""
    found, wanted = _recall(spark, _given(spark), least=0.5, shard_rows=500, beam=8)
    assert wanted > 20 and 0.9 * wanted <= found <= wanted


def test_a_group_larger_than_the_beam_is_walked_whole():
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    rows = np.concatenate([rng.standard_normal((700, 32)), base + 0.03 * rng.standard_normal((900, 32))])
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(1600)]
    row, node = Graph.build(rows).search(rows, 8, 0.95)
    truth = rows @ rows.T >= 0.95
    found = np.zeros_like(truth)
    found[row, node] = True
    assert truth.sum() > 700_000 and (found & truth).sum() >= 0.99 * truth.sum()


def test_spanning_forest_keeps_components():
    rng = np.random.default_rng(6)
    for _ in range(50):
        found = rng.random((7, 9)) < 0.15
        edges = embeddings.spanning(found, 7)
        label = list(range(16))
        for i, j in np.argwhere(found):
            old, new = label[j + 7], label[i]
            label = [new if x == old else x for x in label]
        again = list(range(16))
        for i, j in edges:
            assert found[i, j - 7] and again[i] != again[j]
            old, new = again[j], again[i]
            again = [new if x == old else x for x in again]
        assert [[x == y for x in label] for y in label] == [[x == y for x in again] for y in again]
