"""Near copies among embeddings: small-world graphs per shard, exact cosines, components.

Equal vectors are one class. Classes are dealt to shards of a fixed expected size by a hash, so no group
of near copies fills a shard, and each shard gets a graph. Every vector queries every shard: two shards meet
in one task, which searches the graph of each with the vectors of the other, so a link that one direction
misses may be found by the other. A beam is widened until a sample of the queries, compared with the whole
shard, finds the links it should; the samples of all tasks are added up, and too low a sum widens all beams.

A large group of near copies is walked in full, but only counts of links and a spanning forest leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.llm.components import components
from calltrail.llm.graph import Graph
from calltrail.llm.ranks import small
from calltrail.session import materialize

LEAST = 0.95
SLACK = 1e-3  # how far below the threshold single precision may put a pair that is then verified
SHARD_ROWS = 8192  # vectors of a shard; a task holds two shards and a table of their pairs of one byte each
BEAM = 2
RECALL = 0.99  # of the links of the sampled queries
SAMPLED = 256  # queries of each task that are compared with the whole shard
BATCH = 256  # queries searched at a time

_SHARD = "dim int, shard bigint, n_shards bigint, single boolean, ids binary, classes binary, sizes binary, vectors binary, layers array<binary>"
_FOUND = "kind int, a bigint, b bigint, width int"


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The vectors of a shard and the graph over them, in the graph's order."""
    column = rows.column("embedding").combine_chunks()
    single = column.type.value_type == pa.float32()
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    order = np.argsort(rows.column("class").to_numpy(), kind="stable")
    raw = raw[order]
    graph = Graph.build(_units(raw).astype(np.float32))
    blobs = [rows.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("id", "class", "n")]
    values = [key[0].as_py(), key[1].as_py(), rows.column("n_shards")[0].as_py(), single, *blobs, raw.astype("<f4" if single else "<f8").tobytes()]
    names = ["dim", "shard", "n_shards", "single", "ids", "classes", "sizes", "vectors"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
    arrays = [pa.array([v], kind) for v, kind in zip(values, kinds)]
    layers = pa.array([[layer.astype("<i4").tobytes() for layer in graph.links]], pa.list_(pa.binary()))
    return pa.Table.from_arrays([*arrays, layers], names=[*names, "layers"])


class _Shard:
    def __init__(self, row: dict):
        self.ids, self.classes, self.sizes = (np.frombuffer(row[c], "<i8") for c in ("ids", "classes", "sizes"))
        raw = np.frombuffer(row["vectors"], "<f4" if row["single"] else "<f8").reshape(len(self.ids), row["dim"])
        self.exact = _units(raw)
        self.near = self.exact.astype(np.float32)
        links = [np.frombuffer(b, "<i4") for b in row["layers"]]
        self.graph = Graph(self.near, [v.reshape(-1, 32 if k == 0 else 16) for k, v in enumerate(links)])

    def verified(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray, least: float) -> np.ndarray:
        good = np.empty(len(row), bool)
        for at in range(0, len(row), 1 << 17):
            part = slice(at, at + (1 << 17))
            good[part] = np.einsum("nd,nd->n", queries[row[part]], self.exact[node[part]]) >= least
        return good


def _search(found: np.ndarray, queries: _Shard, shard: _Shard, width: int, least: float) -> tuple[int, int, int]:
    """Marks in found[query, node] the links that the graph of `shard` gives; links of the sample, those found, and the beam."""
    sample = np.unique(np.linspace(0, len(queries.ids) - 1, SAMPLED).astype(np.int64))
    truth = queries.exact[sample] @ shard.exact.T >= least
    same = queries is shard
    if same:
        truth[np.arange(len(sample)), sample] = False
    wanted = int(truth.sum())
    while True:
        row, node = shard.graph.search(queries.near[sample], width, least - SLACK)
        got = int(truth[row, node].sum())
        if got >= RECALL * wanted or width >= len(shard.ids):
            break
        width = min(2 * width, len(shard.ids))
    for at in range(0, len(queries.ids), BATCH):
        row, node = shard.graph.search(queries.near[at : at + BATCH], width, least - SLACK)
        good = shard.verified(queries.exact[at : at + BATCH], row, node, least)
        found[row[good] + at, node[good]] = True
    return wanted, got, width


def spanning(found: np.ndarray, offset: int) -> list[tuple[int, int]]:
    """A spanning forest of the links found[i, j] between nodes i and offset + j."""
    root = np.arange(max(found.shape[0], offset + found.shape[1]))
    edges = []
    for i in np.flatnonzero(found.any(axis=1)):
        near = np.flatnonzero(found[i]) + offset
        roots, first = np.unique(root[near], return_index=True)
        new = roots != root[i]
        if new.any():
            edges += [(int(i), int(j)) for j in near[first[new]]]
            root[np.isin(root, roots[new])] = root[i]
    return edges


def _compare(least: float, width: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sides = [_Shard(row) for row in sorted(rows.to_pylist(), key=lambda r: r["shard"])]
        a, b = sides[0], sides[-1]
        found = np.zeros((len(a.ids), len(b.ids)), bool)
        audits = [_search(found, a, b, width, least)]
        if a is b:
            found |= found.T
            np.fill_diagonal(found, False)
        else:
            audits.append(_search(found.T, b, a, width, least))
        counts_a, counts_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        for at in range(0, len(a.ids), BATCH):
            i, j = np.nonzero(found[at : at + BATCH])
            np.add.at(counts_a, i + at, b.sizes[j])
            np.add.at(counts_b, j, a.sizes[i + at])
        offset = 0 if a is b else len(a.ids)
        out = [(0, side.classes, n) for side, n in ((a, counts_a), (b, counts_b))[: 1 if a is b else 2]]
        columns = [[], [], [], []]
        for kind, classes, n in out:
            linked = n > 0
            for column, values in zip(columns, (np.full(linked.sum(), kind), classes[linked], n[linked], np.zeros(linked.sum(), int))):
                column.extend(values.tolist())
        for i, j in spanning(found, offset):
            for column, value in zip(columns, (1, int(a.ids[i]), int(b.ids[j - offset]), 0)):
                column.append(value)
        for wanted, got, used in audits:
            for column, value in zip(columns, (2, wanted, got, used)):
                column.append(value)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "a", "b", "width"])

    return run


def linked_classes(vectors: DataFrame, least: float = LEAST, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """(classes, found) of `vectors`(vec_id, embedding), all of them valid.

    classes(embedding, id, n, class): equal vectors, their least id and how many they are. found(kind, a, b, width):
    kind 0 is a class with the vectors of other classes linked to it, counted in one pair of shards; 1 a link
    of a spanning forest, as ids; 2 an audit: links of the sample, those found, and the beam.
    """
    equal = vectors.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(equal.withColumn("dim", F.size("embedding")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("n_shards"))
    dealt = classes.join(small(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("class"), "n_shards"))
    shards = materialize(dealt.groupBy("dim", "shard").applyInArrow(_build, _SHARD), "shards")
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_shards") - 1))
    met = shards.select("*", others.alias("_other")).withColumns({"low": F.least("shard", "_other"), "high": F.greatest("shard", "_other")})
    while True:
        found = materialize(met.groupBy("dim", "low", "high").applyInArrow(_compare(least, beam), _FOUND), "vector-links")
        wanted, got = found.where("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).head()
        if got >= RECALL * wanted or beam >= 2 * shard_rows:
            return classes.select("embedding", "id", "n", "class"), found
        beam *= 2


def similar_vectors(table: DataFrame, least: float = LEAST, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `table`(vec_id, embedding).

    Two rows link when the cosine of their vectors is `least` or more in double precision; equal vectors always do.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, vectors of different
    lengths do not link. Rows that share a vec_id are compared as rows and named by that id; rows without one link
    with nothing, have no component and are kept. An empty table gives no rows. Other columns are not read.
    """
    kind = table.schema["embedding"].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = table.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(f"array<{element}>"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    classes, found = linked_classes(rows.where(valid), least, shard_rows, beam)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("linked"))
    labels = components(found.where("kind = 1").select("a", "b"))
    named = classes.join(counts, "class", "left").join(labels, "id", "left").select(
        F.col("embedding").alias("_of"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    good = rows.where(valid).join(named, F.col("embedding") == F.col("_of")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    told = good.unionByName(alone)
    return told.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(found: DataFrame) -> DataFrame:
    """wanted, found, beam: links of the sampled queries, those that the graphs gave, and the widest beam."""
    return found.where("kind = 2").agg(F.sum("a").alias("wanted"), F.sum("b").alias("found"), F.max("width").alias("beam"))
