"""Similarity join of documents on word shingles by prefix filters under several global orders.

A global order sorts the shingles of every document alike. Two sets with a Jaccard similarity of t
share a shingle among the first n - ceil(t n) + 1 of each, whatever the order. One order builds the
index; a candidate pair must also share prefix shingles under the other orders before its sets are
compared. All orders begin with the shingles that no other set has, as far as a bitmap of fixed size
tells, and end with the most frequent ones. The first kind never enters the index, so documents
without a near copy leave almost nothing there.

Equal sets are one class. A list entry knows how many tokens of its set follow in the order: the first
token that two sets share leaves no more common tokens than the smaller of these numbers, so most
entries of a list cannot pair. Of those that can, the members of a list are first compared with the one
whose shingles are most frequent, then with each other as far as they are still unconnected. So a
large group of near copies costs comparisons in proportion to its size, and no link between components
is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.llm.components import components
from calltrail.llm.ranks import each_text, fresh, freeing, small, small_batches
from calltrail.session import materialize

WIDTH = 5
PERCENT = 75
HEAVY = 1 << 16  # frequent shingles that the orders put last; bounds the broadcast, not the join
SHARDS = 256  # parts of the 32-bit space in which shingles are looked for twice
MAP_BITS = 27  # the bitmap of shingles that may be shared has 2^27 bits, 16 MB, at any corpus size
CHUNK = 1 << 20  # shingles counted at a time in a task
CHUNK_HEAVY = 1 << 14  # frequent shingles that a task names for each chunk
BLOOM_BITS = 1 << 26
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # one odd multiplier per order
_MIX = np.array([0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_WORDS_KEPT = 100_000  # words whose hashes a worker remembers; the memory starts anew beyond it
_SETS_KEPT = 200_000  # sets a task remembers to have seen; more only means repeated rows
_words: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    if len(_words) > _WORDS_KEPT:
        _words.clear()
    try:
        codes = list(map(_words.__getitem__, words))
    except KeyError:
        for w in set(words).difference(_words):
            _words[w] = xxhash.xxh3_64_intdigest(w)
        codes = list(map(_words.__getitem__, words))
    a = np.array(codes, np.uint64)
    h = a[: n - WIDTH + 1] * _MIX[0]
    for k in range(1, WIDTH):
        h += a[k : n - WIDTH + 1 + k] * _MIX[k]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n that decide whether it can have a similar set."""
    return n - -(-percent * n // 100) + 1


def _spots(tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens in a space of 32 bits."""
    return ((tokens * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)


class Order:
    """What the global orders know of tokens: a bitmap of those that may be shared, and weights of frequent ones.

    Any bitmap and weights give right results, as all documents are sorted by the same ones.
    """

    def __init__(self, bitmap: np.ndarray, heavy: np.ndarray, weight: np.ndarray):
        self.bitmap, self.heavy, self.weight = bitmap, heavy, weight

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        spot = _spots(tokens) >> np.uint32(32 - MAP_BITS)
        return (self.bitmap[spot >> np.uint32(3)] >> (np.uint32(7) - (spot & np.uint32(7))).astype(np.uint8)) & np.uint8(1) > 0

    def weights(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of frequent tokens, 0 for others."""
        if not len(self.heavy):
            return np.zeros(len(tokens), np.int64)
        at = np.searchsorted(self.heavy, tokens)
        at[at == len(self.heavy)] = 0
        return np.where(self.heavy[at] == tokens, self.weight[at], 0)

    def prefix(self, tokens: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
        """The tokens of the prefix that may be shared with another set, in order; the others cannot meet any."""
        size = prefix_size(len(tokens), percent)
        shared = tokens[self.shared(tokens)]
        size -= len(tokens) - len(shared)
        if size <= 0:
            return shared[:0]
        mixed = shared * np.uint64(ORDERS[order])
        mixed ^= mixed >> np.uint64(32)
        return shared[np.lexsort((mixed, self.weights(shared)))[:size]]

    def rank(self, tokens: np.ndarray) -> float:
        """How much a set is made of frequent and shared tokens: the original of near copies leads its list."""
        return round(float(np.log1p(self.weights(tokens)).mean() + 0.01 * self.shared(tokens).mean()), 9)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct 24-bit numbers as their differences: two bytes each, or four where one is too large."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    wide = len(gaps) > 0 and gaps.max() > 0xFFFF
    return (b"4" if wide else b"2") + gaps.astype("<u4" if wide else "<u2").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    at = np.cumsum(np.frombuffer(blob, "<u4" if blob[:1] == b"4" else "<u2", offset=1), dtype=np.uint32)
    at += np.arange(len(at), dtype=np.uint32)
    return at


def _classes(docs: DataFrame) -> DataFrame:
    """Three kinds of rows from one pass, told apart by `kind`.

    0: doc_id, n, key, class_id of a document; key is a 128-bit hash of its set and class_id a 64-bit
    one, both null without words. 1: class_id and n of a shingle that is frequent in a chunk. 2: n is a
    shard of the 32-bit space, key and more the places there that a chunk has, and has at least twice.
    """
    names = ["kind", "doc_id", "n", "key", "class_id", "more"]

    def batch_of(kind: int, ids: pa.Array, n: pa.Array, keys: pa.Array, classes: pa.Array, more: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), ids, n, keys, classes, more], names=names)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(held)
        values, times = np.unique(tokens, return_counts=True)
        often = np.flatnonzero(times >= 3)
        often = often[np.argsort(-times[often], kind="stable")[:CHUNK_HEAVY]]
        no_ids, no_keys = pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.binary())
        yield batch_of(1, no_ids, pa.array(times[often], pa.int64()), no_keys, _longs(values[often]), no_keys)
        spots, times = np.unique(_spots(tokens), return_counts=True)
        edges = np.searchsorted(spots, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(24))
        low, twice = spots & np.uint32(0xFFFFFF), times > 1
        parts = [slice(edges[k], edges[k + 1]) for k in range(SHARDS)]
        once = pa.array([packed(low[part]) for part in parts], pa.binary())
        again = pa.array([packed(low[part][twice[part]]) for part in parts], pa.binary())
        none = pa.nulls(SHARDS, pa.int64())
        yield batch_of(2, none, pa.array(range(SHARDS), pa.int64()), once, none, again)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[bytes] = set()
        for batch in rows:
            sizes, keys, classes = [], [], []
            for text in each_text(batch.column(1)):
                tokens = shingles(text)
                raw = tokens.tobytes()
                key = xxhash.xxh3_128_digest(raw) if len(tokens) else None
                sizes.append(len(tokens))
                keys.append(key)
                classes.append(xxhash.xxh3_64_intdigest(raw) if len(tokens) else None)
                if key is not None and key not in seen:
                    if len(seen) < _SETS_KEPT:
                        seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                    if size >= CHUNK:
                        yield from flush(held)
                        held, size = [], 0
            signed = np.array([c or 0 for c in classes], np.uint64).view(np.int64)
            none = np.array([c is None for c in classes], bool)
            yield batch_of(
                0, batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(signed, pa.int64(), mask=none), pa.nulls(len(sizes), pa.binary()),
            )
        if held:
            yield from flush(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        freeing(run, _words), "kind int, doc_id bigint, n bigint, key binary, class_id bigint, more binary"
    )


def _order(rows: DataFrame) -> Order:
    """The bitmap of shingles in two sets, and the most frequent shingles with their counts.

    A shard's places stream through one task that keeps a counter of fixed size; a copy of a set in
    another task, or two shingles in one place, may set a bit in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for shard, counter in state.items():
                bits = (counter > 1).reshape(-1, 1 << (32 - MAP_BITS)).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["shard", "bits"])
            state.clear()

        for batch in batches:
            for i in range(batch.num_rows):  # a row's bytes at a time
                shard, once, again = (batch.column(c)[i].as_py() for c in range(3))
                if shard not in state:
                    yield from done()
                    state[shard] = np.zeros(1 << 24, np.uint8)
                counter = state[shard]
                at = unpacked(once)
                counter[at] = np.minimum(counter[at] + 1, 2)
                counter[unpacked(again)] = 2
        yield from done()

    parts = rows.where("kind = 2").select("n", "key", "more").repartition("n").sortWithinPartitions("n")
    slices = parts.mapInArrow(freeing(run), "shard bigint, bits binary").toPandas()  # one slice of fixed size per shard
    width = (1 << MAP_BITS) // 8 // SHARDS
    bitmap = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for shard, bits in zip(slices["shard"], slices["bits"]):
        bitmap[shard * width : (shard + 1) * width] = np.frombuffer(bits, np.uint8)
    counts = rows.where("kind = 1").groupBy("class_id").agg(F.sum("n").alias("times"))
    top = counts.orderBy(F.desc("times"), "class_id").limit(HEAVY).toPandas()
    values = top["class_id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return Order(bitmap, values[order], top["times"].to_numpy(np.int64)[order])


def _index(docs: DataFrame, shared) -> DataFrame:
    """(token, class_id, n, left, rank) of the prefixes under the first order; left counts the tokens from this one on."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        seen: set[int] = set()
        names = ["token", "class_id", "n", "left", "rank"]
        for batch in rows:
            chosen, classes, sizes, left, ranks = [], [], [], [], []
            for text in each_text(batch.column(0)):
                tokens = shingles(text)
                part = order.prefix(tokens, 0) if len(tokens) else tokens
                if not len(part):
                    continue
                class_id = xxhash.xxh3_64_intdigest(tokens.tobytes())
                if class_id in seen:
                    continue
                if len(seen) < _SETS_KEPT:
                    seen.add(class_id)
                k = len(part)
                chosen.append(part)
                classes.append(np.full(k, class_id, np.uint64))
                sizes.append(np.full(k, len(tokens), np.int64))
                left.append(int(order.shared(tokens).sum()) - np.arange(k))
                ranks.append(np.full(k, order.rank(tokens)))
            if chosen:
                columns = [_longs(np.concatenate(chosen)), _longs(np.concatenate(classes))]
                columns += [pa.array(np.concatenate(c), t) for c, t in ((sizes, pa.int64()), (left, pa.int64()), (ranks, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = docs.where("doc_id is not null").select("text").mapInArrow(
        freeing(run, _words), "token bigint, class_id bigint, n bigint, left bigint, rank double"
    )
    return materialize(made, "index")


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the hashes of `ids`(id); the tasks' bitmaps meet in the driver a few at a time."""
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)).alias("bit")).distinct()
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("mask"))
    found = words.toPandas()
    bitmap = np.zeros(BLOOM_BITS // 32, np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return bitmap


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, class_id, n, tokens) of the sets in `wanted`(id, class_id), computed from the texts.

    A bitmap of fixed size holds back most other texts; a join drops the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(BLOOM_BITS)).alias("bit")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in rows:
            bits = batch.column(2).to_numpy()
            passed = np.flatnonzero((bitmap[bits >> 5] >> (bits & 31)) & 1)
            if not len(passed):
                continue
            found = [shingles(t) for t in each_text(batch.column(1).take(pa.array(passed)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(passed)).cast(pa.int64()),
                    _longs(np.array([xxhash.xxh3_64_intdigest(t.tobytes()) for t in found], np.uint64)),
                    pa.array([len(t) for t in found], pa.int64()),
                    pa.array([t.tobytes() for t in found], pa.binary()),
                ],
                names=["id", "class_id", "n", "tokens"],
            )

    rows = docs.where("doc_id is not null").select("doc_id", "text", bit)
    made = rows.mapInArrow(freeing(run, _words), "id bigint, class_id bigint, n bigint, tokens binary")
    # an id may stand with several texts, and with one several times; each wanted set is kept once
    return materialize(made.join(small(wanted), ["id", "class_id"], "left_semi").dropDuplicates(["id", "class_id"]), "sets")


def _may_link(n_a: Column, left_a: Column, n_b: Column, left_b: Column) -> Column:
    """Whether sets of n_a and n_b tokens can be similar if they share none before the last left_a and left_b of them."""
    most = F.least(left_a, left_b)
    return 100 * most >= PERCENT * (n_a + n_b - most)


def _links(pairs: DataFrame, sets: DataFrame, shared) -> DataFrame:
    """The pairs (a, b) of `pairs`, class ids, whose sets pass the filters of all orders and then the exact test: a, b as document ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in rows:
            kept = []
            for i, pair in enumerate(zip(batch.column(2), batch.column(3))):  # a pair's bytes at a time
                s, t = (np.frombuffer(side.as_buffer(), np.uint64) for side in pair)
                if all(_common(np.sort(order.prefix(s, o)), np.sort(order.prefix(t, o))) for o in range(1, len(ORDERS))):
                    common = _common(s, t)
                    if 100 * common >= PERCENT * (len(s) + len(t) - common):
                        kept.append(i)
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept)) for c in (0, 1)], names=["a", "b"])

    side = {k: sets.select(F.col("id").alias(f"id_{k}"), F.col("class_id").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in "ab"}
    # the pairs go to the sets, not the sets to the pairs, while they are few
    both = side["a"].join(small(pairs), "a").join(side["b"], "b").where("id_a <> id_b")
    return both.select("id_a", "id_b", "tokens_a", "tokens_b").mapInArrow(freeing(run), "a bigint, b bigint")


def _common(s: np.ndarray, t: np.ndarray) -> int:
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return 0
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int(np.count_nonzero(t[at] == s))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size of every row.

    component_id is the smallest doc_id that links reach; class_size counts the rows with an equal
    set. A null text, or one without words, has no shingles, links with nothing and has class_size
    null. Rows with a null doc_id get a null component and link nothing. Rows that share a doc_id
    are compared by their texts and named by that id. An empty table gives no rows. Other columns
    are not read.
    """
    with small_batches(docs.sparkSession):
        return _similar(docs)


def _similar(docs: DataFrame) -> DataFrame:
    rows = materialize(_classes(docs), "classes")
    told = rows.where("kind = 0").select("doc_id", "n", "key", "class_id")
    classes = materialize(
        told.where("key is not null and doc_id is not null").groupBy("key", "class_id")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("class_size")), "representatives",
    )
    labels = _labels(docs, classes, _order(rows))
    named = classes.join(labels, "id", "left").select(
        F.col("key").alias("of"), F.coalesce("component", "id").alias("component"), "class_size"
    )
    # an id with several texts is in several classes; the join is on the set
    joined = told.join(named, F.col("key") == F.col("of"), "left")
    alone = F.when(F.col("key").isNull(), F.col("doc_id"))
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), alone))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"), "class_size")


def _labels(docs: DataFrame, classes: DataFrame, order: Order) -> DataFrame:
    """id, component of the class representatives that link with another."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    index = _index(docs, shared)
    lead = F.max(F.struct("rank", "class_id", "n", "left")).alias("lead")
    heads = index.groupBy("token").agg(lead, F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high")
    own = index.join(heads.select("token", "lead"), "token").dropDuplicates(["token", "class_id"])
    lists = materialize(own, "lists")
    stars = lists.where("class_id <> lead.class_id").where(_may_link(F.col("n"), F.col("left"), F.col("lead.n"), F.col("lead.left")))
    stars = materialize(stars.select(F.col("lead.class_id").alias("a"), F.col("class_id").alias("b")).distinct(), "star-pairs")
    wanted = materialize(lists.select("class_id").distinct().join(classes.select("id", "class_id"), "class_id"), "wanted")
    sets = _sets(docs, wanted)
    links = materialize(_links(stars, sets, shared), "links")
    first_labels = components(links)
    of_class = materialize(classes.join(first_labels, "id", "left").select("class_id", F.coalesce("component", "id").alias("label")), "labels")
    labelled = lists.join(of_class, "class_id").select("token", "class_id", "n", "left", "label")
    open_lists = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rest = materialize(labelled.join(open_lists.select("token"), "token", "left_semi"), "open-lists")
    sides = [rest.select(*[F.col(c).alias(f"{c}_{k}") for c in ("token", "class_id", "n", "left", "label")]) for k in "ab"]
    apart = (F.col("class_id_a") < F.col("class_id_b")) & (F.col("label_a") != F.col("label_b"))
    may = _may_link(*(F.col(c) for c in ("n_a", "left_a", "n_b", "left_b")))
    met = sides[0].join(sides[1], (F.col("token_a") == F.col("token_b")) & apart & may)
    across = met.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).distinct()
    # stars put the leading class first, whatever its number
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = materialize(across.join(tested, ["a", "b"], "left_anti"), "open-pairs")
    more = materialize(_links(across, sets, shared), "links")
    return components(links.unionByName(more))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, with all their columns.

    Rows with a null doc_id stay. Rows that share a doc_id are one document: they stay or go together
    when their texts do not differ.
    """
    judged = similar_documents(docs).where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    gone = materialize(judged, "near-copies")
    name = fresh(docs, "_gone")
    return docs.join(small(gone.select(F.col("doc_id").alias(name))), F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END)) AS s FROM words),
classes AS (SELECT s, min(doc_id) AS id, count(*) AS class_size, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT id, n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.id AS a, b.id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
labels AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, class_size
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN labels USING (id)"""
