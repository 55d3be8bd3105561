"""How the sources of a language differ in their words, with exact integer arithmetic.

The counts form a matrix of groups (language, source) and terms, with the frequent terms first, so
that its far end is nearly empty. The matrix is cut into blocks of a fixed number of rows and columns.
A task holds a block as a quadtree (K = 2: each node halves rows and columns) and walks it jointly
for all pairs of groups: a quadrant in which neither side has a count costs its number of columns
times one value, and only columns in which one of the two has a count are looked at. The walk keeps a
bounded frontier. A large vocabulary or a language with many sources gives more blocks, not larger ones.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.llm.ranks import small, with_rank
from calltrail.session import materialize

MIN_DOCS = 10
TOP = 10
ROWS = 64  # groups in a block, a power of two
COLUMNS = 1024  # terms in a block, a power of two
FRONTIER = 1 << 17  # nodes that a walk opens at a time
HELD = 200_000  # counts that a task keeps before it sends them on
SCALE = 1_000_000_000
# A-Z in lower case, other ASCII that is no letter as a blank; bytes of other characters stay
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of it that have it."""
    names = ["lang", "source", "term", "n", "docs"]

    def flush(counts: dict, having: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            k = len(found)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string())]
            columns.append(pa.array([t.decode() for t in found], pa.string()))
            columns.append(pa.array(list(found.values()), pa.int64()))
            columns.append(pa.array([having[lang, source][t] for t in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, having, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in rows:
            for lang, source, text in zip(*(batch.column(c) for c in range(3))):
                found = terms(text.as_py())
                if not found:
                    continue
                key = lang.as_py(), source.as_py()
                before = len(counts[key])
                counts[key].update(found)
                having[key].update(set(found))
                size += len(counts[key]) - before
                if size >= HELD:
                    yield from flush(counts, having)
                    counts, having, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from flush(counts, having)

    made = _named(docs).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a count in whole billionths, from 1 on; exact for counts of any size."""
    wide = [c.cast("decimal(20,0)") for c in (n, total, kept)]
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide[0] + F.lit(2)), wide[1] + F.lit(2) * wide[2])


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Quadtree:
    """The nonzero cells of one block. level[0] are the cells; a node above covers two rows and two columns below."""

    def __init__(self, cells: np.ndarray):
        self.level = [cells]
        while self.level[-1].shape[1] > 1:
            a = self.level[-1]
            if a.shape[0] > 1:
                a = a[0::2] | a[1::2]
            self.level.append(a[:, 0::2] | a[:, 1::2])


def joint_values(a: Quadtree, shares_a: np.ndarray, zero_a: np.ndarray, b: Quadtree, shares_b: np.ndarray, zero_b: np.ndarray,
                 columns: int, same: bool) -> np.ndarray:
    """Summed divergence of every row of block a with every row of block b over the first `columns` columns.

    shares_* hold the shares of the cells, zero_* those of a row's empty cells. With `same`, a and b are one
    block and only values above the diagonal are right.
    """
    total = np.zeros((len(zero_a), len(zero_b)), np.int64)
    top = len(a.level) - 1
    empty = [np.zeros((a.level[k].shape[0], b.level[k].shape[0]), np.int64) for k in range(top + 1)]
    root = np.array([(i, j) for i in range(a.level[top].shape[0]) for j in range(b.level[top].shape[0]) if i <= j or not same])
    open_nodes = [(top, root[:, 0], root[:, 1], np.zeros(len(root), np.int64))]
    while open_nodes:
        k, x, y, c = open_nodes.pop()
        if len(x) > FRONTIER:
            for at in range(0, len(x), FRONTIER):
                open_nodes.append((k, *(v[at : at + FRONTIER] for v in (x, y, c))))
            continue
        inside = (c << k) < columns
        x, y, c = x[inside], y[inside], c[inside]
        counted = a.level[k][x, c] | b.level[k][y, c]
        bare = ~counted
        np.add.at(empty[k], (x[bare], y[bare]), np.minimum(columns - (c[bare] << k), 1 << k))
        x, y, c = x[counted], y[counted], c[counted]
        if k == 0:
            np.add.at(total, (x, y), _divergence(shares_a[x, c], shares_b[y, c]))
            continue
        halves_a = 1 + (a.level[k - 1].shape[0] > a.level[k].shape[0])
        halves_b = 1 + (b.level[k - 1].shape[0] > b.level[k].shape[0])
        parts = [(halves_a * x + i, halves_b * y + j, 2 * c + h) for i in range(halves_a) for j in range(halves_b) for h in (0, 1)]
        x, y, c = (np.concatenate(v) for v in zip(*parts))
        kept = x <= y if same else slice(None)
        open_nodes.append((k - 1, x[kept], y[kept], c[kept]))
    bare = np.zeros_like(total)
    for counts in empty:
        bare += counts.repeat(len(zero_a) // counts.shape[0], 0).repeat(len(zero_b) // counts.shape[1], 1)
    return total + bare * _divergence(zero_a[:, None], zero_b[None, :])


def _block_values(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Values of the pairs of groups of one block: lang, a, b, value."""
    lang, low, high, _ = (k.as_py() for k in key)
    group, column, share_, columns = (table.column(c).to_numpy() for c in ("group_no", "column", "share", "columns"))
    marks = column < 0  # one row for each group of the block: the share of a term it does not have
    width = int(columns[marks].max()) if marks.any() else 0

    def side(block: int) -> tuple[np.ndarray, Quadtree, np.ndarray, np.ndarray]:
        mine = group // ROWS == block
        row = group % ROWS
        groups = np.sort(row[mine & marks])
        height = 1 << int(groups.max(initial=0)).bit_length()
        zero = np.ones(height, np.int64)
        zero[row[mine & marks]] = share_[mine & marks]
        cells = np.zeros((height, COLUMNS), bool)
        shares = np.repeat(zero[:, None], COLUMNS, 1)
        at = mine & ~marks
        cells[row[at], column[at]] = True
        shares[row[at], column[at]] = share_[at]
        return groups, Quadtree(cells), shares, zero

    same = low == high
    groups_a, *block_a = side(low)
    groups_b, *block_b = (groups_a, *block_a) if same else side(high)
    values = joint_values(*block_a, *block_b, width, same)
    a, b = np.repeat(groups_a, len(groups_b)), np.tile(groups_b, len(groups_a))
    if same:
        a, b = a[a < b], b[a < b]
    return pa.table(
        {"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a + low * ROWS, pa.int64()),
         "b": pa.array(b + high * ROWS, pa.int64()), "value": pa.array(values[a, b], pa.int64())}
    )


def _pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value of every two groups of a language, a < b as group numbers.

    cells(lang, group_no, n_groups, term_no, share), groups(lang, group_no, n_groups, zero_share, n_terms).
    """
    columns = ["lang", "low", "high", "block", "group_no", "column", "share", "columns"]
    own, other = F.floor(F.col("group_no") / ROWS), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / ROWS)))
    counted = cells.select("*", other.alias("_other")).select(
        "lang", F.least(own, "_other").alias("low"), F.greatest(own, "_other").alias("high"),
        F.floor(F.col("term_no") / COLUMNS).alias("block"), "group_no", (F.col("term_no") % COLUMNS).alias("column"), "share",
        F.lit(0).cast("bigint").alias("columns"),
    )
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n_terms") - 1) / COLUMNS), F.lit(0))))
    marks = groups.select("*", other.alias("_other")).select("*", blocks.alias("block")).select(
        "lang", F.least(own, "_other").alias("low"), F.greatest(own, "_other").alias("high"), "block", "group_no",
        F.lit(-1).cast("bigint").alias("column"), F.col("zero_share").alias("share"),
        F.least(F.col("n_terms") - F.col("block") * COLUMNS, F.lit(COLUMNS)).cast("bigint").alias("columns"),
    )
    rows = counted.select(*columns).unionByName(marks.select(*columns))
    values = rows.groupBy("lang", "low", "high", "block").applyInArrow(_block_values, "lang string, a bigint, b bigint, value bigint")
    return values.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source) of `docs`(lang, source, text).

    Part `pair`: the other sources of the language by how far the group's shares of the kept terms are from
    theirs; every other source has a row, 0 where the language keeps no term. Part `term`: the `top` terms
    that the group uses more than its language does. A language keeps the terms of at least `min_docs` of its
    documents. Null text, lang and source count as empty; each row is a document, repeated rows too. A group
    without terms has pairs and no terms, a language with one source no pairs, an empty table no rows. Ties
    go by the UTF-8 order of the item. Other columns are not read.
    """
    cells = materialize(count_terms(docs), "term-counts")
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    numbered = with_rank(kept.withColumn("rare", -F.col("docs")), ["rare", "term"], group="lang", rank="term_no", label="terms")
    vocabulary = numbered.select("lang", "term", "lang_n", "term_no")
    counted = materialize(cells.join(vocabulary, ["lang", "term"]).drop("docs"), "kept-counts")

    languages = counted.groupBy("lang").agg(F.sum("n").alias("lang_total"), (F.max("term_no") + 1).alias("n_terms"))
    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    present = _named(docs).select("lang", "source").distinct()
    group_rows = present.join(sizes, ["lang", "source"], "left").join(small(languages), "lang", "left")
    group_rows = group_rows.fillna(0, ["total", "lang_total", "n_terms"])
    groups = with_rank(group_rows, ["source"], group="lang", total="n_groups", rank="group_no", label="groups")
    none = F.col("n_terms") == 0
    zero = F.when(none, F.lit(1)).otherwise(share(F.lit(0), F.col("total"), F.col("n_terms")))
    groups = materialize(groups.withColumn("zero_share", zero.cast("bigint")), "numbered-groups")

    own = share(F.col("n"), F.col("total"), F.col("n_terms")).cast("bigint")
    cells = materialize(counted.join(small(groups), ["lang", "source"]).withColumn("share", own), "shares")
    expected = share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).cast("bigint")
    above = cells.withColumn("expected", expected).where("share > expected")
    told = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("share"), F.col("expected")).alias("value"))

    pairs = _pair_values(cells, groups)
    both = pairs.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p"))
    names = {c: small(groups.select("lang", F.col("group_no").alias(f"_{c}"), F.col("source").alias(c))) for c in ("source", "item")}
    apart = both.select("lang", "value", F.col("_p.a").alias("_source"), F.col("_p.b").alias("_item"))
    apart = apart.join(names["source"], ["lang", "_source"]).join(names["item"], ["lang", "_item"])
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(best)) for part in (told, apart)]
    ranked[0] = ranked[0].where(F.col("rank") <= top)  # each task keeps its first rows of a group before the shuffle
    return ranked[0].unionByName(ranked[1])


ORACLE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
tokens AS (SELECT doc, lang, source, unnest(words) AS term FROM rows),
vocabulary AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
languages AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM rows),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY lang, source),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS p,
         1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS q
  FROM groups JOIN vocabulary USING (lang) JOIN languages USING (lang)
  LEFT JOIN counted USING (lang, source, term) LEFT JOIN sizes USING (lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
told AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN pair_values USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10"""
