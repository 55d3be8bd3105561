"""Seeded choices of an exact number of rows, without sorting the table.

Rows are ranked by md5 of (seed, key). The cut is a single (hash, key) value: everything up
to it is chosen. It is found by counting rows per hash prefix and looking only into the
prefix that the cut falls in, so the final plan is a plain filter on the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDARY_ROWS = 10_000
STEP = 4


def hash_rank(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _narrow(df: DataFrame, prefix: str, target: Callable[[Column], Column]):
    """The next hash prefix that row number `target`(rows) falls in, its rows, and how many of them.

    One scan; at most 16**STEP rows reach the window.
    """
    depth = len(prefix) + STEP
    counts = (
        df.filter(F.col("_h").startswith(prefix))
        .groupBy(F.substring("_h", 1, depth).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(all_rows))
    goal = target(F.col("total"))
    here = (F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal)
    return placed.filter(here).select("p", "n", (goal - F.col("upto") + F.col("n")).alias("left")).head()


def _cut_value(df: DataFrame, target: Callable[[Column], Column], boundary_rows: int):
    """Row with the hash and key of the target-th row in hash order, None if that is row 0."""
    at = _narrow(df, "", target)
    if at is None:
        return None
    while at["n"] > boundary_rows and len(at["p"]) < 32:
        left = at["left"]
        at = _narrow(df, at["p"], lambda total: F.lit(left))
    inside = df.filter(F.col("_h").startswith(at["p"]))
    if at["n"] > boundary_rows:  # one hash, so copies of one key
        return inside.head()
    return (
        inside.withColumn("rn", F.row_number().over(Window.orderBy("_h", "_k")))
        .filter(F.col("rn") == at["left"])
        .head()
    )


def chosen(df: DataFrame, key: str, seed: int, ratio: float | None = None, count: int | None = None,
           boundary_rows: int = BOUNDARY_ROWS) -> Column:
    """A Boolean column that is true for exactly the requested number of rows of `df`.

    `key` must be unique in `df`; rows that share a key always fall on the same side. Give
    `ratio`, clamped to [0, 1], or `count`; a count outside 0..n means all rows.
    """
    if count is None:
        share = max(0.0, min(1.0, float(ratio)))
        if share in (0.0, 1.0):
            return F.lit(share == 1.0)
        target = lambda total: F.floor(total * F.lit(share)).cast("bigint")
    else:
        if count == 0:
            return F.lit(False)
        target = lambda total: F.when((total > count) & F.lit(count > 0), F.lit(count)).otherwise(total).cast("bigint")
    cut = _cut_value(df.select(hash_rank(F.col(key), seed).alias("_h"), F.col(key).alias("_k")), target, boundary_rows)
    if cut is None:
        return F.lit(False)
    h = hash_rank(F.col(key), seed)
    return (h < F.lit(cut["_h"])) | ((h == F.lit(cut["_h"])) & (F.col(key) <= F.lit(cut["_k"])))


def chosen_by_kind(df: DataFrame, key: str, kind: str, kinds: list, seed: int, ratio: float) -> Column:
    """As `chosen`, with the ratio met inside every value of `kind`, each on its own."""
    out = F.lit(False)
    for value in kinds:
        part = df.filter(F.col(kind) == F.lit(value))
        out = out | ((F.col(kind) == F.lit(value)) & chosen(part, key, seed, ratio))
    return out
