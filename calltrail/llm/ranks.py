"""Distributed ranks and other helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrail.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not use in any letter case."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def with_rank(df: DataFrame, order: list[str], group: str | None = None, total: str | None = None,
              rank: str = "rank", label: str = "ranked") -> DataFrame:
    """`df` with the 0-based rank of each row, in its group when one is given.

    Rows are range-partitioned and sorted on (group, *order), written once, and numbered inside
    their partition; a small table of (partition, group) counts turns that into global ranks.
    A group that holds most of the rows spreads over many partitions. Equal rows get different
    ranks in an order fixed by the written table. `total` names a column for the group's size.
    """
    keys = ([group] if group else []) + order
    mid = fresh(df, "_row")
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(mid, F.monotonically_increasing_id()), label
    )
    part, row = F.shiftright(mid, _ROW_BITS), F.col(mid).bitwiseAND((1 << _ROW_BITS) - 1)
    by = [part.alias("_part")] + ([F.col(group).alias("_group")] if group else [])
    counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    window = Window.partitionBy("_group") if group else Window.partitionBy()
    before = window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(window).alias("_total")
    )
    on = part == F.col("_part")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_group"))
    joined = placed.join(offsets, on, "left")
    added = [(row - F.col("_first") + F.col("_before")).alias(rank)]
    if total:
        added.append(F.col("_total").alias(total))
    return joined.select(*[F.col(c) for c in df.columns], *added)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def batches(values: Iterable[str | None]) -> list[str]:
    """Texts of an Arrow column with null as empty."""
    return ["" if v is None else v for v in values]


def each_text(column: pa.Array) -> Iterator[str | None]:
    """Texts of an Arrow column one at a time, so that a task never holds a batch as Python objects."""
    return (value.as_py() for value in column)


def release() -> None:
    """Gives memory that is free back to the system. Workers live on between tasks and stages, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: dict):
    """`run`, and then the worker's `caches` emptied and its free memory given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            release()

    return wrapped


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs that run inside hand at most `rows` rows at a time to Python; whole texts fill a batch of the usual size with tens of MB on both sides."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


BROADCAST_ROWS = 2_000_000  # narrow tables above this are joined by a shuffle instead


def small(side: DataFrame) -> DataFrame:
    """`side`, a narrow table, with a broadcast hint if its rows are few enough to bound its size."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
