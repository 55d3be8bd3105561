"""Order inside groups when one group may hold a large share of all rows.

A window partitioned by the group key puts a whole group into one task. Keys are counted first;
where none exceeds a fixed number of rows, that plain window is the plan. Otherwise the rows of the
hot keys are cut into slices along the order, at the quantiles of a sketch per hot key; a slice that
is still too large is cut again. Each slice is counted on its own, and the count of the slices
before it is added from a small table. No task gathers more rows as the table grows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.session import materialize

HOT_ROWS = 100_000
PART_SIZE = 10_000
WAYS = 64  # slices that one cut makes at most
SKETCH = 2048  # size of the quantile sketches: ranks are off by less than a tenth of a slice
MAX_LEVELS = 10  # WAYS ** MAX_LEVELS slices of a key at most; their numbers stay BIGINT
SLICE = "_slice"
BUCKETS = 1 << 16  # of keys that are counted together before the keys of full ones are counted
BROADCAST_BYTES = 128 << 20  # of a table that is sent whole to every executor
ROW_BYTES = 64  # of such a row beside its texts


@dataclass(frozen=True)
class Slices:
    """Where hot keys are cut. `hot` lists them and is None if there are none.

    With `every`, a BIGINT that never falls along the order, all keys are cut by it instead.
    """

    keys: list[str]
    hot: DataFrame | None = None
    levels: list[tuple[Column, DataFrame]] = field(default_factory=list)
    every: Column | None = None

    @property
    def cuts(self) -> bool:
        return self.every is not None or bool(self.levels)

    def mark(self, df: DataFrame) -> DataFrame:
        """`df` with its slice, a number that never falls along the order inside a key."""
        if self.every is not None:
            return df.withColumn(SLICE, self.every.cast("bigint"))
        out = df.withColumn(SLICE, F.lit(0).cast("bigint"))
        for by, bounds in self.levels:
            place = F.size(F.filter("_bounds", lambda b: b <= F.coalesce(by.cast("bigint"), F.lit(-(2**63)))))
            out = lookup(out, bounds, [*self.keys, SLICE]).withColumn(
                SLICE, F.col(SLICE) * WAYS + F.when(F.col("_bounds").isNull(), 0).otherwise(place)
            ).drop("_bounds")
        return out

    def hot_rows(self, df: DataFrame, other: bool = False) -> DataFrame:
        """The rows of the keys that are cut, or the others."""
        if self.every is not None:
            return df.filter(F.lit(not other))
        return lookup(df, self.hot, self.keys, "left_anti" if other else "left_semi")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys are keys like others. `table` was written, so its size is known to the planner."""
    renamed = table.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(renamed, on, how).drop(*[f"_on_{k}" for k in keys])


def looked_up(table: DataFrame, size: int) -> DataFrame:
    """`table`, of `size` bytes, as the smaller side of a join by keys it holds about once each.

    Sent whole if it is small. Else both sides are shuffled and each task hashes its share of the table, so that the
    larger side is not sorted.
    """
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("shuffle_hash")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """The keys of more than `hot_rows` rows, with `_rows`; None if there are none. Reads the key columns alone.

    Rows are counted by bucket of the key's hash first: a task hands on one row a bucket, not one a key. Only the keys in
    buckets of more than `hot_rows` rows, which hold every hot key, are counted on their own.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if keys:
        df = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
        counted = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
        full = materialize(counted.select("_bucket"), "full-buckets")
        if full.isEmpty():
            return None
        df = lookup(df, full, ["_bucket"], "left_semi")
    found = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit), "hot-keys")
    return None if found.isEmpty() else found


def slices(df: DataFrame, keys: list[str], by: Column | list[Column], hot_rows: int | None = None) -> Slices:
    """Slices of at most `hot_rows` rows for `df`. Without keys the whole table is one group.

    `by` are BIGINTs that fix the order from its first column on, each never falling where those before
    it are equal; nulls come first. A later one only cuts what those before it leave together. Rows equal
    in all of them stay in one slice.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    found = hot_keys(df, keys, limit)
    if found is None:
        return Slices(list(keys))
    cut = Slices(list(keys), found.drop("_rows"))
    group = [*keys, SLICE]
    rows = cut.hot_rows(df)
    for one in by if isinstance(by, list) else [by]:
        value = F.coalesce(one.cast("bigint"), F.lit(-(2**63)))
        while len(cut.levels) < MAX_LEVELS:
            marked = cut.mark(rows).select(*group, value.alias("_by"))
            sizes = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_by").alias("_low"), F.max("_by").alias("_high"))
            large = materialize(sizes.filter((F.col("_rows") > limit) & (F.col("_low") < F.col("_high"))), "large-slices")
            if large.isEmpty():
                break
            cut.levels.append((one, materialize(_bounds(marked, large, group, limit), "slice-bounds")))
    return cut


def _bounds(marked: DataFrame, large: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Ascending first values of the slices after the first, by the quantiles of a sketch per large slice."""
    sketches = lookup(marked, large, group, "left_semi").groupBy(*group).agg(
        F.kll_sketch_agg_bigint("_by", F.lit(SKETCH)).alias("_sketch")
    )
    ways = F.least(F.ceil(F.col("_rows") * 2 / limit), F.lit(WAYS))  # slices of half the limit leave room for the sketch's error
    told = lookup(sketches, large, group).withColumn(
        "_cuts", F.kll_sketch_get_quantile_bigint("_sketch", F.array(*[F.lit(i / WAYS) for i in range(1, WAYS)]))
    )
    chosen = F.transform(F.sequence(F.lit(1), ways - 1), lambda i: F.element_at("_cuts", F.floor(i * WAYS / ways).cast("int")))
    cuts = F.array_sort(F.array_distinct(chosen))
    inner = F.filter(cuts, lambda b: b > F.col("_low"))
    # one value that fills most of a slice still parts from the others
    return told.select(*group, F.when(F.size(inner) > 0, inner).otherwise(F.array(F.col("_low") + 1)).alias("_bounds"))


def running_count(df: DataFrame, keys: list[str], order: list[Column], cut: Slices, name: str,
                  weight: Column | None = None, total: str | None = None) -> DataFrame:
    """Rows (or summed `weight`) of the key up to and including each row.

    `df` must carry the slice column set by `cut.mark`. `keys` may be finer than the keys
    of `cut`. With `total`, the sum over the whole key is added too.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    df = df.withColumn("_weight", weight)
    if cut.levels:
        df = materialize(df, "sliced")  # read twice, and counts may be chained
    piece = Window.partitionBy(*keys, SLICE) if cut.cuts else Window.partitionBy(*keys)
    upto = piece.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.sum("_weight").over(upto))
    if total:
        out = out.withColumn("_piece_total", F.sum("_weight").over(piece))
    if not cut.cuts:
        return (out.withColumn(total, F.col("_piece_total")).drop("_piece_total") if total else out).drop("_weight")
    per_slice = cut.hot_rows(df).groupBy(*keys, SLICE).agg(F.sum("_weight").alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_slice.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"),
    )
    out = lookup(out, offsets, [*keys, SLICE]).withColumn(
        name, F.col(name) + F.coalesce("_before", F.lit(0))
    )
    if total:
        out = out.withColumn(total, F.coalesce("_all", "_piece_total")).drop("_piece_total")
    return out.drop("_before", "_all", "_weight")


def collect_parts(df: DataFrame, keys: list[str], order: list[str], values: list[str], by: Column | list[Column],
                  part_size: int = PART_SIZE, hot_rows: int | None = None, cut: Slices | None = None) -> DataFrame:
    """Ordered lists per key in parts of at most `part_size` items.

    Returns keys, `part` (from 0), `n_total` (items of the whole key) and `items`
    (array of structs of `values`). A key of ordinary size is exactly part 0; a huge one is
    whole too, spread over several rows. Ordinary keys take one shuffle and a local sort; a
    key is hot, unless `hot_rows` says otherwise, when it does not fit one part. Pass `cut` where
    the slices are known already.
    """
    hot_rows = part_size if hot_rows is None else hot_rows
    columns = list(dict.fromkeys([*keys, *order, *values]))
    sort_by = [c for c in columns if c not in keys]
    narrow = df.select(*columns)
    cut = slices(df, keys, by, hot_rows) if cut is None else cut
    ordinary = narrow if cut.hot is None else cut.hot_rows(narrow, other=True)
    ordinary = (
        ordinary.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*sort_by))).alias("_all"))
        .withColumn("n_total", F.size("_all").cast("bigint"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("n_total") - 1) / part_size).cast("int"))))
        .select(
            *keys, F.col("part").cast("bigint").alias("part"), "n_total",
            F.transform(
                F.slice("_all", F.col("part") * part_size + 1, part_size),
                lambda s: F.struct(*[s[v].alias(v) for v in values]),
            ).alias("items"),
        )
    )
    return ordinary if cut.hot is None else ordinary.unionByName(_hot_parts(narrow, keys, sort_by, values, cut, part_size))


def _hot_parts(df: DataFrame, keys: list[str], sort_by: list[str], values: list[str], cut: Slices,
               part_size: int) -> DataFrame:
    """The parts of hot keys. Rows that are copies of each other are counted before the
    shuffle and repeated inside the parts at the end."""
    packed = cut.hot_rows(df).groupBy(*keys, *sort_by).agg(F.count(F.lit(1)).alias("_copies"))
    placed = running_count(
        cut.mark(packed), keys, [F.col(c) for c in sort_by], cut, "_end",
        weight=F.col("_copies"), total="n_total",
    )
    first = F.col("_end") - F.col("_copies")
    size = F.lit(part_size).cast("bigint")
    spread = placed.withColumn(
        "part",
        F.explode(F.sequence(F.floor(first / size), F.floor((F.col("_end") - 1) / size))),
    )
    low = F.greatest(first, F.col("part") * size)
    high = F.least(F.col("_end"), (F.col("part") + 1) * size)
    pieces = spread.select(
        *keys, "part", "n_total",
        F.struct(
            low.alias("at"), (high - low).cast("int").alias("n"),
            F.struct(*values).alias("item"),
        ).alias("_piece"),
    )
    return pieces.groupBy(*keys, "part", "n_total").agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list("_piece")),
                lambda p: F.array_repeat(p["item"], p["n"]),
            )
        ).alias("items")
    )


def rolling_mean(df: DataFrame, keys: list[str], order: list[Column], by: Column | list[Column], value: str,
                 last: int = 100, chunk: int = 100_000, hot_rows: int | None = None) -> DataFrame:
    """Mean and count of the last `last` rows of the key, adding `rolling_avg`, `rolling_runs`.

    Where a key is hot, rows are numbered, cut into chunks of `chunk` positions, and the last
    `last - 1` rows of a chunk are also handed to the next one, so no window holds more than one chunk.
    """
    if chunk < last:
        raise ValueError("chunk must be at least as long as the rolling window")
    cut = slices(df, keys, by, hot_rows)
    if cut.hot is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), Window.currentRow)
        return df.withColumn("rolling_avg", F.avg(value).over(frame)).withColumn("rolling_runs", F.count(F.lit(1)).over(frame))
    placed = running_count(cut.mark(df), keys, order, cut, "_pos").drop(SLICE)
    at = F.floor((F.col("_pos") - 1) / F.lit(chunk))
    carried = (F.col("_pos") - 1) % F.lit(chunk) >= F.lit(chunk - (last - 1))
    copies = placed.withColumn("_home", at).withColumn(
        "_chunk", F.explode(F.when(carried, F.array(at, at + 1)).otherwise(F.array(at)))
    )
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(last - 1), Window.currentRow)
    )
    return (
        copies.withColumn("rolling_avg", F.avg(value).over(frame))
        .withColumn("rolling_runs", F.count(F.lit(1)).over(frame))
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_pos", "_home", "_chunk")
    )
