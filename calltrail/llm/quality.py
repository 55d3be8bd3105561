"""Quality rules: base rules, then robust outliers of text statistics per language and source.

Location and scatter are minimum-covariance-determinant estimates: from several starts, each C-step
takes the rows of a group with the smallest distances and estimates anew from them. After a few steps
the start with the smallest determinant of the scatter goes on, until no step makes a determinant
smaller. A step is one aggregation over (group, start, distance bin) for all groups and starts, so a
group that holds a third of all rows is summed before any shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.llm.ranks import each_text, fresh, release, small_batches
from calltrail.session import materialize

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
ESTIMATE_TYPE = T.StructType(
    [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("center", "inverse")] + [T.StructField("logdet", T.DoubleType())]
)

GROUP = ("lang", "source")
X = ("x0", "x1", "x2", "x3", "x4")
# Spread below which differences of a statistic do not count as odd, in its transformed unit.
FLOORS = (0.5, 0.1, 0.7, 0.7, 0.2)
SHARE = 0.75  # part of a group that the estimates rest on
# Makes the scatter of the central 75 % of five normal variables that of all:
# 0.75 / P(chi2 with 7 degrees < 75 % quantile of chi2 with 5 degrees).
CONSISTENCY = 1.41
PRIOR_ROWS = 50.0  # weight of the language's estimate in a group's
CUTOFF = 30.86  # 99.999 % quantile of chi2 with 5 degrees
BINS_PER_E = 64  # bins of the squared distance, per factor e
STARTS = 3  # medians and quartiles, and the moments of that many less one random halves
FIRST_STEPS = 2  # steps of every start before the best goes on
SMALLER = 1e-3  # least fall of a log determinant that counts; so steps end
MAX_STEPS = 1000  # more means an error
_MOMENTS = [(i, j) for i in range(5) for j in range(i, 5)]


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """The COUNTS of a text."""
    words = text.encode().split()  # splits bytes at the six ASCII white-space characters
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [s for s in text.split("\n") if s.strip(WHITE)] if "\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    _, pairs = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)
    _, at, times = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


@F.arrow_udf(STATS_TYPE)
def statistics(text: pa.Array) -> pa.Array:
    rows = [text_statistics(t or "") for t in each_text(text)]
    columns = list(zip(*rows)) or [()] * len(COUNTS)
    release()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def base_failed(of: Column) -> Column:
    words = of["n_words"]
    return (words < 50) | (100 * of["n_repeat_words"] > 50 * words)


def transformed(of: Column) -> list[Column]:
    """The statistics on scales on which they are roughly normal: lengths, and rates of defects."""
    words, chars = F.greatest(of["n_words"], F.lit(1)), F.greatest(of["word_chars"], F.lit(1))
    return [
        F.log1p(of["n_words"].cast("double")), F.log(chars / words), F.log1p(1000 * of["n_symbols"] / chars),
        F.log1p(1000 * of["n_dup_lines"] / words), F.asin(F.sqrt(of["n_repeat_words"] / words)),
    ]


def _with_estimates(rows: DataFrame, estimates: DataFrame, names: dict[str, str]) -> DataFrame:
    """`rows` with the columns of their group's estimates, under the names given."""
    renamed = estimates.select(*[F.col(c).alias(names[c]) for c in names])
    on = F.col(names["lang"]).eqNullSafe(F.col("lang")) & F.col(names["source"]).eqNullSafe(F.col("source"))
    return rows.join(renamed, on, "left")


def distance(x: list[Column], center: Column, inverse: Column) -> Column:
    off = [x[i] - center[i] for i in range(5)]
    return sum((inverse[5 * i + j] * off[i] * off[j] * (1 if i == j else 2) for i, j in _MOMENTS), F.lit(0.0))


def _starting(rows: DataFrame) -> DataFrame:
    """lang, source, start, center, inverse, logdet to begin with.

    Start 0 is the median and interquartile range of each statistic, rounded to 2 digits so that their
    counts stay few. The others are the moments of a random half of the rows, chosen by a hash.
    """
    cuts = [F.percentile(F.round(c, 2), [0.25, 0.5, 0.75]).alias(c) for c in X]
    spread = [F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(f)) for c, f in zip(X, FLOORS)]
    inverse = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(5) for j in range(5)]
    first = rows.groupBy(*GROUP).agg(*cuts).select(
        *GROUP, F.lit(0).alias("start"), F.array(*[F.col(c)[1] for c in X]).alias("center"), F.array(*inverse).alias("inverse"),
        F.lit(float("inf")).alias("logdet"),
    )
    halves = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(1, STARTS)])))
    halves = halves.where(F.pmod(F.xxhash64("start", *X), F.lit(2)) == 0)
    return first.unionByName(_estimated(halves.groupBy(*GROUP, "start").agg(*_sums())))


def _sums() -> list[Column]:
    """n, sums and sums of products, as s0, s1, ..."""
    sums = [F.count(F.lit(1)).cast("double")] + [F.sum(c) for c in X] + [F.sum(F.col(X[i]) * F.col(X[j])) for i, j in _MOMENTS]
    return [s.alias(f"s{k}") for k, s in enumerate(sums)]


_SUMS = [f"s{k}" for k in range(1 + len(X) + len(_MOMENTS))]


@F.arrow_udf(ESTIMATE_TYPE)
def _estimate(own: pa.Array, language: pa.Array) -> pa.Array:
    """Center, inverse scatter and log determinant of the scatter from [n, sums, sums of products] of a group and of its language."""

    def moments(sums: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        n, mean, cov = sums[0], np.array(sums[1:6]) / sums[0], np.zeros((5, 5))
        for (i, j), s in zip(_MOMENTS, sums[6:]):
            cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
        return n, mean, cov

    centers, inverses, sizes = [], [], []
    for a, b in zip(own.to_pylist(), language.to_pylist()):
        (n, mean, cov), (_, wide_mean, wide_cov) = moments(a), moments(b)
        share = n / (n + PRIOR_ROWS)
        scatter = CONSISTENCY * (share * cov + (1 - share) * wide_cov) + np.diag(np.square(FLOORS))
        centers.append([float(f"{v:.10g}") for v in share * mean + (1 - share) * wide_mean])
        inverses.append([float(f"{v:.10g}") for v in np.linalg.inv(scatter).ravel()])
        sizes.append(float(f"{np.linalg.slogdet(scatter)[1]:.10g}"))
    kind = pa.list_(pa.float64())
    arrays = [pa.array(centers, kind), pa.array(inverses, kind), pa.array(sizes, pa.float64())]
    return pa.StructArray.from_arrays(arrays, names=["center", "inverse", "logdet"])


def _estimated(sums: DataFrame) -> DataFrame:
    """Estimates of every (group, start) from its sums."""
    language = Window.partitionBy("lang", "start")
    both = sums.select(*GROUP, "start", F.array(*_SUMS).alias("own"), F.array(*[F.sum(c).over(language) for c in _SUMS]).alias("language"))
    return both.select(*GROUP, "start", _estimate("own", "language").alias("e")).select(*GROUP, "start", "e.*")


def c_step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates from the SHARE of each group's rows that are nearest under `estimates`, for every start."""
    names = {c: f"_{c}" for c in (*GROUP, "start", "center", "inverse")}
    group = Window.partitionBy(*GROUP, "start")
    near = _with_estimates(rows, estimates, names).withColumnRenamed("_start", "start")
    d = distance([F.col(c) for c in X], F.col("_center"), F.col("_inverse"))
    binned = near.withColumn("bin", F.floor(F.log(F.greatest(d, F.lit(0.0)) + 1e-3) * BINS_PER_E))
    bins = binned.groupBy(*GROUP, "start", "bin").agg(*_sums())
    before = F.coalesce(F.sum("s0").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bins = bins.withColumn("before", before).withColumn("total", F.sum("s0").over(group))
    core = bins.where(F.col("before") < SHARE * F.col("total")).groupBy(*GROUP, "start")
    return materialize(_estimated(core.agg(*[F.sum(c).alias(c) for c in _SUMS])), "mcd")


def fit(rows: DataFrame) -> DataFrame:
    """lang, source, center, inverse, logdet from `rows`(lang, source, x0 to x4): the estimates of every group.

    Groups lean on their language with the weight of PRIOR_ROWS rows, so a group of one row has estimates
    too. A group takes a step's result only if its determinant falls, so the steps come to an end; they
    go on until no group moves. Null lang or source is a group like others.
    """
    estimates = materialize(_starting(rows), "mcd")
    for _ in range(FIRST_STEPS):
        estimates = c_step(rows, estimates)
    best = F.min(F.struct("logdet", "start", "center", "inverse")).alias("b")
    estimates = materialize(
        estimates.groupBy(*GROUP).agg(best).select(*GROUP, F.lit(0).alias("start"), "b.center", "b.inverse", "b.logdet"), "mcd"
    )
    names = {c: f"_{c}" for c in (*GROUP, "center", "inverse", "logdet")}
    for _ in range(MAX_STEPS):
        both = _with_estimates(c_step(rows, estimates), estimates, names)
        falls = F.col("logdet") < F.col("_logdet") - SMALLER
        taken = [F.when(falls, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("center", "inverse", "logdet")]
        estimates = materialize(both.select(*GROUP, "start", *taken, falls.alias("moved")), "mcd")
        if estimates.where("moved").isEmpty():
            return estimates.drop("start", "moved")
        estimates = estimates.drop("moved")
    raise RuntimeError(f"estimates did not settle in {MAX_STEPS} steps")


def judge_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the COUNTS, base_failed, kept, distance of every row.

    Rows that pass the base rules are kept unless their squared Mahalanobis distance from their
    group exceeds `cutoff`; distance is null where the base rules fail. A null or empty text has no
    words and fails. Rows with equal or null doc_id are judged one by one. An empty table gives no
    rows. Other columns are not read.
    """
    with small_batches(docs.sparkSession):
        told = materialize(docs.select("doc_id", *GROUP, statistics("text").alias("of")), "statistics")
    rows = told.where(~base_failed(F.col("of"))).select(*GROUP, *[x.alias(c) for c, x in zip(X, transformed(F.col("of")))])
    names = {c: f"_{c}" for c in (*GROUP, "center", "inverse")}
    near = _with_estimates(told, fit(rows), names)
    failed = base_failed(F.col("of"))
    d = F.when(~failed, F.round(distance(transformed(F.col("of")), F.col("_center"), F.col("_inverse")), 6))
    kept = ~failed & (F.coalesce(d, F.lit(0.0)) <= cutoff)
    return near.select("doc_id", "of.*", failed.alias("base_failed"), kept.alias("kept"), d.alias("distance"))


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` that judge_documents keeps, with all their columns.

    Statistics are computed once for the estimates and once more where rows are filtered, so no text
    is shuffled and repeated ids cannot mix.
    """
    with small_batches(docs.sparkSession):
        told = materialize(docs.select(*GROUP, statistics("text").alias("of")), "statistics")
    rows = told.where(~base_failed(F.col("of"))).select(*GROUP, *[x.alias(c) for c, x in zip(X, transformed(F.col("of")))])
    estimates = fit(rows)
    of = fresh(docs, "_of")
    names = {c: fresh(docs, f"_{c}") for c in (*GROUP, "center", "inverse")}
    near = _with_estimates(docs.withColumn(of, statistics("text")).where(~base_failed(F.col(of))), estimates, names)
    d = F.round(distance(transformed(F.col(of)), F.col(names["center"]), F.col(names["inverse"])), 6)
    return near.where(F.coalesce(d, F.lit(0.0)) <= cutoff).select(*docs.columns)
