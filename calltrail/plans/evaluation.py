"""Scores of predictions, their summaries and the comparison of two models."""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from calltrail.session import materialize

SAMPLE = ["model", "sample_id"]
METRICS = ["precision", "recall", "success_rate", "qor"]


def judge_score(num_requests: Column, scores: Column) -> Column:
    """Sum of the scores over the number of requests, unanswered ones 0; clipped to 0..100."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s.cast("double"))
    mean = F.when(num_requests > 0, total / num_requests).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean))


class ToolCounts(NamedTuple):
    """n_pred, n_hit, n_ok of every (model, sample_id) with calls, and n_true of every sample_id with true tools."""

    called: DataFrame
    true: DataFrame


def tool_counts(calls: DataFrame, truth: DataFrame) -> ToolCounts:
    """How many tools were called, hit and ran well, and how many are true.

    calls(model, sample_id, tool, error); truth(sample_id, tool). They meet on (sample, tool) after both were reduced
    to one row per tool, so a sample with very many calls spreads over its tools.
    """
    called = calls.groupBy(*SAMPLE, "tool").agg(F.max(F.when(F.col("error") == "", 1).otherwise(0)).alias("ok"))
    wanted = truth.select("sample_id", "tool").distinct()
    met = called.join(wanted.withColumn("hit", F.lit(1)), ["sample_id", "tool"], "left")
    per_sample = met.groupBy(*SAMPLE).agg(
        F.count(F.lit(1)).alias("n_pred"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"),
        F.coalesce(F.sum(F.col("hit") * F.col("ok")), F.lit(0)).alias("n_ok"),
    )
    return ToolCounts(per_sample, wanted.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_true")))


def written_counts(calls: DataFrame, truth: DataFrame) -> ToolCounts:
    """tool_counts, written once: for predictions that are scored more than once by the same calls and true tools."""
    counts = tool_counts(calls, truth)
    return ToolCounts(materialize(counts.called, "called"), materialize(counts.true, "true"))


def tool_scores(predictions: DataFrame, calls: DataFrame | None = None, truth: DataFrame | None = None,
                counts: ToolCounts | None = None) -> DataFrame:
    """precision, recall and success_rate per (model, sample_id).

    predictions(model, sample_id), one row each; calls and truth as in tool_counts, or its result.
    """
    counts = tool_counts(calls, truth) if counts is None else counts
    # by sample and model last: so the scores lie where save_scores needs them
    joined = predictions.join(counts.true, "sample_id", "left").join(counts.called, SAMPLE, "left")
    return joined.select(
        *predictions.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_true", "n_hit", "n_ok")],
    ).select(
        *predictions.columns, "n_pred", "n_true", "n_hit", "n_ok",
        _share("n_hit", "n_pred").alias("precision"),
        _share("n_hit", "n_true").alias("recall"),
        _share("n_ok", "n_true").alias("success_rate"),
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def evaluate(predictions: DataFrame, calls: DataFrame | None = None, truth: DataFrame | None = None,
             judge: DataFrame | None = None, overwrite: bool = False, counts: ToolCounts | None = None) -> DataFrame:
    """Scores per (model, sample_id), with `weight` for the summaries.

    `counts` stands for calls and truth where they were counted before (written_counts).
    judge(model, sample_id, num_requests, response_scores); leave it out when the predictions
    carry these two columns. predictions(model, sample_id, failed, stored): `stored` is a struct of earlier scores or
    null, kept per metric unless `overwrite`. A failed prediction counts 0 for precision, recall and
    qor and is not counted for success. `weight` is the number of times a score is counted
    when values are weighted as in the original tables: 2 when fresh, 1 when stored or failed.
    """
    fresh = tool_scores(predictions, calls, truth, counts)
    qor = judge_score(F.col("num_requests"), F.col("response_scores")).alias("qor")
    scored = fresh.select("*", qor) if judge is None else fresh.join(judge.select(*SAMPLE, qor), SAMPLE, "left")
    failed = F.coalesce("failed", F.lit(False))
    out = []
    for metric in METRICS:
        stored = F.lit(None).cast("double") if overwrite else F.col(f"stored.{metric}")
        when_failed = F.lit(None).cast("double") if metric == "success_rate" else F.lit(0.0)
        out.append(
            F.coalesce(stored, F.when(failed, when_failed).otherwise(F.col(metric))).alias(metric)
        )
        out.append(
            F.when(stored.isNotNull() | failed, 1).otherwise(2).alias(f"{metric}_weight")
        )
    return scored.select(*SAMPLE, failed.alias("failed"), *out)


def long_scores(scores: DataFrame, reference_weights: bool = False) -> DataFrame:
    """model, sample_id, metric, value, weight; metrics without a value are left out."""
    entries = [
        F.struct(
            F.lit(m).alias("metric"), F.col(m).alias("value"),
            (F.col(f"{m}_weight") if reference_weights else F.lit(1)).cast("bigint").alias("weight"),
        )
        for m in METRICS
    ]
    return (
        scores.select(*SAMPLE, F.explode(F.array(*entries)).alias("e"))
        .select(*SAMPLE, "e.*")
        .filter(F.col("value").isNotNull())
    )


def summarize(scores: DataFrame, reference_weights: bool = False) -> DataFrame:
    """Mean, population deviation, count, sum and last value per model and metric."""
    long = long_scores(scores, reference_weights)
    w, v = F.col("weight"), F.col("value")
    n, total = F.sum(w), F.sum(w * v)
    squares = F.sum(w * v * v)
    if not reference_weights:
        deviation = F.stddev_pop(v)
    else:
        deviation = F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))
    return long.groupBy("model", "metric").agg(
        (total / n).alias("avg"), deviation.alias("std"), n.alias("count"), total.alias("sum"),
        F.max_by("value", "sample_id").alias("last"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """One row per model: mean recall, success rate and judge score."""
    return scores.groupBy("model").agg(
        F.avg("recall").alias("recall"), F.avg("success_rate").alias("success_rate"), F.avg("qor").alias("qor")
    )


def save_scores(predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """Predictions with their scores as the new `stored` struct; failed ones keep what they had."""
    new = scores.filter(~F.col("failed")).select(*SAMPLE, F.struct(*METRICS).alias("_new"))
    return predictions.join(new, SAMPLE, "left").withColumn("stored", F.coalesce("_new", "stored")).drop("_new")


def only_tests(predictions: DataFrame, test_ids: DataFrame) -> DataFrame:
    return predictions.join(test_ids.select("sample_id").distinct(), "sample_id", "left_semi")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta function of {a}, {b} at {x} does not converge")


def student_p(t: float | None, df: float) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or math.isnan(t) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    if df > 1e6:  # the normal limit and the next term; log-gamma differences lose digits here
        t = abs(t)
        return math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t**3 + t) / (2 * df)
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else student_p(a, b - 1.0) for a, b in zip(t, n)], dtype="float64")


def compare(first: DataFrame, second: DataFrame, with_p: bool = True) -> DataFrame:
    """Paired t-test per metric over the samples both score tables have a value for."""
    a = long_scores(first).select("sample_id", "metric", F.col("value").alias("_a"))
    b = long_scores(second).select("sample_id", "metric", F.col("value").alias("_b"))
    return _t_test(a.join(b, ["sample_id", "metric"]), with_p)


def compare_models(scores: DataFrame, first: str, second: str, with_p: bool = True) -> DataFrame:
    """The same for two models of one score table, which is read once."""
    long = long_scores(scores.filter(F.col("model").isin(first, second)))
    value = lambda model: F.max(F.when(F.col("model") == model, F.col("value")))
    paired = long.groupBy("sample_id", "metric").agg(value(first).alias("_a"), value(second).alias("_b"))
    return _t_test(paired.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()), with_p)


def _t_test(paired: DataFrame, with_p: bool) -> DataFrame:
    d = F.col("_a") - F.col("_b")
    out = paired.filter(F.col("metric") != "precision").groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    t = F.col("mean_diff") / F.nullif(F.col("_sd") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))
    out = out.withColumn("t_stat", t).drop("_sd")
    return out.withColumn("p_value", p_value("t_stat", F.col("n").cast("double"))) if with_p else out
