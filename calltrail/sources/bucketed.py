"""Tables written in buckets of one key, so that joins and sums on it read them side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.session import scratch_dir

BUCKETS = 32


def write_bucketed(df: DataFrame, name: str, key: str = "sample_id", buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """`df` as the table `name` in buckets of `key`, sorted inside; one shuffle now, none in later joins.

    The table lies at `path` (else in the shared folder) and replaces one of the same name. Tables that
    are to be joined need the same number of buckets. Take one bucket for every few GB of the largest.
    """
    spark = df.sparkSession
    folder = path or scratch_dir(spark, name)
    rows = df.repartition(buckets, key)  # the same hash as the buckets: one file each
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", folder).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def join_prediction_inputs(predictions: DataFrame, truth: DataFrame, raw: DataFrame) -> DataFrame:
    """Predictions whose sample has metadata and a raw workflow, with `true_tools`, `query` and `response`.

    predictions(model, sample_id, ...), truth(sample_id, tool), raw(sample_id, query, response), a raw row per
    sample. Where all three are bucketed by sample_id nothing is shuffled: the sums keep the buckets
    and the merge joins read them in step.
    """
    tools = truth.groupBy("sample_id").agg(F.sort_array(F.collect_set("tool")).alias("true_tools"))
    told = predictions.join(tools.hint("merge"), "sample_id")
    return told.join(raw.select("sample_id", "query", "response").hint("merge"), "sample_id")
