"""Streaming intake of workflow files, chains rebuilt from a stream of selections, scores of new predictions.

Chains keep keyed state: the chains of a run and their lengths. A micro-batch reads and writes the
state of the runs it has rows of, and the state store gives a batch that is run again the state that
it had before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calltrail.plans.workflows import CHAIN_PREFIX, MAX_CHAINS

STATE = "n_chains bigint, steps array<bigint>"
BUCKETS = 64  # partitions of a score table; a batch reads those its keys fall in


def read_workflow_stream(spark: SparkSession, path: str) -> DataFrame:
    """id, file, modified, text of every new workflow file."""
    from calltrail.sources.readers import path_text

    files = spark.readStream.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(
        F.regexp_extract(path_text(F.col("_metadata.file_name")), r"^(.*?)(\.[^.]*)?$", 1).alias("id"),
        path_text(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )


def intake(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parse new files and write steps and rejects by batch; read_intake gives the newest of each id.

    No state is kept: an id may come again, and a good delivery follows a broken one.
    """
    from calltrail.plans.workflows import flatten_steps
    from calltrail.session import materialize
    from calltrail.sources.readers import newest_documents, parse_workflows

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = parse_workflows(newest_documents(materialize(batch, "intake")))
        flatten_steps(good).write.mode("overwrite").parquet(f"{target}/steps/batch={batch_id}")
        good.select("workflow_id").write.mode("overwrite").parquet(f"{target}/accepted/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}/rejects/batch={batch_id}")

    return read_workflow_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def read_intake(spark: SparkSession, target: str) -> DataFrame:
    """Steps of the last good delivery of every workflow, found on the narrow list of accepted ids."""
    last = spark.read.parquet(f"{target}/accepted").groupBy("workflow_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/steps").join(last, ["workflow_id", "batch"], "left_semi")


def place_run(rows: pd.DataFrame, order: list[str], n_chains: int, steps: list[int], max_chains: int) -> tuple[pd.DataFrame, int, list[int]]:
    """One run's selections of a batch placed after what the run had: the rows, its chains, and the steps of each chain."""
    rows = rows.sort_values(order, kind="stable", ignore_index=True)
    opens = (rows["which_chain"] == "-1").fillna(False).to_numpy(bool)
    if len(rows) and n_chains == 0:
        opens[0] = True
    opened = n_chains + np.cumsum(opens)
    named = rows["which_chain"].str.extract(f"^{CHAIN_PREFIX}([0-9]{{1,18}})$", expand=False)
    target = pd.to_numeric(named).fillna(0).to_numpy(np.int64)
    full = opens & (opened > max_chains)
    known = ~opens & (target >= 1) & (target <= np.minimum(opened, max_chains))
    good = (opens & ~full) | known
    chain = np.where(opens, opened, target)
    step = np.zeros(len(rows), np.int64)
    steps = list(steps)
    for number in np.unique(chain[good]):  # no more than max_chains
        mine = good & (chain == number)
        steps += [0] * (int(number) - len(steps))
        step[mine] = steps[number - 1] + 1 + np.arange(mine.sum())
        steps[number - 1] += int(mine.sum())
    rows["outcome"] = np.where(good, "committed", np.where(full, "saturated", "unknown_chain"))
    number = pd.array(chain, "Int64")
    number[~good] = pd.NA
    position = pd.array(step, "Int64")
    position[~good] = pd.NA
    rows["chain_number"], rows["step_pos"] = number, position
    rows["chain_id"] = np.where(good, [f"{CHAIN_PREFIX}{c}" for c in chain], None)
    return rows, min(int(opened[-1]) if len(rows) else n_chains, max_chains), steps


def stream_chains(selections: DataFrame, folder: str, order: list[str], max_chains: int = MAX_CHAINS) -> StreamingQuery:
    """Rebuild chains from a stream of selections(run, which_chain, *order) into {folder}/placed.

    Selections of a run must arrive in order across batches; inside a batch they are sorted by `order`,
    columns without nulls. A run's rows of one batch meet in one task, so the source's limit of a batch
    (maxFilesPerTrigger) bounds them; its state is one row however long it is. Other columns are left
    out; the order columns identify a row. The file sink and the state store make a batch that is run
    again write the same rows once.
    """
    columns = list(dict.fromkeys(["run", "which_chain", *order]))
    rows = selections.select(*columns)
    added = [("outcome", T.StringType()), ("chain_number", T.LongType()), ("step_pos", T.LongType()), ("chain_id", T.StringType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in added]])

    def place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n_chains, steps = state.get if state.exists else (0, [])
        placed, n_chains, steps = place_run(pd.concat(list(batches)), order, n_chains, steps, max_chains)
        state.update((n_chains, [int(n) for n in steps]))
        yield placed[[f.name for f in schema]]

    placed = rows.groupBy("run").applyInPandasWithState(place, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return placed.writeStream.format("parquet").option("path", f"{folder}/placed").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start()


def _bucket() -> Column:
    return F.pmod(F.xxhash64("model", "sample_id"), F.lit(BUCKETS)).alias("bucket")


def newest_predictions(predictions: DataFrame) -> DataFrame:
    """One row per (model, sample_id): the newest, of equally new ones the largest row. No row order matters."""
    rest = [c for c in predictions.columns if c not in ("model", "sample_id", "modified")]
    row = F.struct("modified", *rest)
    return predictions.groupBy("model", "sample_id").agg(F.max(row).alias("_r")).select("model", "sample_id", "_r.*")


def evaluate_new(predictions: DataFrame, score, results: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Score predictions(model, sample_id, modified, ...) that `results` has no score of, or of an older one only.

    `modified` is a timestamp. A delivery that repeats another within `late` of its arrival never reaches
    the batch; of several versions in a batch the newest counts. `score` turns a batch of predictions into
    rows with model, sample_id and scores. Results lie in folders by bucket and batch: a batch reads the
    buckets of its own keys, and one that is run again replaces its own folders. read_scores gives the newest.
    """
    # the watermark goes by arrival, so that no delivery is too old to be read
    arrived = predictions.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", late)
    fresh = arrived.dropDuplicatesWithinWatermark(["model", "sample_id", "modified"]).drop("_arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        from calltrail.session import materialize

        spark = batch.sparkSession
        todo = materialize(newest_predictions(batch).withColumn("bucket", _bucket()), "new-predictions")
        touched = [r[0] for r in todo.select("bucket").distinct().collect()]  # at most BUCKETS
        if batch_id > 0 and touched and _has_rows(spark, results):
            earlier = spark.read.parquet(results).filter(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
            known = earlier.groupBy("model", "sample_id").agg(F.max("modified").alias("_scored"))
            todo = todo.join(known, ["model", "sample_id"], "left").filter(F.col("_scored").isNull() | (F.col("modified") > F.col("_scored"))).drop("_scored")
        versions = todo.select("model", "sample_id", "modified", "bucket")
        scored = score(todo.drop("bucket")).drop("modified", "bucket").join(versions, ["model", "sample_id"])
        # a bucket's rows meet before they are written, or every task would leave a file in every bucket
        scored.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(results)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def _has_rows(spark: SparkSession, path: str) -> bool:
    from calltrail.sources.versions import _files

    files, at = _files(spark, path)
    return files.exists(at()) and any(s.getPath().getName().startswith("bucket=") for s in files.listStatus(at()))


def read_scores(spark: SparkSession, results: str) -> DataFrame:
    """The score of the newest prediction of every (model, sample_id)."""
    rows = spark.read.parquet(results)
    kept = [c for c in rows.columns if c not in ("model", "sample_id", "bucket", "batch", "modified")]
    newest = F.max_by(F.struct("modified", *kept), F.struct("modified", "batch")).alias("_r")
    return rows.groupBy("model", "sample_id").agg(newest).select("model", "sample_id", "_r.*")


def compact_scores(spark: SparkSession, results: str, table: str) -> str:
    """Writes read_scores as the next version of `table`, by bucket; readers of the old version are not disturbed."""
    from calltrail.sources.versions import write_version

    return write_version(read_scores(spark, results).withColumn("bucket", _bucket()), table, ["bucket"])
