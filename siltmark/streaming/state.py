"""The same state from a stream of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state


def latest_stream(stream: DataFrame) -> DataFrame:
    """Last write per key as a streaming aggregate, for output mode complete or update. Its state is one row per key ever written."""
    return state.latest(stream)


def flush_batch(path: str):
    """A foreachBatch body that writes each micro-batch as one run; a repeated batch id overwrites its own run only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run = state.latest(batch).withColumn("run", F.lit(batch_id))
        run.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    return write


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(flush_batch(path)).start()
    query.awaitTermination()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/run=*")
