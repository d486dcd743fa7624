"""Mutation logs: (seq, key, op, value), op being SET or DEL; a larger seq is a later write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    return _log(events, F.col("event_id"), F.concat(F.lit("u"), F.col("user_id")), F.col("event_type") == "error", F.col("value"))


def from_orders(orders: DataFrame) -> DataFrame:
    return _log(orders, F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey")), F.col("o_orderstatus") == "P", F.col("o_totalprice"))


def _log(df, seq, key, deleted, value) -> DataFrame:
    return df.select(
        seq.cast("long").alias("seq"),
        key.alias("key"),
        F.when(deleted, F.lit("DEL")).otherwise(F.lit("SET")).alias("op"),
        F.when(deleted, F.lit(None).cast("double")).otherwise(value).alias("value"),
    )


def with_seq_check(log: DataFrame) -> DataFrame:
    """Rows of log whose seq is null or not unique: a log without a total order has some, a sound one none."""
    return log.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1 or seq is null")
