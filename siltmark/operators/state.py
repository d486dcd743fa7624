"""Current state of a mutation log: the last write of each key wins, and a deletion is a write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The last write of each key, deletions included. max_by combines on the map side, so hot keys stay cheap."""
    last = log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return last.select("key", "w.op", "w.value", "w.seq")


def latest_ranked(log: DataFrame) -> DataFrame:
    """The same by a window with a group limit."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", "op", "value", "seq")


def live(last: DataFrame) -> DataFrame:
    """Of the last writes, those that are not deletions; filtering before last-write-wins would bring old values back."""
    return last.where("op = 'SET'").select("key", "value", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """One key's value: the key predicate reaches the scan; no row for a missing or deleted key."""
    return live(latest(log.where(F.col("key") == key)))


def mget(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Every requested key once, with a null value for a miss. The state is cut down to the keys before it is built."""
    wanted = keys.select("key").distinct()
    return wanted.join(live(latest(log.join(wanted, "key", "left_semi"))), "key", "left")


def exists(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(live(latest(log)), "key", "left_semi")


def absent(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(live(latest(log)), "key", "left_anti")


def scan(log: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Live keys in [low, high), in byte order."""
    if low is not None:
        log = log.where(F.col("key") >= low)
    if high is not None:
        log = log.where(F.col("key") < high)
    return live(latest(log)).orderBy("key")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    return live(latest(log.where(F.col("seq") <= seq)))
