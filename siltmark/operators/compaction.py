"""Levelled compaction and garbage collection over runs with a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import islands

#: Runs of level 0 and of any other level from which a level is compacted; MiB of a level's output runs are 10 ** level.
LEVEL0_RUNS, LEVEL_RUNS = 4, 10


def merge(runs: DataFrame, drop_tombstones: bool) -> DataFrame:
    """One row per key, that of the lowest level and newest run. Tombstones may go only if no deeper level is left out."""
    best = runs.groupBy("key").agg(F.min_by(F.struct("op", "value", "seq"), F.struct("level", -F.col("run"))).alias("w"))
    out = best.select("key", "w.op", "w.value", "w.seq")
    return out.where("op <> 'DEL'") if drop_tombstones else out


def may_drop(output_level: int, deepest_level: int) -> bool:
    return output_level >= deepest_level


def candidates(manifest: DataFrame) -> DataFrame:
    """Levels that are due, with their runs counted."""
    n = manifest.groupBy("level").agg(F.count("*").alias("runs"))
    return n.where(((F.col("level") == 0) & (F.col("runs") >= LEVEL0_RUNS)) | (F.col("runs") >= LEVEL_RUNS))


def inputs(manifest: DataFrame, level: int) -> DataFrame:
    """The runs (level, run) that a compaction of a level merges; manifest: run, level, lo, hi.

    A seed run, at level 0 with all that it reaches through overlaps there, and the runs of the next level that overlap the range so
    covered. The first seed, by run, with two runs or more is taken; if no seed has that, the first three runs, if there are as many, are seeds together.
    """
    low, high = manifest.where(F.col("level") == level), manifest.where(F.col("level") == level + 1)
    group = islands(low) if level == 0 else low.withColumn("island", F.col("run"))
    ranges = group.groupBy("island").agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"), F.min("run").alias("first"), F.count("*").alias("n"))
    counted = overlapping(ranges, high).where(F.col("n") + F.col("more") > 1)
    best = counted.orderBy("first").limit(1).select("island", F.lit(1).alias("one"))
    # without such a seed: three runs, and at level 0 what they reach
    three = low.orderBy("run").limit(3).withColumn("one", F.lit(1)).withColumn("of", F.count("*").over(Window.partitionBy("one")))
    three = three.where("of = 3").join(best.select("one"), "one", "left_anti").select("run")
    seeds = group.join(best.select("island"), "island", "left_semi").select("run").union(three)
    picked = group.join(group.join(seeds, "run", "left_semi").select("island").distinct(), "island", "left_semi").select("run", "lo", "hi")
    whole = picked.agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi")).withColumn("one", F.lit(1))  # one row
    met = high.withColumn("one", F.lit(1)).join(whole, "one").where((F.col("lo") <= F.col("g_hi")) & (F.col("hi") >= F.col("g_lo"))).select("run")
    return picked.select(F.lit(level).alias("level"), "run").union(met.select(F.lit(level + 1).alias("level"), "run"))


def overlapping(ranges: DataFrame, others: DataFrame) -> DataFrame:
    """ranges (island, g_lo, g_hi, ...) with more, how many of others (lo, hi) overlap each: those that begin up to its end without those
    that end before it begins, counted in one order of all ends, not by pairs."""
    point = lambda df, at, kind, island=None: df.select(F.col(at).alias("at"), F.lit(kind).alias("kind"), (F.col(island) if island else F.lit(None)).cast("long").alias("island"))
    points = point(others, "lo", 0).union(point(ranges, "g_hi", 1, "island")).union(point(ranges, "g_lo", 2, "island")).union(point(others, "hi", 3))
    order = Window.orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, 0)
    seen = points.withColumn("begun", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(order)).withColumn("ended", F.sum(F.when(F.col("kind") == 3, 1).otherwise(0)).over(order))
    more = seen.where("kind in (1, 2)").groupBy("island").agg(F.sum(F.when(F.col("kind") == 1, F.col("begun")).otherwise(-F.col("ended"))).alias("more"))
    return ranges.join(more, "island")


def chosen(runs: list[dict], level: int) -> tuple[list[dict], list[dict]]:
    """The same for a store's manifest, which is a list of runs: those of the level and those of the next; both empty if nothing is to be done."""
    low, high = ([r for r in runs if r["level"] == k] for k in (level, level + 1))

    def grown(seeds: list[dict]) -> tuple[list[dict], list[dict]]:
        lo, hi, inside = min(r["lo"] for r in seeds), max(r["hi"] for r in seeds), seeds
        while level == 0:
            more = [r for r in low if r["lo"] <= hi and r["hi"] >= lo or r in seeds]
            lo, hi = min([lo, *(r["lo"] for r in more)]), max([hi, *(r["hi"] for r in more)])
            if len(more) == len(inside):
                break
            inside = more
        return inside, [r for r in high if r["lo"] <= hi and r["hi"] >= lo]

    for seed in [[r] for r in low] + ([low[:3]] if len(low) >= 3 else []):
        found = grown(seed)
        if len(found[0]) + len(found[1]) > 1:
            return found
    return [], []


def target_bytes(level: int) -> int:
    """Bytes of an output run of a level."""
    return 10**level << 20


def size_split(rows: DataFrame, size: str, limit: int, parts: int = 64) -> DataFrame:
    """Cuts rows, in key order, into pieces of about limit units.

    Running sums in two steps: within ranges of keys, and over the sums of the ranges, of which there are a fixed number.
    A piece begins where the running sum passes a multiple of the limit, which a greedy cut need not do.
    """
    ranged = rows.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    inner = ranged.withColumn("inner", F.sum(size).over(Window.partitionBy("part").orderBy("key")))
    sums = inner.groupBy("part").agg(F.max("inner").alias("whole"))
    base = sums.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("base"))
    done = inner.join(F.broadcast(base), "part")
    return done.withColumn("piece", F.floor((F.col("base") + F.col("inner") - F.col(size)) / F.lit(limit)).cast("long")).drop("part", "inner", "base")


def level_rewrite(runs: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The rows of all levels after a compaction: without those of the removed runs, with the added."""
    return runs.join(removed.select("run").distinct(), "run", "left_anti").unionByName(added)


def dead_runs(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Run files that no manifest row names."""
    return files.join(manifest.select("run"), "run", "left_anti")


def dead_logs(logs: DataFrame, min_live: int) -> DataFrame:
    """Log files older than the oldest that still holds unflushed writes."""
    return logs.where(F.col("log") < min_live)


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest version of the manifest: the rows added and not removed, up to it."""
    net = versions.groupBy("run").agg(F.max_by(F.struct("action", "level"), "version").alias("w"))
    return net.where("w.action = 'add'").select("run", "w.level")
