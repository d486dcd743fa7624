"""Sorted immutable runs and their manifest.

Runs have the columns run, key, op, value, seq; a manifest has run, lo, hi, n, tombstones and, where levels matter, level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flush(log: DataFrame, run: Column) -> DataFrame:
    """Each run keeps the last write of each of its keys, tombstones included."""
    last = log.withColumn("run", run).groupBy("run", "key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return last.select("run", "key", "w.op", "w.value", "w.seq")


def manifest(runs: DataFrame, *more: str) -> DataFrame:
    return runs.groupBy("run", *more).agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.count(F.when(F.col("op") == "DEL", 1)).alias("tombstones")
    )


def sorted_scan(runs: DataFrame) -> DataFrame:
    """Rows in run and key order, ranked within the run."""
    return runs.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("key")))


def search(manifest: DataFrame, key: str) -> DataFrame:
    """Runs whose key range covers the key."""
    return manifest.where((F.col("lo") <= key) & (F.col("hi") >= key))


def first_hit(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the row that a read finds first: the lowest level, and there the newest run.

    The lowest (level, -run) is a plain aggregate, so no run is visited in turn. Deleted keys are hits with op DEL.
    """
    hits = runs.join(keys.select("key").distinct(), "key", "left_semi")
    best = hits.groupBy("key").agg(F.min_by(F.struct("level", "run", "op", "value"), F.struct("level", -F.col("run"))).alias("w"))
    return best.select("key", "w.level", "w.run", "w.op", "w.value")


def key_order(lo: Column, hi: Column, key: Column) -> Column:
    """1 if the range lies after the key, -1 if before, 0 if it holds it."""
    return F.when(key < lo, 1).when(key > hi, -1).otherwise(0)


def is_empty(lo: Column, hi: Column) -> Column:
    """A range with an empty end is none."""
    return (F.coalesce(F.octet_length(lo), F.lit(0)) == 0) | (F.coalesce(F.octet_length(hi), F.lit(0)) == 0)


def cover(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """The least range over both if they overlap or the first is empty; otherwise the first as it is."""
    meets = (lo <= other_hi) & (hi >= other_lo)
    return (
        F.when(is_empty(lo, hi), F.struct(other_lo.alias("lo"), other_hi.alias("hi")))
        .when(meets, F.struct(F.least(lo, other_lo).alias("lo"), F.greatest(hi, other_hi).alias("hi")))
        .otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))
    )


#: Places in the order of begins that a block holds when pairs are made.
STEP = 1024


def overlap_pairs(manifest: DataFrame) -> DataFrame:
    """Pairs of runs whose ranges share a key. The result itself may be quadratic.

    Two ranges meet exactly if the later begins within the earlier. Ranges are numbered by their begins, so that those which begin within
    a range have neighbouring numbers, from its own up to a number found by counting begins. Numbers are cut into blocks of STEP; a tile is
    a block and one that its ranges reach. Tiles are dealt out evenly, and each range takes its part of the other block as it is: nothing
    is compared, so that beyond the pairs themselves the work is a tile for STEP * STEP of them. Only a manifest passes through the ordered window.
    """
    # an empty range meets none
    known = manifest.where("run is not null and lo <= hi").select("run", "hi", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("kind")))).alias("e")).select("run", "hi", "e.*")
    # begins and ends in one order: an end has seen the begins up to it
    seen = known.withColumn("no", F.sum(1 - F.col("kind")).over(Window.orderBy("at", "kind", "hi", "run").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    numbered = seen.groupBy("run").agg(F.min("no").alias("no"), F.max("no").alias("upto"))
    of = lambda c: F.floor(F.col(c) / STEP)
    blocks = numbered.groupBy(of("no").alias("block")).agg(F.sort_array(F.collect_list(F.struct("no", "upto", "run"))).alias("ranges"), F.max(of("upto")).alias("top"))
    tiles = blocks.select("block", F.explode(F.sequence("block", "top")).alias("other"))
    others = blocks.select(F.col("block").alias("other"), F.col("ranges.run").alias("others"))
    reaching = F.filter("ranges", lambda r: r["upto"] >= F.col("other") * STEP)
    # merged: tiles look small before they are made, and mustn't be broadcast
    met = tiles.join(others.hint("merge"), "other").join(blocks.select("block", "ranges").hint("merge"), "block").select("block", "other", "others", reaching.alias("ranges"))
    # a given number isn't lowered by adaptive execution, which sees only how few bytes the tiles have
    dealt = met.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "other")

    def part(r):
        first, end = F.greatest(r["no"] + 1 - F.col("other") * STEP, F.lit(0)), F.least(r["upto"] + 1 - F.col("other") * STEP, F.lit(STEP))
        return F.struct(r["run"].alias("a"), (first + 1).cast("int").alias("first"), F.greatest(end - first, F.lit(0)).cast("int").alias("n"))

    # as a transform isn't compiled, its rows come one at a time: a compiled stage would hold all pairs of a tile at once
    ranges = dealt.select("others", F.explode(F.transform("ranges", part)).alias("r"))
    pairs = ranges.select("r.a", F.explode(F.slice("others", F.col("r.first"), F.col("r.n"))).alias("b"))
    return pairs.select(F.least("a", "b").alias("a_run"), F.greatest("a", "b").alias("b_run"))


def islands(manifest: DataFrame) -> DataFrame:
    """Adds island: runs connected by overlapping ranges share one, counted from 1 in key order.

    Only a manifest (a row per run file) passes through the ordered window, never the data.
    """
    order = Window.orderBy("lo", "hi", "run")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = manifest.withColumn("opens", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    return opened.withColumn("island", F.sum("opens").over(order)).drop("opens")


def closure(manifest: DataFrame, seeds: DataFrame) -> DataFrame:
    """All runs that the seeds reach through overlaps, the seeds included."""
    marked = islands(manifest)
    return marked.join(marked.join(seeds.select("run"), "run", "left_semi").select("island").distinct(), "island", "left_semi").drop("island")
