"""Sharding (operator 6): jump consistent hashing, in DataFrame functions only.

A key's shard follows from the key and the number of shards alone, without a ring table; with one shard more, a
key either stays or moves into the new shard. The generator is the usual 64-bit linear congruence, kept in
exact decimals because long arithmetic that overflows is an error in ANSI mode.

Defined cases: a null key counts as key 0; equal keys share a shard; a null text has size 1 and checksum 0; rows
that repeat get slots of their own; an empty table gives no rows; only the key and the text are read, so other
columns' names do not matter. Negative keys are taken modulo 2**64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARDS = 8
#: Rows of a shard are ranked in this many parts, whose sizes are then summed up.
PARTS = 4096
#: Fixed value: the multiplier of the generator, 2862933555777941757, as high and low 32 bits.
HIGH, LOW = divmod(2862933555777941757, 1 << 32)
WHOLE, WORD = 1 << 64, 1 << 32


def jump(key: Column, shards: int) -> Column:
    """The last two jumps below shards and shards + 1, as a struct of ints: now, grown.

    The fold runs shards + 1 steps. A jump always goes upwards, so that many reach beyond any number of shards.
    """
    dec = "decimal(38,0)"
    whole, word, high, low = (F.lit(str(x)).cast(dec) for x in (WHOLE, WORD, HIGH, LOW))
    start = F.struct(
        F.pmod(F.coalesce(key.cast("long"), F.lit(0)).cast(dec), whole).cast("decimal(20,0)").alias("k"),
        F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        top = F.pmod(s["k"].cast(dec) * high.cast("decimal(11,0)"), word).cast("decimal(11,0)") * word.cast("decimal(11,0)")
        k = F.pmod(top.cast(dec) + (s["k"].cast("decimal(20,0)") * low.cast("decimal(11,0)")).cast(dec) + F.lit(1), whole).cast("decimal(20,0)")
        r = F.floor(k / F.lit(str(1 << 33)).cast("decimal(11,0)")).cast("double") + 1.0
        # once beyond the shards, the jump stays there
        j = F.when(s["j"] > shards, s["j"]).otherwise(F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / r)).cast("long"))
        return F.struct(
            k.alias("k"), j.alias("j"),
            F.when(j < shards, j).otherwise(s["now"]).alias("now"), F.when(j <= shards, j).otherwise(s["grown"]).alias("grown"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: F.struct(s["now"].cast("int").alias("now"), s["grown"].cast("int").alias("grown")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """One row for each row of docs: id, size, checksum, law, shard, slot within the shard and the shard with one more.

    Texts are not shuffled, only ids, sizes and checksums. Slots count from 0 without gaps: rows are ranked within
    parts of a shard, chosen by id, size and checksum, and the sizes of the parts before (shards * parts rows at most,
    so that they may be broadcast) are added.
    """
    text = F.coalesce(C.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(C.col(id_col).alias(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = rows.withColumn("__j", jump(F.col(id_col), shards)).select(
        "*", F.col("__j.now").alias("shard"), F.col("__j.grown").alias("grown_shard"), F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.lit(parts)).cast("int").alias("__part")
    ).drop("__j")
    from pyspark.sql import Window

    sizes = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = sizes.select(
        F.col("shard").alias("__shard"), F.col("__part").alias("__p"),
        (F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")).alias("__before"),
    )
    ranked = placed.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__part").orderBy(id_col, "text_crc32")) - 1)
    joined = ranked.join(F.broadcast(before), (F.col("shard") == F.col("__shard")) & (F.col("__part") == F.col("__p")))
    return joined.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__at")).alias("slot"), "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(C.read(spark, sf_dir, "documents"))


QUERIES = {"op6_sharding": op6_sharding}
