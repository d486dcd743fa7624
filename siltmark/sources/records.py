"""Native log files: payloads as checksummed fragments in blocks of fixed size.

A log file is rotated at a few MiB, so that a whole one is a row: files are read as binaries, one decoder call each.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import BLOCK, HEADER, TYPES, crc32c_bytes, fragment, fragment_count

NUMBERS = {name: k for k, name in TYPES.items()}


def encode_log(payloads: list[bytes]) -> bytes:
    """The bytes of a log; a block's tail too short for a header stays empty."""
    out = bytearray()
    for data in payloads:
        at, begun = 0, False
        while not begun or at < len(data):
            room = BLOCK - len(out) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = data[at : at + room - HEADER]
            whole = at + len(part) == len(data)
            kind = ("last" if whole else "middle") if begun else ("full" if whole else "first")
            out += struct.pack("<IHB", crc32c_bytes(part), len(part), NUMBERS[kind]) + part
            at, begun = at + len(part), True
    return bytes(out)


def decode_log(log: bytes) -> list[bytes]:
    """The payloads; one that the end of the log cuts off is left out. A wrong type, order, length or checksum raises ValueError."""
    out: list[bytes] = []
    parts: list[bytes] | None = None
    at = 0
    while True:
        if BLOCK - at % BLOCK < HEADER:
            at += BLOCK - at % BLOCK
        if at + HEADER > len(log):
            return out
        check, size, number = struct.unpack_from("<IHB", log, at)
        kind, end = TYPES.get(number), at + HEADER + size
        if kind is None:
            raise ValueError(f"illegal record type {number} at byte {at}")
        if end > at - at % BLOCK + BLOCK:
            raise ValueError(f"a record at byte {at} passes its block")
        if end > len(log):
            return out
        data = log[at + HEADER : end]
        if crc32c_bytes(data) != check:
            raise ValueError(f"wrong checksum at byte {at}")
        if (parts is None) != (kind in ("full", "first")):
            raise ValueError(f"record type {kind} out of order at byte {at}")
        if kind == "full":
            out.append(data)
        else:
            parts = [*(parts or []), data]
            if kind == "last":
                out.append(b"".join(parts))
                parts = None
        at = end


#: Fragments that are listed at once.
STEP = 4096


def fragments(payloads: DataFrame) -> DataFrame:
    """How payloads lie in a log from a block's start: a row with part, type and bytes for each fragment, and the other columns.

    payloads have a column length. The result itself grows with the lengths, not with the rows. A payload is cut into stretches of
    STEP fragments, and stretches are dealt out evenly before they are listed, so that one file or a few long payloads keep every core busy.
    """
    names = [c for c in payloads.columns if c != "length"]
    counted = payloads.withColumn("_n", fragment_count(F.col("length")))
    stretches = counted.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(STEP))))
    # a given number isn't lowered by adaptive execution, which sees only how few bytes the stretches have
    dealt = stretches.repartition(int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_from")
    # subtraction first: no overflow behind the last stretch
    listed = dealt.withColumn("_part", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.least(F.lit(STEP - 1), F.col("_n") - F.col("_from")))))
    return listed.select(*names, *fragment(F.col("length"), F.col("_n"), F.col("_part")))


def decoded(logs: DataFrame) -> DataFrame:
    """log, ordinal and payload of logs (log, bytes)."""

    def run(batches):
        for b in batches:
            for log, data in zip(b.column(0), b.column(1)):
                found = decode_log(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([log.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], names=["log", "ordinal", "payload"])

    return logs.selectExpr("cast(log as bigint) as log", "bytes").mapInArrow(run, "log long, ordinal long, payload binary")


def encoded(payloads: DataFrame) -> DataFrame:
    """(log, bytes) from (log, ordinal, payload); a log is a few MiB, so that one is a group."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        return pa.table({"log": rows["log"].slice(0, 1), "bytes": pa.array([encode_log(rows["payload"].to_pylist())], pa.binary())})

    return payloads.selectExpr("cast(log as bigint) as log", "ordinal", "cast(payload as binary) as payload").groupBy("log").applyInArrow(run, "log long, bytes binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """log, ordinal and payload of all files NUMBER.log in a folder; other names are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    named = files.selectExpr("try_cast(regexp_extract(path, '([0-9]+)[.]log$', 1) as bigint) as log", "content as bytes").where("log is not null")
    return decoded(named)
