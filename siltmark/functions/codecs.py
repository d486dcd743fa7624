"""Scalar codecs: stored values, wire frames, checksums, shared key prefixes and log framing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a log block and of a record header; the reflected polynomial of CRC-32C.
BLOCK, HEADER, POLYNOMIAL = 32768, 7, 0x82F63B78


def encode_value(op: Column, value: Column) -> Column:
    """Hex of a stored value: a tag byte (01 set, 00 deleted) and the value's UTF-8."""
    return F.when(op == "DEL", F.lit("00")).otherwise(F.concat(F.lit("01"), F.hex(F.encode(value, "UTF-8"))))


def decode_value(stored: Column) -> Column:
    """Inverse of encode_value; null for a tombstone."""
    return F.when(F.substring(stored, 1, 2) == "01", F.decode(F.unhex(F.substring(stored, F.lit(3), F.length(stored))), "UTF-8"))


def resp_bulk(text: Column) -> Column:
    """A bulk frame, its length in bytes; the null frame for null."""
    return F.coalesce(F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n")), F.lit("$-1\r\n"))


def resp_simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def resp_error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit("\r\n"))


def resp_integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit("\r\n"))


def resp_array(frames: Column) -> Column:
    """frames: an array of encoded frames."""
    return F.concat(F.lit("*"), F.size(frames).cast("string"), F.lit("\r\n"), F.array_join(frames, ""))


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two keys share at the front."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(
        F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    )


def record_bytes(payload: Column) -> Column:
    """Bytes of a payload in a log from a block's start: a header for each fragment that a block can hold."""
    return payload + HEADER * F.greatest(F.lit(1), F.ceil(payload / F.lit(BLOCK - HEADER))).cast("long")


def fragment_count(length: Column) -> Column:
    """Fragments of a payload of so many bytes in a log from a block's start."""
    return F.greatest(F.lit(1), F.ceil(length / F.lit(BLOCK - HEADER))).cast("int")


def fragment(length: Column, n: Column, part: Column) -> list[Column]:
    """part, type and bytes of one of a payload's n fragments, counted from 1."""
    room = BLOCK - HEADER
    return [
        part.alias("part"),
        F.when(n == 1, "full").when(part == 1, "first").when(part == n, "last").otherwise("middle").alias("type"),
        F.least(F.lit(room).cast("long"), length - (part - 1) * room).cast("long").alias("bytes"),
    ]


#: Numbers of the record types in a header.
TYPES = {1: "full", 2: "first", 3: "middle", 4: "last"}


def record_type(number: Column) -> Column:
    """The name of a record type, illegal for any other number."""
    out = F.lit("illegal")
    for k, name in TYPES.items():
        out = F.when(number == k, F.lit(name)).otherwise(out)
    return out


def value_bytes(op: Column, value: Column) -> Column:
    """Bytes of a stored value."""
    return F.when(op == "DEL", F.lit(1)).otherwise(F.octet_length(value) + 1).cast("long")


def stored_error(stored: Column) -> Column:
    """Why hex of a stored value can't be decoded; null if it can."""
    return F.when(F.coalesce(F.length(stored), F.lit(0)) < 2, F.lit("empty")).when(~F.substring(stored, 1, 2).isin("00", "01"), F.lit("unknown tag"))


def manifest_entry_bytes(lo: Column, hi: Column) -> Column:
    """Bytes of a run in a native manifest: 28 and those of its range's ends; a whole manifest has 8, and 4 before each entry."""
    return (F.lit(28) + F.octet_length(lo) + F.octet_length(hi)).cast("long")


def _turned(text: Column, width: int) -> Column:
    return F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(width))])


def little_endian(n: Column, width: int = 8) -> Column:
    """Hex of a whole number from 0 on in so many bytes, the lowest first."""
    return _turned(F.lpad(F.hex(n), 2 * width, "0"), width)


def from_little_endian(text: Column, width: int = 8) -> Column:
    """Inverse of little_endian, unsigned."""
    return F.conv(_turned(text, width), 16, 10).cast("decimal(20,0)")


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ POLYNOMIAL * (n & 1)
        out.append(n)
    return out


_TABLE = _crc_table()


def crc32c_bytes(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _TABLE
    for b in data:
        c = t[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def crc32c(data: Column) -> Column:
    """CRC-32C of a string's UTF-8 or of bytes, by table in a fold; the built-in crc32 has another polynomial."""
    table = F.array(*[F.lit(x).cast("long") for x in _TABLE])
    coded = F.hex(data.cast("binary"))
    places = F.when(F.length(coded) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.length(coded) / 2, F.lit(1)).cast("int") - 1))

    def step(c: Column, i: Column) -> Column:
        b = F.conv(F.substring(coded, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        return F.get(table, c.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")).bitwiseXOR(F.shiftright(c, 8))

    return F.aggregate(places, F.lit(0xFFFFFFFF).cast("long"), step, lambda c: c.bitwiseXOR(F.lit(0xFFFFFFFF)))
