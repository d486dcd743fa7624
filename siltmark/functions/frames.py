"""Wire frames read back: a fold over the bytes of a frame, and what a command's reply says.

A frame is walked node by node, an array before its elements, so that nested arrays need no recursion: what is still to be read is one
count. status is complete, incomplete (more bytes are needed) or invalid. Numbers are the digits that a line begins with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRLF = "\r\n"
NODE = "struct<kind:string,text:string>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def latin(data: Column) -> Column:
    """Bytes as a string of one character each, so that positions are bytes."""
    return F.decode(data.cast("binary"), "ISO-8859-1")


def text_of(part: Column) -> Column:
    return F.encode(part, "ISO-8859-1").cast("string")


def line_end(data: Column, at: Column) -> Column:
    """Where, from place at on (counted from 1), the line's end stands; 0 if it isn't there yet."""
    return F.position(F.lit(CRLF), data, at)


def peek(data: Column, at: Column) -> Column:
    """The byte at a place, empty behind the end."""
    return F.substring(data, at, F.lit(1))


def number(line: Column) -> Column:
    return F.regexp_extract(line, "^[0-9]+", 0).try_cast("int")


def decode(frame: Column) -> Column:
    """nodes (kind and text, arrays with their count before their elements), used bytes and status of the frame that data begins with."""
    return let(latin(F.coalesce(frame.cast("binary"), F.lit(b""))), _decode)


def _decode(s: Column) -> Column:
    def node(kind: str, text: Column, end: Column, more: Column | None = None) -> Column:
        return F.struct(F.lit("more").alias("status"), F.struct(F.lit(kind).alias("kind"), text.alias("text")).alias("node"), end.cast("int").alias("at"), (F.lit(0) if more is None else more).alias("more"))

    def stop(why: str) -> Column:
        return F.struct(F.lit(why).alias("status"), F.lit(None).cast(NODE).alias("node"), F.lit(0).alias("at"), F.lit(0).alias("more"))

    def read(at: Column) -> Column:
        def by_line(eol: Column) -> Column:
            kind, line = peek(s, at), F.substring(s, at + 1, eol - at - 1)
            n, body = number(line), eol + 2
            return (
                F.when(at > F.length(s), stop("incomplete"))
                .when(~kind.isin(*"+-:$*"), stop("invalid"))
                .when(eol == 0, stop("incomplete"))
                .when(kind == "+", node("simple", text_of(line), body))
                .when(kind == "-", node("error", text_of(line), body))
                .when((kind == "$") & line.startswith("-"), F.when(line == "-1", node("null", F.lit(None).cast("string"), body)).otherwise(stop("invalid")))
                .when(n.isNull(), stop("invalid"))
                .when(kind == ":", node("integer", n.cast("string"), body))
                .when(kind == "*", node("array", n.cast("string"), body, n))
                .when(F.length(s) < eol + n + 3, stop("incomplete"))
                .otherwise(node("bulk", text_of(F.substring(s, body, n)), body + n + 2))
            )

        return let(line_end(s, at + 1), by_line)

    def step(st: Column, _: Column) -> Column:
        def on(x: Column) -> Column:
            good = x["status"] == "more"
            return F.struct(
                x["status"].alias("status"), F.when(good, x["at"]).otherwise(st["at"]).alias("at"), F.when(good, st["left"] - 1 + x["more"]).otherwise(st["left"]).alias("left"),
                F.when(good, F.concat(st["nodes"], F.array(x["node"]))).otherwise(st["nodes"]).alias("nodes"),
            )

        return F.when((st["status"] != "more") | (st["left"] == 0), st).otherwise(let(read(st["at"]), on))

    start = F.struct(F.lit("more").alias("status"), F.lit(1).alias("at"), F.lit(1).alias("left"), F.array().cast(f"array<{NODE}>").alias("nodes"))
    turns = F.sequence(F.lit(1), F.size(F.split(s, CRLF, -1)) + 1)
    end = lambda st: F.struct(st["nodes"].alias("nodes"), (st["at"] - 1).alias("used"), F.when(st["left"] == 0, F.lit("complete")).when(st["status"] == "more", F.lit("incomplete")).otherwise(st["status"]).alias("status"))
    return F.aggregate(turns, start, step, end)


def complete(frame: Column) -> Column:
    """Whether data begins with a whole frame: a reader of a stream waits while it doesn't."""
    return decode(frame)["status"] == "complete"


def shown(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: F.concat(x["kind"], F.lit("="), F.coalesce(x["text"], F.lit("")))), "|")


def reply(verb: Column, frame: Column) -> Column:
    """value and error of a command's reply: GET gives a value or null, SET and DEL give OK, PING gives its message; an error frame its text."""

    def read(d: Column) -> Column:
        first = F.get(d["nodes"], F.lit(0))
        kind, text = first["kind"], first["text"]
        error = (
            F.when(d["status"] != "complete", d["status"])
            .when(kind == "error", text)
            .when((verb == "GET") & ~kind.isin("bulk", "simple", "null"), F.lit("unexpected reply"))
            .when(verb.isin("SET", "DEL") & ~(kind.isin("bulk", "simple") & (F.upper(text) == "OK")), F.lit("unexpected reply"))
            .when((verb == "PING") & ~kind.isin("bulk", "simple"), F.lit("unexpected reply"))
        )
        return F.struct(F.when(error.isNull(), text).alias("value"), error.alias("error"))

    return let(decode(frame), read)
