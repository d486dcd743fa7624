"""The command language: GET key, SET key value, DEL key, PING [message]; one command a line, quoted where needed.

A verb, in any case, must be followed by white space. Double quotes know \\" \\n \\r \\t \\\\, single quotes \\' \\\\.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import codecs, frames

VERB = r"^([A-Za-z]+)\s+"
TOKEN = r""""(?:[^"\\]|\\["nrt\\])*"|'(?:[^'\\]|\\['\\])*'|[^\s"']+"""


def _plain(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)

    def undo(pairs):
        def one(part):
            for mark, char in pairs:
                part = F.replace(part, F.lit("\\" + mark), F.lit(char))
            return part

        return F.array_join(F.transform(F.split(inner, r"\\\\"), one), "\\")

    return (
        F.when(token.startswith('"'), undo((('"', '"'), ("n", "\n"), ("r", "\r"), ("t", "\t"))))
        .when(token.startswith("'"), undo((("'", "'"),)))
        .otherwise(token)
    )


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds verb, args and error; error is null for a sound command."""
    text = F.col(line)
    verb = F.upper(F.regexp_extract(text, VERB, 1))
    rest = F.regexp_replace(text, VERB, "")
    args = F.transform(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)), _plain)
    out = lines.withColumn("verb", verb).withColumn("args", args)
    n = F.size("args")
    fits = F.when(F.col("verb").isin("GET", "DEL"), n == 1).when(F.col("verb") == "SET", n == 2).otherwise(n <= 1)
    error = (
        F.when(text.isNull() | (F.col("verb") == ""), F.lit("no command"))
        .when(F.trim(F.regexp_replace(rest, TOKEN, "")) != "", F.lit("syntax"))
        .when(~F.col("verb").isin("GET", "SET", "DEL", "PING"), F.lit("unknown command"))
        .when(~fits, F.lit("wrong number of arguments"))
    )
    return out.withColumn("error", error)


def replay(commands: DataFrame) -> DataFrame:
    """Parsed commands by seq, each with the value that it sees at its time, and its reply as a wire frame.

    Each key's commands are ordered by themselves; a PING has no key and sees nothing, so PINGs are spread by seq.
    """
    key = F.when(F.col("verb") != "PING", F.col("args")[0])
    sound = commands.where("error is null").withColumn("key", key)
    write = F.when(F.col("verb").isin("SET", "DEL"), F.struct(F.col("verb").alias("op"), F.get("args", F.lit(1)).alias("value")))
    before = Window.partitionBy("key", F.when(F.col("verb") == "PING", F.col("seq"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = sound.withColumn("w", write).withColumn("seen", F.last("w", ignorenulls=True).over(before))
    value = F.when(F.col("verb") == "GET", F.when(F.col("seen.op") == "SET", F.col("seen.value")))
    reply = (
        F.when(F.col("verb") == "GET", codecs.resp_bulk(value))
        .when(F.col("verb") == "PING", F.when(F.size("args") == 1, codecs.resp_bulk(F.get("args", F.lit(0)))).otherwise(codecs.resp_simple(F.lit("PONG"))))
        .otherwise(codecs.resp_simple(F.lit("OK")))
    )
    return seen.select("seq", "verb", "key", value.alias("value"), reply.alias("reply"))


def encode(commands: DataFrame) -> DataFrame:
    """Adds frame: a sound command as an array frame of its verb and arguments."""
    parts = F.concat(F.array(codecs.resp_simple(F.col("verb"))), F.transform("args", codecs.resp_bulk))
    return commands.withColumn("frame", codecs.resp_array(parts))


def printed(answered: DataFrame) -> DataFrame:
    """Adds shown: what a terminal prints; (nil) for a miss, 1 for a write, and a PING's message."""
    message = frames.reply(F.col("verb"), F.col("reply"))["value"]
    shown = F.when(F.col("verb") == "GET", F.coalesce("value", F.lit("(nil)"))).when(F.col("verb").isin("SET", "DEL"), F.lit("1")).otherwise(message)
    return answered.withColumn("shown", shown)
