"""The command line: `python -m siltmark --root FOLDER` reads commands from a terminal or a pipe and runs them on a store."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import commands
from .store import Store

#: Where a server listens by default, should one stand in front.
HOST, PORT = "127.0.0.1", 6379
LABEL = re.compile(r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)")


def port(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is no port number")
    if not 1 <= int(text) <= 65535:
        raise argparse.ArgumentTypeError("a port lies between 1 and 65535")
    return int(text)


def host(text: str) -> str:
    labels = text.removesuffix(".").split(".")
    if len(text) > 253 or not all(LABEL.fullmatch(x) for x in labels):
        raise argparse.ArgumentTypeError(f"{text!r} is no host name")
    return text


def folder(text: str) -> str:
    if not text or "\0" in text:
        raise argparse.ArgumentTypeError(f"{text!r} is no path")
    return text


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siltmark", description=__doc__)
    p.add_argument("--root", type=folder, required=True, help="the store's folder")
    p.add_argument("--host", type=host, default=HOST)
    p.add_argument("--port", type=port, default=PORT)
    p.add_argument("--script", type=folder, help="a text file of commands, in any store that Spark reads, instead of standard input")
    return p.parse_args(argv)


def address(args: argparse.Namespace) -> str:
    return f"{args.host}:{args.port}"


def script(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a text file of commands. Numbers follow the lines' places; blank lines are left out. A blank stands for a line's end."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return lines.where("trim(line) <> ''").withColumn("line", F.concat("line", F.lit(" ")))


def answers(done: DataFrame) -> DataFrame:
    """seq and shown, what a terminal prints for a command or its error."""
    return commands.printed(done).select("seq", F.coalesce("error", "shown").alias("shown"))


def run(store: Store, lines, out, prompt: str = "") -> None:
    """Commands from an iterable of lines: with a prompt one by one, otherwise all in one batch."""
    schema = "seq long, line string"

    def answer(some: list[str]) -> None:
        frame = store.spark.createDataFrame([(k, x.rstrip("\r\n") + " ") for k, x in enumerate(some)], schema)
        for r in answers(store.execute(frame)).orderBy("seq").toLocalIterator():
            out.write(r["shown"] + "\n")

    if prompt:
        out.write(prompt)
        out.flush()
        for line in lines:
            if line.strip():
                answer([line])
            out.write(prompt)
            out.flush()
    elif every := [x for x in lines if x.strip()]:
        answer(every)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("siltmark").getOrCreate()
    store = Store(spark, args.root)
    if args.script:
        for r in answers(store.execute(script(spark, args.script))).orderBy("seq").toLocalIterator():
            print(r["shown"])
    else:
        run(store, sys.stdin, sys.stdout, "> " if sys.stdin.isatty() else "")
    store.close()
    return 0
