"""Frames, logs, compaction, maintenance and the command line."""

import argparse
import io
import random

import pytest
from pyspark.sql import functions as F

from siltmark import cli
from siltmark.functions import codecs, frames
from siltmark.maintenance import PERIODS, Maintenance
from siltmark.operators import compaction, runs
from siltmark.plans.queries import QUERIES
from siltmark.sources import records
from siltmark.store import Store


def test_frames(spark):
    cases = [
        (b"+\r\n", "simple=", 3, "complete"), (b"*0\r\n", "array=0", 4, "complete"), (b"*2\r\n*1\r\n$0\r\n\r\n:7\r\nmore", "array=2|array=1|bulk=|integer=7", 18, "complete"),
        (b"*2\r\n:1\r\n", "array=2|integer=1", 8, "incomplete"), (b"$3\r\nab", "", 0, "incomplete"), (b"$-2\r\n", "", 0, "invalid"), (b"!\r\n", "", 0, "invalid"), (b":x\r\n", "", 0, "invalid"),
        ("$3\r\nné\r\n".encode(), "bulk=né", 9, "complete"), (b"", "", 0, "incomplete"), (None, "", 0, "incomplete"), (b"+half\r", "", 0, "incomplete"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, b binary").select("k", frames.decode(F.col("b")).alias("d"), frames.complete(F.col("b")).alias("whole"))
    for r in df.select("k", frames.shown(F.col("d.nodes")).alias("n"), "d.used", "d.status", "whole").collect():
        assert (r["n"], r["used"], r["status"]) == cases[r["k"]][1:] and r["whole"] == (r["status"] == "complete"), cases[r["k"]]
    # every prefix of a frame waits for more
    whole = b"*3\r\n+SET\r\n$3\r\nkey\r\n$5\r\nva\r\nl\r\n"
    cut = spark.createDataFrame([(whole[:k],) for k in range(len(whole))], "b binary").select(frames.decode(F.col("b"))["status"].alias("s")).distinct().collect()
    assert [r["s"] for r in cut] == ["incomplete"]


def test_crc32c_of_bytes(spark):
    rng = random.Random(1)
    rows = [(rng.randbytes(n),) for n in (0, 1, 2, 9, 300)] + [(b"123456789",)]
    got = spark.createDataFrame(rows, "b binary").select("b", codecs.crc32c(F.col("b")).alias("c")).collect()
    assert all(r["c"] == codecs.crc32c_bytes(bytes(r["b"])) for r in got)


def test_logs(tmp_path, spark):
    rng = random.Random(2)
    payloads = [rng.randbytes(rng.choice([0, 1, 200, 32754, 32761, 32762, 100_000])) for _ in range(80)] + [b"the last"]
    log = records.encode_log(payloads)
    assert records.decode_log(log) == payloads and records.decode_log(log[:-7]) == payloads[:-1] and records.decode_log(b"") == []
    with pytest.raises(ValueError, match="checksum"):
        records.decode_log(log[:20] + bytes([log[20] ^ 1]) + log[21:] if payloads[0] else records.encode_log([b"abc"])[:-1] + b"x")
    with pytest.raises(ValueError, match="type"):
        records.decode_log(log[:6] + b"\x09" + log[7:])
    for name, some in (("2.log", payloads[:5]), ("10.log", payloads[5:9]), ("x.log", [b"no"]), ("3.txt", [b"no"])):
        (tmp_path / name).write_bytes(records.encode_log(some))
    got = {(r["log"], r["ordinal"]): bytes(r["payload"]) for r in records.read(spark, str(tmp_path)).collect()}
    assert got == {(2, k): p for k, p in enumerate(payloads[:5])} | {(10, k): p for k, p in enumerate(payloads[5:9])}


def test_overlap_pairs_of_a_chain(spark):
    rng = random.Random(3)
    ranges = [(k, 2 * k, 2 * k + 3) for k in range(1500)] + [(2000 + k, a := rng.randrange(3000), a + rng.randrange(60)) for k in range(200)] + [(5000, 0, 10_000), (5001, 7, 7)]
    got = {tuple(r) for r in runs.overlap_pairs(spark.createDataFrame(ranges, "run long, lo long, hi long")).collect()}
    assert got == {(a, b) for a, al, ah in ranges for b, bl, bh in ranges if a < b and al <= bh and ah >= bl}


def test_compaction_inputs_of_frames_and_of_stores_agree(spark):
    rng = random.Random(4)
    for _ in range(6):
        rows = [(k, rng.randrange(2), lo := rng.randrange(60), lo + rng.randrange(9)) for k in range(rng.randrange(1, 14))]
        df = spark.createDataFrame(rows, "run long, level long, lo long, hi long")
        for level in (0, 1):
            low, high = compaction.chosen([{"run": r, "level": v, "lo": a, "hi": b} for r, v, a, b in rows], level)
            want = {r["run"] for r in low + high}
            got = {r["run"] for r in compaction.inputs(df, level).collect()}
            assert got == want, (rows, level)


def write(store, pairs, start=0):
    store.write(store.spark.createDataFrame([(k, a, "DEL" if b is None else "SET", b) for k, (a, b) in enumerate(pairs)], "seq long, key string, op string, value string"))


def test_store_compacts_what_overlaps(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    for lo in (0, 100, 200, 150):
        write(s, [(f"k{lo + i:04}", f"v{lo}") for i in range(60)])
        s.flush()
    assert s.compact_due() == 1
    # the first run overlaps nothing; the second meets the last, and that the third
    levels = {(r["level"], r["lo"], r["hi"]) for r in s._manifest["runs"]}
    assert levels == {(0, "k0000", "k0059"), (1, "k0100", "k0259")}
    assert s.get("k0150") == "v150" and s.get("k0100") == "v100" and s.state().count() == 220
    assert not s.compact(5) and s.compact_due() == 0
    monkeypatch.setattr(compaction, "target_bytes", lambda level: 200)
    write(s, [(f"k{i:04}", "w") for i in range(120)])
    s.flush()
    assert s.compact(0)
    parts = [r for r in s._manifest["runs"] if r["level"] == 1]
    assert len(parts) > 3 and sum(r["n"] for r in parts) == 260
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:])) and s.state().count() == 260
    # deletions of all there is leave no run
    write(s, [(f"k{i:04}", None) for i in range(300)])
    s.flush()
    assert s.compact(0) and s._manifest["runs"] == [] and s.state().count() == 0
    gone = s.gc()
    assert any(x.startswith("manifest/") for x in gone) and len(s._names("manifest")) == 1 and s._names("run") == [] and not s.gc()
    assert Store(spark, str(tmp_path / "s")).state().count() == 0


def test_maintenance(spark, tmp_path):
    now = [0.0]
    s = Store(spark, str(tmp_path / "s"))
    m = Maintenance(s, clock=lambda: now[0])
    assert m.periods == PERIODS and m.tick() == []
    for k in range(4):
        s.set("k", str(k))
        m.handle("dump")
    now[0] = 61
    assert m.tick() == ["readers"]
    now[0] = 700
    assert m.tick() == ["readers", "logs", "runs", "compaction"] and m.tick() == []
    assert [r["level"] for r in s._manifest["runs"]] == [1] and s.get("k") == "3"
    assert s.gc_readers(1000) == 0 and s.gc_readers(0) >= 1 and s.gc_readers(0) == 0
    turns = iter([False, False, True])
    m.run(lambda: next(turns), pause=0)


def test_execute_and_command_line(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    out = io.StringIO()
    cli.run(s, ["set fruit 'red apple'\n", "get fruit\n", "get none\n", "\n", "del fruit\n", "get fruit\n", "ping\n", "ping hey\n", "set fruit\n", "jump x\n", "set a 1"], out)
    assert out.getvalue().split("\n") == ["1", "red apple", "(nil)", "1", "(nil)", "PONG", "hey", "wrong number of arguments", "unknown command", "1", ""]
    out = io.StringIO()
    cli.run(Store(spark, str(tmp_path / "s")), ["get a\n", "get fruit\n"], out, prompt="> ")
    assert out.getvalue() == "> 1\n> (nil)\n> "
    (tmp_path / "script.txt").write_text("set b 2\n\nget a\nget b\n")
    assert [r["shown"] for r in cli.answers(s.execute(cli.script(spark, str(tmp_path / "script.txt")))).orderBy("seq").collect()] == ["1", "1", "2"]
    assert s.get("b") == "2"
    many = spark.range(1500).select(F.col("id").alias("seq"), F.concat(F.lit("set n"), F.col("id") % 100, F.lit(" x"), F.col("id"), F.lit(" ")).alias("line"))
    assert s.execute(many).count() == 1500 and s.get("n7") == "x1407"
    s.close()


def test_arguments():
    args = cli.arguments(["--root", "/x", "--port", "80", "--host", "a-b.example"])
    assert cli.address(args) == "a-b.example:80" and args.root == "/x" and cli.address(cli.arguments(["--root", "/x"])) == "127.0.0.1:6379"
    for check, bad in ((cli.port, "0"), (cli.port, "65536"), (cli.port, "x"), (cli.host, "-a"), (cli.host, "a_b"), (cli.host, ""), (cli.folder, "")):
        with pytest.raises(argparse.ArgumentTypeError):
            check(bad)


def test_whole_answers_have_rows(spark):
    for name in ("compaction_candidates", "compaction_inputs_level3", "log_truncated_tail", "reply_errors"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1, name


def test_fragments_of_long_payloads_are_dealt_out(spark, tmp_path):
    ids = [0, 1, 337, 338, 675, 676, 1_383_346, 4_999_999, 5_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = QUERIES["record_fragments"](spark, str(tmp_path))
    want = []
    for i in ids:
        n = max(1, -(-i * 97 // 32761))
        want += [(i, k, "full" if n == 1 else "first" if k == 1 else "last" if k == n else "middle", min(32761, i * 97 - (k - 1) * 32761)) for k in range(1, n + 1)]
    assert df.columns == ["event_id", "part", "type", "bytes"] and sorted(tuple(r) for r in df.collect()) == want
    # one file, and two payloads that hold nearly all fragments
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 1 and max(held) < 0.8 * len(want)
    assert spark.createDataFrame([(3, None, 70_000)], "k int, v string, length long").transform(records.fragments).orderBy("part").collect() == [(3, None, 1, "first", 32761), (3, None, 2, "middle", 32761), (3, None, 3, "last", 4478)]


def test_overlap_pairs_are_dealt_out(spark):
    # ranges that all meet, over several blocks: few bytes, many pairs
    ranges = [(k * 7919 % 4000, k, 10_000 - k % 3) for k in range(4000)]
    df = runs.overlap_pairs(spark.createDataFrame(ranges, "run long, lo long, hi long"))
    held = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count(F.when(F.col("a_run") >= F.col("b_run"), 1)).alias("bad")).collect()
    assert sum(r["n"] for r in held) == 4000 * 3999 // 2 and not any(r["bad"] for r in held)
    assert len(held) > 1 and max(r["n"] for r in held) < 0.8 * 4000 * 3999 // 2


def test_overlap_pairs_of_odd_ranges(spark):
    rng = random.Random(5)
    ranges = [(k, a := rng.randrange(200_000), a + rng.choice([0, 0, 50, 300])) for k in range(3000)] + [(k, 70_000, 70_000) for k in range(3000, 3040)]
    ranges += [(4000, 0, 200_000), (4001, 100_000, 200_300), (4002, None, None), (4003, 5, None), (4004, None, 5), (None, 0, 200_000), (4005, None, None)]
    got = [tuple(r) for r in runs.overlap_pairs(spark.createDataFrame(ranges, "run long, lo long, hi long")).collect()]
    whole = [r for r in ranges if None not in r]
    want = {(a, b) for a, al, ah in whole for b, bl, bh in whole if a < b and al <= bh and ah >= bl}
    assert len(got) == len(want) and set(got) == want
    assert runs.overlap_pairs(spark.createDataFrame([], "run long, lo long, hi long")).count() == 0
