import pytest

from siltmark.functions import commands
from siltmark.store import Store
from siltmark.streaming import state as streaming


def test_store_life(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.get("a") is None and s.ping() == "PONG" and s.ping("x") == "x"
    s.set("a", "1")
    s.set("", "empty key")
    s.set("b", "")
    s.flush()
    s.delete("a")
    s.flush()
    assert s.get("a") is None and s.get("") == "empty key" and s.get("b") == ""
    again = Store(spark, str(tmp_path / "s"))
    again.compact(0)
    assert again.state().count() == 2 and again.get("a") is None
    assert again.gc() and not again.gc()
    assert Store(spark, str(tmp_path / "s")).get("b") == ""


def test_tombstone_goes_only_at_the_deepest_level(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for key in "akz":  # a compaction takes two runs at least, so that each key is written twice
        for value in ("older", "old"):
            s.set(key, value)
            s.flush()
        assert s.compact(0)
    assert s.compact(1) and {r["level"] for r in s._manifest["runs"]} == {2} and s.get("k") == "old"
    for _ in range(2):
        s.delete("k")
        s.flush()
    assert s.compact(0)
    assert s.get("k") is None and s.log().count() == 4
    assert s.compact(1)
    assert s.get("k") is None and s.log().count() == 2 and s.get("a") == "old"


@pytest.mark.parametrize(
    "line, verb, args, error",
    [
        ("get 123", "GET", ["123"], None),
        ('get     "123"     ', "GET", ["123"], None),
        ("  get", "", None, "no command"),
        ("ping", "", None, "no command"),
        ("ping ", "PING", [], None),
        (r'get "a\\b \"c\" \n\r\td"', "GET", ['a\\b "c" \n\r\td'], None),
        (r"get '\'\\'", "GET", ["'\\"], None),
        ("get ''", "GET", [""], None),
        ('get "x', "GET", None, "syntax"),
        ("set a", "SET", ["a"], "wrong number of arguments"),
        ("mix a", "MIX", ["a"], "unknown command"),
        (None, None, None, "no command"),
    ],
)
def test_parse(spark, line, verb, args, error):
    r = commands.parse(spark.createDataFrame([(line,)], "line string")).first()
    assert r["error"] == error and (verb is None or r["verb"] == verb) and (args is None or r["args"] == args)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 7}", "DEL" if i % 5 == 0 else "SET", str(i)) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], "seq long, key string, op string, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, key string, op string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    from siltmark.operators import state

    got = {tuple(r) for r in state.latest(streaming.read_runs(spark, str(tmp_path / "out"))).collect()}
    want = {tuple(r) for r in state.latest(spark.createDataFrame(rows, "seq long, key string, op string, value string")).collect()}
    assert got == want
