"""A store in a directory: appended mutation batches, runs by level and a versioned manifest, all Parquet.

One writer at a time. A run is written before the manifest version that names it, so a crash between leaves only
unreferenced files, which gc() removes. Every write is one DataFrame of keys; per-key calls make frames of one row, and a script of
commands is one frame for execute().
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import commands
from .operators import compaction, state

LOG = "seq long, key string, op string, value string"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._manifest = self._load()
        self._readers: dict[str, tuple[DataFrame, float]] = {}

    def _hpath(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        p = self._hpath(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _load(self) -> dict:
        """The newest complete manifest version; a version is complete once it has its final name."""
        names = [x for x in self._names("manifest") if x.endswith(".json")]
        if not names:
            return {"version": 0, "next": 1, "seq": 0, "logs": [], "runs": []}
        stream = self._fs.open(self._hpath(f"manifest/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1}
        name = f"manifest/{manifest['version']:012d}.json"
        out = self._fs.create(self._hpath(name + ".tmp"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(self._hpath(name + ".tmp"), self._hpath(name)):
            raise OSError(f"another writer has published {name}")
        self._manifest = manifest

    def write(self, mutations: DataFrame) -> None:
        """Appends mutations (seq, key, op, value); their seq must be unique and is taken after all earlier writes."""
        m, number = self._manifest, self._manifest["next"]
        shifted = mutations.select((F.col("seq") + m["seq"]).alias("seq"), "key", "op", F.col("value").cast("string").alias("value"))
        seen = Observation()
        shifted.observe(seen, F.max("seq").alias("top")).write.mode("overwrite").parquet(f"{self.path}/log/{number}")
        top = seen.get["top"]
        self._publish(m | {"next": number + 1, "seq": (top if top is not None else m["seq"]) + 1, "logs": [*m["logs"], number]})

    def set(self, key: str, value: str) -> None:
        self.write(self.spark.createDataFrame([(0, key, "SET", value)], LOG))

    def delete(self, key: str) -> None:
        self.write(self.spark.createDataFrame([(0, key, "DEL", None)], LOG))

    def log(self) -> DataFrame:
        """All mutations that a read must see: those of the runs and of the unflushed batches."""
        m = self._manifest
        paths = [f"log/{n}" for n in m["logs"]] + [f"run/{r['run']}" for r in m["runs"]]
        return self.reader(*paths) if paths else self.spark.createDataFrame([], LOG)

    def reader(self, *names: str) -> DataFrame:
        """A frame over some of the store's folders, kept for later reads; reading touches it."""
        key = "\n".join(names)
        frame = self._readers[key][0] if key in self._readers else self.spark.read.schema(LOG).parquet(*[f"{self.path}/{n}" for n in names])
        self._readers[key] = frame, time.time()
        return frame

    def gc_readers(self, idle: float, now: float | None = None) -> int:
        """Drops frames that nobody has read for idle seconds, and returns how many."""
        old = [k for k, (_, at) in self._readers.items() if (time.time() if now is None else now) - at >= idle]
        for k in old:
            self._readers.pop(k)[0].unpersist()
        return len(old)

    def state(self) -> DataFrame:
        return state.live(state.latest(self.log()))

    def get(self, key: str) -> str | None:
        row = state.get(self.log(), key).first()
        return row and row["value"]

    def mget(self, keys: DataFrame) -> DataFrame:
        return state.mget(self.log(), keys)

    def ping(self, message: str | None = None) -> str:
        return "PONG" if message is None else message

    def execute(self, lines: DataFrame) -> DataFrame:
        """Runs commands (seq, line) in their order: each sound one sees the store and all before it. Returns seq, line, error, verb, value and reply.

        The state of the keys named comes in front as writes; what the script sets and deletes is appended as one batch.
        """
        parsed = commands.parse(lines)
        sound = parsed.where("error is null")
        named = sound.where("verb <> 'PING'").select(F.col("args")[0].alias("key")).distinct()
        now = self.mget(named).where("value is not null").select(F.lit(-1).cast("long").alias("seq"), F.lit("SET").alias("verb"), F.array("key", "value").alias("args"), F.lit(None).cast("string").alias("error"))
        answered = commands.replay(sound.select("seq", "verb", "args", "error").unionByName(now)).where("seq >= 0")
        out = lines.join(parsed.select("seq", "error"), "seq").join(answered, "seq", "left").select("seq", "line", "error", "verb", "value", "reply")
        rows = out.collect() if self._small(lines) else None
        batch = sound.where("verb in ('SET', 'DEL')").select("seq", F.col("args")[0].alias("key"), F.col("verb").alias("op"), F.get("args", F.lit(1)).alias("value"))
        if rows is None:  # read before the writes, as they change what a later read gives
            folder = f"{self.path}/reply/{self._manifest['version']}"
            out.write.mode("overwrite").parquet(folder)
            out = self.spark.read.parquet(folder)
        else:
            out = self.spark.createDataFrame(rows, out.schema)
        if batch.take(1):
            self.write(batch)
        return out

    @staticmethod
    def _small(lines: DataFrame) -> bool:
        return len(lines.limit(1001).collect()) <= 1000

    def _write_runs(self, rows: DataFrame, number: int, level: int, limit: int | None) -> list[dict]:
        """Writes rows (a key once each) in key order, in pieces of about limit bytes, and returns their entries; no rows give none."""
        size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 1).cast("long")
        rows = rows.select("seq", "key", "op", "value")
        pieces = rows.withColumn("piece", F.lit(0).cast("long")) if limit is None else compaction.size_split(rows.withColumn("bytes", size), "bytes", limit).drop("bytes")
        folder = f"{self.path}/run/{number}"
        pieces.repartitionByRange("piece", "key").sortWithinPartitions("piece", "key").write.mode("overwrite").partitionBy("piece").parquet(folder)
        if not any(x.startswith("piece=") for x in self._names(f"run/{number}")):
            return []
        # a row for each output run, as many as the manifest gets
        made = self.spark.read.parquet(folder).groupBy("piece").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy("piece").collect()
        return [{"run": f"{number}/piece={r['piece']}", "level": level, "lo": r["lo"], "hi": r["hi"], "n": r["n"], "bytes": r["bytes"]} for r in made]

    def flush(self) -> None:
        """All unflushed batches become one run of level 0."""
        m = self._manifest
        if m["logs"]:
            new = self._write_runs(state.latest(self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/{n}" for n in m["logs"]])), m["next"], 0, None)
            self._publish(m | {"next": m["next"] + 1, "logs": [], "runs": [*m["runs"], *new]})

    def compact(self, level: int) -> bool:
        """Merges a seed run of a level, what it overlaps there and the next level's overlaps into runs of the next level, of its
        size each; tombstones go if nothing lies deeper. False if there are no two runs to merge."""
        m = self._manifest
        low, high = compaction.chosen(m["runs"], level)
        old = [*high, *low]
        if not old:
            return False
        rows = state.latest(self.spark.read.schema(LOG).parquet(*[f"{self.path}/run/{r['run']}" for r in old]))
        if compaction.may_drop(level + 1, max(r["level"] for r in m["runs"])):
            rows = rows.where("op <> 'DEL'")
        new = self._write_runs(rows, m["next"], level + 1, compaction.target_bytes(level + 1))
        self._publish(m | {"next": m["next"] + 1, "runs": [*[r for r in m["runs"] if r not in old], *new]})
        return True

    def compact_due(self) -> int:
        """Compacts once every level that has reached its number of runs, the upper first; returns how many were."""
        done = 0
        for level in sorted({r["level"] for r in self._manifest["runs"]}):
            n = sum(r["level"] == level for r in self._manifest["runs"])
            if n >= (compaction.LEVEL0_RUNS if level == 0 else compaction.LEVEL_RUNS):
                done += self.compact(level)
        return done

    def gc(self) -> list[str]:
        return [*self.gc_logs(), *self.gc_runs(), *self.gc_manifests()]

    def _drop(self, names: list[str]) -> list[str]:
        for name in names:
            self._fs.delete(self._hpath(name), True)
        return names

    def gc_logs(self) -> list[str]:
        """Deletes, and returns, folders of batches that the manifest no longer names."""
        live = {str(n) for n in self._manifest["logs"]}
        return self._drop([f"log/{n}" for n in self._names("log") if n not in live])

    def gc_runs(self) -> list[str]:
        """The same for runs; pieces of one compaction that are still named stay."""
        live = {r["run"] for r in self._manifest["runs"]}
        dead = []
        for n in self._names("run"):
            pieces = [f"{n}/{x}" for x in self._names(f"run/{n}") if x.startswith("piece=")]
            if not live & set(pieces):
                dead.append(f"run/{n}")
            else:
                dead += [f"run/{x}" for x in pieces if x not in live]
        return self._drop(dead)

    def gc_manifests(self) -> list[str]:
        """The same for versions of the manifest before the newest."""
        return self._drop([f"manifest/{x}" for x in self._names("manifest") if x < f"{self._manifest['version']:012d}.json"])

    def close(self) -> None:
        """Drops the readers. Nothing is flushed: batches that aren't are read again when the store is opened."""
        self.gc_readers(0)
