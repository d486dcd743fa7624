"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, commands, frames
from ..operators import compaction, runs, state
from ..sources import mutations as M
from ..sources import records
from ..store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = "m as (select event_id seq, 'u' || user_id as key, case when event_type = 'error' then 'DEL' else 'SET' end as op, case when event_type = 'error' then null else value end as value from events)"
OD = "m as (select o_orderkey seq, 'c' || o_custkey as key, case when o_orderstatus = 'P' then 'DEL' else 'SET' end as op, case when o_orderstatus = 'P' then null else o_totalprice end as value from orders)"
LAST = "l as (select key, op, value, seq from (select *, row_number() over (partition by key order by seq desc) rn from m) where rn = 1)"
RUNS = "r as (select run, key, op, value, seq from (select *, row_number() over (partition by run, key order by seq desc) rn from (select *, cast(floor(seq / 1000) as bigint) run from m)) where rn = 1)"
#: Runs 0 to 4 lie at level 2, 5 to 8 at level 1, the rest at level 0.
LEVELS = "v as (select *, case when run < 5 then 2 when run < 9 then 1 else 0 end as level from r)"
MANIFEST = "f as (select run, min(key) lo, max(key) hi, count(*) n, count(*) filter (op = 'DEL') tombstones from r group by run)"
#: Runs of the users seen at most twice in a slice of events, their ranges those of the event numbers.
SPANS = "s as (select user_id as run, min(event_id) lo, max(event_id) hi from events where event_id % 10 = 3 and event_id < 1500 group by user_id having count(*) <= 2)"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def events(spark, d):
    return M.from_events(M.table(spark, d, "events"))


def orders(spark, d):
    return M.from_orders(M.table(spark, d, "orders"))


def event_runs(spark, d):
    return runs.flush(events(spark, d), F.floor(F.col("seq") / 1000).cast("long"))


def levelled(spark, d):
    return event_runs(spark, d).withColumn("level", F.when(F.col("run") < 5, 2).when(F.col("run") < 9, 1).otherwise(0))


def spans(spark, d):
    e = M.table(spark, d, "events").where("event_id % 10 = 3 and event_id < 1500")
    return e.groupBy(F.col("user_id").alias("run")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("*").alias("n")).where("n <= 2").drop("n")


def wanted(spark, d):
    return M.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key"))


WANTED = "k as (select 'c' || c_custkey as key from customer where c_custkey % 3 = 0)"
LIVE = "select key, value, seq from l where op = 'SET'"

query("mutation_log", f"with {EV} select * from m")(events)
query("sequence_check", f"with {EV} select seq, count(*) n from m group by seq having count(*) > 1 or seq is null")(lambda s, d: M.with_seq_check(events(s, d)))
query("state_max_by", f"with {EV}, {LAST} {LIVE}")(lambda s, d: state.live(state.latest(events(s, d))))
query("state_row_number", f"with {EV}, {LAST} {LIVE}")(lambda s, d: state.live(state.latest_ranked(events(s, d))))
query("state_orders", f"with {OD}, {LAST} {LIVE}")(lambda s, d: state.live(state.latest(orders(s, d))))
query("state_with_tombstones", f"with {EV}, {LAST} select * from l")(lambda s, d: state.latest(events(s, d)))
query("tombstone_keys", f"with {EV}, {LAST} select key, seq from l where op = 'DEL'")(lambda s, d: state.latest(events(s, d)).where("op = 'DEL'").select("key", "seq"))
query("get_point", f"with {EV}, {LAST} {LIVE} and key = 'u7'")(lambda s, d: state.get(events(s, d), "u7"))
query("get_missing", f"with {EV}, {LAST} {LIVE} and key = 'nobody'")(lambda s, d: state.get(events(s, d), "nobody"))
query("mget_left_join", f"with {OD}, {LAST}, {WANTED} select k.key, x.value, x.seq from k left join ({LIVE}) x on x.key = k.key")(lambda s, d: state.mget(orders(s, d), wanted(s, d)))
query("exists_semi", f"with {OD}, {LAST}, {WANTED} select key from k where key in (select key from l where op = 'SET')")(lambda s, d: state.exists(orders(s, d), wanted(s, d)))
query("absent_anti", f"with {OD}, {LAST}, {WANTED} select key from k where key not in (select key from l where op = 'SET')")(lambda s, d: state.absent(orders(s, d), wanted(s, d)))
query("range_scan", f"with {OD}, {LAST} {LIVE} and key >= 'c10' and key < 'c2'")(lambda s, d: state.scan(orders(s, d), "c10", "c2"))
query("state_as_of", f"with {EV.replace('from events', 'from events where event_id <= 5000')}, {LAST} {LIVE}")(lambda s, d: state.as_of(events(s, d), 5000))
query("flush_runs", f"with {EV}, {RUNS} select * from r")(event_runs)
query("run_manifest", f"with {EV}, {RUNS}, {MANIFEST} select * from f")(lambda s, d: runs.manifest(event_runs(s, d)))
query("sorted_run_scan", f"with {EV}, {RUNS} select *, row_number() over (partition by run order by key) as at from r")(lambda s, d: runs.sorted_scan(event_runs(s, d)))
query("search_runs", f"with {EV}, {RUNS}, {MANIFEST} select * from f where lo <= 'u99' and hi >= 'u99'")(lambda s, d: runs.search(runs.manifest(event_runs(s, d)), "u99"))
query(
    "first_hit_by_level",
    f"with {EV}, {RUNS}, {LEVELS} select key, level, run, op, value from (select *, row_number() over (partition by key order by level, run desc) rn from v where key like 'u1%') where rn = 1",
)(lambda s, d: runs.first_hit(levelled(s, d), events(s, d).where("key like 'u1%'")))
query("overlap_pairs", f"with {SPANS} select a.run a_run, b.run b_run from s a join s b on a.run < b.run and a.lo <= b.hi and a.hi >= b.lo")(lambda s, d: runs.overlap_pairs(spans(s, d)))
query(
    "overlap_closure",
    f"with recursive {SPANS}, c as (select * from s where run = (select min(run) from s) union select s.* from s join c on s.lo <= c.hi and s.hi >= c.lo) select run, lo, hi from c",
)(lambda s, d: runs.closure(spans(s, d), spans(s, d).agg(F.min("run").alias("run"))))
# The same operators over whole tables: the SQL above fixes subsets of users and keys.
ALL = "k as (select 'c' || c_custkey as key from customer)"


def all_spans(spark, d):
    return M.table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


def customers(spark, d):
    return M.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key"))


query("mget_left_join_all", f"with {OD}, {LAST}, {ALL} select k.key, x.value, x.seq from k left join ({LIVE}) x on x.key = k.key")(lambda s, d: state.mget(orders(s, d), customers(s, d)))
query("exists_semi_all", f"with {OD}, {LAST}, {ALL} select key from k where key in (select key from l where op = 'SET')")(lambda s, d: state.exists(orders(s, d), customers(s, d)))
query("absent_anti_all", f"with {OD}, {LAST}, {ALL} select key from k where key not in (select key from l where op = 'SET')")(lambda s, d: state.absent(orders(s, d), customers(s, d)))
query("first_hit_by_level_all", f"with {EV}, {RUNS}, {LEVELS} select key, level, run, op, value from (select *, row_number() over (partition by key order by level, run desc) rn from v) where rn = 1")(
    lambda s, d: runs.first_hit(levelled(s, d), events(s, d))
)
# Every user's range over all events; no SQL, as the pairs and the recursion of whole tables are too many for it.
query("overlap_pairs_all", None)(lambda s, d: runs.overlap_pairs(all_spans(s, d)))
query("overlap_closure_all", None)(lambda s, d: runs.closure(all_spans(s, d), all_spans(s, d).agg(F.min("run").alias("run"))))
UPPER = f"with {EV}, {RUNS}, {LEVELS}, w as (select key, op, value, seq from (select *, row_number() over (partition by key order by level, run desc) rn from v WHERE) where rn = 1) select * from w"
query("compact_keep_tombstones", UPPER.replace("WHERE", "where level < 2"))(lambda s, d: compaction.merge(levelled(s, d).where("level < 2"), False))
query("compact_drop_tombstones", UPPER.replace("WHERE", "") + " where op <> 'DEL'")(lambda s, d: compaction.merge(levelled(s, d), True))
#: Runs of 250 events in turn at four levels, their ranges those of the event numbers and 100 more, so that neighbours overlap.
STAIRS = "t as (select cast(floor(event_id / 250) as bigint) as run, cast(floor(event_id / 250) as bigint) % 4 as level, min(event_id) as lo, max(event_id) + 100 as hi from events group by 1, 2)"


def stairs(spark, d):
    run = F.floor(F.col("event_id") / 250).cast("long")
    return M.table(spark, d, "events").groupBy(run.alias("run"), (run % 4).alias("level")).agg(F.min("event_id").alias("lo"), (F.max("event_id") + 100).alias("hi"))


query("compaction_candidates", f"with {STAIRS} select level, count(*) as runs from t group by level having (level = 0 and count(*) >= 4) or count(*) >= 10")(lambda s, d: compaction.candidates(stairs(s, d)))
for _level in range(4):
    # at level 0 of these runs nothing overlaps within the level, so that a seed stands alone
    query(
        f"compaction_inputs_level{_level}",
        f"with {STAIRS}, s as (select *, (select count(*) from t h where h.level = {_level + 1} and h.lo <= t.hi and h.hi >= t.lo) as more from t where level = {_level}), "
        "c as (select * from s where more > 0 order by run limit 1), p as (select * from c union all select * from (select * from s order by run limit 3) where (select count(*) from c) = 0), "
        f"w as (select min(lo) as lo, max(hi) as hi from p) select {_level} as level, run from p union all select {_level + 1} as level, t.run from t, w where t.level = {_level + 1} and t.lo <= w.hi and t.hi >= w.lo",
    )(lambda s, d, level=_level: compaction.inputs(stairs(s, d), level))
query(
    "compaction_split",
    f"with {OD}, {LAST}, z as (select key, octet_length(encode(key)) + 8 as size from l), y as (select key, size, cast(floor((sum(size) over (order by key) - size) / 2048) as bigint) as piece from z) "
    "select piece, min(key) as lo, max(key) as hi, count(*) as n, cast(sum(size) as bigint) as bytes from y group by piece",
)(
    lambda s, d: compaction.size_split(state.latest(orders(s, d)).select("key", (F.octet_length("key") + 8).cast("long").alias("size")), "size", 2048)
    .groupBy("piece").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
)


def store_state(spark, d):
    """The state of a store after its runs are flushed, compacted and cleaned up; it lies in the warehouse, which a cluster shares."""
    store = Store(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/store-{uuid.uuid4().hex}")
    log = events(spark, d)
    for part in range(4):
        store.write(log.where(F.col("seq") % 4 == part).select("seq", "key", "op", "value"))
        store.flush()
    store.compact_due()
    store.gc()
    return store.state().select("key", F.col("value").cast("double").alias("value"))


# four batches, each in its own order, the later over the earlier
query(
    "store_state",
    f"with {EV}, b as (select *, seq % 4 as part from m), x as (select *, row_number() over (partition by key order by part desc, seq desc) as rn from b) select key, value from x where rn = 1 and op = 'SET'",
)(store_state)
RANGES = "g as (select o_custkey as run, min(cast(o_orderkey as varchar)) as lo, max(cast(o_orderkey as varchar)) as hi from orders group by 1)"


def order_ranges(spark, d):
    key = F.col("o_orderkey").cast("string")
    return M.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))


query("range_key_order", f"with {RANGES} select run, case when '5000' < lo then 1 when '5000' > hi then -1 else 0 end as side, lo = '' or hi = '' as empty from g")(
    lambda s, d: order_ranges(s, d).select("run", runs.key_order(F.col("lo"), F.col("hi"), F.lit("5000")).alias("side"), runs.is_empty(F.col("lo"), F.col("hi")).alias("empty"))
)
query(
    "range_cover",
    f"with {RANGES} select run, case when lo <= '5' and hi >= '3' then least(lo, '3') else lo end as lo, case when lo <= '5' and hi >= '3' then greatest(hi, '5') else hi end as hi from g",
)(lambda s, d: order_ranges(s, d).select("run", runs.cover(F.col("lo"), F.col("hi"), F.lit("3"), F.lit("5")).alias("r")).select("run", "r.lo", "r.hi"))
query("manifest_bytes", f"with {RANGES} select run, 28 + octet_length(encode(lo)) + octet_length(encode(hi)) as bytes, sum(32 + octet_length(encode(lo)) + octet_length(encode(hi))) over () + 8 as whole from g".replace(", sum(", ", cast(sum(").replace(") over () + 8", ") over () as bigint) + 8"))(
    lambda s, d: (r := order_ranges(s, d).select("run", codecs.manifest_entry_bytes(F.col("lo"), F.col("hi")).alias("bytes"), F.lit(1).alias("one"))).join(r.groupBy("one").agg((F.sum(F.col("bytes") + 4) + 8).alias("whole")), "one").drop("one")
)
query(
    "level_rewrite_anti_union",
    f"with {EV}, {RUNS}, {LEVELS}, w as (select key, op, value, seq from (select *, row_number() over (partition by key order by level, run desc) rn from v where level < 2) where rn = 1) select run, level, key, op, value, seq from v where level = 2 union all select 1000, 1, key, op, value, seq from w",
)(
    lambda s, d: compaction.level_rewrite(
        (v := levelled(s, d).select("run", "level", "key", "op", "value", "seq")),
        v.where("level < 2"),
        compaction.merge(v.where("level < 2"), False).select(F.lit(1000).cast("long").alias("run"), F.lit(1).alias("level"), "key", "op", "value", "seq"),
    )
)
query(
    "size_split",
    f"with {OD}, {LAST}, z as (select key, octet_length(encode(key)) + 8 as size from l where op = 'SET') select key, size, cast(floor((sum(size) over (order by key) - size) / 4096) as bigint) as piece from z",
)(lambda s, d: compaction.size_split(state.live(state.latest(orders(s, d))).select("key", (F.octet_length("key") + 8).cast("long").alias("size")), "size", 4096))
query("gc_dead_runs", f"with {EV}, {RUNS} select distinct run from r where run % 3 <> 0")(lambda s, d: compaction.dead_runs(event_runs(s, d).select("run").distinct(), event_runs(s, d).where("run % 3 = 0").select("run").distinct()))
query("gc_logs", "select distinct cast(floor(event_id / 500) as bigint) as log from events where event_id < 3500")(
    lambda s, d: compaction.dead_logs(M.table(s, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("log")).distinct(), 7)
)
VERSIONS = "e as (select event_id as version, user_id as run, case when event_type = 'error' then 'remove' else 'add' end as action, cast(event_id % 3 as bigint) as level from events)"
query("manifest_latest_version", f"with {VERSIONS} select run, level from (select *, row_number() over (partition by run order by version desc) rn from e) where rn = 1 and action = 'add'")(
    lambda s, d: compaction.latest_version(
        M.table(s, d, "events").select(F.col("event_id").alias("version"), F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), (F.col("event_id") % 3).alias("level"))
    )
)
LINES = (
    "i as (select event_id seq, case event_id % 6 when 0 then 'set u' || user_id || ' \"' || event_type || ' \\\"x\\\"\"' when 1 then 'GET u' || user_id || ' ' "
    "when 2 then 'del  ''u' || user_id || '''' when 3 then 'ping hello' when 4 then 'set u' || user_id else 'what u' || user_id end as line from events)"
)


def lines(spark, d):
    u, t = F.concat(F.lit("u"), F.col("user_id")), F.col("event_type")
    k = F.col("event_id") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("set "), u, F.lit(' "'), t, F.lit(' \\"x\\""')))
        .when(k == 1, F.concat(F.lit("GET "), u, F.lit(" ")))
        .when(k == 2, F.concat(F.lit("del  '"), u, F.lit("'")))
        .when(k == 3, F.lit("ping hello"))
        .when(k == 4, F.concat(F.lit("set "), u))
        .otherwise(F.concat(F.lit("what "), u))
    )
    return M.table(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("line"))


PARSED = "select event_id seq, event_id % 6 k, 'u' || user_id u, event_type t from events"
query(
    "parse_commands",
    f"select seq, case k when 0 then 'SET' when 1 then 'GET' when 2 then 'DEL' when 3 then 'PING' when 4 then 'SET' else 'WHAT' end as verb, case k when 0 then u || '|' || t || ' \"x\"' when 3 then 'hello' else u end as args, case k when 4 then 'wrong number of arguments' when 5 then 'unknown command' end as error from ({PARSED})",
)(lambda s, d: commands.parse(lines(s, d)).select("seq", "verb", F.array_join("args", "|").alias("args"), "error"))
query("command_errors", "select case event_id % 6 when 4 then 'wrong number of arguments' else 'unknown command' end as error, count(*) n from events where event_id % 6 > 3 group by 1")(
    lambda s, d: commands.parse(lines(s, d)).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
)
REPLAY = (
    f"with p as ({PARSED}), w as (select seq, k, u, case when k = 3 then null else u end as key, case k when 0 then t || ' \"x\"' end as v from p where k < 4), "
    "x as (select *, last_value(case when k in (0, 2) then k end ignore nulls) over q as wk, last_value(case k when 0 then v when 2 then '' end ignore nulls) over q as wv from w window q as (partition by key, case when k = 3 then seq end order by seq rows between unbounded preceding and 1 preceding)), "
    "y as (select seq, case k when 0 then 'SET' when 1 then 'GET' when 2 then 'DEL' else 'PING' end as verb, key, case when k = 1 and wk = 0 then wv end as value from x) "
)
CRLF = "chr(13) || chr(10)"
query(
    "replay_commands",
    REPLAY + f"select *, case verb when 'GET' then case when value is null then '$-1' || {CRLF} else '$' || octet_length(encode(value)) || {CRLF} || value || {CRLF} end when 'PING' then '$5' || {CRLF} || 'hello' || {CRLF} else '+OK' || {CRLF} end as reply from y",
)(lambda s, d: commands.replay(commands.parse(lines(s, d))))
query("resp_encode", f"select seq, '*2' || {CRLF} || '+GET' || {CRLF} || '$' || octet_length(encode(u)) || {CRLF} || u || {CRLF} as frame from ({PARSED}) where k = 1")(
    lambda s, d: commands.encode(commands.parse(lines(s, d)).where("error is null and verb = 'GET'")).select("seq", "frame")
)
query("value_encode_hex", f"with {EV}, {LAST} select key, case when op = 'DEL' then '00' else '01' || hex(encode(key)) end as stored from l")(
    lambda s, d: state.latest(events(s, d)).select("key", codecs.encode_value(F.col("op"), F.col("key")).alias("stored"))
)
query("value_decode", f"with {EV}, {LAST} select key, case when op = 'SET' then key end as back from l")(
    lambda s, d: state.latest(events(s, d)).select("key", codecs.decode_value(codecs.encode_value(F.col("op"), F.col("key"))).alias("back"))
)
query(
    "prefix_shared_len",
    "select n_name as name, r_name as other, cast((select count(*) from generate_series(1, least(length(n_name), length(r_name))) g(i) where substr(n_name, 1, i) = substr(r_name, 1, i)) as int) as shared from nation join region on n_regionkey = r_regionkey",
)(
    lambda s, d: M.table(s, d, "nation").join(M.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    .select(F.col("n_name").alias("name"), F.col("r_name").alias("other"), codecs.shared_prefix(F.col("n_name"), F.col("r_name")).alias("shared"))
)
query("wal_record_len", "select event_id, cast(event_id * 97 + 7 * greatest(1, ceil(event_id * 97 / 32761.0)) as bigint) as bytes from events")(
    lambda s, d: M.table(s, d, "events").select("event_id", codecs.record_bytes(F.col("event_id") * 97).alias("bytes"))
)
_CRC_TABLE = f"[list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, {codecs.POLYNOMIAL}) else a >> 1 end) for n in range(256)]"
query(
    "crc32c",
    f"with t as (select {_CRC_TABLE} as tab), e as (select distinct event_type as x from events), c as (select x, xor(list_reduce(list_prepend(4294967295, [cast(ord(ch) as bigint) for ch in string_split(x, '')]), "
    "lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) as crc from e, t) select event_id, crc from events join c on event_type = x",
)(lambda s, d: M.table(s, d, "events").select("event_id", codecs.crc32c(F.col("event_type")).alias("crc")))
query(
    "little_endian",
    "select event_id, (select string_agg(substr(h, 15 - 2 * i, 2), '' order by i) from (select printf('%016X', event_id * 99991) as h), generate_series(0, 7) g(i)) as stored, cast(event_id * 99991 as decimal(20, 0)) as back from events",
)(lambda s, d: M.table(s, d, "events").select("event_id", codecs.little_endian(F.col("event_id") * 99991).alias("stored")).withColumn("back", codecs.from_little_endian(F.col("stored"))))
query("value_bytes", f"with {EV}, {LAST} select key, case when op = 'DEL' then 1 else 1 + octet_length(encode(key)) end as bytes from l")(
    lambda s, d: state.latest(events(s, d)).select("key", codecs.value_bytes(F.col("op"), F.col("key")).alias("bytes"))
)
query("value_errors", "select event_id, case event_id % 4 when 2 then 'unknown tag' when 3 then 'empty' end as error from events")(
    lambda s, d: M.table(s, d, "events").select("event_id", codecs.stored_error(F.element_at(F.array(F.lit("00"), F.lit("0141"), F.lit("0241"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))).alias("error"))
)
query("record_types", "select event_id, case event_id % 6 when 1 then 'full' when 2 then 'first' when 3 then 'middle' when 4 then 'last' else 'illegal' end as type from events")(
    lambda s, d: M.table(s, d, "events").select("event_id", codecs.record_type(F.col("event_id") % 6).alias("type"))
)
query(
    "record_fragments",
    "with p as (select event_id, event_id * 97 as n, greatest(1, cast(ceil(event_id * 97 / 32761.0) as int)) as k from events) select event_id, cast(i as int) as part, "
    "case when k = 1 then 'full' when i = 1 then 'first' when i = k then 'last' else 'middle' end as type, least(32761, n - (i - 1) * 32761) as bytes from p, generate_series(1, k) g(i)",
)(lambda s, d: records.fragments(M.table(s, d, "events").select("event_id", (F.col("event_id") * 97).alias("length"))))


def log_tails(spark, d):
    """Logs of 500 events each, cut off by seven bytes and read back: the last payload is lost, the others are whole."""
    e = M.table(spark, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("log"), F.col("event_id").alias("ordinal"), F.repeat("props", (F.col("event_id") % 50 + 1).cast("int")).alias("payload"))
    cut = records.encoded(e).withColumn("bytes", F.expr("substring(bytes, 1, octet_length(bytes) - 7)"))
    back = records.decoded(cut)
    return back.groupBy("log").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"), F.max("ordinal").alias("last"))


query(
    "log_truncated_tail",
    "with p as (select cast(floor(event_id / 500) as bigint) as log, event_id, octet_length(encode(props)) * (event_id % 50 + 1) as n, max(event_id) over (partition by floor(event_id / 500)) as top from events) "
    "select log, count(*) as n, cast(sum(n) as bigint) as bytes, count(*) - 1 as last from p where event_id < top group by log",
)(log_tails)


def wire(spark, d):
    """Frames of every kind, whole, cut and wrong."""
    t, n = F.col("props"), F.col("event_id").cast("string")
    bulk = codecs.resp_bulk(t)
    kinds = [
        codecs.resp_simple(t), codecs.resp_error(n), codecs.resp_integer(F.col("event_id")), bulk, codecs.resp_bulk(F.lit(None).cast("string")),
        codecs.resp_array(F.array(bulk, codecs.resp_integer(F.col("event_id")), codecs.resp_array(F.array(codecs.resp_simple(n), codecs.resp_bulk(F.lit("a\r\nb")))))),
        F.substring(bulk, F.lit(1), F.length(bulk) - 3), F.concat(F.lit("?"), n, F.lit("\r\n")), F.concat(codecs.resp_integer(F.col("event_id")), F.lit("+next")),
    ]
    return M.table(spark, d, "events").select("event_id", F.element_at(F.array(*kinds), (F.col("event_id") % 9 + 1).cast("int")).alias("frame"))


_N = "octet_length(encode(props))"
query(
    "resp_decode",
    f"with p as (select event_id, event_id % 9 as k, props, cast(event_id as varchar) as n, {_N} as b from events) select event_id, case k when 0 then 'simple=' || props when 1 then 'error=' || n when 2 then 'integer=' || n when 3 then 'bulk=' || props when 4 then 'null=' "
    f"when 5 then 'array=3|bulk=' || props || '|integer=' || n || '|array=2|simple=' || n || '|bulk=a' || {CRLF} || 'b' when 8 then 'integer=' || n else '' end as nodes, "
    "cast(case k when 0 then b + 3 when 1 then length(n) + 3 when 2 then length(n) + 3 when 3 then 5 + length(cast(b as varchar)) + b when 4 then 5 when 5 then 4 + 5 + length(cast(b as varchar)) + b + length(n) + 3 + 4 + length(n) + 3 + 10 when 8 then length(n) + 3 else 0 end as int) as used, "
    "case k when 6 then 'incomplete' when 7 then 'invalid' else 'complete' end as status from p",
)(lambda s, d: wire(s, d).select("event_id", frames.decode(F.col("frame")).alias("d")).select("event_id", frames.shown(F.col("d.nodes")).alias("nodes"), F.col("d.used").alias("used"), F.col("d.status").alias("status")))
query(
    "resp_encode_kinds",
    f"with p as (select event_id, event_id % 9 as k, props, cast(event_id as varchar) as n, {_N} as b from events) select event_id, case k when 1 then '-' || n || {CRLF} when 2 then ':' || n || {CRLF} else '$-1' || {CRLF} end as frame from p where k in (1, 2, 4)",
)(lambda s, d: wire(s, d).where("event_id % 9 in (1, 2, 4)"))
query("reply_parse", REPLAY + "select seq, case verb when 'GET' then value when 'PING' then 'hello' else 'OK' end as value, cast(null as varchar) as error from y")(
    lambda s, d: commands.replay(commands.parse(lines(s, d))).select("seq", frames.reply(F.col("verb"), F.col("reply")).alias("r")).select("seq", "r.value", "r.error")
)
query("reply_errors", "select event_id, case event_id % 9 when 1 then cast(event_id as varchar) when 2 then 'unexpected reply' when 5 then 'unexpected reply' when 6 then 'incomplete' when 7 then 'invalid' when 8 then 'unexpected reply' end as error from events")(
    lambda s, d: wire(s, d).select("event_id", frames.reply(F.lit("GET"), F.col("frame"))["error"].alias("error"))
)
query("cli_shown", REPLAY + "select seq, case verb when 'GET' then coalesce(value, '(nil)') when 'PING' then 'hello' else '1' end as shown from y")(
    lambda s, d: commands.printed(commands.replay(commands.parse(lines(s, d)))).select("seq", "shown")
)
query(
    "command_encode",
    f"select seq, case k when 0 then '*3' || {CRLF} || '+SET' || {CRLF} || '$' || octet_length(encode(u)) || {CRLF} || u || {CRLF} || '$' || octet_length(encode(t || ' \"x\"')) || {CRLF} || t || ' \"x\"' || {CRLF} "
    f"when 2 then '*2' || {CRLF} || '+DEL' || {CRLF} || '$' || octet_length(encode(u)) || {CRLF} || u || {CRLF} when 3 then '*2' || {CRLF} || '+PING' || {CRLF} || '$5' || {CRLF} || 'hello' || {CRLF} end as frame from ({{PARSED}}) where k in (0, 2, 3)".replace("{PARSED}", PARSED),
)(lambda s, d: commands.encode(commands.parse(lines(s, d)).where("error is null and verb <> 'GET'")).select("seq", "frame"))
