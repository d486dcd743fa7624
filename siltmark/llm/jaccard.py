"""Near-duplicates by exact Jaccard similarity of word shingles: how simhash.deduplicate settles a stated similarity.

Two documents are near copies if their sets of shingles (WORDS words each, in lower case; a shorter text is one shingle) have a
Jaccard similarity of at least SIMILAR. No pair is missed: with the
shingles of all documents in one fixed order, two such sets share one of the first n - ceil(0.8 n) + 1 shingles of each. The order
puts the frequent shingles of a sample last; the sample bears on the speed only.

Documents with the same set are one node. Of all that share a shingle each is first compared with the least node and with the CHAIN next
ones in an order by a hash of shingle and node only; then, within the components found so, only pairs of different components are, those
within the shingle's largest component left out. So a large group of near copies isn't paired with itself: where too few are similar to the
least node, the chains, others at each shingle, hold the group together. Each candidate is verified on the whole sets; sets are sent for the nodes of candidates only,
which the tasks know by a bitmap of a fixed size (a node that is there by chance is dropped afterwards). Pairs of different components
that share a rare shingle are compared by sketches within the join, which never rules out a similar pair: only likely pairs become rows, though the
comparisons can be quadratic if many unlike documents share the shingle, and the rows if many that are just less than similar do.

Defined cases: null, empty and wordless texts have the empty set and are copies of one another. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WORDS, SEED = 5, 42
#: Similarity as a fraction, so that the limit itself is exact.
SIMILAR = (4, 5)
#: Of so many documents the order of shingles is taken from one; how many shingles it puts last.
SHARE, FREQUENT = 16, 100_000
#: Of a shingle's nodes in the order by hash, how many next ones each is compared with at first.
CHAIN = 2
#: Nodes in a group when pairs are tested; bits of the map of candidates.
GROUP, MAP_BITS = 4096, 1 << 26
#: Places of a sketch.
BITS = 2048
#: Bytes of text whose shingles are made at once.
PART = 1 << 20


def sets_of(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Of each text the hashes of its distinct shingles, sorted.

    All by arrays: a shingle is a sum of its words' hashes times odd numbers, mixed.
    """
    out: list[np.ndarray] = []
    begin = held = 0
    for at, t in enumerate(texts):
        held += len(t)
        if held >= PART or at == len(texts) - 1:
            out += _sets_of(texts[begin : at + 1], size)
            begin, held = at + 1, 0
    return out


#: A-Z to a-z and white space to blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([c]), SEED) for c in range(256)], "<u8")
_STEP = np.uint64(xxhash.xxh64_intdigest(b"step", SEED) | 5)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * _BYTE[1]
    h = (h ^ h >> np.uint64(32)) * (_BYTE[2] | np.uint64(1))
    return h ^ h >> np.uint64(29)


def _sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([t.translate(PLAIN) for t in texts]) + b" ", np.uint8)
    blank = data == 32
    edge = np.diff(blank, prepend=True)
    starts, ends = np.flatnonzero(edge & ~blank), np.flatnonzero(edge & blank)
    # a word's hash: the sum of its bytes' numbers times powers, from differences of running sums
    run = np.cumsum(_BYTE[data] * np.cumprod(np.full(len(data), _STEP)))
    down = np.cumprod(np.full(len(data), _BACK))
    before = np.where(starts > 0, run[starts - 1], np.uint64(0))
    h = _mixed((run[ends - 1] - before) * down[starts] + (ends - starts).astype("<u8") * _BYTE[3])
    del run, down
    lengths = np.array([len(t) for t in texts], np.int64) + 1
    first = np.searchsorted(starts, np.cumsum(lengths) - lengths)
    counts = np.diff(np.append(first, len(starts)))
    times = [_BYTE[4 + k] | np.uint64(1) for k in range(size)]
    padded, summed = np.concatenate([h, np.zeros(size, "<u8")]), np.zeros(len(h), "<u8")
    for k in range(size):
        summed += padded[k : k + len(h)] * times[k]
    summed, out = _mixed(summed).view("<i8"), []
    for at, n in zip(first.tolist(), counts.tolist()):
        if n >= size:
            out.append(np.unique(summed[at : at + n - size + 1]))
        elif n:
            own = sum(int(x) * int(t) for x, t in zip(h[at : at + n], times)) + n
            out.append(_mixed(np.array([own & (1 << 64) - 1], "<u8")).view("<i8"))
        else:
            out.append(np.empty(0, "<i8"))
    return out


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set, signed: bit i is set if over half of the shingles' hashes have it."""
    votes = np.unpackbits(found.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64) if len(found) else np.zeros(64)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray) -> bytes:
    """Whether the number of shingles is odd at each of BITS places: two sets differ by at least as many shingles as their sketches by bits."""
    odd = np.bincount(found.view("<u8") % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


#: Longs of a small sketch, the halves of a sketch folded onto one another.
SMALL = 8


def small(whole: bytes) -> list[int]:
    return np.bitwise_xor.reduce(np.frombuffer(whole, "<i8").reshape(-1, SMALL)).tolist()


SEEN = [C.field("node", C.LONG), C.field("n", C.INT), C.field("fp", C.LONG), C.field("sketch", T.BinaryType()), C.field("small", T.ArrayType(C.LONG))]


def seen_of(docs: DataFrame, carry, text_col: str, size: int = WORDS) -> DataFrame:
    """carry, node, number of shingles, fingerprint and sketch of each document."""

    def factory():
        def work(texts):
            made = sets_of(texts, size)
            sketches = [sketch(s) for s in made]
            return [[node_of(s) for s in made], [len(s) for s in made], [fingerprint(s) for s in made], sketches, [small(x) for x in sketches]]

        return work

    return C.map_texts(docs, carry, C.col(text_col), SEEN, factory)


def bitmap(keys: DataFrame) -> DataFrame:
    """(k, bits): for each key a bit at its place among MAP_BITS, in at most MAP_BITS / 32768 rows of 4 kB."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(MAP_BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def marked(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """rows with __marked: false only if the key is none of those that the bitmap was made from."""
    place = F.pmod(F.col(key), F.lit(MAP_BITS))
    known = bits.select((F.col("k") - 1).alias("__k"), F.col("bits").alias("__bits"))
    one = F.substring("__bits", F.pmod(F.shiftright(place, 3), F.lit(4096)).cast("int") + 1, F.lit(1))
    bit = F.conv(F.hex(one), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))) != 0
    met = rows.join(F.broadcast(known), F.shiftright(place, 15) == F.col("__k"), "left")
    return met.withColumn("__marked", F.coalesce(bit, F.lit(False))).drop("__k", "__bits")


def _bits(keys: DataFrame) -> np.ndarray:
    out = np.zeros((MAP_BITS >> 15, 4096), np.uint8)
    for r in bitmap(keys).collect():
        out[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sets_for(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and value, the set itself, of each text whose node is, or by chance seems, one of nodes."""
    shared = texts.sparkSession.sparkContext.broadcast(_bits(nodes))

    def run(batches):
        bits = shared.value
        for b in batches:
            for part in C.slices(b):
                made = [(node_of(s), s) for s in sets_of(part.column(0).to_pylist(), size)]
                kept = [(n, s.tobytes()) for n, s in made if bits[(n % MAP_BITS) >> 3] >> (n & 7) & 1]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], names=["node", "value"])
        C.let_go()

    return texts.select(F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, "node long, value binary")


def prefix(found: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a similar set shares one; last: sorted frequent shingles with their ranks."""
    n = len(found)
    if len(last):
        at = np.minimum(np.searchsorted(last, found), len(last) - 1)
        found = found[np.lexsort((found, np.where(last[at] == found, rank[at], -1)))]
    return found[: n - (-(-n * SIMILAR[0] // SIMILAR[1])) + 1]


def frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample holds often, sorted, and their ranks by frequency."""
    def run(batches):
        for b in batches:
            for s in C.slices(b):
                made = sets_of(s.column(0).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, "<i8"), *made]))], names=["token"])

    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    counts = picked.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("df")).where("df > 2")
    top = counts.orderBy(F.desc("df"), "token").limit(FREQUENT).toArrow()
    token, df = top["token"].to_numpy(), top["df"].to_numpy()
    by = np.argsort(token)
    return token[by], df[by]


def shared(texts: DataFrame, size: int) -> DataFrame:
    """token, node, n, at and met: the places of nodes among the first shingles that others have there too, and those others (node, n) to compare
    at first: the least one and the next ones by hash, if they are possible."""
    order = texts.sparkSession.sparkContext.broadcast(frequent(texts, size))

    def factory():
        last, rank = order.value

        def work(data):
            made = sets_of(data, size)
            return [[node_of(s) for s in made], [len(s) for s in made], [prefix(s, last, rank) if len(s) else s for s in made]]

        return work

    kept = C.map_texts(texts, [], F.col("text"), [C.field("node", C.LONG), C.field("n", C.INT), C.field("p", T.ArrayType(C.LONG))], factory)
    places = kept.select("node", "n", F.posexplode("p").alias("at", "token"))
    w = Window.partitionBy("token").orderBy("node")
    once = places.withColumn("before", F.lag("node").over(w)).where("before is null or before <> node").drop("before")
    own, v = F.struct("node", "n", "at"), Window.partitionBy("token").orderBy(F.xxhash64("token", "node"), "node")
    near = once.select("*", F.first(own).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lead("node").over(w).alias("next"))
    chained = near.where("first.node <> node or next is not null").select("token", "node", "n", "at", F.array("first", *(F.lead(own, k).over(v) for k in range(1, CHAIN + 1))).alias("met"))
    likely = F.filter("met", lambda y: y.isNotNull() & (y["node"] != F.col("node")) & possible(F.col("n"), F.col("at"), y["n"], y["at"]))
    return chained.withColumn("met", F.transform(likely, lambda y: F.struct(y["node"].alias("node"), y["n"].alias("n"))))


def possible(xn, xat, yn, yat):
    """False if sets of these sizes that share the shingles at these places of the order can't be similar."""
    most = F.least(xat, yat) + F.least(xn - xat, yn - yat)
    up, down = SIMILAR
    return (F.least(xn, yn) * down >= F.greatest(xn, yn) * up) & (most * (up + down) >= (xn + yn) * up)


def tested(pairs: DataFrame, values_for: Callable[[DataFrame], DataFrame], test: Callable[[bytes, bytes, int, int], bool]) -> DataFrame:
    """The pairs (a, b, an, bn) whose values pass; values_for: from nodes to (node, value), more nodes and repeats allowed.

    Nodes fall into groups of some GROUP nodes, pairs into blocks of two groups; a value goes once to each block that has a pair of its
    node, however many pairs that are.
    """
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    groups = max(1, needed.count() // GROUP)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    ga, gb = of("a"), of("b")
    placed = pairs.select(F.least(ga, gb).alias("g"), F.greatest(ga, gb).alias("h"), "a", "b", "an", "bn")
    where = placed.select("g", "h", F.col("a").alias("node")).union(placed.select("g", "h", "b")).distinct()
    once = values_for(needed).groupBy("node").agg(F.first("value").alias("value"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        value = dict(zip(left["vnode"].to_pylist(), left["value"].to_pylist()))
        rows = zip(*(right[c].to_pylist() for c in ("a", "b", "an", "bn")))
        return right.select(["a", "b", "an", "bn"]).filter(pa.array([test(value[a], value[b], an, bn) for a, b, an, bn in rows], pa.bool_()))

    sent = where.join(once, "node").select(F.col("g").alias("vg"), F.col("h").alias("vh"), F.col("node").alias("vnode"), "value")
    return sent.groupBy("vg", "vh").cogroup(placed.groupBy("g", "h")).applyInArrow(run, "a long, b long, an int, bn int").checkpoint()


def verified(pairs: DataFrame, seen: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; sketches, which never rule out a similar pair, are compared first."""
    close = tested(pairs.distinct().checkpoint(), lambda nodes: seen.select("node", F.col("sketch").alias("value")).join(nodes, "node", "left_semi"), _near)
    return tested(close, lambda nodes: sets_for(texts, nodes, size), _similar).select("a", "b")


def _near(x: bytes, y: bytes, xn: int, yn: int) -> bool:
    up, down = SIMILAR
    apart = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
    return min(xn, yn) * down >= max(xn, yn) * up and apart * (up + down) <= (xn + yn) * (down - up)


def _similar(x: bytes, y: bytes, xn: int, yn: int) -> bool:
    up, down = SIMILAR
    same = len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True))
    return same * down >= (xn + yn - same) * up


def pairs_of(x: str, y: str):
    low, high = (f(F.struct(f"{x}.node", f"{x}.n"), F.struct(f"{y}.node", f"{y}.n")) for f in (F.least, F.greatest))
    return [low["node"].alias("a"), high["node"].alias("b"), low["n"].alias("an"), high["n"].alias("bn")]


def links(seen: DataFrame, texts: DataFrame, near: DataFrame, components, size: int = WORDS) -> DataFrame:
    """Edges a < b that connect whatever is similar. seen: node and sketch of each of texts (text); near: pairs (a, b, an, bn) of nodes that are likely similar;
    components: a function from edges to (node, root)."""
    places = shared(texts, size).checkpoint()
    met = places.select(F.struct("node", "n").alias("x"), F.explode("met").alias("y")).select(*pairs_of("x", "y"))
    found = verified(met.union(near), seen, texts, size)
    roots = components(found).withColumnRenamed("node", "__node")
    known = places.join(roots, F.col("node") == F.col("__node"), "left").select("token", "node", "n", "at", F.coalesce("root", "node").alias("part"))
    mixed = known.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    here = known.join(mixed, "token", "left_semi").checkpoint()
    sizes = here.groupBy("token", "part").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    sketches = seen.join(here.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("small").alias("small"))
    here = here.join(sizes, "token").join(sketches, "node")
    x, y = here.where("part <> main").alias("x"), here.alias("y")
    apart = (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    # compared by small sketches where they meet, so that only likely pairs become rows
    differ = sum((F.bit_count(F.col("x.small")[i].bitwiseXOR(F.col("y.small")[i])) for i in range(SMALL)), F.lit(0))
    close = differ * sum(SIMILAR) <= (F.col("x.n") + F.col("y.n")) * (SIMILAR[1] - SIMILAR[0])
    cross = x.join(y, F.col("x.token") == F.col("y.token")).where(apart & possible(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")) & close)
    return found.union(verified(cross.select(*pairs_of("x", "y")), seen, texts, size)).distinct()
