"""SimHash near-duplicates (operator 8): segment-popcount embedding, grid join, exact check, components.

A fingerprint's 64 bits form 32 segments of two bits; the segments' popcounts embed it in a grid, where the Manhattan
distance is never above the number of differing bits. Two fingerprints at most DISTANCE = 2 bits apart agree in
every popcount of at least one of three thirds of the segments, so the grid cells are those thirds. Within a cell
pairs are kept by Manhattan distance and then verified by differing bits.

A cell of over CELL fingerprints, as large groups of near copies make, isn't paired. Its fingerprints go
through midpoints instead: each sends itself to the 65 values within one bit. Two fingerprints are within two bits exactly if
they share such a value, and all that share one are linked, so this loses no link and its size is linear; at most
65 fingerprints meet at a value.

Everything works on distinct fingerprints; documents come back by a join, whose hot keys adaptive execution splits. Components
are found by alternating large and small stars, with a checkpoint in the shared folder after each round.

Defined cases: null, empty and wordless texts have fingerprint 0, linked like any other; repeated rows are returned
each; a null id belongs to its component but is never its smallest id (null if all are null); an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import jaccard

SHINGLE, SEED, DISTANCE, CELL = 3, 42, 2, 64
EVEN = 0x5555555555555555
#: Bits of the embedding that make up each third of the grid: 11, 11 and 10 segments of two bits.
THIRDS = tuple(((1 << b) - (1 << a)) - (1 << 64 if b == 64 else 0) for a, b in ((0, 22), (22, 44), (44, 64)))


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """Unsigned; bit i is set if over half of the shingles' hashes have it."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    hashed, join, votes = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : at + (1 << 15) + size - 1]
        shingles = zip(*(part[i:] for i in range(size))) if len(part) >= size else [part]
        h = np.array([hashed(join(s), SEED) for s in shingles], "<u8")
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


FIELDS = [C.field("__fp", C.LONG)]


def _signed(size: int):
    def factory():
        def work(texts):
            return [[x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, size) for t in texts)]]

        return work

    return factory


def embed(fp: Column) -> Column:
    """Popcounts of the two-bit segments, packed in two bits each."""
    up = F.shiftrightunsigned(fp, 1)
    both = up.bitwiseAND(fp).bitwiseAND(F.lit(EVEN))
    return F.shiftleft(both, 1).bitwiseOR(up.bitwiseXOR(fp).bitwiseAND(F.lit(EVEN)))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of embeddings: a field's XOR is 1 or 3 for a difference of one, 2 for two."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseAND(F.lit(EVEN))) + 2 * F.bit_count(F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(EVEN)))


def links(nodes: DataFrame, cell_size: int = CELL) -> DataFrame:
    """Edges a < b that connect whatever lies within DISTANCE bits; nodes: distinct fingerprints fp."""
    cells = nodes.select("fp", F.posexplode(F.array(*[embed(F.col("fp")).bitwiseAND(F.lit(m)) for m in THIRDS])).alias("third", "cell"))
    sizes = cells.groupBy("third", "cell").agg(F.count("*").alias("n")).where("n > 1")
    crowded = sizes.where(F.col("n") > cell_size).select("third", "cell")
    few = cells.join(sizes.where(F.col("n") <= cell_size).select("third", "cell"), ["third", "cell"], "left_semi")
    met = few.groupBy("third", "cell").agg(F.sort_array(F.collect_list(F.struct("fp", embed(F.col("fp")).alias("at")))).alias("f"))
    first = met.select("f", F.posexplode("f").alias("i", "x"))
    # compared within the cell's list, so that only links become rows
    close = first.select(
        F.col("x.fp").alias("a"),
        F.explode(F.filter(F.slice("f", F.col("i") + 2, cell_size), lambda y: (manhattan(F.col("x.at"), y["at"]) <= DISTANCE) & (F.bit_count(F.col("x.fp").bitwiseXOR(y["fp"])) <= DISTANCE))).alias("y"),
    ).select("a", F.col("y.fp").alias("b"))
    many = cells.join(crowded, ["third", "cell"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64)])
    at = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    shared = at.groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("f")).where("size(f) > 1")
    stars = shared.select(F.col("f")[0].alias("a"), F.explode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("b"))
    return close.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b) but the roots themselves; the root is a component's smallest node.

    A large star hooks larger neighbours of a node to the smallest node around it, a small star the others; every round
    writes its edges to the checkpoint folder, so that a lost executor costs one round at most.
    """
    C.ensure_checkpoints(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hooked = both.join(least, "u")
        if large:
            return hooked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        return hooked.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()

    now, mark = edges.where("a < b").distinct().checkpoint(), None
    while True:
        sum_ = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (found := tuple(sum_)) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = found
        now = star(star(now, True), False).where("a < b").distinct().checkpoint()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, __fp and component_id of each row; texts are read once and never shuffled."""
    C.ensure_checkpoints(docs.sparkSession)
    seen = C.map_texts(docs, [C.col(id_col).alias("doc_id")], C.col(text_col), FIELDS, _signed(size)).checkpoint()
    ids = seen.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")).checkpoint()
    found = components(links(ids.select("fp")))
    rooted = ids.join(found, ids["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    to = rooted.join(whole, "root").select(F.col("fp").alias("__node"), "component_id")
    return seen.join(to, F.col("__fp") == F.col("__node"), "left").drop("__node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return cluster(docs, id_col, text_col, size).select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = jaccard.WORDS) -> DataFrame:
    """docs with one document of each group of near copies: shingles of size words, a Jaccard similarity of jaccard.SIMILAR (0.8) or more.

    Fingerprints of the shingle sets are linked as everywhere here and give the first candidates. No distance of 64 bits is exact for a
    similarity, so that jaccard.links finds the rest and verifies each link on whole sets. A group's row with the smallest id
    stays, and of rows that repeat id and text one; rows that share an id only are told apart by their text. Documents without an id stay.
    """
    C.ensure_checkpoints(docs.sparkSession)
    key = F.xxhash64(C.col(text_col))
    seen = jaccard.seen_of(docs, [C.col(id_col).alias("doc_id"), key.alias("h")], text_col, size).checkpoint()
    nodes = seen.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("least")).checkpoint()
    head = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", "x.node", "x.n")
    same = nodes.alias("x").join(head.alias("y"), F.col("x.fp") == F.col("y.fp")).where("x.node <> y.node")
    close = links(head.select("fp")).alias("l").join(head.alias("x"), F.col("l.a") == F.col("x.fp")).join(head.alias("y"), F.col("l.b") == F.col("y.fp"))
    near = same.select(*jaccard.pairs_of("x", "y")).union(close.select(*jaccard.pairs_of("x", "y")))
    edges = jaccard.links(seen, docs.select(C.col(text_col).cast("string").alias("text")), near, components, size)
    found = components(edges).withColumnRenamed("node", "__node")
    parts = nodes.join(found, F.col("node") == F.col("__node"), "left").groupBy(F.coalesce("root", "node").alias("part")).agg(F.min("least").alias("least"))
    kept = parts.where("least is not null").select(F.col("least.doc_id").alias("__id"), F.col("least.h").alias("__h")).checkpoint()
    # rows that may go: only these are joined, the others are passed on where they are
    rows = seen.where("doc_id is not null").groupBy("doc_id", "h").agg(F.count("*").alias("times"))
    going = rows.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("h") == F.col("__h")), "left").where("__id is null or times > 1").select("h")
    keyed = jaccard.marked(docs.withColumn("__key", key), "__key", jaccard.bitmap(going).checkpoint())
    known = C.col(id_col).isNull() | ~F.col("__marked")
    again = keyed.where(~known).join(kept, (C.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__h")), "left_semi").dropDuplicates([id_col, "__key"])
    return keyed.where(known).union(again).select(*[C.col(c) for c in docs.columns])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
