"""Benchmark decontamination (operator 9): suffix arrays of the training texts, searched for every test suffix.

Each shard (a batch of documents) becomes one sequence of word numbers with a gap between documents. Its suffix array holds,
in word order, the suffixes that open with as many benchmark words as a window has; no other suffix can match.
Every suffix of every benchmark item is found in it by binary search and marks all its places; from the first place of a window in each document,
matches that continue one another are joined into the longest verbatim ones, with their places in document and item. So a window that
many items and many places share costs their sum, not their product.

The benchmark is the stated query set: its windows are broadcast in blocks of at most BLOCK_BYTES of text each,
and every shard is searched for one block after another; a worker lets go of a block before it reads the next, so that memory is bounded
by a block and a batch.

Defined cases: a null, empty or wordless text, of document or item, has no words and no hit; an item of fewer words than
a window is one window; items that repeat count once for each id; an item without an id marks words but is not
listed; repeated documents are returned each; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Bytes that part words become blanks, A-Z become a-z; digits, letters and all beyond ASCII stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


class Block:
    """Windows of some items: word numbers from 1; by length, sorted big-endian keys and for each window its (item, place)s."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        of: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], ">u4")
            n = min(size, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                of[n][ids[at : at + n].tobytes()].append((k, at))
        self.windows = []
        for n, found in sorted(of.items()):
            keys = sorted(found)
            places = [np.array(found[k], np.int64) for k in keys]
            self.windows.append((n, np.array(keys, f"S{4 * n}"), np.cumsum([0, *map(len, places)]), np.concatenate(places)))


def matches(block: Block, ids: np.ndarray):
    """(length, starts in ids, items, places in items) of each window that occurs, of an item that has it twice its first place; ids: word numbers, 0 for all others."""
    n = len(ids)
    # how many benchmark words stand in a row from each place on
    stops = np.flatnonzero(ids == 0)
    here = np.arange(n)
    at = np.searchsorted(stops, here)
    run = np.where(at < len(stops), np.append(stops, n)[at], n) - here
    for size, keys, upto, places in block.windows:
        starts = np.flatnonzero(run >= size)
        if not len(starts):
            continue
        rows = np.ascontiguousarray(ids[starts[:, None] + np.arange(size)]).astype(">u4")
        suffixes = rows.view(f"S{4 * size}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        low, high = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
        for k in np.flatnonzero(high > low):
            own = places[upto[k] : upto[k + 1]]
            own = own[np.unique(own[:, 0], return_index=True)[1]]
            yield size, starts[order[low[k] : high[k]]], own[:, 0], own[:, 1]


def search(blocks, texts: list[bytes]):
    """For each text: number of words, words hit, items (as (id, longest words, first word, item's first word)) with windows in it."""
    tokens = [words_of(t) for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    total = int(first[-1])
    change = np.zeros(total + 1, np.int32)
    items: list[dict] = [{} for _ in texts]
    for block in blocks:
        get, ids = block.number.get, np.zeros(total, np.uint32)
        for k, t in enumerate(tokens):
            if t:
                ids[first[k] : first[k] + len(t)] = [get(w, 0) for w in t]
        found = []
        for size, p, item, at in matches(block, ids):
            np.add.at(change, p, 1)
            np.add.at(change, p + size, -1)
            # of each text only the first place goes on to the window's items, not every place with every item
            p = p[np.unique(np.searchsorted(first, p, "right"), return_index=True)[1]]
            found.append((size, np.repeat(p, len(item)), np.tile(item, len(p)), np.tile(at, len(p))))
        if not found:
            continue
        size = np.concatenate([np.full(len(x[1]), x[0]) for x in found])
        p, item, at = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
        # windows of one item that follow each other on one diagonal are one longer match
        order = np.lexsort((p, p - at, item))
        size, p, item, at = size[order], p[order], item[order], at[order]
        opens = np.ones(len(p), bool)
        opens[1:] = (item[1:] != item[:-1]) | (p[1:] - at[1:] != p[:-1] - at[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(p)) - 1
        of = np.searchsorted(first, p[begin], "right") - 1
        for d, i, n, s, q in zip(of.tolist(), item[begin].tolist(), (p[end] + size[end] - p[begin]).tolist(), (p[begin] - first[of]).tolist(), at[begin].tolist()):
            key = block.ids[i]
            best = items[d].get(key)
            if best is None or (-n, s, q) < (-best[0], best[1], best[2]):
                items[d][key] = (n, s, q)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change)[:total] > 0)])
    marked = hit[first[1:] - 1] - hit[first[:-1]] if total else np.zeros(len(texts), np.int64)
    return lengths.tolist(), marked.tolist(), items


MATCH = T.ArrayType(T.StructType([C.field("item_id", C.STRING), C.field("n_words", C.LONG), C.field("doc_word", C.LONG), C.field("item_word", C.LONG)]))
FIELDS = [C.field("n_words", C.LONG), C.field("n_hit", C.LONG), C.field("n_items", C.LONG), C.field("items_sha256", C.STRING), C.field("longest", MATCH)]


def blocks_of(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, size: int) -> list:
    """Broadcasts of the benchmark's blocks; it is read partition by partition."""
    out, items, held = [], [], 0
    rows = benchmark.select(C.col(id_col).cast("string"), F.coalesce(C.col(text_col).cast("string"), F.lit(""))).distinct()
    for i, text in rows.toLocalIterator():
        data = text.encode()
        items.append((i, data))
        held += len(data)
        if held >= BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(Block(items, size)))
            items, held = [], 0
    return [*out, spark.sparkContext.broadcast(Block(items, size))] if items else out


def each_of(shared: list):
    """The broadcasts' values one after another; of several, a worker holds one at a time."""
    for b in shared:
        yield b.value
        if len(shared) > 1 and hasattr(b, "_value"):
            del b._value


def scan(docs: DataFrame, benchmark: DataFrame, carry, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    shared = blocks_of(docs.sparkSession, benchmark, item_col, item_text, size)

    def factory():
        def work(texts):
            out = ([], [], [], [], [])
            at, begin, held = 0, 0, 0
            for at, t in enumerate(texts):  # shards of about 8 MB
                held += len(t)
                if held >= 8 << 20 or at == len(texts) - 1:
                    lengths, marked, items = search(each_of(shared), texts[begin : at + 1])
                    for n, m, found in zip(lengths, marked, items):
                        ids = sorted(i for i in found if i is not None)
                        out[0].append(n)
                        out[1].append(m)
                        out[2].append(len(ids))
                        out[3].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                        out[4].append([{"item_id": i, "n_words": found[i][0], "doc_word": found[i][1], "item_word": found[i][2]} for i in ids])
                    begin, held = at + 1, 0
            return out

        return work

    return C.map_texts(docs, carry, C.col(text_col), FIELDS, factory).withColumn("contaminated", F.col("n_hit") > 0)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row for each row of docs; longest: of each item the longest match, its words and where it begins in document and item."""
    return scan(docs, benchmark, [C.col(id_col).alias(id_col)], text_col, **more)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    return C.rows_of(scan(docs, benchmark, C.with_rows(docs), text_col, **more).where("not contaminated"), docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark")).drop("longest")


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
