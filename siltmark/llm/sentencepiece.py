"""SentencePiece encoding and decoding (operator 1): a relational lattice and a fold.

Text is cut into units wherever no piece of the vocabulary has the two characters side by side, so that no piece crosses a
cut. Every distinct unit goes through a lattice once: its substrings up to the longest piece are exploded, equi-joined to the piece
table (broadcast: its size is that of the vocabulary), grouped by unit and folded with aggregate(). For a unigram model the fold is Viterbi's:
the best score at every place, then the way back. For a BPE model the highest sum of scores isn't what the model means: there the
fold goes once over the same edges in the order of their scores, joining an edge that spans exactly two neighbouring pieces. An edge with a
better score that only such a join makes possible is joined at once.

The texts of a task are dealt into chunks of some CHUNK bytes. (chunk, unit) pairs, each once a chunk, meet the folded units by unit
and go on to their chunk, where the chunk's texts, packed, meet its own small dictionary: no dictionary is broadcast, and none is larger than a
chunk's. Hot units appear once a chunk, so no group is large. If a chunk's rows should differ between its two readings (input that isn't
deterministic), units missing from its dictionary are encoded in place by the same rule.

A unit of over LONGEST characters, such as a run of thousands of dashes, would make the fold quadratic; it is merged by the same rule with
a heap (tested against the library; the test tables have no such unit).

Characters without a piece become byte pieces. Decoding joins the pieces, blanks for their mark, and drops the blank that
encoding put in front.

Defined cases: a null or empty text has no pieces and decodes to an empty text; a text's own U+2581 is read as a blank, as
the library does; repeated rows are returned each; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = os.environ.get("SILTMARK_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
#: Bytes of text in a chunk and in its parts, and parts that Python works on at once; characters of a unit that is folded.
CHUNK, PART, AT_ONCE, LONGEST = 32 << 20, 1 << 20, 3, 1024
BLANK = "▁"


class Vocabulary:
    """ids and scores by piece (with blanks for their mark), bytes by id, and the ids of the byte pieces."""

    def __init__(self, rows: list[tuple[int, str, float, str]], kind: str = "bpe"):
        """rows: id, piece, score and type: normal, byte, control or unknown. kind: bpe or unigram."""
        self.kind = kind
        self.table = {p.replace(BLANK, " "): (i, s) for i, p, s, t in rows if t == "normal"}
        self.byte = {int(p[3:-1], 16): i for i, p, _, t in rows if t == "byte"}
        self.out = {i: bytes([int(p[3:-1], 16)]) if t == "byte" else p.replace(BLANK, " ").encode() if t == "normal" else b"" for i, p, _, t in rows}
        self.unknown = next((i for i, _, _, t in rows if t == "unknown"), 0)
        self.longest = max(map(len, self.table), default=1)

    @classmethod
    def read(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        import sentencepiece as S

        sp = S.SentencePieceProcessor(model_file=path)
        kinds = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
        return cls([(i, sp.id_to_piece(i), float(sp.get_score(i)), kinds(i)) for i in range(sp.vocab_size())], kind)

    def late(self, piece: str) -> bool:
        """Whether the piece can come from two pieces of which one has a worse score: it may become possible after its turn."""
        own, table = self.table[piece][1], self.table
        for k in range(1, len(piece)):
            halves = [x for x in (piece[:k], piece[k:]) if len(x) > 1]
            if all(x in table for x in halves) and any(table[x][1] <= own for x in halves):
                return True
        return False

    def single(self, c: str) -> list[int]:
        """Ids of a character that no chosen piece covers."""
        if hit := self.table.get(c):
            return [hit[0]]
        return [self.byte.get(b, self.unknown) for b in c.encode()] if self.byte else [self.unknown]

    def encode_unit(self, unit: str) -> list[int]:
        parts = self._merged(unit) if self.kind == "bpe" else self._best(unit)
        out: list[int] = []
        for p in parts:
            hit = self.table.get(p)
            if hit:
                out.append(hit[0])
            else:
                out += self.single(p)
        return out

    def _merged(self, unit: str) -> list[str]:
        """Joins the best-scored neighbouring pair, the leftmost of equals, until none is a piece."""
        table, parts = self.table, list(unit)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := table.get(joint := parts[i] + parts[after[i]])):
                heapq.heappush(heap, (-hit[1], i, joint))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joint = heapq.heappop(heap)
            if parts[i] and after[i] < n and parts[i] + parts[after[i]] == joint:
                j = after[i]
                parts[i], parts[j], after[i] = joint, "", after[j]
                if after[j] < n:
                    before[after[j]] = i
                offer(before[i])
                offer(i)
        return [p for p in parts if p]

    def _best(self, unit: str) -> list[str]:
        """The way with the best sum of scores; a character without a piece costs more than any way around it."""
        worst = self.worst()
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            found = (best[e - 1][0] + worst, e - 1)
            for s in range(max(0, e - self.longest), e):
                hit = self.table.get(unit[s:e])
                if hit and best[s][0] + hit[1] > found[0]:
                    found = (best[s][0] + hit[1], s)
            best.append(found)
        parts, e = [], len(unit)
        while e:
            parts.append(unit[best[e][1] : e])
            e = best[e][1]
        return parts[::-1]

    def worst(self) -> float:
        return min((s for _, s in self.table.values()), default=0.0) - 10.0


class Cutter:
    """Cuts texts into units. Two characters stay together if a table of 2**22 places has their pair: a pair that
    is there by chance only makes a unit longer, never a wrong one."""

    def __init__(self, vocabulary: Vocabulary):
        pairs = sorted({p[i : i + 2] for p in vocabulary.table for i in range(len(p) - 1)})
        self.together = np.zeros(1 << 22, bool)
        if pairs:
            chars = np.array([[ord(x) for x in p] for p in pairs], np.uint32)
            self.together[self._place(chars[:, 0], chars[:, 1])] = True

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) + (a >> np.uint32(3))) >> np.uint32(10)

    def units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All units in order, and for each text the number of the first unit after it."""
        marked = [" " + t.replace(BLANK, " ") if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in marked])
        chars, data = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32), whole.encode("utf-8", "replace")
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.together[self._place(chars[:-1], chars[1:])]
        cut[ends[ends < len(chars)]] = True
        first = np.flatnonzero(cut)
        after = np.searchsorted(first, ends, "left")
        if len(data) != len(chars):
            first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[first]
        offsets = np.append(first, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), after


def chunked(batches):
    """(chunk, part of a batch without its last column) in the order of the rows. The last two columns are the text and the number of the
    partition. A row's chunk follows from that number and from the bytes of text before it there, whatever the batches are."""
    so_far = 0
    for whole in batches:
        if not whole.num_rows:
            continue
        base, text = whole.column(whole.num_columns - 1)[0].as_py() << 24, whole.num_columns - 2
        b = pa.RecordBatch.from_arrays(whole.columns[:-1], names=whole.schema.names[:-1])
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = so_far + np.cumsum(sizes) - sizes
        so_far = int(before[-1] + sizes[-1]) if len(sizes) else so_far
        chunk, part = before // CHUNK, before // PART
        edges = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(part) != 0)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
            if z > a:
                yield base + int(chunk[a]), b.slice(a, z - a)


def chunk_units(docs: DataFrame, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """(chunk, unit), each once."""
    shared = docs.sparkSession.sparkContext.broadcast(Cutter(vocabulary))

    def run(batches):
        cutter, now, seen = shared.value, None, []

        def done():
            every = pc.unique(pa.concat_arrays(seen))
            for at in range(0, len(every), 1 << 14):
                some = every.slice(at, 1 << 14)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now, np.int64)), some], names=["chunk", "unit"])

        for chunk, b in chunked(batches):
            if chunk != now and seen:
                yield from done()
                seen = []
            now = chunk
            seen.append(pc.unique(cutter.units(_texts(b.column(0)))[0]))
            if len(seen) > 8:
                seen = [pc.unique(pa.concat_arrays(seen))]
        if seen:
            yield from done()
        C.let_go()

    C.bound_batches(docs.sparkSession)
    return docs.select(_utf8(text_col), _partition()).mapInArrow(run, "chunk long, unit string")


def _partition() -> Column:
    """The number of the partition as the scan counts it; a task's own number is another one below a union."""
    return F.spark_partition_id().alias("__partition")


def _utf8(text_col: str) -> Column:
    return F.coalesce(C.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__text")


def _texts(column) -> list[str]:
    return [t.decode("utf-8", "replace") for t in column.to_pylist()]


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit and edges: structs (rank, s, e, id, late) of every piece in it; words have distinct units. A unit without any piece is left out.

    Needs no exchange beyond the broadcast if words are partitioned by unit.
    """
    n = F.length("unit")
    starts = words.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s")).select("unit", "s", F.substring("unit", F.col("s") + 1, F.lit(longest)).alias("from"))
    ends = starts.select("unit", "s", "from", F.explode(F.sequence(F.lit(1), F.length("from"))).alias("n"))
    cut = ends.select("unit", "s", (F.col("s") + F.col("n")).alias("e"), F.substring("from", F.lit(1), F.col("n")).alias("piece"))
    met = cut.join(F.broadcast(pieces), "piece")
    return met.groupBy("unit").agg(F.collect_list(F.struct("rank", "s", "e", "id", "late")).alias("edges"))


def fold_merges(edges: Column, size: Column) -> Column:
    """A byte for each place of a unit of size characters: 1 where a piece begins or ends, 0 inside."""

    def able(marks: Column, e: Column) -> Column:
        x = F.substring(marks, e["s"] + 1, e["e"] - e["s"] + 1).cast("string")
        return (F.replace(x, F.lit("0"), F.lit("")) == "111") & x.startswith("1") & x.endswith("1")

    def joined(marks: Column, e: Column) -> Column:
        return F.overlay(marks, F.repeat(F.lit("0"), e["e"] - e["s"] - 1).cast("binary"), e["s"] + 2, e["e"] - e["s"] - 1)

    def folded(m: Column, later: Column) -> Column:
        def follow(marks: Column, e: Column) -> Column:
            """Joins, best first, what came before e in the order and is possible only now."""
            near = F.filter(later, lambda x: (x["s"] <= e["s"]) & (x["e"] >= e["e"]) & ((x["rank"] < e["rank"]) | (x["rank"] == e["rank"]) & (x["s"] < e["s"])))

            def with_near(these: Column) -> Column:
                def step(b: Column, _: Column) -> Column:
                    return C.let(F.get(F.filter(these, lambda x: able(b, x)), F.lit(0)), lambda best: F.coalesce(joined(b, best), b))

                return F.aggregate(these, joined(marks, e), step)

            return C.let(near, with_near)

        start = F.repeat(F.lit("1"), size + 1).cast("binary")
        return F.aggregate(m, start, lambda b, e: F.when(able(b, e), follow(b, e)).otherwise(b))

    return C.let(F.array_sort(F.filter(edges, lambda e: e["e"] - e["s"] > 1)), lambda m: C.let(F.filter(m, lambda e: e["late"]), lambda later: folded(m, later)))


def fold_viterbi(edges: Column, size: Column, worst: float) -> Column:
    """The same marks for a unigram model: the best sum of scores (rank is the negative score); characters without a piece cost worst."""
    chars = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct((i + 1).alias("e"), i.alias("s"), F.lit(worst).alias("score")))
    every = F.array_sort(F.concat(F.transform(edges, lambda e: F.struct(e["e"].alias("e"), e["s"].alias("s"), (-e["rank"]).alias("score"))), chars))
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back")))

    def step(best: Column, e: Column) -> Column:
        """best: by place up to the last end seen; edges come in the order of their ends."""
        new = F.struct((F.get(best, e["s"])["score"] + e["score"]).alias("score"), e["s"].alias("back"))
        opened = F.concat(best, F.array(new))
        better = F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(new))
        return F.when(F.size(best) == e["e"], opened).when(new["score"] > F.get(best, e["e"])["score"], better).otherwise(best)

    ends = F.struct(size.alias("at"), F.repeat(F.lit("0"), size + 1).cast("binary").alias("marks"))

    def way(best: Column) -> Column:
        def back(s: Column, _: Column) -> Column:
            marked = F.overlay(s["marks"], F.lit("1").cast("binary"), s["at"] + 1, F.lit(1))
            return F.when(s["at"] >= 0, F.struct(F.get(best, s["at"])["back"].alias("at"), marked.alias("marks"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), size), ends, back, lambda s: s["marks"])

    return C.let(F.aggregate(every, begin, step), way)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """piece, id, rank (the negative score) and late of the vocabulary's normal pieces."""
    rows = [(p, i, -s, vocabulary.kind == "bpe" and vocabulary.late(p)) for p, (i, s) in vocabulary.table.items()]
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "rank": [r[2] for r in rows], "late": [r[3] for r in rows]}))


def spelled(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a character, or of characters none of which has a piece."""
    first = vocabulary.byte.get(0)
    if first is None or any(vocabulary.byte.get(b) != first + b for b in range(256)):
        return F.transform(F.split(text, ""), lambda _: F.lit(vocabulary.unknown))
    coded = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(coded) / 2).cast("int") - 1), lambda k: (F.conv(F.substring(coded, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + F.lit(first)))


def dictionary(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """unit and ids for words (distinct units of 1 to LONGEST characters) with at least one piece, by lattice and fold."""
    net = lattice(words, piece_table(words.sparkSession, vocabulary), vocabulary.longest)
    edges, unit, size = F.col("edges"), F.col("unit"), F.length("unit")
    marks = fold_merges(edges, size) if vocabulary.kind == "bpe" else fold_viterbi(edges, size, vocabulary.worst())

    def ids(s: Column, e: Column) -> Column:
        hit = F.get(F.filter(edges, lambda x: (x["s"] == s) & (x["e"] == e)), F.lit(0))["id"]
        return C.let(hit, lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(spelled(F.substring(unit, s + 1, F.lit(1)), vocabulary)))

    def pieces(at: Column) -> Column:
        """at: where pieces begin and end."""
        return F.flatten(F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda s, k: ids(s, F.get(at, k + 1))))

    at = C.let(marks, lambda m: F.filter(F.sequence(F.lit(0), size), lambda i: F.substring(m, i + 1, F.lit(1)) == F.lit("1").cast("binary")))
    return net.select("unit", C.let(at, pieces).alias("ids"))


def chunk_dictionaries(pairs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(chunk, packed): units with their ids, some of them in each row; pairs: (chunk, unit), each once.

    Pairs are dealt by unit once; what needs them, distinct units and the join, shares that exchange (both read both columns).
    """
    dealt = pairs.where(F.length("unit") <= LONGEST).repartition("unit")
    words = dealt.groupBy("unit").agg(F.min("chunk").alias("least"))
    folded = dictionary(words.where("least >= 0").select("unit"), vocabulary).withColumnRenamed("unit", "__unit")
    met = dealt.join(folded, F.col("unit") == F.col("__unit"), "left").select("chunk", "unit", F.coalesce("ids", spelled(F.col("unit"), vocabulary)).alias("ids"))
    small = max(vocabulary.out, default=0) < 1 << 16

    def packed(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        b = table.take(pc.sort_indices(table, [("chunk", "ascending"), ("unit", "ascending")])).combine_chunks().to_batches()[0]
        chunk = b.column(0).to_numpy()
        sorted_ = pa.RecordBatch.from_arrays([b.column(1), b.column(2).cast(pa.list_(pa.uint16() if small else pa.int32()))], names=["unit", "ids"])
        edges = np.flatnonzero(np.diff(chunk)) + 1
        spans = list(zip([0, *edges.tolist()], [*edges.tolist(), len(chunk)]))
        return pa.RecordBatch.from_arrays([pa.array([int(chunk[a]) for a, _ in spans], pa.int64()), pa.array([pack(sorted_.slice(a, z - a)) for a, z in spans], pa.binary())], names=["chunk", "packed"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= 1 << 15:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)
        C.let_go()

    return met.mapInArrow(run, "chunk long, packed binary")


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: pa.Buffer) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False))))


def encode(docs: DataFrame, vocabulary: Vocabulary, carry, text_col: str = "text", check: bool = False) -> DataFrame:
    """carry and ids of every row; with check also round_trip, whether the decoded ids give the text again."""
    chosen = docs.select(*carry, _utf8(text_col), _partition())
    kept = chosen.schema.fields[:-2]
    last = len(kept)

    def packed(batches):
        for chunk, b in chunked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([1], pa.int32()), pa.array([pack(b)], pa.binary())], names=["chunk", "kind", "packed"])
        C.let_go()

    texts = chosen.mapInArrow(packed, "chunk long, kind int, packed binary")
    known = chunk_dictionaries(chunk_units(docs, text_col, vocabulary), vocabulary).select("chunk", F.lit(0).alias("kind"), "packed")
    both = known.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, Cutter(vocabulary)))
    fields = [*kept, IDS, *([C.field("round_trip", C.BOOL)] if check else [])]
    names = [f.name for f in fields]

    def run(batches):
        v, cutter = shared.value
        spelling = [v.out.get(i, b"") for i in range(max(v.out, default=0) + 1)].__getitem__
        now, known, parts = None, [], []

        def done():
            """Rows of some texts of a chunk; parts: texts, packed, with their units."""
            if not parts:
                return
            known[:] = [Book.joined(known)]
            book = Book(known[0], v, [units for _, units, _ in parts])
            for data, units, after in parts:
                part = unpack(data)
                ids, ends = book.encode(units, after)
                made = [pa.ListArray.from_arrays(pa.array(np.append([0], ends).astype(np.int32)), pa.array(ids))]
                if check:
                    at = [0, *ends.tolist()]
                    made.append(pa.array([b"".join(map(spelling, ids[x:y].tolist()))[1:] == t for x, y, t in zip(at, at[1:], part.column(last).to_pylist())], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(last)), *made], names=names)

        for b in batches:
            for chunk, kind, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = packed.as_buffer()
                if chunk != now:
                    yield from done()
                    now, known, parts = chunk, [], []
                    C.let_go()
                if kind == 0:
                    known.append(unpack(data))
                else:
                    units, after = cutter.units(_texts(unpack(data).column(last)))
                    parts.append((data, units.dictionary_encode(), after))
                    if len(parts) >= AT_ONCE:
                        yield from done()
                        parts.clear()
        yield from done()
        known, parts = [], []
        C.let_go()

    return both.select("chunk", "kind", "packed").mapInArrow(run, T.StructType(fields))


class Book:
    """The dictionary of a chunk, whose texts are made of these units (dictionary-encoded)."""

    @staticmethod
    def joined(known: list[pa.RecordBatch]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.list_(pa.int32())]
        columns = [pa.concat_arrays([x.column(i).cast(t) for x in known]) if known else pa.array([], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "ids"])

    def __init__(self, known: pa.RecordBatch, vocabulary: Vocabulary, coded: list[pa.DictionaryArray]):
        units, ids = known.columns
        wanted = pa.concat_arrays([x.dictionary for x in coded])
        place = pc.index_in(wanted, units)
        if place.null_count:
            missing = pc.unique(wanted.filter(pc.is_null(place)))
            units, ids = pa.concat_arrays([units, missing]), pa.concat_arrays([ids, pa.array([vocabulary.encode_unit(u) for u in missing.to_pylist()], pa.list_(pa.int32()))])
            place = pc.index_in(wanted, units)
        self.lengths = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = ids.flatten().to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place, self.at = place.to_numpy(zero_copy_only=False), 0

    def encode(self, coded: pa.DictionaryArray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the parts in their order: ids of all units, and for each text the number of the first id after it."""
        own = self.place[self.at : self.at + len(coded.dictionary)]
        self.at += len(own)
        of = own[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.lengths[of]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.values[np.arange(total) + np.repeat(self.starts[of] - (ends - each), each)]
        return ids, np.append([0], ends)[after]


IDS = C.field("ids", T.ArrayType(T.IntegerType()))


def decode(pieces: DataFrame, vocabulary: Vocabulary, carry, ids_col: str = "ids") -> DataFrame:
    """carry and text of every row of ids; ids that the vocabulary hasn't are left out, null lists give an empty text."""
    shared = pieces.sparkSession.sparkContext.broadcast(vocabulary.out)
    chosen = pieces.select(*carry, C.col(ids_col).alias("__ids"))
    kept = chosen.schema.fields[:-1]
    names = [f.name for f in kept] + ["text"]

    def run(batches):
        get = shared.value.get
        for b in (x for whole in batches for x in C.slices(whole)):
            made = []
            for ids in b.column(b.num_columns - 1).to_pylist():
                t = b"".join([get(i, b"") for i in ids or ()]).decode("utf-8", "replace")
                made.append(t[1:] if t.startswith(" ") else t)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(made, pa.string())], names=names)

    return chosen.mapInArrow(run, T.StructType([*kept, C.field("text", C.STRING)]))


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """id, ids, n_pieces and round_trip (whether decoding gives the text again) of every row."""
    coded = encode(docs, Vocabulary.read(path), [C.col(id_col).alias(id_col)], text_col, check=True)
    return coded.select(id_col, "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(C.read(spark, sf_dir, "documents"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
