"""Toxicity (operator 2): a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are which n-grams of three to five characters it has, hashed to 2**BITS places. Each feature
is scaled by the logarithm of the ratio of its share of toxic and of other training texts; a logistic regression
is trained on the scaled features. Training takes at most SAMPLE labelled rows of each class, those whose id has the
smallest hash, so what reaches the driver is bounded at any size: ids of places, 2**BITS a row at most. Training and calibration
weight each class by its full count of labelled rows, so that a score means the same whether or not a class was cut. The model is a vector of
2**BITS weights and is broadcast. Every whole text is scored, in place, without a shuffle.

Defined cases: a null or empty text has no features and gets the score of the intercept; rows with a null id have the remainder of
an empty id and are held out; labels that are null are not learnt from; a repeated label row counts again;
if one class has no rows, the score is the share of toxic training rows (0.5 without any); only id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS, SIZES = 18, (3, 4, 5)
#: Labelled rows of each class that training takes at most.
SAMPLE = 3000
ROUNDS, RIDGE, SMOOTH, RATE, BLOCK = 80, 1e-5, 1.0, 4.0, 256
#: Odd multipliers that spread the characters of an n-gram.
MIX, LAST = 0x9E3779B1, 0x85EBCA6B


def places(data: bytes, seen: np.ndarray) -> np.ndarray:
    """Places of a text's n-grams, each once, in order. seen: 2**BITS zeros, left as found."""
    text = b" " + b" ".join(data.decode("utf-8", "replace").lower().encode().split()) + b" "
    whole = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    for at in range(0, len(whole), 1 << 20):
        c = whole[at : at + (1 << 20) + SIZES[-1] - 1]
        acc = c * np.uint32(MIX)
        for n in range(2, SIZES[-1] + 1):
            if len(c) < n:
                break
            acc = (acc[:-1] ^ acc[:-1] >> np.uint32(15)) * np.uint32(LAST) + c[n - 1 :] * np.uint32(MIX)
            if n in SIZES:
                seen[(acc * np.uint32(MIX)) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    """weights by place and an intercept; a score is the logistic function of their sum over a text's places."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[bytes]) -> list[float]:
        seen, w, out = np.zeros(1 << BITS, bool), self.weights, []
        for t in texts:
            z = self.bias + (float(w[places(t, seen)].sum(dtype=np.float64)) if t else 0.0)
            out.append(float(1 / (1 + np.exp(-max(-60.0, min(60.0, z))))))
        return out


def train(rows: list[np.ndarray], labels: np.ndarray, each_for: tuple[float, float] = (1.0, 1.0), ridge: float = RIDGE, rounds: int = ROUNDS) -> Model:
    """rows: places of each text; labels: 0 or 1; each_for: how many rows one of either class stands for.

    Accelerated full-batch descent; the same rows give the same model. A feature's value depends on its place alone, so that only
    the places are held, four bytes each and without the rare ones, and BLOCK rows at a time are worked on.
    """
    n, y = len(rows), labels.astype(np.float64)
    each_row = np.where(y == 1, each_for[1], each_for[0])
    if not n or y.min() == y.max():
        share = y.mean() if n else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    counts = np.zeros((2, 1 << BITS), np.int32)
    for r, k in zip(rows, y.astype(int).tolist()):
        counts[k, r] += 1
    neg, pos = counts
    ratio = np.log((pos + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (n - y.sum() + 2 * SMOOTH))
    used = np.flatnonzero((pos + neg >= 3) & (ratio != 0))
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    lists = [(m := number[r])[m >= 0] for r in rows]
    each, idx = np.array([len(x) for x in lists]), np.concatenate(lists)
    del lists
    r, ends = ratio[used], np.append(0, np.cumsum(each))
    blocks = [(a, min(n, a + BLOCK)) for a in range(0, n, BLOCK)]

    def summed(u: np.ndarray) -> np.ndarray:
        """For each row the sum of u over its places."""
        return np.concatenate([np.diff(np.append(0, np.cumsum(u[idx[ends[a] : ends[z]]]))[ends[a : z + 1] - ends[a]]) for a, z in blocks])

    r = r / np.sqrt(max(1e-9, summed(r * r).mean()))
    w, v, b, vb, t = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 1.0
    for _ in range(rounds):
        z = summed(r * v) + vb
        e = each_row * (1 / (1 + np.exp(-z)) - y) / each_row.sum()
        g = ridge * v
        for a, end in blocks:
            g += r * np.bincount(idx[ends[a] : ends[end]], weights=np.repeat(e[a:end], each[a:end]), minlength=len(used))
        new, newb, more = v - RATE * g, vb - RATE * e.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / more * (new - w), newb + (t - 1) / more * (newb - b)
        w, b, t = new, newb, more
    weights = np.zeros(1 << BITS, np.float32)
    scale, shift = calibrate(summed(r * w) + b, y, each_row)
    weights[used] = scale * w * r
    return Model(weights, float(scale * b + shift))


def calibrate(z: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, float]:
    """Scale and shift of z under which a logistic function fits weighted labels, softened so that separable ones stay finite."""
    toxic, other = (each * y).sum(), (each * (1 - y)).sum()
    aim = np.where(y == 1, (toxic + 1) / (toxic + 2), 1 / (other + 2))
    a = np.column_stack([z, np.ones(len(z))])
    p = np.array([1.0, 0.0])

    def loss(q):
        t = a @ q
        return float((each * (np.logaddexp(0, t) - aim * t)).sum())

    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a @ p, -60, 60)))
        step = np.linalg.solve(a.T @ (a * (each * s * (1 - s))[:, None]) + 1e-9 * np.eye(2), a.T @ (each * (s - aim)))
        k = 1.0
        while k > 1e-6 and loss(p - k * step) > loss(p):
            k /= 2
        p = p - k * step
    return float(p[0]), float(p[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from the documents of at most sample rows of labels for each class that are not held out."""
    known = labels.select(C.col(id_col).alias("__id"), C.col(label).cast("int").alias("__y")).where(~held_out(F.col("__id")))
    chosen = [known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample) for y in (0, 1)]
    full = dict(known.where("__y in (0, 1)").groupBy("__y").count().collect())
    each_for = tuple(max(1.0, full.get(y, 0) / sample) for y in (0, 1))
    both = F.broadcast(chosen[0].union(chosen[1]))  # 2 * sample rows of two numbers
    joined = docs.select(C.col(id_col).alias("__id"), C.col(text_col).alias("__t")).join(both, "__id")

    def factory():
        seen = np.zeros(1 << BITS, bool)

        def work(texts):
            return [[places(t, seen).astype("<i4").tobytes() for t in texts]]

        return work

    kept = C.map_texts(joined, [F.col("__id"), F.col("__y")], F.col("__t"), [C.field("places", T.BinaryType())], factory)
    return train(*sample_of(kept), each_for)


def sample_of(kept: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Places and labels of the training rows in a fixed order; the places are views of what Spark has sent."""
    table = kept.select("__id", "__y", F.xxhash64("places").alias("__h"), "places").toArrow()
    order = np.lexsort([table[c].to_numpy() for c in ("__h", "__y", "__id")])
    views = [np.frombuffer(x.as_buffer(), "<i4") if x.as_buffer().size else np.empty(0, "<i4") for x in table["places"]]
    return [views[k] for k in order.tolist()], table["__y"].to_numpy()[order].astype(np.int64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def factory():
        m = Model(*shared.value)
        return lambda texts: [m.scores(texts)]

    seen = C.map_texts(docs, [C.col(id_col).alias(id_col)], C.col(text_col), [C.field("score", C.DOUBLE)], factory)
    return seen.select(id_col, held_out(C.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.read(spark, sf_dir, "labels")))


QUERIES = {"op2_toxicity": op2_toxicity}
