"""Personal data (operator 3): fixed base rules, and a character BiLSTM with CRF transitions that adds spans.

Base rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers in whole texts, each in one linear pass.
The model, trained here in numpy from labelled spans that a seeded generator plants in filler, reads overlapping windows
of WIDTH characters, STRIDE apart, over the whole text. A window without a digit or @, nor next to one that has any, can't hold such a
span and is not run. Each window is decoded by Viterbi; where two overlap, each gives the tags of the half of the overlap nearer to its middle. So a
span may run on over any number of windows; a span cut where its neighbour window isn't run is dropped. Then all spans of a text are reconciled at once: best score first, without overlap.
An added span must fit its kind's count of digits (a card its check digit, an address its four numbers up to 255) and may not meet a kept
base match, nor repeat a match that the rule of its own kind has dropped. Within a dropped stretch the model may cut anew.

Defined cases: a null or empty text has no spans; spans of different kinds may overlap (base rules); repeated rows are
returned each; a null id is passed through; an empty table gives no rows; only id and text are read. Offsets are code
points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def rules(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans as (start, kind, end), and likewise the stretches that a rule matched and then dropped."""
    kept, dropped = [], []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in USER:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            kept.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        # long runs of digits are over 255 unless they are zeros and a small number
        good = all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))
        kept.append((m.start(), 1, m.end())) if good else dropped.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        kept.append((m.start(), 2, m.end())) if 12 <= len(d) <= 19 and luhn(d) else dropped.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum("0" <= c <= "9" for c in m[0])
            kept.append((m.start(), 3, m.end())) if 9 <= n <= 15 else dropped.append((m.start(), 3, m.end()))
    return sorted(kept), dropped


# The model

WIDTH, STRIDE, HIDDEN, SEED = 64, 32, 12, 11
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
SIGNS = "@.-+() \n_%/:,;"
CLASSES = len(SIGNS) + 6  # none (padding), digit, lower case, upper case, other ASCII, beyond ASCII
_KLASS = np.full(129, CLASSES - 2, np.int64)
_KLASS[48:58], _KLASS[97:123], _KLASS[65:91], _KLASS[128] = 1, 2, 3, CLASSES - 1
for _i, _c in enumerate(SIGNS):
    _KLASS[ord(_c)] = 4 + _i


def classes(text: str) -> np.ndarray:
    return _KLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


def sample(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window's character classes and its tags: filler with planted spans, some in forms beyond the base rules."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(1, 9)))
    pick = lambda *x: x[rng.integers(len(x))]

    def planted(kind: int) -> str:
        if kind == 0:
            return f"{word()}{pick('', '.', '_')}{word()}{pick('@', '@', ' @ ')}{word()}.{pick('', word() + '.')}{pick('com', 'org', 'net', 'de')}"
        if kind == 1:
            return pick(".", ".", " . ").join(str(rng.integers(0, 256)) for _ in range(4))
        if kind == 2:
            return pick("", " ", "-", ".").join(digits(4) for _ in range(4))
        return pick("+", "+", "00") + digits(2) + pick(" ", "-", "/") + digits(3) + pick(" ", "-", "/") + digits(rng.integers(5, 8))

    text, tags = "", []
    while len(text) < WIDTH:
        x = rng.random()
        if x < 0.22:
            kind = int(rng.integers(len(KINDS)))
            s = planted(kind)
            tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
        else:
            s = digits(rng.integers(1, 7)) if x < 0.3 else word() if x < 0.9 else word().title()
            tags += [0] * len(s)
        gap = pick(" ", " ", " ", ", ", ". ", "\n", ": ")
        text += s + gap
        tags += [0] * len(gap)
    at = int(rng.integers(0, len(text) - WIDTH + 1))
    return classes(text)[at : at + WIDTH], np.array(tags[at : at + WIDTH])


def lstm(x: np.ndarray, p: dict, d: str, keep: bool = False):
    """Hidden states (time, batch, HIDDEN) of one direction over classes x (time, batch)."""
    steps, n = x.shape
    wx, wh = p["x" + d], p["h" + d]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = wx[x[t]] + h @ wh
        a[:, : 3 * HIDDEN] = 0.5 + 0.5 * np.tanh(0.5 * a[:, : 3 * HIDDEN])
        a[:, 3 * HIDDEN :] = np.tanh(a[:, 3 * HIDDEN :])
        i, f, o, g = np.split(a, 4, axis=1)
        before, hb = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((t, a, before, hb, tc))
    return (out, kept) if keep else out


def backward(x, p, d, kept, dout, grad) -> None:
    n = x.shape[1]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t, a, before, hb, tc in reversed(kept):
        i, f, o, g = np.split(a, 4, axis=1)
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(grad["x" + d], x[t], da)
        grad["h" + d] += hb.T @ da
        dh, dc = da @ p["h" + d].T, dc * f


def logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(e: np.ndarray, tr: np.ndarray, y: np.ndarray):
    """Gradients of the mean negative log-likelihood of tags y for emissions e (time, batch, TAGS) and transitions tr."""
    steps, n, _ = e.shape
    al, be = [e[0]], [np.zeros_like(e[0])]
    for t in range(1, steps):
        al.append(e[t] + logsum(al[-1][:, :, None] + tr, 1))
    for t in range(steps - 1, 0, -1):
        be.append(logsum(tr + (e[t] + be[-1])[:, None, :], 2))
    be.reverse()
    z = logsum(al[-1], 1)
    de = np.exp(np.stack(al) + np.stack(be) - z[None, :, None])
    dt = np.zeros_like(tr)
    for t in range(1, steps):
        dt += np.exp(al[t - 1][:, :, None] + tr + (e[t] + be[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dt, (y[t - 1], y[t]), -1)
    rows = np.arange(n)
    for t in range(steps):
        de[t, rows, y[t]] -= 1
    return de / n, dt / n


@lru_cache(1)
def model() -> dict:
    """The trained weights; the seed fixes them."""
    rng = np.random.default_rng(SEED)
    p = {k: (rng.standard_normal(s) * 0.25).astype(np.float32) for k, s in {
        "xf": (CLASSES, 4 * HIDDEN), "hf": (HIDDEN, 4 * HIDDEN), "xb": (CLASSES, 4 * HIDDEN), "hb": (HIDDEN, 4 * HIDDEN),
        "w": (2 * HIDDEN, TAGS), "b": (TAGS,), "t": (TAGS, TAGS)}.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, 301):
        xs, ys = zip(*(sample(rng) for _ in range(48)))
        x, y = np.stack(xs, 1), np.stack(ys, 1)
        (hf, kf), (hb, kb) = lstm(x, p, "f", True), lstm(x, p, "b", True)
        h = np.concatenate([hf, hb], 2)
        de, dt = crf(h @ p["w"] + p["b"], p["t"], y)
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        grad["t"], grad["b"], grad["w"] = dt, de.sum((0, 1)), np.einsum("tbh,tbk->hk", h, de)
        dh = de @ p["w"].T
        backward(x, p, "f", kf, dh[:, :, :HIDDEN], grad)
        backward(x, p, "b", kb, dh[:, :, HIDDEN:], grad)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= (0.03 * (1 - step / 400) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def decode(x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (time, batch) of windows x (time, batch) and by how much each tag beats none by itself."""
    e = np.concatenate([lstm(x, p, "f"), lstm(x, p, "b")], 2) @ p["w"] + p["b"]
    score, back = e[0], []
    for t in range(1, len(e)):
        s = score[:, :, None] + p["t"]
        back.append(s.argmax(1))
        score = s.max(1) + e[t]
    tags = np.empty(x.shape, np.int64)
    tags[-1] = score.argmax(1)
    rows = np.arange(x.shape[1])
    for t in range(len(e) - 2, -1, -1):
        tags[t] = back[t][rows, tags[t + 1]]
    return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]


def windows(text: str) -> tuple[list[int], np.ndarray]:
    """Starts and classes (batch, WIDTH) of the windows with a digit or @ and of those next to them; together all windows cover the text."""
    c = classes(text)
    n = max(0, -(-(len(c) - WIDTH) // STRIDE)) + 1
    c = np.pad(c, (0, (n - 1) * STRIDE + WIDTH - len(c)))
    all_ = np.lib.stride_tricks.sliding_window_view(c, WIDTH)[::STRIDE]
    has = ((all_ == 1) | (all_ == 4)).any(1)
    has = has | np.append(has[1:], False) | np.append(False, has[:-1])
    return (np.flatnonzero(has) * STRIDE).tolist(), all_[has]


MARGIN = 2.0
DIGITS = ((0, 99), (4, 12), (12, 19), (9, 15))


def guesses(texts: list[str], p: dict) -> list[list[tuple[float, int, int, int]]]:
    """Of each text the model's candidate spans as (score, start, kind, end)."""
    found: list[list] = [[] for _ in texts]
    starts, of, rows = [], [], []
    for k, text in enumerate(texts):
        s, w = windows(text)
        starts += s
        of += [k] * len(s)
        rows.append(w)
    if not starts:
        return found
    every = np.concatenate(rows)
    edge = (WIDTH - STRIDE) // 2
    k, tags, gain, at = -1, [], [], 0  # of the run of overlapping windows so far: text, tags and gains from character at on

    def close() -> None:
        if k >= 0:
            found[k] += spans_of(tags, np.concatenate(gain), at, len(texts[k]))

    for lot in range(0, len(every), 1024):
        t, g = decode(np.ascontiguousarray(every[lot : lot + 1024].T), p)
        for b in range(t.shape[1]):
            if of[lot + b] == k and starts[lot + b] == at + len(tags) - WIDTH + STRIDE:
                # the overlap's second half is this window's
                del tags[len(tags) - edge :]
                gain[-1] = gain[-1][: len(gain[-1]) - edge]
                tags += t[WIDTH - STRIDE - edge :, b].tolist()
                gain.append(g[WIDTH - STRIDE - edge :, b])
            else:
                close()
                k, tags, gain, at = of[lot + b], t[:, b].tolist(), [g[:, b]], starts[lot + b]
    close()
    return found


def spans_of(tags: list[int], gain: np.ndarray, base: int, length: int) -> list[tuple[float, int, int, int]]:
    """Spans of tags that begin at character base of a text; those cut by the ends of the tags inside the text are left out."""
    out, i, n = [], 0, len(tags)
    while i < n:
        if tags[i] and tags[i] % 2:
            j = i + 1
            while j < n and tags[j] == tags[i] + 1:
                j += 1
            start, end = base + i, min(base + j, length)
            if (i or not start) and (j < n or end == length):
                out.append((float(gain[i:j].mean()), start, (tags[i] - 1) // 2, end))
            i = j
        else:
            i += 1
    return out


def valid(address: str) -> bool:
    return all(p.isascii() and p.isdigit() and int(p) <= 255 for p in (x.strip() for x in address.split(".")))


def reconcile(text: str, base, dropped, candidates) -> list[tuple[int, int, int]]:
    """Base spans and the best candidates that meet neither a base span nor each other; by start, then kind."""
    taken = [(s, e) for s, _, e in base]
    out, judged = list(base), set(dropped)
    for score, s, k, e in sorted(set(candidates), key=lambda c: (-c[0], c[1], c[2], c[3])):
        part = text[s:e]
        n = sum("0" <= c <= "9" for c in part)
        low, high = DIGITS[k]
        fits = low <= n <= high and (k != 0 or "@" in part and "." in part.partition("@")[2]) and (k != 1 or part.count(".") == 3 and valid(part)) and (k != 2 or luhn("".join(c for c in part if "0" <= c <= "9")))
        if score >= MARGIN and fits and (s, k, e) not in judged and part == part.strip() and all(e <= a or b <= s for a, b in taken):
            out.append((s, k, e))
            taken.append((s, e))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FIELDS = [*(C.field(f"n_{k}", C.LONG) for k in KINDS), C.field("base_sha256", C.STRING), C.field("spans", C.STRING)]
NONE = hashlib.sha256(b"").hexdigest()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def factory():
        p = shared.value

        def work(texts):
            out = [[0] * len(texts) for _ in KINDS] + [[NONE] * len(texts), [""] * len(texts)]
            some = [(k, s) for k, t in enumerate(texts) if SIGN.search(s := t.decode("utf-8", "replace"))]
            for (k, text), more in zip(some, guesses([s for _, s in some], p)):
                base, dropped = rules(text)
                for _, kind, _ in base:
                    out[kind][k] += 1
                out[4][k] = hashlib.sha256(joined(base).encode()).hexdigest()
                out[5][k] = joined(reconcile(text, base, dropped, more))
            return out

        return work

    return C.map_texts(docs, [C.col(id_col).alias(id_col)], C.col(text_col), FIELDS, factory)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.read(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
