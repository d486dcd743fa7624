"""Secret scans (operator 7): one deterministic automaton for all rules, one pass over the bytes.

Every rule has a core, an expression whose first end shows that a match has begun, and a tail, the bytes that
lengthen the match. The cores are compiled together by subset construction and minimised; the pass stops at the
ends of cores only. There a second automaton, of the reversed core, walks back to the leftmost start, and the
tail is followed to the end. Cores hold no long counts but one, since counted classes that overlap would multiply the
states; least lengths are compared afterwards. Matches of one rule do not overlap: the next begins after the last, kept or not.

Defined cases: a null or empty text has no spans; spans of different rules may overlap; repeated rows are scanned
alike and all returned; only the id and the text are read, so other columns' names do not matter. Offsets
are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from operator import length_hint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .automaton import Automaton

VALUE = "A-Za-z0-9+/_.=-"
#: name, core, tail class, least length, whether the length is that of the value only
RULES = (
    ("assign", f"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[{VALUE}]""", VALUE, 6, True),
    ("access", "AKIA[A-Z0-9]", "A-Z0-9", 20, False),
    ("hex", "[0-9a-f]{24}", "0-9a-f", 24, False),
    ("github", "gh[pousr]_[A-Za-z0-9]", "A-Za-z0-9", 40, False),
    ("slack", "xox[abprs]-[A-Za-z0-9-]", "A-Za-z0-9-", 15, False),
    ("google", "AIza[A-Za-z0-9_-]", "A-Za-z0-9_-", 39, False),
    ("private", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "", 27, False),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", "A-Za-z0-9_-", 20, False),
)
BASE = ("assign", "access", "hex")


@lru_cache(1)
def compiled() -> tuple[Automaton, list[Automaton]]:
    return Automaton([r[1] for r in RULES], anywhere=True), [Automaton([r[1]], anywhere=False, backward=True) for r in RULES]


def scanner(forward: Automaton | None = None, backward: list[Automaton] | None = None):
    """A function from bytes to (rule number, start, end) in bytes, by rule and start."""
    if forward is None:
        forward, backward = compiled()
    begin = forward.rows()[1]
    back = [a.rows()[1] for a in backward]
    from .automaton import parse

    tails = [parse(f"[{r[2]}]")[1][0][1] if r[2] else frozenset() for r in RULES]
    least, value_only = [r[3] for r in RULES], [r[4] for r in RULES]
    several = range(len(RULES))

    def scan(data: bytes) -> list[tuple[int, int, int]]:
        n, row, found = len(data), begin, []
        done = [0] * len(RULES)
        it = iter(data)
        for c in it:
            row = row[c]
            if row[256]:
                at = n - length_hint(it)
                for k in several:
                    if not row[256] >> k & 1 or at <= done[k]:
                        continue
                    start, r, j, low = -1, back[k], at, done[k]
                    while j > low:
                        j -= 1
                        r = r[data[j]]
                        if r[256]:
                            start = j
                    if start < 0:
                        continue
                    end, tail = at, tails[k]
                    while end < n and data[end] in tail:
                        end += 1
                    done[k] = end
                    if end - (at - 1 if value_only[k] else start) >= least[k]:
                        found.append((k, start, end))
        return found

    return scan


def spans_of(data: bytes, scan) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the rules' order."""
    found = scan(data)
    if not found:
        return []
    if data.isascii():
        place = int
    else:
        at = dict.fromkeys(x for _, s, e in found for x in (s, e))
        last = chars = 0
        for x in sorted(at):
            chars += len(data[last:x].decode("utf-8", "replace"))
            last, at[x] = x, chars
        place = at.__getitem__
    return [(RULES[k][0], place(s), place(e)) for s, k, e in sorted((s, k, e) for k, s, e in found)]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans) -> str:
    """text with each stretch covered by spans replaced by [kind] of the span that begins it."""
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


FIELDS = [C.field("n_assign", C.LONG), C.field("n_access", C.LONG), C.field("n_hex", C.LONG), C.field("base_sha256", C.STRING), C.field("spans", C.STRING)]
REDACTED = C.field("__redacted", C.STRING)


def _scan_all(with_text: bool):
    forward, backward = compiled()
    scan_with = scanner

    def factory():
        scan = scan_with(forward, backward)

        def work(texts):
            out = [[], [], [], [], [], []]
            for data in texts:
                spans = spans_of(data, scan)
                base = [x for x in spans if x[0] in BASE]
                for k, kind in enumerate(BASE):
                    out[k].append(sum(x[0] == kind for x in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(spans))
                if with_text:
                    text = data.decode("utf-8", "replace")
                    out[5].append(redact(text, spans) if spans else text)
            return out[: 5 + with_text]

        return work

    return factory


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, the counts and digest of the base spans, and all spans."""
    return C.map_texts(docs, [C.col(id_col).alias(id_col)], C.col(text_col), FIELDS, _scan_all(False))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows of docs in their own columns, each secret replaced by its kind in brackets; null texts stay null."""
    seen = C.map_texts(docs, C.with_rows(docs), C.col(text_col), [*FIELDS, REDACTED], _scan_all(True))
    old, hit = F.col("__row").getField(text_col), F.col("spans") != ""
    new = {text_col: F.when(hit, F.col("__redacted")).otherwise(old)}
    if chars_col in docs.columns:
        new[chars_col] = F.when(hit, F.length("__redacted").cast(docs.schema[chars_col].dataType)).otherwise(F.col("__row").getField(chars_col))
    return seen.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.read(spark, sf_dir, "documents"))


QUERIES = {"op7_secret_scans": op7_secret_scans}
