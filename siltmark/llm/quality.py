"""Quality rules (operator 4): line-first cleaning.

Each line is judged on its own by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses more than max_lost of its characters is rejected.

Defined cases: a null or empty text has no words, fails the base rule and is rejected; a blank line is neither
kept nor lost; repeated rows are judged alike and all returned; columns other than the id and the text are not
read, so clashing names do not matter; a null id is passed through.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ENDS = tuple(x.encode() for x in (".", "!", "?", "…", '"', "'", "”", "’", "»", ":", ";", ")", "]", "。", "！", "？", "،", "؟", "।"))
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
SEPARATORS = re.compile(rb"[|>]|\xc2\xbb|\xe2\x80\xa2|\xc2\xb7|\xe2\x80\xba")
BOILERPLATE = re.compile(
    rb"all rights reserved|(?:accept|use[sd]?|using|our) (?:of )?cookies|enable javascript|terms (?:of|and) (?:use|service|conditions)"
    rb"|privacy policy|lorem ipsum|click here|(?:sign|log) ?in to|subscribe to (?:our|the)|^\s*copyright\b|\xc2\xa9|licen[sc]ed under|powered by",
    re.I,
)
MAX_LOST = 0.5


def fails(line: bytes) -> str:
    """The rule that a line with a word fails, or an empty string.

    punctuation: under eight words without a final punctuation mark, over a tenth of the characters are symbols,
    or over a third of the words end in two exclamation or question marks. navigation: a separator for every
    four words or fewer, and two at least. boilerplate: a stock phrase in a line of under 40 words.
    """
    words = line.split()
    n = len(words)
    signs = len(line) - len(line.translate(None, SYMBOLS))
    if signs:
        m = len(SEPARATORS.findall(line))
        if m >= 2 and 4 * m >= n:
            return "navigation"
        if 10 * signs > len(line):
            return "punctuation"
    elif b"\xc2" in line or b"\xe2" in line:
        m = len(SEPARATORS.findall(line))
        if m >= 2 and 4 * m >= n:
            return "navigation"
    if n < 8 and not line.rstrip().endswith(ENDS):
        return "punctuation"
    if b"!!" in line or b"??" in line:
        if 3 * sum(w.rstrip(b".,;:").endswith((b"!!", b"??")) for w in words) > n:
            return "punctuation"
    if n < 40 and BOILERPLATE.search(line):
        return "boilerplate"
    return ""


def examine(data: bytes, max_lost: float = MAX_LOST) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share, cleaned text."""
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, True, False, 0.0, b""
    bare = data.translate(None, SPACES)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = lost = total = 0
    left = []
    for line in data.split(b"\n"):
        if not line or line.isspace():
            left.append(line)
            continue
        if line in seen:
            again += 1
        seen.add(line)
        total += len(line)
        if fails(line):
            lost += len(line)
        else:
            left.append(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeats += i + 3 - max(i, upto)
                upto = i + 3
    failed = n < 50 or 100 * repeats > 50 * n
    share = lost / total
    return n, chars, symbols, again, repeats, failed, not failed and share <= max_lost, share, b"\n".join(left) if lost else data


FIELDS = [C.field("n_words", C.LONG), C.field("word_chars", C.LONG), C.field("n_symbols", C.LONG), C.field("n_dup_lines", C.LONG), C.field("n_repeat_words", C.LONG), C.field("base_failed", C.BOOL), C.field("kept", C.BOOL), C.field("lost_share", C.DOUBLE)]
CLEANED = C.field("__cleaned", C.STRING)


def _scores(max_lost: float, with_text: bool):
    def factory():
        def work(texts):
            made = list(zip(*(examine(x, max_lost) for x in texts)))
            if with_text:
                made[8] = [x.decode("utf-8", "replace") for x in made[8]]
            return made[: 8 + with_text]

        return work

    return factory


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row for each row of docs: its id, the base figures, the share of text lost to line rules and the verdict."""
    return C.map_texts(docs, [C.col(id_col).alias(id_col)], C.col(text_col), FIELDS, _scores(max_lost, False))


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", max_lost: float = MAX_LOST) -> DataFrame:
    """docs without the rejected documents, in their own columns; texts are left without their failing lines."""
    seen = C.map_texts(docs, C.with_rows(docs), C.col(text_col), [*FIELDS, CLEANED], _scores(max_lost, True)).where("kept")
    new = {text_col: F.col("__cleaned")} | ({chars_col: F.length("__cleaned").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return seen.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(C.read(spark, sf_dir, "documents"))


QUERIES = {"op4_quality_rules": op4_quality_rules}
