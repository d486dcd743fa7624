"""HTML extraction (operator 10): structure where a page has it, nearest-URL page differencing where it has not.

A page is cut into blocks, lines of text in page order. Elements that are never main text (navigation, headers, footers,
asides, forms, scripts, and elements whose class, id or role says advert, menu, comments or the like) are left out. If the
page has an article or main element, its blocks are the text, and nothing is compared: lines that articles share
are text and must stay. Of the other pages, those of a host with the same lines are one, placed where the first of them lies in
the order of URL paths. Each is paired with the different page before it in the host (the first with the one after), their lines aligned
by longest common subsequence, and the shared lines deleted as the site's frame; if all lines are shared, they stay.

The order is a range partitioning by host and path, so that a host with a third of all pages spreads over many
tasks; each task's first and last page are handed to its neighbours, so results don't depend on the tasks. Pages with an article
never take part in it.

Defined cases: null or empty html gives an empty text; a null URL is an empty host and path; repeated pages are returned each
(with the same text; a host whose pages are all equal keeps its lines); ties of path go by URL and id; an empty table gives no rows.
"""

from __future__ import annotations

import html as H
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>""")
#: Used after a tag that never ends: no tag then reaches over another's beginning.
SHORT = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
OUT = frozenset("nav header footer aside form script style textarea title iframe noembed noframes xmp noscript template head select button dialog object svg canvas menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer header masthead comment comments respond discussion "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay widget search complementary contentinfo".split()
)

#: What a name of noise may have beside words of NOISE: site-header, comment-list; but not article-header or with-sidebar.
BESIDE = frozenset(
    "area bar block bottom box btn button buttons center col column container content custom desktop form global group holder inner item items left link links list "
    "main mobile outer page panel post posts primary right row secondary section site slot sticky the top unit wrap wrapper".split()
)


def noisy(rest: str) -> bool:
    """Whether a whole name is noise: one word of NOISE at least, and otherwise words that go with it, or numbers."""
    if "=" not in rest:
        return False
    for m in NAMES.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if any(w in NOISE for w in words) and all(w in NOISE or w in BESIDE or w.isdigit() for w in words):
                return True
    return False


def blocks(page: str) -> tuple[list[str], bool]:
    """Lines of text in page order, and whether they come from an article or main element.

    If the page's only article or main lies in an element named like noise, and nothing else is left, that element isn't left out.
    """
    found = _blocks(page, False)
    return found if found[0] else _blocks(page, True)


def _blocks(page: str, spare: bool) -> tuple[list[str], bool]:
    """spare: elements that hold an article or main are never left out."""
    inside: list[str] = []
    outside: list[str] = []
    parts: list[str] = []
    depth, lower, at, n = 0, None, 0, len(page)
    container = ""
    skip, level, back, spared = "", 0, 0, set()
    tag, ends, gone, last = TAG, {}, set(), page.rfind(">")

    def close_of(name: str, at: int) -> int:
        """Where the next closing tag of that name begins, -1 if none does; every stretch of the page is searched once a name."""
        nonlocal lower
        lower = lower or page.lower()
        if name in gone:
            return -1
        if ends.get(name, -1) < at:
            ends[name] = lower.find(f"</{name}", at)
            if ends[name] < 0:
                gone.add(name)
        return ends[name]

    def flush() -> None:
        if parts:
            line = " ".join(H.unescape("".join(parts)).split())
            if line:
                (inside if depth else outside).append(line)
            parts.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not skip:
            parts.append(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = tag.match(page, lt) if lt < last else None
        if not m and lt < last and tag is TAG and page[lt + 1 : lt + 2] not in ("", " "):
            if page[lt + 1].isalpha() or page[lt + 1] == "/" and page[lt + 2 : lt + 3].isalpha():
                tag = SHORT
                m = tag.match(page, lt)
        if not m:
            if not skip:
                parts.append("<")
            at = lt + 1
            continue
        at, name, closing = m.end(), m[2].lower(), bool(m[1])
        alone = name in VOID or m[3].endswith("/") and name not in INLINE and name not in OUT and name not in ("article", "main", "div", "p")
        if skip:
            if spare and name in ("article", "main") and not closing:
                spared.add(back)
                at, skip = back, ""
            elif name == skip and not alone:
                level += -1 if closing else 1
                if not level:
                    skip = ""
            elif name in RAW and not closing:
                end = close_of(name, at)
                at = n if end < 0 else end
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if not closing and not alone and at not in spared and (name in OUT or name not in ("html", "body", "article", "main") and noisy(m[3]) or name == "article" and depth and noisy(m[3])):
            end = close_of(name, at)
            if name in RAW:
                at = n if end < 0 else end
            if end >= 0:  # an element that is never closed hides nothing
                flush()
                skip, level, back = name, 1, at
            continue
        if name in ("article", "main") and (not container or name == container):
            depth = max(0, depth + (-1 if closing else 1))
            container = name if depth else ""
    flush()
    return (inside, True) if inside else (outside, False)


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by rows of bits."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    kept = {*range(lead), *range(len(a) - tail, len(a))}
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for line in x:
        v = rows[-1]
        u = v & where.get(line, 0)
        rows.append((v + u | v - u) & full)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            kept.add(lead + i - 1)
            i, j = i - 1, j - 1
    return kept


def without_shared(own: list[str], other: list[str] | None) -> list[str]:
    if not other:
        return own
    shared = common(own, other)
    return [x for k, x in enumerate(own) if k not in shared] or own


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
LINES = [C.field("__lines", T.ArrayType(C.STRING)), C.field("__whole", C.BOOL)]


def _cut():
    def work(texts):
        made = [blocks(t.decode("utf-8", "replace")) for t in texts]
        return [[x[0] for x in made], [x[1] for x in made]]

    return work


def _edges(batches):
    """The first and the last page of a task."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = b.slice(0, 1) if first is None else first
            last = b.slice(b.num_rows - 1, 1)
    if first is not None:
        yield from (first, last)


def edges_of(ordered: DataFrame) -> dict[int, tuple[tuple | None, tuple | None]]:
    """For each task the page before its first and the page after its last, as (host, lines): two pages a task at most reach the driver."""
    ends: dict[int, list[tuple]] = {}
    for r in ordered.select("__part", "__host", "__lines").mapInArrow(_edges, ordered.select("__part", "__host", "__lines").schema).collect():
        ends.setdefault(r["__part"], []).append((r["__host"], list(r["__lines"])))
    parts = sorted(ends)
    return {p: (ends[parts[k - 1]][1] if k else None, ends[parts[k + 1]][0] if k + 1 < len(parts) else None) for k, p in enumerate(parts)}


def _differ(edges):
    """Batches in the order of host and path: each page against the one before it, the first of a host against the one after."""

    def run(batches):
        before = after = waiting = None  # pages as (host, lines); waiting: the row that still needs the page after it
        started = False

        def made(rows):
            texts = ["\n".join(without_shared(r["__lines"], other)) for r, other in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r, _ in rows], pa.string()) for c in ("__host", "__key")] + [pa.array(texts, pa.string())], names=["host", "key", "text"])

        for whole in batches:
            for b in C.slices(whole):
                out = []
                for row in b.to_pylist():
                    if not started:
                        (before, after), started = edges.value[row["__part"]], True
                    host, lines = row["__host"], row["__lines"]
                    if waiting is not None:
                        out.append((waiting, lines if waiting["__host"] == host else None))
                        waiting = None
                    if before is not None and before[0] == host:
                        out.append((row, before[1]))
                    else:
                        waiting = row
                    before = (host, lines)
                if out:
                    yield made(out)
        if waiting is not None:
            yield made([(waiting, after[1] if after is not None and after[0] == waiting["__host"] else None)])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars of every page."""
    seen = C.map_texts(pages, [C.col(id_col).alias("page_id"), C.col(url_col).alias("url")], C.col(html_col), LINES, _cut)
    C.ensure_checkpoints(pages.sparkSession)
    seen = seen.checkpoint()  # pages are parsed once, whatever of them is compared
    whole = seen.where("__whole or size(__lines) = 0").select("page_id", "url", F.array_join("__lines", "\n").alias("text"))
    url = F.coalesce("url", F.lit(""))
    rest = seen.where("not __whole and size(__lines) > 0").select(
        "page_id", "url", "__lines", F.lower(F.regexp_extract(url, HOST, 1)).alias("__host"), F.regexp_extract(F.regexp_replace(url, HOST, ""), "^[^?#]*", 0).alias("__path"),
        C.sha256(F.array_join("__lines", "\n")).alias("__key"),
    )
    unlike = rest.groupBy("__host", "__key").agg(F.min(F.struct("__path", url.alias("url"), "page_id")).alias("__at"), F.first("__lines").alias("__lines"))
    order = ["__host", "__at.__path", "__at.url", "__at.page_id", "__key"]
    ordered = unlike.repartitionByRange(*order).sortWithinPartitions(*order).select("__host", "__key", "__lines", F.spark_partition_id().alias("__part")).checkpoint()
    edges = pages.sparkSession.sparkContext.broadcast(edges_of(ordered))
    compared = ordered.mapInArrow(_differ(edges), "host string, key string, text string")
    each = rest.select("page_id", "url", "__host", "__key").join(compared, (F.col("__host") == F.col("host")) & (F.col("__key") == F.col("key"))).select("page_id", "url", "text")
    both = whole.union(each)
    return both.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.read(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
