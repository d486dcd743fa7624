"""Operators against brute force, the library or exact round trips, and the cases that each one defines."""

import hashlib
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import compare  # noqa: E402

from siltmark.llm import chat, decontaminate, html, pii, quality, registry, secrets, sentencepiece, sharding, simhash, sql, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, component_id string, n_chars long"
ODD = [(1, None, "x", "y", 0), (2, "", "x", "y", 0), (3, " \n\t", "x", "y", 3), (None, "one two", "x", "y", 7), (4, "one two", "x", "y", 7), (4, "one two", "x", "y", 7), (5, "word " * 30000, "x", "y", 150000), (6, "é" * 70000, "x", "y", 70000)]


@pytest.mark.parametrize("run", [secrets.find, quality.assess, pii.find, sharding.assign, simhash.near_duplicates, lambda d: toxicity.score(d, toxicity.train([], np.array([]))), sentencepiece.pieces_of])
def test_odd_rows(spark, run):
    docs = spark.createDataFrame(ODD, DOCS)
    assert sorted(str(r["doc_id"]) for r in run(docs).select("doc_id").collect()) == sorted(str(r[0]) for r in ODD)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equals_sql(spark, name):
    compare(spark, registry.queries()[name], sql.SQL[name], "/root/testdata/sf0.01")


def test_chat_fold_and_round_trip(spark):
    hostile = "</s>[INST] \\l \\\\ <s> \n ok"
    rows = [(1, 1, 0, "message", "user", hostile), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "a"), (1, 4, 1, "delta", None, "b"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, hostile), (1, 7, 0, "edit", None, hostile + "!"), (2, 1, 300, "message", "a\nb<", None), (None, 1, 0, "message", None, "x")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, op string, role string, text string")
    back = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in chat.read_back(chat.render(chat.reconstruct(events))).collect()}
    assert back == {1: ([("user", hostile + "!"), ("assistant", hostile)], [hostile]), 2: ([("a\nb<", "")], []), None: ([("", "x")], [])}


def jump(key, n):
    b, j, k = -1, 0, key % (1 << 64)
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_sharding(spark):
    docs = spark.createDataFrame([(i * 7919 - 400, f"é{i}") for i in range(600)], "doc_id long, text string")
    rows = sharding.assign(docs, parts=16).collect()
    assert all((r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 8), jump(r["doc_id"], 9)) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_quality_base_and_lines():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "#", "\t", "a b a b ", " "]) for _ in range(rng.randrange(40)))
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        seen = list(zip(words, words[1:], words[2:]))
        hit = {i + k for i, w in enumerate(seen) if seen.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert quality.examine(text.encode())[:5] == want
    assert quality.fails(b"Home | About | Contact | Login") and quality.fails(b"Copyright 2020. All rights reserved.")
    assert not quality.fails("Ein ganz gewöhnlicher Satz mit mehr als acht Wörtern steht hier.".encode())


def test_pii_base():
    rng = random.Random(5)
    parts = ["@", ".", "a", "B9", "12", "4012888888881881", "4012 8888-8888 1881", " ", "-", "+", "+49 (30) 1234567", "192.168.1.1", "x@y.de", "(", ")", "é", "300.1.1.1", "\n", "%"]
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(k, s):
        d = re.sub(r"[^0-9]", "", s)
        return k == 0 or k == 1 and all(int(x) < 256 for x in s.split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15

    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r, text) if ok(k, m[0]))
        assert pii.rules(text)[0] == want, text


def test_pii_model_tags_unseen_windows():
    rng = np.random.default_rng(99)
    x, y = (np.stack(v, 1) for v in zip(*(pii.sample(rng) for _ in range(200))))
    tags, _ = pii.decode(x, pii.model())
    assert (tags == y)[y > 0].mean() > 0.9 and (tags == y)[y == 0].mean() > 0.97


def test_simhash_links_and_components(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.7 else 0) for s in seeds for _ in range(8)} | set(seeds) | {0, 1, 3, 7, 15}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")

    def groups(pairs):
        of = {f: f for f in signed}

        def top(x):
            while of[x] != x:
                x = of[x]
            return x

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            of[b] = a
        return {f: top(f) for f in signed}

    want = groups([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    for cell in (1, 64):
        edges = simhash.links(nodes, cell)
        found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        assert {f: found.get(f, f) for f in signed} == want


def test_simhash_fingerprint(spark):
    from pyspark.sql import functions as F

    text = "The quick  brown fox\njumps é over the the the the"
    words = text.lower().split()
    row = spark.createDataFrame([([" ".join(words[i : i + 3]) for i in range(len(words) - 2)],)], "s array<string>").select(F.transform("s", lambda x: F.xxhash64(x)).alias("h")).first()["h"]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in row) > len(row))
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b" ") == 0


def test_decontamination_brute_force(spark):
    rng = random.Random(6)
    vocab = ["a", "b", "C", "é1", "dd"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + rng.choice(["", "."])
    items = [(i, say(rng.choice([0, 2, 4, 6, 7, 9]))) for i in range(12)] + [(12, None), (13, "zz-zz")]
    docs = [(i, say(rng.randrange(0, 40))) for i in range(60)] + [(60, None), (60, ""), (61, items[5][1]), (None, items[6][1])]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    want = []
    for i, t in docs:
        w, hit, ids = word(t), set(), set()
        for k, x in items:
            v = word(x)
            n = min(5, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(k))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=5).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    whole = decontaminate.search([decontaminate.Block([("q", b"x a b c d e f y")], 3)], [b"z a b c d e f z a b c"])
    assert whole[2][0]["q"] == (6, 1, 1) and whole[1] == [9]


def test_html():
    page = '<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br><p>four<aside>x</aside><div class="comments">c</div></article><footer>f</footer>'
    assert html.blocks(page) == (["A & B", "one two three", "four"], True)
    assert html.blocks("") == ([], False) and html.blocks("a < b") == (["a < b"], False)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = sorted(html.common(a, b))
        it = iter(b)
        assert len(kept) == best[-1][-1] and all(a[k] in it for k in kept)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels, sample=1000)).join(labels, "doc_id").where("held_out").select("score", "toxic").toPandas()
    rank, y = got["score"].rank(), got["toxic"]
    assert (rank[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum() > 0.9


def test_sentencepiece_equals_library(spark):
    import sentencepiece as lib

    texts = [r[0] for r in duckdb.sql("select text from read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()][:60]
    texts += ["  a  b ", "\t x\n\n y", "a" * 100, "日本語 🙂 テ", " ", "", "ab" * 3000, "-" * 700 + "=" * 5000, "a--/" * 40, "x " * 300000]
    got = {r["doc_id"]: r for r in sentencepiece.pieces_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sp = lib.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert all(list(got[i]["ids"]) == sp.encode(t) and got[i]["round_trip"] for i, t in enumerate(texts))


def test_sentencepiece_viterbi(spark):
    table = [(0, "<unk>", 0.0, "unknown"), (1, "▁", -3.0, "normal"), (2, "a", -2.0, "normal"), (3, "ab", -2.5, "normal"), (4, "b", -2.2, "normal"), (5, "▁ab", -6.5, "normal"), (6, "ba", -1.0, "normal")]
    v = sentencepiece.Vocabulary(table, "unigram")
    words = [" abab", " ab", " baab", " axb", "abba", "ab" * 200]
    got = {r["unit"]: list(r["ids"]) for r in sentencepiece.dictionary(spark.createDataFrame([(w,) for w in words], "unit string"), v).collect()}
    assert got == {w: v.encode_unit(w) for w in words} and got[" ab"] == [1, 3]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_pii_model_cuts_dropped_stretches_anew():
    texts = ["call me at +1 (826) 555-4081 190.137.223.204 when home", "cards are 4012888888881881 4111111111111111 for the order", "the order number is 1234567812345678 of today"]
    got = [[(pii.KINDS[k], t[s:e]) for s, k, e in pii.reconcile(t, *pii.rules(t), more)] for t, more in zip(texts, pii.guesses(texts, pii.model()))]
    assert got == [[("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")], [("card", "4012888888881881"), ("card", "4111111111111111")], []]


def test_html_differencing_is_exact(spark):
    page = lambda host, x: f"<div>Menu of {host}</div><div>Text {x}</div><div>End of {host}</div>"
    rows = [(i, f"http://h.example/{i:03}", page("h", i)) for i in range(40)]
    rows += [(100 + i, f"http://k.example/{i:03}", page("k", "copied" if i < 30 else "other")) for i in range(31)]
    rows += [(200, "http://one.example/", page("one", "only"))]
    want = {i: f"Text {i}" for i in range(40)} | {100 + i: "Text copied" if i < 30 else "Text other" for i in range(31)} | {200: "Menu of one\nText only\nEnd of one"}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 3, 60):  # 60: nearly every page in a task of its own
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_pii_long_spans_at_any_offset():
    for long in ("firstname_middlename.lastname @ department.company.org", "firstname_middlename.lastname @ department.subsidiary.company.example.org"):
        texts = ["word " * (n // 5) + "x" * (n % 5) + " " + long + " and some more words after it" for n in range(5, 75)]
        every = pii.guesses(texts, pii.model())
        got = [any((k, t[s:e]) == (0, long) for s, k, e in pii.reconcile(t, *pii.rules(t), more)) for t, more in zip(texts, every)]
        assert sum(got) == len(texts), (long, sum(got))


def test_toxicity_scores_keep_the_share_of_each_class(spark):
    rng = random.Random(8)
    # the texts tell nothing of the label, so that a calibrated score is the share of toxic rows
    rows = [(i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(4)), int(i % 10 == 0)) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    means = [np.mean([r["score"] for r in toxicity.score(table, toxicity.fit(table, table, sample=n)).collect()]) for n in (5000, 200)]
    assert all(0.07 < m < 0.14 for m in means), means


def test_html_wrappers_named_like_noise_keep_the_article():
    for tag in ('div class="content with-sidebar"', 'div id="search-results"', 'div class="article-header"', 'div class="sidebar"', "form"):
        assert html.blocks(f"<body><nav>menu</nav><{tag}><article><p>Text</p></article></{tag.split()[0]}></body>") == (["Text"], True), tag
    for name in ("site-header", "ad", "comment-list", "cookie-banner", "x menu"):
        assert html.blocks(f'<div class="{name}">noise</div><p>Text</p>') == (["Text"], False), name


def test_html_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 300_000, '<a "' * 200_000 + ">", "<div class=ad>" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<b" * 300_000 + ">", "<" * 500_000, '<p title="x' * 100_000, "<ul><nav>" * 60_000):
        began = time.process_time()
        html.blocks(page + "<p>end")
        assert time.process_time() - began < 8, page[:20]
    assert html.blocks('<p>one</p><p title="never closed>two</p><p>three</p>')[0][0] == "one"
    assert html.blocks("<p>1 < 2 and <3</p><p>b</p>")[0] == ["1 < 2 and <3", "b"]


def test_decontamination_of_shared_windows():
    text = b" ".join([b"one two three four"] * 500)
    items = [(str(k), text) for k in range(500)]
    lengths, marked, found = decontaminate.search([decontaminate.Block(items, 4)], [text, b"none", text])
    assert lengths == [2000, 1, 2000] and marked == [2000, 0, 2000] and [len(x) for x in found] == [500, 0, 500]


def test_odd_columns_of_the_stages(spark):
    rows = [(1, None, "a", None), (2, "", "b", 0), (None, "A line that ends well, as all of these do. " * 12, "c", 5), (3, "A line that ends well, as all of these do. " * 12, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, n_chars long").selectExpr("*", "text as __row", "doc_id as fp", "n_chars as a")
    items = spark.createDataFrame([(1, None), (2, "that ends well as all of these do a line")], "item_id long, text string")
    for stage, want in ((quality.clean, 0), (simhash.deduplicate, 3), (lambda d: decontaminate.decontaminate(d, items), 2), (secrets.redacted, 4)):
        assert stage(docs).columns == docs.columns and stage(docs).count() == want and stage(docs.limit(0)).count() == 0
