"""Secret scans against the rules as regular expressions, run one by one."""

import random
import re

from pyspark.sql import functions as F

from siltmark.llm import secrets as S

RULES = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (r, ok) in enumerate(RULES) for m in r.finditer(text) if ok(m)]
    return [(S.BASE[k], s, e) for s, k, e in sorted(found)]


def test_same_as_regular_expressions():
    rng = random.Random(3)
    parts = ["password", "PASSWD", "api_key", "apikey", "ApiKey", "Token", "secret", " ", ":", "=", '"', "'", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "é", "xyz", "_", ".", "\n", "a", "f00"]
    scan = S.scanner()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert [x for x in S.spans_of(text.encode(), scan) if x[0] in S.BASE] == brute(text), text


def test_added_kinds():
    scan = S.scanner()
    text = "é ghp_" + "a1B2" * 9 + " xoxb-1234567890-x -----BEGIN RSA PRIVATE KEY----- AIza" + "x" * 35 + " eyJabc.eyJdef.sig_1234567"
    assert [k for k, _, _ in S.spans_of(text.encode(), scan)] == ["github", "slack", "private", "google", "jwt"]


def test_rows(spark):
    rows = [(1, "token: abcdef", "x"), (2, None, "x"), (3, "", "x"), (4, "token: abcdef", "x"), (None, "nothing", "x"), (5, "a" * 200000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["spans"] for r in S.find(df).collect()}
    assert got == {1: "assign:0:13", 2: "", 3: "", 4: "assign:0:13", None: "", 5: "hex:0:200000"}
    assert S.find(df.limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in S.redacted(df).collect()}
    assert kept[1] == "[assign]" and kept[2] is None and kept[None] == "nothing"
    assert S.find(spark.createDataFrame([(1, "x")], "doc_id long, text string")).select(F.sum("n_hex")).first()[0] == 0
