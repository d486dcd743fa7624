import random

from siltmark.llm import jaccard, simhash


def test_near_copies_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    bases = [[word() for _ in range(rng.choice([3, 8, 60, 90]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(160, None), (161, " "), (162, rows[5][1].upper()), (None, rows[6][1])]
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    got = [r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x is not None) == sorted(least.values()) and got.count(None) == 1


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = [w if k not in (20, 90, 150) else f"new{k}" for k, w in enumerate(base)]  # 15 of 196 shingles differ
    far = [w if k % 20 else f"new{k}" for k, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == [1, 3]


def test_rows_that_repeat_an_id(spark):
    text = lambda seed: " ".join(f"w{random.Random(seed * 1000 + k).randrange(9000)}" for k in range(60))
    rows = [(1, text(1), "x"), (1, text(2), "x"), (2, text(1), "y"), (3, text(3), "x"), (3, text(3), "x"), (None, text(3), "z"), (4, None, "x"), (5, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(map(str, simhash.deduplicate(docs).collect()))
    assert len(got) == 6 and sum("doc_id=1," in r for r in got) == 2 and sum("doc_id=None" in r for r in got) == 2
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_group_at_the_limit_of_similarity_makes_few_rows(spark, monkeypatch):
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(180)], []
    for i in range(300):  # two of 180 words differ: a pair is similar only if its changes are near one another
        w = list(base)
        for at in rng.sample(range(180), 2):
            w[at] = f"new{i}.{at}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(176)} for _, t in rows]
    left, groups = set(range(300)), []
    while left:
        group = now = {left.pop()}
        while now:
            now = {b for b in left if any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in now)}
            left -= now
            group = group | now
        groups.append(min(group))
    counts, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: counts.append(pairs.count()) or verified(pairs, *a))
    got = [r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    places = 300 * (176 - 141 + 1)
    assert sorted(got) == sorted(groups) and len(counts) == 2 and max(counts) <= 5 * places
