from siltmark.plans.queries import QUERIES


def test_overlaps_of_all_users(spark, tmp_path):
    spans = {u: (u * 5000, u * 5000 + 200 * u) for u in range(1, 30)} | {40: (5100, 12000)}
    rows = [(e, u) for u, (lo, hi) in spans.items() for e in (lo, (lo + hi) // 2, hi)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    pairs = {(a, b) for a, (al, ah) in spans.items() for b, (bl, bh) in spans.items() if a < b and al <= bh and ah >= bl}
    reached, size = {1}, 0
    while size < len(reached):
        size = len(reached)
        reached |= {x for p in pairs if reached & set(p) for x in p}
    assert {tuple(r) for r in QUERIES["overlap_pairs_all"](spark, str(tmp_path)).collect()} == pairs and (1, 40) in pairs
    assert {r["run"] for r in QUERIES["overlap_closure_all"](spark, str(tmp_path)).collect()} == reached and len(reached) > 2


def test_all_keys_are_looked_up(spark):
    d = "/root/testdata/sf0.01"
    customers = spark.read.parquet(f"{d}/customer.parquet").count()
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count()
    assert QUERIES["mget_left_join_all"](spark, d).count() == customers
    assert QUERIES["exists_semi_all"](spark, d).count() + QUERIES["absent_anti_all"](spark, d).count() == customers
    assert QUERIES["first_hit_by_level_all"](spark, d).count() == users
