import random
from collections import Counter

from pyspark.sql import functions as F

from strandlake.operators import orphans, ranges, skew

T = "ref int, key string, t bigint"
V = "ref int, key string, loaded bigint, removed bigint"
DAY = 86_400_000_000


def test_counts_by_key_with_hot_keys_and_tags(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(30)}", rng.choice(["t1", "t1", "t1", f"t{rng.randrange(50)}", None])) for _ in range(4000)]
    rows += [(None, "t1")] * 10
    df = spark.createDataFrame(rows, "k string, t string").withColumn("row", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.key_value: (r.n_rows, r.n_tags) for r in ranges.counts_by_key(df, {"f": (F.col("k"), F.col("t"))}).collect()}
    n = Counter(k for k, _ in rows if k is not None)
    tags = {k: len({t for x, t in rows if x == k and t is not None}) for k in n}
    assert got == {k: (n[k], tags[k]) for k in n}


def test_counts_of_an_empty_table_and_null_tags(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert ranges.counts_by_key(df, {"f": (F.col("k"), F.col("t"))}).collect() == []
    df = spark.createDataFrame([("a", None), ("a", None), ("", "")], "k string, t string")
    got = {r.key_value: (r.n_rows, r.n_tags) for r in ranges.counts_by_key(df, {"f": (F.col("k"), F.col("t"))}).collect()}
    assert got == {"a": (2, 0), "": (1, 1)}


def plain_orphans(refs, targets):
    out = Counter()
    for ref, key, t in refs:
        if key is None or t is None:
            continue
        of_key = [(a, b) for r, k, a, b in targets if (r, k) == (ref, key)]
        if any(a is not None and a <= t and (b is None or b > t) for a, b in of_key):
            continue
        loaded = [a for a, _ in of_key if a is not None]
        reason = "missing" if not of_key else "late" if loaded and all(a > t for a in loaded) else "deleted"
        out[ref, t // DAY, key, reason] += 1
    return out


def found_orphans(spark, refs, targets):
    rows = orphans.orphan_references(spark.createDataFrame(refs, T), spark.createDataFrame(targets, V)).collect()
    assert len({tuple(r)[:4] for r in rows}) == len(rows)
    return {(r.ref, (r.day - __import__("datetime").date(1970, 1, 1)).days, r.key, r.reason): r.n for r in rows}


def test_orphans_against_the_plain_definition(spark):
    rng = random.Random(3)
    when = lambda: rng.randrange(4 * DAY)
    refs = [(rng.randrange(2), f"k{rng.randrange(12)}", when()) for _ in range(600)]
    targets = [(rng.randrange(2), f"k{rng.randrange(9)}", when(), when() if rng.random() < 0.7 else None) for _ in range(25)]
    refs += refs[:50]
    targets += targets[:5]
    assert found_orphans(spark, refs, targets) == plain_orphans(refs, targets)


def test_orphans_of_nulls_and_empty_tables(spark):
    refs = [(0, None, 5), (0, "a", None), (0, "a", 5), (0, "b", 5), (0, "b", 5)]
    assert found_orphans(spark, refs, []) == {(0, 0, "a", "missing"): 1, (0, 0, "b", "missing"): 2}
    assert found_orphans(spark, [], [(0, "a", 1, None)]) == {}
    # Loaded at the very time holds; removed at the very time doesn't.
    assert found_orphans(spark, [(0, "a", 5), (0, "b", 5)], [(0, "a", 5, None), (0, "b", 1, 5)]) == {(0, 0, "b", "deleted"): 1}
    # A target that was never loaded never holds, but is not missing.
    assert found_orphans(spark, [(0, "a", 5)], [(0, "a", None, None)]) == {(0, 0, "a", "deleted"): 1}


def heavy_case():
    """A key with most references and few periods, one with many of both, one without a target, and light keys."""
    rng = random.Random(4)
    of = lambda key, n, days=30: [(0, key, rng.randrange(days * DAY)) for _ in range(n)]
    refs = of("few", 2500) + of("many", 1500, 2) + of("none", 900) + [r for i in range(60) for r in of(f"k{i}", 20)]
    targets = [(0, "few", 3 * DAY, 9 * DAY), (0, "few", 12 * DAY + 7, 12 * DAY + DAY // 2), (0, "few", 20 * DAY, None)]
    targets += [(0, "many", 10_000_000 + i * 100_000_000, 10_000_000 + i * 100_000_000 + 60_000_000) for i in range(1300)]
    targets += [(0, f"k{i}", i * DAY // 2, i * DAY) for i in range(40)]
    return refs, targets


def test_orphans_of_heavy_keys(spark):
    refs, targets = heavy_case()
    daily = spark.createDataFrame(refs, T).groupBy("ref", "key").agg(F.count("*").alias("n"))
    periods = orphans.validity(spark.createDataFrame(targets, V))
    # By the usual limits: two keys go by broadcast, the one with too many periods doesn't.
    assert {k for _, k in orphans.heavy_keys(daily, periods, orphans.LEAST_REFERENCES)} == {"few", "none"}
    assert found_orphans(spark, refs, targets) == plain_orphans(refs, targets)


def test_orphan_counts(spark):
    df = spark.createDataFrame([(0, "d1", "a", "late", 3), (0, "d1", "b", "late", 1), (0, "d2", "a", "missing", 2)], "ref int, day string, key string, reason string, n bigint")
    assert {tuple(r) for r in orphans.orphan_counts(df).collect()} == {(0, "d1", "late", 2, 4), (0, "d2", "missing", 1, 2)}


def test_join_unique_splits_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(20)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", "h"), ("k1", "one")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.join_unique(left, right, ["k"], how, least_rows=1, least=8)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)


def test_number_rows_is_dense_and_in_order(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("x"))
    got = ranges.number_rows(df, ["x"], "n").collect()
    assert sorted((r.n, r.x) for r in got) == [(i, i) for i in range(1, 1001)]
