import random

from strandlake.llm import components


def plain(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(x, root(x)) for x in parent}


def found(spark, pairs, **extra):
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("*", "1 AS v", "2 AS w", "'x' AS value")
    return {tuple(r) for r in components.groups(df, "a", "b").collect()}


def test_random_graph_with_hub_chain_and_repeats(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(120)]
    pairs += [("hub", f"h{i}") for i in range(150)]  # a star
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a chain
    pairs += pairs[:40] + [(b, a) for a, b in pairs[:40]] + [("self", "self"), (None, "x"), ("y", None), ("", "empty")]
    assert found(spark, pairs) == plain(pairs)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", "a"), (None, None)]) == set()


def test_fresh_key_is_a_bijection(spark):
    df = spark.range(-3000, 3000).select(components.fresh_key("id", 7).alias("k"))
    assert df.distinct().count() == 6000


def test_colliding_names_are_chosen_anew(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(components.F, "xxhash64", lambda c, seed: F.length(F.coalesce(c, F.lit(""))).cast("bigint") if "0" in str(seed) else real(c, seed))
    assert found(spark, [("aa", "bb"), ("cc", "dd")]) == {("aa", "aa"), ("bb", "aa"), ("cc", "cc"), ("dd", "cc")}
