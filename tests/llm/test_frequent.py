import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import frequent


def test_codewords_survive_errors_and_gaps():
    rng = random.Random(6)
    for _ in range(30):
        one = rng.getrandbits(64)
        word = frequent.codewords(np.array([one], dtype=np.uint64))[0].tolist()
        assert frequent.decode(word) == one
        for at in rng.sample(range(16), 4):
            word[at] = rng.randrange(257)
        assert frequent.decode(word) == one
        word = frequent.codewords(np.array([one], dtype=np.uint64))[0].tolist()
        for at in rng.sample(range(16), 6):
            word[at] = None
        assert frequent.decode(word) == one
    assert frequent.decode([None] * 16) is None


def found(spark, values, share, parts=5):
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(parts).withColumn("id", F.lit(1)).withColumn("field", F.lit("x"))
    return {r.key_value: r.n for r in frequent.frequent_values(df, {"f": F.col("v")}, share).collect()}


def expected(values, share):
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    return {v: n for v, n in counts.items() if n >= share * total}


def test_many_heavy_values_among_rare_ones(spark):
    rng = random.Random(7)
    values = [f"heavy{rng.randrange(120)}" for _ in range(14_000)] + [f"rare{i}" for i in range(5000)] + ["", None, "long" * 500] * 120
    assert found(spark, values, 1 / 200) == expected(values, 1 / 200)


def test_ties_at_the_threshold_one_value_and_none(spark):
    values = [v for i in range(10) for v in [f"t{i}"] * 10]
    assert found(spark, values, 0.1) == expected(values, 0.1)
    assert found(spark, ["a"] * 50, 0.5) == {"a": 50}
    assert found(spark, [None] * 5, 0.5) == {}
    assert found(spark, [], 0.5) == {}


def test_groups_that_cannot_be_decoded_are_counted(spark, monkeypatch):
    """With nothing decoded, all comes from the exact fallback."""
    monkeypatch.setattr(frequent, "decode", lambda symbols: None)
    values = [f"h{i}" for i in range(8) for _ in range(30)] + [f"r{i}" for i in range(60)]
    assert found(spark, values, 0.05) == expected(values, 0.05)
