import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandlake.llm import distinct

KEYS = ["day", "grp", "site"]


def exact(rows):
    out = {}
    for *keys, v in rows:
        if v is not None:
            for n in range(4):
                for c in combinations(range(3), n):
                    name = "+".join(KEYS[i] for i in c) or "total"
                    out.setdefault((name, *(keys[i] if i in c else None for i in range(3))), set()).add(v)
    return {k: len(v) for k, v in out.items()}


def test_combinations_lie_within_the_error(spark):
    rng = random.Random(8)
    rows = [(f"d{rng.randrange(3)}", rng.choice(["a", "b", None]), f"s{rng.randrange(2)}", f"v{rng.randrange(20_000)}" if rng.random() < 0.95 else None) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "day string, grp string, site string, v string").withColumn("m", F.lit(1)).withColumn("h", F.lit(2))
    parts = distinct.registers(df, KEYS, {"of_v": F.col("v")})
    got = {(r.grouping, r.day, r.grp, r.site): (r.n_distinct, r.standard_error) for r in distinct.distinct_by_combination(parts, KEYS, ["of_v"]).collect()}
    counts = exact(rows)
    assert got.keys() == counts.keys()
    # The key of a null and the combination without that key are told apart by the grouping.
    assert ("grp", None, None, None) in got and ("total", None, None, None) in got
    for key, (n, error) in got.items():
        assert error == pytest.approx(1.04 / 64)
        assert n == pytest.approx(counts[key], rel=3.5 * error)


def test_levels_of_the_lattice_give_the_registers_of_the_rows(spark):
    rng = random.Random(9)
    rows = [(f"d{rng.randrange(4)}", f"g{rng.randrange(3)}", "s", f"v{rng.randrange(9_000)}") for _ in range(20_000)]
    df = spark.createDataFrame(rows, "day string, grp string, site string, v string")
    by_lattice = {r.day: r.n_distinct for r in distinct.distinct_by_combination(distinct.registers(df, KEYS, {"v2": F.col("v")}), KEYS, ["v2"]).filter("grouping = 'day'").collect()}
    by_days = distinct.merge(distinct.registers(df.filter("grp = 'g0'"), ["day"], {"v2": F.col("v")}).unionByName(distinct.registers(df.filter("grp <> 'g0'"), ["day"], {"v2": F.col("v")})), ["day"], ["v2"])
    assert by_lattice == {r.day: r.n_distinct for r in distinct.estimate(by_days, ["day"], ["v2"]).collect()}


def test_the_stated_error_is_the_real_one(spark):
    """Root mean square error over many sets, also where the estimator changes from one form to another."""
    for n, sets in ((100, 200), (1_000, 400), (3_000, 400), (8_192, 400), (10_240, 600), (11_000, 600), (13_000, 600), (16_384, 400), (50_000, 200), (200_000, 100)):
        df = spark.range(0, n * sets, 1, 8).select((F.col("id") % sets).alias("k"), (F.col("id") * 7919 + n * 1_000_003).alias("v"))
        # Two partial results are merged, so that the estimate is that of a merged sketch.
        halves = [distinct.registers(df.filter(F.col("v") % 2 == i), ["k"], {"m": F.col("v")}) for i in (0, 1)]
        found = distinct.estimate(distinct.merge(halves[0].unionByName(halves[1]), ["k"], ["m"]), ["k"], ["m"]).collect()
        assert len(found) == sets
        off = [r.n_distinct / n - 1 for r in found]
        rmse = math.sqrt(sum(x * x for x in off) / sets)
        assert rmse <= 1.1 * distinct.standard_error(), (n, rmse)
        assert abs(sum(off) / sets) <= 0.3 * distinct.standard_error(), n


def test_small_counts_are_exact_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("a", None), ("b", None), (None, "")], "k string, v string")
    parts = distinct.registers(df, ["k"], {"m": F.col("v"), "pair": F.struct("k", "v")})
    got = {(r.k, r.measure): r.n_distinct for r in distinct.estimate(parts, ["k"], ["m", "pair"]).collect()}
    assert got == {("a", "m"): 2, ("a", "pair"): 3, ("b", "pair"): 1, (None, "m"): 1, (None, "pair"): 1}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "day string, grp string, site string, v string")
    parts = distinct.registers(empty, KEYS, {"m": F.col("v")})
    assert parts.count() == 0
    assert distinct.distinct_by_combination(parts, KEYS, ["m"]).collect() == []
    assert distinct.estimate(distinct.registers(empty, [], {"m": F.col("v")}), [], ["m"]).collect() == []


def test_reserved_names(spark):
    df = spark.createDataFrame([("a",)], "measure string")
    with pytest.raises(ValueError):
        distinct.registers(df, ["measure"], {"v": F.col("measure")})
    with pytest.raises(ValueError):
        distinct.registers(df.toDF("k"), ["k"], {"k": F.col("k")})
