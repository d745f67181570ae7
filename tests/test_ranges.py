"""Range-partitioned operators against plain loops, with few partitions' worth of boundaries forced by many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import intervals, ranges, sweep


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows_of(seed, n=400, hot=0.7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        s = rng.randrange(3000)
        out.append((i, key, s, s + rng.choice([0, 1, 5, 30])))
    return out + [(n, "hot", None, 4), (n + 1, "hot", 4, None), (n + 2, "hot", 10, 20), (n + 3, "hot", 10, 20)]


def plain_islands(rows, touching):
    out, by = {}, {}
    for i, k, s, e in rows:
        if s is None or e is None:
            out[i] = None
        else:
            by.setdefault(k, []).append((s, e, i))
    for intervals_of in by.values():
        number, reach = 0, None
        for s, e, i in sorted(intervals_of):
            low, high = (2 * s, 2 * e + 1) if touching else (2 * s + 1, max(2 * e, 2 * s + 2))
            if reach is None or low > reach:
                number += 1
                reach = high
            reach = max(reach, high)
            out[i] = number
    return out


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_islands(spark, touching, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint")
    got = {r.i: r.island for r in intervals.islands(df, ["k"], touching=touching, bin_size=50).collect()}
    assert got == plain_islands(rows, touching)
    assert intervals.islands(df.limit(0), ["k"]).count() == 0


def test_islands_without_a_window_by_key(spark):
    df = spark.createDataFrame(rows_of(3), "i int, k string, s bigint, e bigint")
    plan = intervals.islands(df, ["k"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_hot_bins_by_broadcast(spark, monkeypatch):
    from strandlake.operators import skew

    monkeypatch.setattr(skew.join_unique_rows, "__defaults__", (1,))
    rows = rows_of(4) + [(1000 + i, "hot", 7, 8) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint")
    assert {r.i: r.island for r in intervals.islands(df, ["k"]).collect()} == plain_islands(rows, True)


def test_segments(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint")
    got = {tuple(r) for r in intervals.elementary_segments(df, ["k"]).collect()}
    want = set()
    for key in {r[1] for r in rows}:
        own = [(s, e) for _, k, s, e in rows if k == key and s is not None and e is not None and s < e]
        cuts = sorted({x for r in own for x in r})
        for lo, hi in zip(cuts, cuts[1:]):
            if depth := sum(s <= lo < e for s, e in own):
                want.add((key, lo, hi, depth))
    assert got == want
    assert intervals.elementary_segments(df.limit(0), ["k"]).count() == 0


def test_period_numbers(spark):
    rows = rows_of(6)
    df = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint")
    found = sweep.periods_and_gaps(df, ["k"], "s", "e", number="no").collect()
    for key in {r.k for r in found}:
        periods = sorted((r.start_pos, r.no) for r in found if r.k == key and r.kind == "period")
        assert [no for _, no in periods] == list(range(1, len(periods) + 1))
        gaps = sorted((r.start_pos, r.no) for r in found if r.k == key and r.kind == "gap")
        assert [no for _, no in gaps] == list(range(1, len(periods)))


def test_covered_length(spark):
    rows = rows_of(7)
    df = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint")
    want = {}
    for _, k, s, e in rows:
        if s is not None and e is not None and s < e:
            want.setdefault(k, set()).update(range(s, e))
    for small in (True, False):
        assert {r.k: r.covered for r in intervals.covered_length(df, ["k"], small_keys=small).collect()} == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("keys", [["k"], []])
def test_prefix_sums(spark, keys):
    rows = [(k, i, random.Random(i).randrange(5)) for i, (_, k, _, _) in enumerate(rows_of(8))]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {r.i: r.before for r in ranges.prefix_sums(df, keys, ["i"], "v", "before").collect()}
    assert got == {i: sum(v for k2, j, v in rows if j < i and (not keys or k2 == k)) for k, i, _ in rows}
    assert ranges.prefix_sums(df.limit(0), keys, ["i"], "v", "before").count() == 0


def test_more_ranges_for_larger_inputs(spark, tmp_path, monkeypatch):
    spark.range(200_000).select(F.rand().alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert ranges.range_count(df) == 7
    monkeypatch.setattr(ranges, "RANGE_BYTES", 100_000)
    assert 10 <= ranges.range_count(df) <= 40


def test_results_may_be_united(spark):
    """The partitions of a united result have other numbers than those the states were taken from."""
    rows = rows_of(9)
    df = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint")
    made = {
        "periods": lambda: sweep.periods_and_gaps(df, ["k"], "s", "e", number="no"),
        "segments": lambda: intervals.elementary_segments(df, ["k"]),
        "sums": lambda: ranges.prefix_sums(df.select("k", "i", F.col("i").cast("bigint").alias("v")), ["k"], ["i"], "v", "before"),
    }
    for name, make in made.items():
        one = sorted(map(tuple, make().collect()), key=str)
        assert sorted(map(tuple, make().unionByName(make()).collect()), key=str) == sorted(one + one, key=str), name
