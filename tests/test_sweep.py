"""Periods and gaps against a plain sweep, whatever the partitions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlake.operators import sweep


def plain(rows):
    groups = {}
    for key, a, b in rows:
        if a is not None and b is not None and a != b:
            groups.setdefault(key, []).append((min(a, b), max(a, b)))
    out = set()
    for key, spans in groups.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def found(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint")
    if extra:
        df = df.selectExpr("*", *extra.split(";"))
    return {tuple(r) for r in sweep.periods_and_gaps(df, ["k"], "a", "b").collect()}


def test_hot_key_runs_over_all_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", s := rng.randrange(5000), s + rng.randrange(-9, 9)) for _ in range(3000)]
    rows += rows[:200]  # repeated rows
    assert found(spark, rows) == plain(rows)


def test_one_long_period_spans_every_partition(spark):
    rows = [("a", 0, 10_000)] + [("a", i, i + 2) for i in range(0, 9000, 3)]
    assert found(spark, rows) == {("a", "period", 0, 10_000)}


def test_touching_nested_and_reversed(spark):
    rows = [("a", 0, 10), ("a", 10, 12), ("a", 20, 13), ("a", 14, 15), ("a", 5, 5), ("b", 1, None), (None, 3, 4), (None, 8, 9)]
    expected = {("a", "period", 0, 12), ("a", "period", 13, 20), ("a", "gap", 12, 13), (None, "period", 3, 4), (None, "period", 8, 9), (None, "gap", 4, 8)}
    assert found(spark, rows) == expected


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", 1, 2)], "1 AS pos;2 AS delta;3 AS kind;'x' AS start_pos") == {("a", "period", 1, 2)}


def test_keys_may_not_be_named_as_results(spark):
    df = spark.createDataFrame([("a", 1, 2)], "kind string, a bigint, b bigint")
    with pytest.raises(ValueError):
        sweep.periods_and_gaps(df, ["kind"], "a", "b")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_any_intervals(spark, rows):
    assert found(spark, rows) == plain(rows)
