"""Operators do no work that grows faster than their rows need."""

import itertools

from strandlake.operators import counts


def total(df, kind, metric):
    """Sum of a metric over the nodes of a kind in the plan that ran."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply(metric).value() if name == kind else 0
        return own + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_reads_of_one_cluster_meet_its_isoforms_without_a_shuffle_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(counts, "STAT_ROWS", 1000, raising=False)
    groups = spark.createDataFrame([(f"PB.{i}", "c") for i in range(60)] + [(None, "d"), ("PB.1", "d"), (None, "e")], "pbid string, member string")
    reads = [(f"r{i}", t, "c") for i in range(80) for t in ("FL", "NonFL")]
    odd = [("two", "FL", "c"), ("two", "FL", "d"), ("none", "NonFL", None), ("none", "FL", None), ("some", "NonFL", None), ("some", "NonFL", "d"), ("lost", "FL", "z"), ("lost", "NonFL", "e"), ("part", "NonFL", "d"), (None, None, "d"), (None, None, "d")]
    clusters = spark.createDataFrame(reads + odd, "read_id string, read_type string, cluster_id string")
    found = counts.read_stat(groups, clusters)
    every = [f"PB.{i}" for i in range(60)]
    want = {(r, "Y" if t == "FL" else "N", "unique" if t == "FL" else "ambiguous", p) for (r, t, _), p in itertools.product(reads, every)}
    want |= {("two", "Y", "unique", p) for p in every} | {("two", "Y", "unmapped", None), ("none", "N", "unmapped", None), ("none", "Y", "unmapped", None), ("some", "N", "unique", "PB.1")}
    want |= {("lost", "Y", "unmapped", None), ("lost", "N", "unmapped", None), ("part", "N", "unique", "PB.1"), (None, "N", "unique", "PB.1")}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert total(found, "ShuffleExchangeExec", "shuffleRecordsWritten") < len(rows) / 2
