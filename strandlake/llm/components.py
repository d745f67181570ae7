"""Groups from pairwise matches, by randomised contraction of the graph.

In each round every vertex hooks to the first of itself and its neighbours in a fresh
hash order; edges are relabelled and deduplicated, and what became a loop is dropped.  A
constant share of the vertices goes in each round, so the rounds grow with the logarithm
of the input.  The mappings of the rounds are expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.skew import LEAST_ROWS, join_unique
from strandlake.session import stage, unstage


def fresh_key(c: Column | str, seed: int) -> Column:
    """A bijection of bigint that orders its values anew for each seed (a Feistel network)."""
    c = F.col(c) if isinstance(c, str) else c
    left = F.shiftright(c, 32).cast("int")
    right = F.shiftright(F.shiftleft(c, 32), 32).cast("int")
    for turn in range(4):
        left, right = right, left.bitwiseXOR(F.hash(right, F.lit(seed * 4 + turn)))
    return F.shiftleft(left.cast("bigint"), 32).bitwiseOR(right.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def _hook(edges: DataFrame, seed: int) -> DataFrame:
    """``v`` and ``w``, its new name: the least key of the vertex and its neighbours."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x"))
    nearest = ends.groupBy("x.v").agg(F.min(fresh_key("x.u", seed)).alias("w"))
    return nearest.select("v", F.least("w", fresh_key("v", seed)).alias("w"))


def _relabel(edges: DataFrame, names: DataFrame, many: int) -> DataFrame:
    """Edges between the new names, each once, without loops."""
    half = join_unique(edges, names.withColumnsRenamed({"v": "a", "w": "x"}), ["a"], rows=many).select("x", "b")
    if many >= LEAST_ROWS:  # as the second join looks for hot keys of its own
        half = stage(half, "half-relabelled")
    whole = join_unique(half, names.withColumnsRenamed({"v": "b", "w": "y"}), ["b"], rows=many)
    out = stage(whole.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    unstage(half)
    return out


def groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row for each value that some pair links: ``value`` and ``group_value``.

    ``group_value`` is the least value linked with it directly or indirectly, itself
    included.  Pairs with a null side or with two equal sides link nothing; repeated and
    reversed pairs count once; an empty table gives an empty result; other columns are
    not read.  Values are compared exactly: their 64-bit names are checked to be
    distinct, and chosen anew if they are not.
    """
    pairs = pairs.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).filter("l != r")
    seed = 0
    while True:
        name = lambda c, seed=seed: F.xxhash64(c, F.lit(seed))
        values = stage(pairs.select(F.explode(F.array("l", "r")).alias("value")).distinct().withColumn("v", name("value")), "vertices")
        if values.groupBy("v").count().filter("count > 1").isEmpty():
            break
        unstage(values)
        seed += 1
    a, b = name(F.col("l")), name(F.col("r"))
    edges = stage(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    names: list[DataFrame] = []
    while many := edges.count():  # the numbers of rows stand in the written files
        names.append(stage(_hook(edges, len(names) + 1), "names"))
        left_over = _relabel(edges, names[-1], many)
        unstage(edges)
        edges = left_over
    unstage(edges)
    if not names:
        return values.select("value", F.col("value").alias("group_value"))
    # A group is named by the round that finished it and its name in that round.
    label = names[-1].withColumn("round", F.lit(len(names)))
    used = [names[-1]]
    for at in range(len(names) - 2, -1, -1):
        later = label.select(F.col("v").alias("w"), F.col("w").alias("later"), F.col("round").alias("later_round"))
        label = join_unique(names[at], later, ["w"], "left").select(
            "v", F.coalesce("later", "w").alias("w"), F.coalesce("later_round", F.lit(at + 1)).alias("round")
        )
        label = stage(label, "labels")
        for df in (names[at], *used):
            unstage(df)
        used = [label]
    named = stage(values.join(label, "v").select("value", "round", "w"), "named")
    for df in (values, *used):
        unstage(df)
    least = named.groupBy("round", "w").agg(F.min("value").alias("group_value"))
    return join_unique(named, least, ["round", "w"]).select("value", "group_value")
