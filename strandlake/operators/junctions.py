"""Splice junctions: report, labels, choice by label and correction of transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import splice_motif
from strandlake.operators import compare
from strandlake.operators.intervals import islands, nearest
from strandlake.operators.ranges import prefix_sums
from strandlake.operators.seqtools import cut_sequences
from strandlake.session import prepare, stage


def junction_rows(records: DataFrame) -> DataFrame:
    """One row for each junction of each transcript: all columns but ``exons``, and ``left``, ``right``, ``junction_no``."""
    others = [c for c in records.columns if c != "exons"]
    rows = records.select(*others, F.posexplode(compare.junctions("exons")).alias("junction_no", "_j"))
    return rows.select(*others, F.col("_j.donor").alias("left"), F.col("_j.acceptor").alias("right"), (F.col("junction_no") + 1).cast("bigint").alias("junction_no"))


def junction_report(records: DataFrame, sample: str = "sample") -> DataFrame:
    """Transcripts and samples that have each junction: ``chr``, ``left``, ``right``, ``strand``, ``num_transcript``, ``num_sample``."""
    return junction_rows(records).groupBy("chr", "left", "right", "strand").agg(F.count("*").alias("num_transcript"), F.countDistinct(sample).alias("num_sample"))


def with_motif(report: DataFrame, genome: DataFrame) -> DataFrame:
    """Add ``genome``, the donor and acceptor bases such as ``GT-AG``; null where the bases are not known.

    ``genome``: ``chr`` and ``sequence``, or windows of it (``seqtools.sequence_windows``).
    """
    columns = [c for c in report.columns if c != "genome"]
    rows = report.select(*columns, (F.col("left") + 1).alias("_a"), (F.col("left") + 3).alias("_b"), (F.col("right") - 2).alias("_c"), F.col("right").alias("_d"))
    rows = cut_sequences(rows, genome, "_a", "_b").withColumnRenamed("piece", "_donor")
    rows = cut_sequences(rows, genome, "_c", "_d")
    return rows.select(*columns, splice_motif("_donor", "piece", "strand").alias("genome"))


def with_annotation(report: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``annotation``: Y if exactly this junction is known, else N."""
    key = ["chr", "strand", "left", "right"]
    marks = known.select(*key).distinct().withColumn("annotation", F.lit("Y"))
    return report.join(marks, key, "left").fillna("N", ["annotation"])


def labelled(report: DataFrame, radius: int = 3) -> DataFrame:
    """Add ``label``, ``<chr>_<strand>_<n>``, of junctions whose ends both lie near each other.

    In the order of (left, right) a junction joins the first open cluster whose first
    member lies within ``radius`` at both ends, else it opens the next one.  Clusters whose
    first member lies further back than ``radius`` are closed, so only a few are open at a
    time.  The clusters of a chromosome and strand are numbered from 0.  This stands for a
    clustering that depends on the order of insertion; the README says how they differ.
    """
    prepare(report.sparkSession)
    key = ["chr", "strand"]
    rows = report.select(*key, "left", "right").dropna().distinct().withColumn("_reach", F.col("left") + radius)
    # A gap wider than the radius ends all open clusters, so stretches between gaps are independent.
    stretches = islands(stage(rows, "junctions"), key, "left", "_reach", island="_stretch")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["_stretch", "left", "right"])
        heads: list[tuple[int, int]] = []
        stretch, oldest, number = None, 0, []
        for now, left, right in zip(pdf["_stretch"].tolist(), pdf["left"].tolist(), pdf["right"].tolist()):
            if now != stretch:
                stretch, heads, oldest = now, [], 0
            while oldest < len(heads) and left - heads[oldest][0] > radius:
                oldest += 1
            at = next((i for i in range(oldest, len(heads)) if abs(right - heads[i][1]) <= radius), None)
            if at is None:
                heads.append((left, right))
                at = len(heads) - 1
            number.append(at)
        return pd.DataFrame({c: pdf[c].tolist() for c in (*key, "left", "right", "_stretch")} | {"_within": number})

    schema = "chr string, strand string, left bigint, right bigint, _stretch bigint, _within bigint"
    some = stretches.select(*key, "left", "right", "_stretch", F.floor(F.col("_stretch") / 256).alias("_some"))
    found = stage(some.groupBy(*key, "_some").applyInPandas(run, schema), "labels")
    heads = found.groupBy(*key, "_stretch").agg((F.max("_within") + 1).alias("_n"))
    numbered = found.join(prefix_sums(heads, key, ["_stretch"], "_n", "_before").drop("_n"), [*key, "_stretch"])
    label = F.concat_ws("_", "chr", "strand", (F.col("_before") + F.col("_within")).cast("string")).alias("label")
    return report.join(numbered.select(*key, "left", "right", label), [*key, "left", "right"])


def scrub_by_label(report: DataFrame, min_sample: int = 1, min_transcript: int = 2, accept_canonical: bool = True, by: Sequence[str] = ("label",)) -> DataFrame:
    """The junctions to keep of each label: a single one always, else those with enough samples and
    transcripts or with a canonical motif; if none passes, the one with most transcripts (ties: lowest ends)."""
    passes = (F.col("num_sample") >= min_sample) & (F.col("num_transcript") >= min_transcript)
    if accept_canonical:
        passes = passes | F.col("genome").eqNullSafe("GT-AG")
    group = Window.partitionBy(*by)
    first = group.orderBy(F.desc("num_transcript"), "left", "right")
    marked = report.withColumns({"_pass": F.coalesce(passes, F.lit(False)), "_n": F.count("*").over(group)})
    marked = marked.withColumns({"_any": F.max("_pass").over(group), "_first": F.row_number().over(first)})
    return marked.filter((F.col("_n") == 1) | F.col("_pass") | (~F.col("_any") & (F.col("_first") == 1))).drop("_pass", "_n", "_any", "_first")


def scrub_transcripts(records: DataFrame, kept: DataFrame, key: str = "pbid", max_diff: int = 20) -> DataFrame:
    """Replace every junction of a transcript by the nearest kept one; a transcript with a junction
    that has none stays as it is.  Gives all rows of ``records`` with ``exons`` and ``scrubbed``."""
    rows = junction_rows(records.select(key, "chr", "strand", "exons"))
    choice = kept.select("chr", "strand", F.col("left").alias("new_left"), F.col("right").alias("new_right")).distinct()
    matched = nearest(rows, choice, ["chr", "strand"], ("left", "right"), ("new_left", "new_right"), max_diff, [key, "junction_no"])
    arrays = matched.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("junction_no", "new_left", "new_right"))).alias("_j"))
    joined = records.join(arrays, key, "left")
    complete = (F.size("exons") > 1) & (F.coalesce(F.size("_j"), F.lit(0)) == F.size("exons") - 1)
    starts = F.concat(F.array(F.col("exons")[0]["start"]), F.transform("_j", lambda x: x["new_right"]))
    ends = F.concat(F.transform("_j", lambda x: x["new_left"] + 1), F.array(F.element_at("exons", -1)["end"]))
    rebuilt = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return joined.withColumns({"exons": F.when(complete, rebuilt).otherwise(F.col("exons")), "scrubbed": complete}).drop("_j")


def merge_equal(records: DataFrame, counts: Sequence[str] = ("count_fl",), key: str = "pbid", members: str | None = None) -> DataFrame:
    """Merge transcripts with equal junctions, single exons with equal exons: the longest stands for all.

    Rows: ``chr``, ``strand``, key and ``exons`` of the longest (ties: least key), sums of
    ``counts`` and ``n_merged``.  ``members``, an array column, is put together and sorted.
    """
    multi = F.size("exons") > 1
    shape = F.when(multi, F.to_json(compare.junctions("exons"))).otherwise(compare.exon_text("exons"))
    span = F.element_at("exons", -1)["end"] - F.col("exons")[0]["start"]
    rows = records.filter(F.size("exons") > 0).withColumns({"_shape": shape, "_span": span})
    best = F.struct(-F.col("_span"), F.col(key))
    joined = [] if members is None else [F.array_sort(F.array_distinct(F.flatten(F.collect_list(members)))).alias(members)]
    return rows.groupBy("chr", "strand", "_shape").agg(
        F.min_by(key, best).alias(key), F.min_by("exons", best).alias("exons"), *(F.sum(c).alias(c) for c in counts), F.count("*").alias("n_merged"), *joined
    ).drop("_shape")
