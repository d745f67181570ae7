"""Abundance, demultiplexing and other counts of isoforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import shade_index
from strandlake.session import stage

#: Rows of a read status that one part of a cluster stands for.
STAT_ROWS = 1_000_000


def abundance(read_stat: DataFrame, given_total: int | None = None) -> DataFrame:
    """Full-length reads of each isoform (``pbid``, ``count_fl``) and their share ``norm_fl``.

    ``read_stat`` has ``id``, ``is_fl`` ('Y' or 'N') and ``pbid``.  Reads without an isoform don't
    count; the share is of all counted reads unless ``given_total`` says otherwise.
    """
    counts = read_stat.filter((F.col("is_fl") == "Y") & F.col("pbid").isNotNull()).groupBy("pbid").agg(F.count("*").alias("count_fl"))
    return _with_share(counts, given_total)


def _with_share(counts: DataFrame, given_total: int | None) -> DataFrame:
    if given_total is not None:
        return counts.withColumn("norm_fl", F.col("count_fl") / F.lit(given_total))
    counts = stage(counts, "counts")  # as the total and the rows are read apart
    total = counts.agg(F.sum("count_fl").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("pbid", "count_fl", (F.col("count_fl") / F.col("_total")).alias("norm_fl"))


def cluster_abundance(groups: DataFrame, clusters: DataFrame, given_total: int | None = None) -> DataFrame:
    """``abundance`` of ``read_stat(groups, clusters)`` without a row for each read and isoform.

    A read that lies in one cluster, as nearly all do, is counted with its cluster, and the
    counts of clusters are added up by isoform; only reads of several clusters are looked up one by
    one, so that a read counts once for an isoform.  Null ids match nothing.
    """
    of_cluster = groups.filter("pbid is not null and member is not null").select("pbid", F.col("member").alias("cluster_id")).distinct()
    reads = clusters.filter("read_type = 'FL' AND cluster_id is not null").groupBy("read_id").agg(F.min("cluster_id").alias("_lo"), F.max("cluster_id").alias("_hi"), F.collect_set("cluster_id").alias("_all"))
    alone = reads.filter("_lo = _hi").groupBy(F.col("_lo").alias("cluster_id")).agg(F.count("*").alias("n")).join(of_cluster, "cluster_id").select("pbid", "n")
    several = reads.filter("_lo <> _hi").select("read_id", F.explode("_all").alias("cluster_id")).join(of_cluster, "cluster_id").select("read_id", "pbid").distinct()
    counts = alone.unionByName(several.groupBy("pbid").agg(F.count("*").alias("n"))).groupBy("pbid").agg(F.sum("n").alias("count_fl"))
    return _with_share(counts, given_total)


def read_stat(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Status of each read: ``id``, ``is_fl``, ``stat`` (unique, ambiguous or unmapped) and ``pbid``.

    ``groups``: ``pbid``, ``member`` (a cluster).  ``clusters``: ``cluster_id``, ``read_id``,
    ``read_type`` (FL or NonFL).  An FL read is unique or unmapped.  Another read is unique
    with one isoform, ambiguous with several (a row each), unmapped only if it has none.

    Reads of one cluster, as nearly all are, get the rows of their cluster as they are, in tasks of about
    ``STAT_ROWS`` rows however many isoforms a cluster has; only reads of several are made distinct.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_cluster = groups.filter("member is not null").select("pbid", F.col("member").alias("cluster_id")).distinct()
    lo, hi, nulls = F.min("cluster_id").alias("_lo"), F.max("cluster_id").alias("_hi"), F.count_if(F.col("cluster_id").isNull()).alias("_nulls")
    reads = clusters.groupBy("read_id", "read_type").agg(lo, hi, nulls, F.collect_set("cluster_id").alias("_all"))
    one = F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi")) & (F.col("_nulls") == 0)

    alone = reads.filter(one).select("read_id", "read_type", F.col("_lo").alias("cluster_id"))
    sizes = of_cluster.groupBy("cluster_id").agg(F.count("*").alias("_rows"), F.count("pbid").alias("_n"))
    parts = F.least(F.lit(n), F.ceil(F.col("_reads") * F.col("_rows") / STAT_ROWS))
    parts_of = sizes.join(alone.groupBy("cluster_id").agg(F.count("*").alias("_reads")), "cluster_id").select("cluster_id", "_n", parts.alias("_parts"))
    # A cluster without isoforms has no parts; its reads are spread as they come.
    spread = F.pmod(F.xxhash64("read_id", "read_type"), F.coalesce("_parts", F.lit(n)))
    left = alone.join(parts_of, "cluster_id", "left").select("read_id", "read_type", "cluster_id", F.coalesce("_n", F.lit(0)).alias("_n"), spread.alias("_part"))
    right = of_cluster.join(parts_of, "cluster_id").select("pbid", "cluster_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    rows = left.repartition(n, "cluster_id", "_part").join(right.repartition(n, "cluster_id", "_part"), ["cluster_id", "_part"], "left").select("read_id", "read_type", "pbid", "_n")

    every = F.when(F.col("_nulls") > 0, F.concat("_all", F.array(F.lit(None)))).otherwise(F.col("_all"))
    several = reads.filter(~one).select("read_id", "read_type", F.explode(every).alias("cluster_id"))
    placed = several.join(of_cluster, "cluster_id", "left").select("read_id", "read_type", "pbid").distinct()
    rows = rows.unionByName(placed.withColumn("_n", F.count("pbid").over(Window.partitionBy("read_id", "read_type"))))

    fl = F.col("read_type") == "FL"
    rows = rows.filter(fl | F.col("pbid").isNotNull() | (F.col("_n") == 0))
    stat = F.when(F.col("pbid").isNull(), "unmapped").when(fl | (F.col("_n") == 1), "unique").otherwise("ambiguous")
    return rows.select(F.col("read_id").alias("id"), F.when(fl, "Y").otherwise("N").alias("is_fl"), stat.alias("stat"), "pbid")


def group_sizes(groups: DataFrame) -> DataFrame:
    """Members of each isoform: ``pbid``, ``n_members``."""
    return groups.groupBy("pbid").agg(F.count("member").alias("n_members"))


def demux(members: DataFrame, primers: DataFrame, names: Sequence[str]) -> DataFrame:
    """Reads of each isoform by primer: a column for each of ``names``, 0 where there are none.

    ``members``: ``pbid``, ``id``; ``primers``: ``id``, ``primer``.  Reads without a primer don't count.
    """
    joined = members.join(primers, "id")
    return joined.groupBy("pbid").agg(*(F.count(F.when(F.col("primer") == n, 1)).alias(n) for n in names))


def demux_long(members: DataFrame, primers: DataFrame) -> DataFrame:
    """As ``demux``, in long form and for any number of primers: ``pbid``, ``primer``, ``n``."""
    return members.join(primers, "id").groupBy("pbid", "primer").agg(F.count("*").alias("n"))


def demux_dense(members: DataFrame, primers: int) -> DataFrame:
    """Full-length reads of each isoform by primer number, dense from 0 to ``primers`` - 1, for older cluster ids.

    ``members``: ``pbid``, ``id``, where the id's second part between ``|`` is the primer number.
    Columns: ``pbid`` and ``primer_0`` and so on; ids without such a number don't count.
    """
    number = F.expr("try_cast(try_element_at(split(id, '[|]'), 2) as int)")
    rows = members.withColumn("_p", number)
    return rows.groupBy("pbid").agg(*(F.count(F.when(F.col("_p") == i, 1)).alias(f"primer_{i}") for i in range(primers)))


def group_read_stat(groups: DataFrame) -> DataFrame:
    """A read status table from groups alone: each distinct member of an isoform is a unique full-length read."""
    rows = groups.filter("member is not null").select(F.col("member").alias("id"), "pbid").distinct()
    return rows.select("id", F.lit("Y").alias("is_fl"), F.lit("unique").alias("stat"), "pbid")


def group_barcodes(matrix: DataFrame, key: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Sums of barcode columns by output group, in long form: key, ``grp``, ``n``."""
    sums = [F.struct(F.lit(g).alias("grp"), sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in cols), F.lit(0)).alias("n")) for g, cols in groups.items()]
    return matrix.select(key, F.explode(F.array(*sums)).alias("_x")).select(key, "_x.grp", "_x.n").groupBy(key, "grp").agg(F.sum("n").alias("n"))


def present_groups(counts: DataFrame, key: str) -> DataFrame:
    """The groups in which a key has any count, joined by commas: key, ``groups``."""
    return counts.filter("n > 0").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("groups"))


def filter_by_count(counts: DataFrame, groups: DataFrame | None = None, min_count: int = 2) -> DataFrame:
    """Isoforms with at least ``min_count`` full-length reads, and, given ``groups``, with a member
    whose id (``.../f<N>p<M>``) has that many too."""
    kept = counts.filter(F.col("count_fl") >= min_count)
    if groups is None:
        return kept
    of_member = F.regexp_extract("member", r"f([0-9]+)p[0-9]+", 1)
    best = groups.groupBy("pbid").agg(F.max(F.when(of_member != "", of_member.cast("bigint"))).alias("_best"))
    return kept.join(best.filter(F.col("_best") >= min_count).select("pbid"), "pbid", "left_semi")


def consistent_ids(isoforms: DataFrame, others: dict[str, DataFrame], key: str = "pbid") -> DataFrame:
    """Ids of ``isoforms`` that another table lacks: key, ``missing_in``; no rows if the tables agree."""
    parts = [isoforms.select(key).distinct().join(o.select(key), key, "left_anti").withColumn("missing_in", F.lit(n)) for n, o in others.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once: key, ``n``."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def cpm(counts: DataFrame, gene: str = "gene", count: str = "fl_count") -> DataFrame:
    """Counts per million, the highest of each gene, and the shade that follows; all-zero columns give no rows."""
    total = counts.agg(F.sum(count).alias("_total")).filter("_total > 0")  # one row
    rows = counts.crossJoin(F.broadcast(total)).withColumn("cpm", F.col(count) * 1e6 / F.col("_total")).drop("_total")
    highest = rows.groupBy(gene).agg(F.max("cpm").alias("gene_cpm"))
    return rows.join(highest, gene).withColumn("shade", shade_index("gene_cpm", "cpm"))


def length_stats(df: DataFrame, length: str = "length") -> DataFrame:
    """One row: ``n``, ``min_len``, ``max_len``, ``avg_len`` and the 5th and 95th percentile (linear interpolation)."""
    return df.agg(
        F.count(length).alias("n"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
        F.avg(length).alias("avg_len"),
        F.percentile(length, 0.05).alias("p5"),
        F.percentile(length, 0.95).alias("p95"),
    )


def length_histogram(df: DataFrame, length: str = "length", width: int = 1000) -> DataFrame:
    """Rows by bins of ``width``: ``bin_start``, ``n``."""
    return df.filter(F.col(length).isNotNull()).groupBy((F.floor(F.col(length) / width) * width).alias("bin_start")).agg(F.count("*").alias("n"))


def identical_sequences(df: DataFrame, sequence: str, key: str, gene: str | None = None) -> DataFrame:
    """Number groups of equal sequences (upper case) in the order of their least key, from 1 within a gene if given.

    Rows: key, ``orf_group`` (``ORFgroup_<gene>_<n>`` or ``ORFgroup_<n>``).  Null sequences are in no group.
    """
    by = [gene] if gene else []
    rows = df.filter(F.col(sequence).isNotNull()).select(key, *by, F.upper(sequence).alias("_seq")).distinct()
    first = rows.groupBy(*by, "_seq").agg(F.min(key).alias("_first"))
    if gene:
        numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy(gene).orderBy("_first", "_seq")))
    else:
        numbered = _number(first, ["_first", "_seq"], "_n")
    name = F.concat_ws("_", F.lit("ORFgroup"), *(F.col(g) for g in by), F.col("_n").cast("string"))
    return rows.join(numbered.drop("_first"), [*by, "_seq"]).select(key, name.alias("orf_group"))


def _number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows from 1 in an order, by range partitions: no task sees more than its own."""
    from strandlake.operators.ranges import number_rows

    return number_rows(df, order, name)


def multimapping(alignments: DataFrame, read: str = "read_id") -> DataFrame:
    """Alignments of each read and whether there is one only: read, ``n``, ``is_unique`` (Y or N)."""
    return alignments.groupBy(read).agg(F.count("*").alias("n")).withColumn("is_unique", F.when(F.col("n") == 1, "Y").otherwise("N"))


def locus_reads(alignments: DataFrame, keys: Sequence[str], min_reads: int = 40) -> DataFrame:
    """Loci with at least ``min_reads`` distinct reads: keys, ``n_reads``."""
    return alignments.groupBy(*keys).agg(F.countDistinct("read_id").alias("n_reads")).filter(F.col("n_reads") >= min_reads)
