"""From alignments to unique isoforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.alignment import is_unmapped
from strandlake.operators import compare
from strandlake.operators.grouped import keep_in_groups, map_groups
from strandlake.operators.intervals import islands
from strandlake.operators.ranges import number_rows
from strandlake.session import prepare, stage

EXONS = "array<struct<start:bigint,end:bigint>>"


def with_reason(alignments: DataFrame, min_coverage: float = 0.99, min_identity: float = 0.95, exons: str | None = None) -> DataFrame:
    """Add ``reason``, why an alignment is ignored; null if it is kept.  The first reason counts:
    unmapped, low coverage, low identity, an empty exon.  Unknown coverage or identity is low."""
    low = lambda c, least: F.col(c).isNull() | (F.col(c) < least)
    reason = (
        F.when(is_unmapped("flag"), "unmapped")
        .when(low("q_coverage", min_coverage), "coverage")
        .when(low("identity", min_identity), "identity")
    )
    if exons:
        reason = reason.when(F.exists(exons, lambda x: x["end"] <= x["start"]), "empty exon")
    return alignments.withColumn("reason", reason)


def quality_alignments(alignments: DataFrame, **limits) -> DataFrame:
    return with_reason(alignments, **limits).filter("reason is null").drop("reason")


def ignored_alignments(alignments: DataFrame, **limits) -> DataFrame:
    return with_reason(alignments, **limits).filter("reason is not null")


def transcripts(exons: DataFrame, key: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """One row for each transcript from one for each exon: key, ``exons`` (ascending), ``start``, ``end``, ``n_exons``.

    A transcript's exons are few by nature; nulls and empty exons are left out.
    """
    rows = exons.filter(F.col(start) < F.col(end))
    array = F.array_sort(F.collect_list(F.struct(F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))))
    out = rows.groupBy(*key).agg(array.alias("exons"))
    return out.withColumns({"start": F.col("exons")[0]["start"], "end": F.element_at("exons", -1)["end"], "n_exons": F.size("exons")})


def gene_clusters(records: DataFrame, keys: Sequence[str] = ("chr",), strand: str = "strand", start: str = "start", end: str = "end") -> DataFrame:
    """Number loci by overlap, first on both strands together and then within each strand: ``island``, ``gene``."""
    joint = stage(islands(records, keys, start, end), "loci")  # as the second step reads it twice
    return islands(joint, [*keys, "island", strand], start, end, island="gene")


def exon_segments_of(transcript_exons: DataFrame, segments: DataFrame, keys: Sequence[str], transcript: str) -> DataFrame:
    """The elementary segments each transcript covers, as ``segment_path`` (starts in order).

    Segments split at every exon end, so a segment belongs to an exon if it starts in it.
    """
    from strandlake.operators.intervals import overlap_join

    met = overlap_join(transcript_exons, segments, keys, ("s", "e"), ("seg_start", "seg_end"))
    return met.groupBy(*keys, transcript).agg(F.array_join(F.array_sort(F.collect_set("seg_start")), ",").alias("segment_path"))


def _adjacent(path: Sequence[int], segments: list[tuple[int, int]]) -> bool:
    return all(segments[x][1] == segments[y][0] for x, y in zip(path, path[1:]))


def mergeable(a: list[int], b: list[int], segments: list[tuple[int, int]], strand: str, merge_5: bool, max_5_diff: int, max_3_diff: int) -> bool:
    """Whether two segment paths differ by allowed extensions at their outer ends only.

    The 3' end may be longer within its exon by ``max_3_diff``; the 5' end too by ``max_5_diff``,
    or by anything, further exons included, with ``merge_5``.
    """
    if b[0] < a[0]:
        a, b = b, a
    if b[0] not in a:
        return False
    lead = a.index(b[0])
    shared = min(len(a) - lead, len(b))
    if a[lead : lead + shared] != b[:shared]:
        return False

    def allowed(extra: list[int], five_prime: bool) -> bool:
        if len(extra) < 2 or five_prime and merge_5:
            return True
        limit = max_5_diff if five_prime else max_3_diff
        return _adjacent(extra, segments) and sum(segments[x][1] - segments[x][0] for x in extra[1:]) <= limit

    # Each extension begins with the shared segment that it continues.
    before = a[lead::-1]
    longer = a[lead + shared - 1 :] if len(a) - lead > shared else b[shared - 1 :]
    before_ok = len(before) < 2 or strand == "+" and merge_5
    if not before_ok:
        limit = max_5_diff if strand == "+" else max_3_diff
        before_ok = _adjacent(before[::-1], segments) and segments[before[0]][0] - segments[before[-1]][0] <= limit
    return before_ok and allowed(longer, strand == "-")


def merge_locus(rows: list[tuple[int, list[tuple[int, int]]]], strand: str, merge_5: bool, max_5_diff: int, max_3_diff: int) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Merge the structures of one locus greedily, from the left: exons and ids of each isoform.

    Structures are taken in the order of start, end and id.
    """
    ends = sorted({x for _, exons in rows for exon in exons for x in exon})
    covered = [any(s <= lo and hi <= e for _, exons in rows for s, e in exons) for lo, hi in zip(ends, ends[1:])] if len(ends) < 64 else None
    if covered is None:
        depth = dict.fromkeys(ends, 0)
        for _, exons in rows:
            for s, e in exons:
                depth[s] += 1
                depth[e] -= 1
        covered, now = [], 0
        for at in ends[:-1]:
            now += depth[at]
            covered.append(now > 0)
    segments = [(lo, hi) for lo, hi, c in zip(ends, ends[1:], covered) if c]
    first_at = {s: i for i, (s, _) in enumerate(segments)}
    last_at = {e: i for i, (_, e) in enumerate(segments)}
    queue = [
        ([i for s, e in exons for i in range(first_at[s], last_at[e] + 1)], [key])
        for key, exons in sorted(rows, key=lambda x: (x[1][0][0], x[1][-1][1], x[0]))
    ]
    # What two paths share must be equal to the end of one of them.  The paths wait in a tree by their segments, so
    # that walking down a path from one of its segments meets just those that may join it there.
    tree: dict = {}
    for at, (path, _) in enumerate(queue):
        node = tree
        for segment in path:
            node = node.setdefault(segment, {})
        node.setdefault(None, []).append(at)

    def below(node: dict) -> Iterator[int]:
        nodes = [child for segment, child in node.items() if segment is not None]
        while nodes:
            node = nodes.pop()
            yield from node.get(None, ())
            nodes += (child for segment, child in node.items() if segment is not None)

    def meeting(path: list[int], lead: int) -> Iterator[int]:
        node = tree
        for segment in path[lead:]:
            node = node.get(segment)
            if node is None:
                return
            yield from node.get(None, ())
        yield from below(node)

    taken = [False] * len(queue)
    done = []
    for at, (path, ids) in enumerate(queue):
        if taken[at]:
            continue
        taken[at], lead, passed = True, 0, at
        while lead < len(path):
            for other in sorted(x for x in meeting(path, lead) if x > passed and not taken[x]):
                passed = other
                if mergeable(path, queue[other][0], segments, strand, merge_5, max_5_diff, max_3_diff):
                    # The joined path differs from here on only, so what was passed stays as it is.
                    path, ids, taken[other] = sorted({*path, *queue[other][0]}), ids + queue[other][1], True
                    break
            else:
                lead += 1
        done.append((path, ids))
    out = []
    for path, ids in done:
        exons: list[list[int]] = []
        for s, e in (segments[i] for i in path):
            if exons and exons[-1][1] == s:
                exons[-1][1] = e
            else:
                exons.append([s, e])
        out.append(([tuple(x) for x in exons], ids))
    return out


def merge_fuzzy(rows: list[tuple[int, list[tuple[int, int]], int]], strand: str, fuzzy: int, allow_5: bool, max_5_diff: int, max_3_diff: int) -> list[tuple[int, int]]:
    """Put isoforms (number, exons, reads) into the first group whose head they match: pairs of number and the kept one.

    A group is known by its head; the isoform with the most exons, then the most reads, then
    the earliest, stands for it.
    """
    groups: list[list[tuple[int, list, int]]] = []
    # A match needs the junctions of the shorter one to agree from the 3' end on, or two single exons with near 3' ends; so few heads are compared.
    index = compare.ThreePrime(strand, fuzzy)
    single: dict[int, list[int]] = {}
    for row in rows:
        exons = row[1]
        near = index.near(exons)
        place = (exons[-1][1] if strand == "+" else exons[0][0]) // (max_3_diff + 1)
        if len(exons) == 1:
            near.update(i for p in (place - 1, place, place + 1) for i in single.get(p, ()))
        for i in sorted(near):
            head = groups[i][0][1]
            if exons[0][0] >= head[-1][1] or head[0][0] >= exons[-1][1]:
                continue
            how = compare.relation(exons, head, strand, fuzzy, max_5_diff, max_3_diff)
            long, short = (exons, head) if how == "super" else (head, exons)
            if how == "exact" or allow_5 and how in ("super", "subset") and compare.same_three_prime(long, short, strand, fuzzy):
                groups[i].append(row)
                break
        else:
            index.add(len(groups), exons)
            if len(exons) == 1:
                single.setdefault(place, []).append(len(groups))
            groups.append([row])
    out = []
    for group in groups:
        kept = max(group, key=lambda x: (len(x[1]), x[2], -x[0]))
        out += [(row[0], kept[0]) for row in group]
    return out


def collapse(
    records: DataFrame, merge_5: bool = True, max_5_diff: int = 1000, max_3_diff: int = 100, max_fuzzy: int = 5, min_reads: int = 1
) -> DataFrame:
    """Collapse transcripts (``read_id``, ``chr``, ``strand``, ``exons``) into isoforms.

    Rows: ``chr``, ``strand``, ``gene_idx``, ``isoform_idx``, ``exons``, ``n_reads`` and the
    ``read_id`` of one member each, so that no list of members is built.  Reads with equal
    exons are counted once before a locus is merged, which is done within one task per locus
    and strand: its size is the number of different structures there, not of reads.  Genes
    are numbered from 1 by chromosome, place and strand, isoforms within a gene by the
    order of merging.  Null or empty exons are left out; ties go by id; reads given twice
    count once.
    """
    prepare(records.sparkSession)
    rows = records.filter(F.size("exons") > 0).select("read_id", "chr", "strand", F.col("exons").cast(EXONS).alias("exons"))
    shape = F.xxhash64("chr", "strand", compare.exon_text("exons"))
    rows = rows.withColumn("shape", shape)
    distinct = rows.groupBy("chr", "strand", "shape").agg(F.first("exons").alias("exons"), F.countDistinct("read_id").alias("n"))
    distinct = distinct.withColumns({"start": F.col("exons")[0]["start"], "end": F.element_at("exons", -1)["end"]})
    placed = stage(gene_clusters(stage(distinct, "structures")), "placed")

    def merge(key: tuple, rows: list[tuple]) -> list[tuple]:
        strand = key[2]
        reads_of = {shape: n for shape, _, n in rows}
        found = merge_locus([(shape, compare.as_exons(x)) for shape, x, _ in rows], strand, merge_5, max_5_diff, max_3_diff)
        isoforms = [(i, exons, sum(reads_of[s] for s in ids), ids) for i, (exons, ids) in enumerate(found, 1)]
        kept_as = dict(merge_fuzzy([x[:3] for x in isoforms], strand, max_fuzzy, merge_5, max_5_diff, max_3_diff))
        exons_of = {x[0]: [{"start": s, "end": e} for s, e in x[1]] for x in isoforms}
        reads: dict[int, int] = {}
        for i, _, n, _ in isoforms:
            reads[kept_as[i]] = reads.get(kept_as[i], 0) + n
        return [(*key, s, kept_as[i], exons_of[kept_as[i]], reads[kept_as[i]]) for i, _, _, ids in isoforms for s in ids]

    key = ["chr", "island", "strand", "gene"]
    schema = f"chr string, island bigint, strand string, gene bigint, shape bigint, isoform_idx bigint, exons {EXONS}, n_reads bigint"
    merged = map_groups(placed.select(*key, "shape", compare.flat("exons").alias("exons"), "n"), key, merge, schema, parts=int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    genes = placed.groupBy("chr", "island", "strand", "gene").agg(F.min("start").alias("_at"))
    numbered = number_rows(genes, ["chr", "_at", "strand", "island", "gene"], "gene_idx").drop("_at")
    named = merged.join(numbered, ["chr", "island", "strand", "gene"]).filter(F.col("n_reads") >= min_reads)
    return named.join(rows.select("shape", "read_id").distinct(), "shape").select("chr", "strand", "gene_idx", "isoform_idx", "exons", "n_reads", "read_id")


def isoforms_of(collapsed: DataFrame) -> DataFrame:
    """One row for each isoform: ``pbid`` (PB.i.j), its place, exons and number of reads."""
    key = ["chr", "strand", "gene_idx", "isoform_idx"]
    return collapsed.groupBy(*key).agg(F.first("exons").alias("exons"), F.first("n_reads").alias("n_reads")).withColumn(
        "pbid", F.concat(F.lit("PB."), "gene_idx", F.lit("."), "isoform_idx")
    )


def members_of(collapsed: DataFrame) -> DataFrame:
    """``pbid`` and ``member`` for each read."""
    return collapsed.select(F.concat(F.lit("PB."), "gene_idx", F.lit("."), "isoform_idx").alias("pbid"), F.col("read_id").alias("member"))


def representative(members: DataFrame, key: str, length: str, error: str | None = None, read: str = "read_id") -> DataFrame:
    """The read that stands for each group: the longest, or with ``error`` the one of least expected error; ties to the largest id."""
    best = F.struct(F.col(length) if error is None else -F.col(error), F.col(read))
    return members.groupBy(key).agg(F.max_by(read, best).alias("representative"))


def collapse_outputs(alignments: DataFrame, reads: DataFrame, limits: dict | None = None, error: str | None = None, min_reads: int = 1, **options) -> dict[str, DataFrame]:
    """The whole collapsing of alignments: ``isoforms``, ``members``, ``representatives``, ``bad`` and ``ignored``.

    ``alignments``: ``read_id``, ``chr``, ``strand``, ``exons``, ``flag``, ``q_coverage``, ``identity``; ``reads``: ``read_id``, ``seq``
    and, if it is named, the column ``error`` with the expected errors of the read.  ``limits`` go to ``with_reason``,
    ``options`` to ``collapse``.  Isoforms of fewer than ``min_reads`` reads are in ``bad`` only, with their members' number.
    """
    checked = with_reason(alignments, exons="exons", **(limits or {}))
    collapsed = stage(collapse(checked.filter("reason is null"), **options), "collapsed")
    enough = F.col("n_reads") >= min_reads
    good = collapsed.filter(enough)
    columns = ["read_id", F.length("seq").alias("_length")] + ([F.col(error).alias("_error")] if error else [])
    known = members_of(good).withColumnRenamed("member", "read_id").join(reads.select(*columns), "read_id")
    chosen = representative(known, "pbid", "_length", "_error" if error else None)
    return {
        "isoforms": isoforms_of(good),
        "members": members_of(good),
        "representatives": chosen.join(reads.select(F.col("read_id").alias("representative"), "seq"), "representative").select("pbid", "representative", "seq"),
        "bad": isoforms_of(collapsed.filter(~enough)),
        "ignored": checked.filter("reason is not null").select("read_id", "reason"),
    }


def transcript_stats(records: DataFrame, key: str) -> DataFrame:
    """Exonic length, genomic span and number of exons of each transcript."""
    exonic = F.aggregate("exons", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    span = F.element_at("exons", -1)["end"] - F.col("exons")[0]["start"]
    return records.filter(F.size("exons") > 0).select(key, exonic.alias("exonic_length"), span.alias("span"), F.size("exons").cast("bigint").alias("n_exons"))


def exon_stats(exons: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """Size of each exon and of the intron before it (null before the first): key, ``exon_no``, ``exon_size``, ``intron_size``."""
    order = Window.partitionBy(key).orderBy(start, end)
    return exons.select(
        key, F.row_number().over(order).cast("bigint").alias("exon_no"), (F.col(end) - F.col(start)).alias("exon_size"), (F.col(start) - F.lag(end).over(order)).alias("intron_size")
    )


def multi_exon(records: DataFrame) -> DataFrame:
    return records.filter(F.size("exons") > 1)


def _without_subsets(exons: list[list[tuple[int, int]]], strand: str, fuzzy: int) -> list[int]:
    """The places of the structures that stay, of a gene's in their order."""
    import numpy as np

    n, gone = len(exons), set()
    index = compare.ThreePrime(strand, fuzzy)
    for i, x in enumerate(exons):
        if len(x) > 1:
            index.add(i, x)
    start, end = np.array([x[0][0] for x in exons]), np.array([x[-1][1] for x in exons])
    inner = np.array([x[-1][0] if strand == "+" else x[0][1] for x in exons])
    alone = np.array([len(x) == 1 for x in exons])
    # A single exon is a copy of those whose last exon it begins in, which it must overlap.
    singles, others = np.flatnonzero(alone), np.flatnonzero(~alone)

    def of_single(i: int) -> list[int]:
        fits = inner[others] - start[i] <= fuzzy if strand == "+" else end[i] - inner[others] <= fuzzy
        return others[fits & (others > i) & (start[others] < end[i]) & (end[others] > start[i])].tolist()

    def of_several(i: int) -> list[int]:
        fits = inner[i] - start[singles] <= fuzzy if strand == "+" else end[singles] - inner[i] <= fuzzy
        near = {j for j in index.near(exons[i]) if j > i and len(exons[j]) != len(exons[i])}
        near.update(singles[fits & (singles > i) & (start[singles] < end[i]) & (end[singles] > start[i])].tolist())
        return sorted(near)

    for i, x in enumerate(exons):
        if i in gone:
            continue
        for j in of_single(i) if len(x) == 1 else of_several(i):
            if j in gone:
                continue
            # Only one with more exons is ``super``.
            long, short, lost = (x, exons[j], j) if len(x) > len(exons[j]) else (exons[j], x, i)
            if compare.is_degraded(long, short, strand, fuzzy) and compare.relation(x, exons[j], strand, fuzzy) == ("super" if lost == j else "subset"):
                gone.add(lost)
                if lost == i:
                    break
    return [i for i in range(n) if i not in gone]


def without_subsets(records: DataFrame, gene: str = "gene", key: str = "pbid", fuzzy: int = 5) -> DataFrame:
    """Drop isoforms that are 5'-degraded copies of a longer one of their gene.

    Pairs of a gene and strand are taken in the order of start, end and id, and a dropped isoform
    drops no other.  A gene's isoforms are compared within one task: those of several exons only
    with others whose junctions agree from the 3' end on, single exons with those whose 3' exon they begin
    in.  Null or empty exons are left out; a null gene is a gene of its own.
    """
    rows = records.filter(F.size("exons") > 0).withColumn("__flat", compare.flat("exons"))
    order = [F.col("exons")[0]["start"], F.element_at("exons", -1)["end"], F.asc_nulls_last(key)]
    return keep_in_groups(rows, [gene, "strand"], order, ["__flat"], lambda k, group: _without_subsets([compare.as_exons(x) for (x,) in group], k[1], fuzzy), drop=["__flat"])
