"""General utilities over sequence records (``id``, ``seq``, ``qual``) and alignments."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.alignment import cigar_ops, cigar_summary, is_unmapped
from strandlake.functions.sequence import overlap_length, reverse_complement
from strandlake.operators import compare
from strandlake.operators.intervals import overlap_join
from strandlake.session import prepare


def select_by_id(records: DataFrame, ids: DataFrame, partial: bool = False, exclude: bool = False, key: str = "id") -> DataFrame:
    """Records whose id, or its part before ``|``, is listed; with ``partial`` also those whose id starts with a listed one.

    ``exclude`` turns the choice round.  Partial ids are tried by the prefixes of an id that
    have the length of some listed id, so the join stays one by equality.
    """
    listed = ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id is not null").distinct()
    keys = [F.col(key), F.substring_index(key, "|", 1)]
    if partial:
        lengths = listed.select(F.length("_id").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("_lengths"))  # one row; lengths are few
        rows = records.crossJoin(F.broadcast(lengths))
        prefixes = F.transform("_lengths", lambda n: F.substring(F.col(key), F.lit(1), n))
        rows = rows.withColumn("_keys", F.array_distinct(F.concat(F.array(*keys), prefixes))).drop("_lengths")
    else:
        rows = records.withColumn("_keys", F.array_distinct(F.array(*keys)))
    hits = rows.select(key, F.explode("_keys").alias("_id")).join(listed, "_id").select(key).distinct()
    return records.join(hits, key, "left_anti" if exclude else "left_semi")


def header_fields(headers: DataFrame, header: str = "header") -> DataFrame:
    """``fields``, a map of the ``key=value`` pairs after the id, split by semicolons."""
    rest = F.substring(F.col(header), F.instr(header, " ") + 1, F.length(header))
    return headers.withColumns({"id": F.substring_index(header, " ", 1), "fields": F.str_to_map(rest, F.lit(";"), F.lit("="))})


def high_quality(headers: DataFrame, min_fl: int = 2, min_accuracy: float = 0.99, header: str = "header", is_flnc: bool = False) -> DataFrame:
    """Records with enough full-length reads (not asked of single reads) and accuracy.  A header without a needed field is an error."""
    rows = header_fields(headers, header)

    def field(name: str):
        value = F.try_element_at("fields", F.lit(name))
        return F.coalesce(value, F.raise_error(F.concat(F.lit(f"no field {name} in "), F.col(header)))).cast("double")

    ok = field("expected_accuracy") >= min_accuracy
    return rows.filter(ok if is_flnc else ok & (field("full_length_coverage") >= min_fl))


def by_coverage(alignments: DataFrame, min_coverage: float, secondary: bool = False, supplementary: bool = False) -> DataFrame:
    """Mapped alignments whose aligned share of the read, clips included, is large enough; others than primary ones on demand."""
    s = cigar_summary("cigar")
    rows = alignments.withColumn("read_coverage", s["query_span"] / F.nullif(s["query_length"], F.lit(0)))
    keep = ~is_unmapped("flag") & (F.col("read_coverage") >= min_coverage)
    for wanted, bit in ((secondary, 256), (supplementary, 2048)):
        if not wanted:
            keep = keep & (F.col("flag").bitwiseAND(F.lit(bit)) == 0)
    return rows.filter(keep)


def random_sample(records: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` records, or all if there are fewer, without replacement: those with the lowest seeded hash of their id."""
    return records.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def number_duplicates(alignments: DataFrame, order: Sequence[str], read: str = "read_id") -> DataFrame:
    """Mapped alignments with exons; the n-th one of a read (n > 1) gets ``.dup<n>`` after its name."""
    rows = alignments.filter(~is_unmapped("flag") & ~F.exists("exons", lambda x: x["start"] >= x["end"]))
    n = F.row_number().over(Window.partitionBy(read).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col(read)).otherwise(F.concat(read, F.lit(".dup"), "_n"))).drop("_n")


def probe_hits(exons: DataFrame, probes: DataFrame, keys: Sequence[str] = ("chr",), read: str = "read_id") -> DataFrame:
    """Probes each read overlaps: read, ``n_probes`` (distinct), ``overlap_bp``, ``n_genes``; zeros without a hit.

    ``exons``: read, keys, ``s``, ``e``; ``probes``: ``probe``, ``gene``, keys, ``p_s``, ``p_e``.  Give the strand as a key if it counts.
    """
    met = overlap_join(exons.select(read, *keys, "s", "e"), probes, list(keys), ("s", "e"), ("p_s", "p_e"))
    hits = met.groupBy(read).agg(F.countDistinct("probe").alias("n_probes"), F.sum(overlap_length("s", "e", "p_s", "p_e")).alias("overlap_bp"), F.countDistinct("gene").alias("n_genes"))
    return exons.select(read).distinct().join(hits, read, "left").fillna(0, ["n_probes", "overlap_bp", "n_genes"])


def on_target_rate(hits: DataFrame) -> DataFrame:
    """One row: reads, reads with a probe, and their share."""
    return hits.agg(F.count("*").alias("n_reads"), F.count(F.when(F.col("n_probes") > 0, 1)).alias("n_on_target")).withColumn(
        "rate", F.col("n_on_target") / F.nullif(F.col("n_reads"), F.lit(0))
    )


def base_map(alignments: DataFrame, read: str = "read_id") -> DataFrame:
    """Blocks of aligned bases: read, ``chr``, ``q_from``, ``r_from``, ``n``: base q_from + k of the read lies on r_from + k."""
    rows = alignments.select(read, "chr", "s", "cigar", F.posexplode(cigar_ops("cigar")).alias("_i", "_op")).select(read, "chr", "s", "cigar", "_i", "_op.*")
    before = Window.partitionBy(read, "chr", "s", "cigar").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda *kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("n")).otherwise(0)).over(before), F.lit(0))
    placed = rows.withColumns({"q_from": moved("M", "I", "S", "=", "X"), "r_from": F.col("s") + moved("M", "D", "N", "=", "X")})
    return placed.filter(F.col("op").isin("M", "=", "X")).select(read, "chr", "q_from", "r_from", "n")


def to_reference(positions: DataFrame, blocks: DataFrame, read: str = "read_id") -> DataFrame:
    """Places of reads (read, ``q``) on the reference: adds ``chr`` and ``r``; inserted and clipped bases are left out."""
    return positions.join(blocks, read).filter((F.col("q") >= F.col("q_from")) & (F.col("q") < F.col("q_from") + F.col("n"))).select(
        *positions.columns, "chr", (F.col("r_from") + F.col("q") - F.col("q_from")).alias("r")
    )


#: Bases of one window of a reference sequence.
WINDOW = 1 << 16


def sequence_windows(genome: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows of reference sequences: ``chr``, ``window`` (from 0) and ``bases``; they begin every ``size`` bases.

    ``genome`` (``chr``, ``sequence``) has one row for each sequence; windows given already stay as they are.
    """
    if "window" in genome.columns:
        return genome
    count = F.floor((F.length("sequence") + size - 1) / size)
    rows = genome.select("chr", "sequence", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)) - 1)).alias("window"))
    return rows.select("chr", "window", F.substring("sequence", (F.col("window") * size + 1).cast("int"), F.lit(size)).alias("bases"))


def cut_sequences(spans: DataFrame, genome: DataFrame, start: str, end: str, size: int = WINDOW, whole: bool = True) -> DataFrame:
    """Add ``piece``: the bases of each span (``chr``, start, end; 0-based, half-open); null if they are not all known.
    Without ``whole`` a span that runs over the end of a sequence gives what there is.

    Each different span meets the windows of the genome that it touches by chromosome and
    window, so neither the spans of a chromosome nor its sequence come together in one task.
    All rows stay.
    """
    windows = sequence_windows(genome, size).withColumnsRenamed({"chr": "_chr", "window": "_window"})
    key = ["_of", "_from", "_to"]
    kinds = spans.select(F.col("chr").alias("_of"), F.col(start).alias("_from"), F.col(end).alias("_to")).filter("_from >= 0 AND _from < _to").distinct()
    spread = kinds.withColumn("_w", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
    met = spread.join(windows, (F.col("_of") == F.col("_chr")) & (F.col("_w") == F.col("_window")))
    first = F.greatest(F.col("_from") - F.col("_w") * size, F.lit(0))
    last = F.least(F.col("_to") - F.col("_w") * size, F.lit(size))
    part = F.struct("_w", F.substring("bases", (first + 1).cast("int"), (last - first).cast("int")).alias("b"))
    pieces = met.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["b"]), "").alias("piece"))
    if whole:
        pieces = pieces.filter(F.length("piece") == F.col("_to") - F.col("_from"))
    on = (F.col("chr") == F.col("_of")) & (F.col(start) == F.col("_from")) & (F.col(end) == F.col("_to"))
    return spans.join(pieces, on, "left").drop(*key)


def reference_sequence(records: DataFrame, genome: DataFrame) -> DataFrame:
    """Error-free sequence of each record from its exons: adds ``seq``; null where bases are not known.

    Each different structure (``chr``, ``strand``, ``exons``) is put together once.
    """
    kinds = records.select(F.col("chr").alias("_c"), F.col("exons").alias("_x")).filter(F.size("_x") > 0).distinct()
    exons = kinds.select(F.col("_c").alias("chr"), "_x", F.posexplode("_x").alias("_i", "_e")).select("chr", "_x", "_i", F.col("_e.start").alias("_s"), F.col("_e.end").alias("_t"))
    pieces = cut_sequences(exons, genome, "_s", "_t")
    array = F.array_sort(F.collect_list(F.struct("_i", "piece")))
    text = F.when(F.max(F.col("piece").isNull()), None).otherwise(F.array_join(F.transform(array, lambda x: x["piece"]), ""))
    whole = pieces.groupBy(F.col("chr").alias("_c"), "_x").agg(text.alias("_seq"))
    joined = records.join(whole, (F.col("chr") == F.col("_c")) & (F.col("exons") == F.col("_x")), "left")
    return joined.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement("_seq")).otherwise(F.col("_seq"))).drop("_c", "_x", "_seq")


def simulate_errors(records: DataFrame, sub: float, ins: float, dele: float, seed: int = 0) -> DataFrame:
    """Put seeded errors into sequences: each base is replaced, preceded by another or left out with its own chance.

    The cumulative chances are those of all three kinds.  Equal ids give equal errors.
    """
    chance = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(1 << 30)) / float(1 << 30)
    other = lambda x, i: F.element_at(F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != x), (F.pmod(F.xxhash64("id", F.lit(seed + 1), i), F.lit(3)) + 1).cast("int"))
    bases = F.filter(F.split("seq", ""), lambda x: x != "")
    made = F.transform(bases, lambda x, i: F.when(chance(i) < sub, other(x, i)).when(chance(i) < sub + ins, F.concat(other(x, i), x)).when(chance(i) < sub + ins + dele, F.lit("")).otherwise(x))
    return records.withColumn("seq", F.array_join(made, ""))


def simulate_alleles(records: DataFrame, ploidy: int, every: int = 300, seed: int = 0) -> DataFrame:
    """``ploidy`` copies of each sequence, all but the first with one SNP in each stretch of ``every`` bases: adds ``allele`` (from 0)."""
    copies = records.withColumn("allele", F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))))
    place = lambda k: k * every + F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(every))
    changed = lambda x, i: F.element_at(
        F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != x), (F.pmod(F.xxhash64("id", "allele", F.lit(seed + 1), i), F.lit(3)) + 1).cast("int")
    )
    bases = F.filter(F.split("seq", ""), lambda x: x != "")
    made = F.transform(bases, lambda x, i: F.when((F.col("allele") > 0) & (i == place(F.floor(i / every))), changed(x, i)).otherwise(x))
    return copies.withColumn("seq", F.array_join(made, ""))


def path_score(found: Sequence[tuple[int, int]], known: Sequence[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
    """Score of a record's exons against those of an annotated transcript, and the pairs (known, found) that match.

    Exons are aligned in order.  A pair that overlaps scores the share of the known exon that
    is covered; where the exons are apart, a found one that lies behind costs 2 and a known one that
    is passed over 1.  The end of the known path is free but for 1 for each exon left over.
    """
    width = len(known)
    rows = [[0.0] * (width + 1)]
    moves = [[2] * (width + 1)]
    for s, e in found:
        row, move = [0.0] * (width + 1), [1] * (width + 1)
        above = rows[-1]
        for j, (lo, hi) in enumerate(known, 1):
            both = min(e, hi) - max(s, lo)
            if both > 0:
                row[j], move[j] = above[j - 1] + both / (hi - lo), 0
            elif hi <= s:
                row[j], move[j] = above[j] - 2, 1
            else:
                row[j], move[j] = row[j - 1] - 1, 2
        rows.append(row)
        moves.append(move)
    best = max(range(width, -1, -1), key=lambda j: rows[-1][j])
    pairs, i, j = [], len(found), best
    while i and j:
        if moves[i][j] == 0:
            pairs.append((j - 1, i - 1))
        i, j = i - (moves[i][j] != 2), j - (moves[i][j] != 1)
    return rows[-1][best] - (width - best), pairs[::-1]


def exon_path_score(record: DataFrame, annotation: DataFrame, keys: Sequence[str] = ("chr",), bin_size: int = 10_000) -> DataFrame:
    """The annotated transcript that each record's exons match best: ``id``, ``transcript``, ``score``, ``n_known`` (its exons)
    and ``matched``, the pairs (known, found) of exon numbers from 0.

    ``record``: ``id``, keys, ``exons``; ``annotation``: ``transcript``, keys, ``exons``.  Transcripts with an exon in the
    span of the record are compared, by ``path_score``; only a score above 0 counts, and ties go to
    the least transcript.  Give the strand as a key if it counts.  Null or empty exons match nothing.
    """
    prepare(record.sparkSession)
    keys = list(keys)
    a = record.filter(F.size("exons") > 0).select("id", *keys, F.col("exons").alias("_x"), F.col("exons")[0]["start"].alias("_s"), F.element_at("exons", -1)["end"].alias("_e"))
    b = annotation.filter(F.size("exons") > 0).select("transcript", *keys, F.col("exons").alias("_y"), F.col("exons")[0]["start"].alias("_p"), F.element_at("exons", -1)["end"].alias("_q"))
    inside = F.exists("_y", lambda z: (z["start"] < F.col("_e")) & (F.col("_s") < z["end"]))
    pairs = overlap_join(a, b, keys, ("_s", "_e"), ("_p", "_q"), bin_size).filter(inside).select("id", "transcript", "_x", "_y")

    @F.pandas_udf("score double, known array<int>, found array<int>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y):
            score, matched = path_score(compare.as_exons(p), compare.as_exons(q))
            rows.append((score, [k for k, _ in matched], [f for _, f in matched]))
        return pd.DataFrame(rows, columns=["score", "known", "found"])

    scored = pairs.select("id", "transcript", F.size("_y").alias("n_known"), run(compare.flat("_x"), compare.flat("_y")).alias("_r"))
    scored = scored.select("id", "transcript", "n_known", "_r.score", F.arrays_zip("_r.known", "_r.found").alias("matched")).filter("score > 0")
    # The best score, and of equal ones the least transcript.
    top = scored.groupBy("id").agg(F.max("score").alias("score"))
    best = scored.join(top, ["id", "score"]).groupBy("id").agg(F.min_by(F.struct("transcript", "score", "n_known", "matched"), "transcript").alias("_b"))
    return best.select("id", "_b.*")


def evaluate_mapping(record: DataFrame, annotation: DataFrame, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """How each record recovers the annotated transcript that it matches best: ``id``, ``transcript``, ``category``, ``boundary``.

    ``full``: every known exon is matched; ``fused``: so too, but the record begins with exons before the
    first match; ``5missX`` and ``3missX``, joined by a semicolon: X known exons are missing at that end of
    the strand; ``skipped``: inner ones are missing; ``bad``: no transcript.  ``boundary`` has for each match
    the differences of start and end.  Both tables have ``exons``, ``record`` has ``id`` and ``strand``.
    """
    best = exon_path_score(record, annotation, keys)
    rows = record.select("id", "strand", F.col("exons").alias("_f")).join(best, "id", "left").join(annotation.select("transcript", F.col("exons").alias("_k")), "transcript", "left")
    first, last = F.col("matched")[0], F.element_at("matched", -1)
    left, right = first["known"], F.col("n_known") - 1 - last["known"]
    plus = F.col("strand") == "+"
    ends = [
        F.when(left > 0, F.concat(F.when(plus, "5miss").otherwise("3miss"), left.cast("string"))),
        F.when(right > 0, F.concat(F.when(plus, "3miss").otherwise("5miss"), right.cast("string"))),
    ]
    missing = F.concat_ws(";", *ends)
    category = (
        F.when(F.col("transcript").isNull(), "bad")
        .when(F.size("matched") == F.col("n_known"), F.when(first["found"] == 0, "full").otherwise("fused"))
        .when(missing == "", "skipped")
        .otherwise(missing)
    )
    known, found = (lambda x: F.element_at("_k", x["known"] + 1)), (lambda x: F.element_at("_f", x["found"] + 1))
    boundary = F.transform("matched", lambda x: F.struct((found(x)["start"] - known(x)["start"]).alias("head"), (found(x)["end"] - known(x)["end"]).alias("tail")))
    return rows.select("id", "transcript", category.alias("category"), boundary.alias("boundary"))


def exon_coverage(exons: DataFrame) -> DataFrame:
    """How many transcripts have each exon: ``chr``, ``strand``, ``s``, ``e``, ``n``."""
    return exons.groupBy("chr", "strand", "s", "e").agg(F.count("*").alias("n"))

