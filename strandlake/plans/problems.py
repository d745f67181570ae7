"""The queries of the general training-data problems, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.tags import key_value, plain_value, tag_value
from strandlake.operators import orphans, ranges, sweep
from strandlake.session import read_table

#: Reference, its field and the key of its target; the first one has its sample before the key.
REFERENCES = (
    ("chain_samples", "pbid", "sample_abundance", "pbid"),
    ("collate_flnc_gene_info", "pbid", "chain_samples", "superpbid"),
    ("collate_flnc_gene_info", "isoform", "classification", "isoform"),
)


def _key(field: str, in_sample: bool) -> Column:
    return F.concat(F.col("sample"), F.lit(":"), key_value(field)) if in_sample else key_value(field)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, targets = [], []
    for ref, (table, field, target, target_field) in enumerate(REFERENCES):
        number, in_sample = F.lit(ref).alias("ref"), ref == 0
        rows, of_target = read_table(spark, sf_dir, table), read_table(spark, sf_dir, target)
        refs.append(rows.select(number, _key(field, in_sample).alias("key"), orphans.micros("loaded_at").alias("t")))
        times = [orphans.micros("loaded_at").alias("loaded"), orphans.micros("removed_at").alias("removed")]
        targets.append(of_target.select(number, _key(target_field, in_sample).alias("key"), *times))
    return orphans.orphan_references(reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, targets))


def _named() -> list[Column]:
    tables, fields = (F.element_at(F.array(*(F.lit(r[i]) for r in REFERENCES)), F.col("ref") + 1) for i in (0, 1))
    return [tables.alias("ref_table"), fields.alias("ref_field"), F.date_format("day", "yyyy-MM-dd").alias("ref_day")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(*_named(), F.col("key").alias("ref_key"), "reason")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan keys and referring rows per table, field, day and reason."""
    return orphans.orphan_counts(_orphans(spark, sf_dir)).select(*_named(), "reason", "n_keys", "n_references")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bc, umi = tag_value("bc"), tag_value("umi")
    fields = {"gene": (plain_value("gene"), F.when(bc.isNotNull() & umi.isNotNull(), F.concat_ws("-", bc, umi))), "bc": (bc, umi)}
    return ranges.counts_by_key(read_table(spark, sf_dir, "umi_bc_error_correct"), fields).select("field", "key_value", "n_rows", "n_tags")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bc, umi = tag_value("bc"), tag_value("umi")
    fields = {"gene": (plain_value("gene"), F.when(bc.isNotNull() & umi.isNotNull(), F.concat_ws("-", bc, umi))), "bc": (bc, umi)}
    counts = ranges.counts_by_key(read_table(spark, sf_dir, "umi_bc_error_correct"), fields)
    return counts.filter("n_rows * 50 >= total").select("field", "key_value")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "scrub_sample_gff_junctions").filter("chr is not null and strand is not null")
    return sweep.periods_and_gaps(rows, ["sample", "chr", "strand"], "left", "right")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_counts, p6_found)}


def _tag(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) NOT IN ('', 'NA') THEN upper(trim({c})) END"


def _plain(c: str) -> str:
    return f"CASE WHEN {c} <> '' AND upper(trim({c})) <> 'NA' THEN {c} END"


def _ref_key(c: str) -> str:
    return _tag(f"split_part({c}, '|', 1)")


def _orphans_sql() -> str:
    parts = []
    for ref, (table, field, target, target_field) in enumerate(REFERENCES):
        before = "sample || ':' || " if ref == 0 else ""
        parts.append(
            f"""SELECT '{table}' AS ref_table, '{field}' AS ref_field, r.t, r.k, r.n AS n_rows,
              count(x.k) AS n, count(*) FILTER (WHERE x.l <= r.t) AS early,
              count(*) FILTER (WHERE x.l <= r.t AND (x.d IS NULL OR x.d > r.t)) AS holds
            FROM (SELECT loaded_at AS t, {before}({_ref_key(field)}) AS k, count(*) AS n FROM {table} GROUP BY 1, 2) r
            LEFT JOIN (SELECT DISTINCT loaded_at AS l, removed_at AS d, {before}({_ref_key(target_field)}) AS k FROM {target}) x ON r.k = x.k
            WHERE r.k IS NOT NULL AND r.t IS NOT NULL GROUP BY r.t, r.k, r.n"""
        )
    return f"""SELECT ref_table, ref_field, strftime(t, '%Y-%m-%d') AS ref_day, k AS ref_key,
      CASE WHEN n = 0 THEN 'missing' WHEN early = 0 THEN 'late' ELSE 'deleted' END AS reason, n_rows
      FROM ({" UNION ALL ".join(parts)}) WHERE holds = 0"""


_GENE_AND_BC = f"""SELECT 'gene' AS field, {_plain("gene")} AS key_value, ({_tag("bc")}) || '-' || ({_tag("umi")}) AS tag FROM umi_bc_error_correct
  UNION ALL SELECT 'bc', {_tag("bc")}, {_tag("umi")} FROM umi_bc_error_correct"""


def oracle_sql() -> dict:
    return {
        "p2_found": f"SELECT DISTINCT ref_table, ref_field, ref_day, ref_key, reason FROM ({_orphans_sql()})",
        "p2_counts": f"""SELECT ref_table, ref_field, ref_day, reason, count(DISTINCT ref_key) AS n_keys, CAST(sum(n_rows) AS BIGINT) AS n_references
          FROM ({_orphans_sql()}) GROUP BY ref_table, ref_field, ref_day, reason""",
        "p3_found": f"""SELECT field, key_value FROM (SELECT field, key_value, count(*) AS n FROM ({_GENE_AND_BC}) WHERE key_value IS NOT NULL GROUP BY 1, 2)
          QUALIFY n * 50 >= sum(n) OVER (PARTITION BY field)""",
        "p3_counts": f"""SELECT field, key_value, count(*) AS n_rows, count(DISTINCT tag) AS n_tags FROM ({_GENE_AND_BC})
          WHERE key_value IS NOT NULL GROUP BY 1, 2""",
        "p6_found": """WITH x AS (SELECT DISTINCT sample, chr, strand, least("left", "right") AS s, greatest("left", "right") AS e FROM scrub_sample_gff_junctions
            WHERE chr IS NOT NULL AND strand IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL AND "left" <> "right"),
          y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY sample, chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x),
          z AS (SELECT *, sum(new) OVER (PARTITION BY sample, chr, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM y),
          p AS (SELECT sample, chr, strand, g, min(s) AS s, max(e) AS e FROM z GROUP BY ALL)
          SELECT sample, chr, strand, 'period' AS kind, s AS start_pos, e AS end_pos FROM p
          UNION ALL SELECT sample, chr, strand, 'gap', e, nxt FROM (SELECT *, lead(s) OVER (PARTITION BY sample, chr, strand ORDER BY s) AS nxt FROM p) WHERE nxt IS NOT NULL""",
    }
