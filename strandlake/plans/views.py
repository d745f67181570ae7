"""Genomics-shaped views over the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strandlake.session import read_table

VIEWS = {
    # Alignments of reads: 0-based start, exclusive end.
    "x_aln": """SELECT l_orderkey AS read_id, l_linenumber AS part, concat('chr', l_suppkey % 5) AS chr,
        CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand,
        l_partkey * 1000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS s,
        l_partkey * 1000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 + CAST(floor(l_quantity) AS BIGINT) * 10 + 1 AS e,
        1 - l_tax AS q_coverage, 1 - l_discount AS identity,
        CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 16 ELSE 0 END AS flag FROM {lineitem}""",
    # Exons of transcripts in sorted, disjoint order; transcripts share loci.
    "x_exon": """SELECT tid, concat('chr', tid % 97 % 5) AS chr, CASE WHEN tid % 2 = 0 THEN '+' ELSE '-' END AS strand, exon_no,
        (tid % 97) * 5000 + exon_no * 700 + (l_partkey % 3) * 10 AS s,
        (tid % 97) * 5000 + exon_no * 700 + (l_partkey % 3) * 10 + 100 + (l_partkey % 7) * 20 AS e
      FROM (SELECT l_orderkey AS tid, l_partkey, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS exon_no FROM {lineitem})""",
    # Members of isoforms, and the same reads by cluster and primer.
    "x_group": """SELECT concat('PB.', o_custkey % 400, '.', o_custkey % 3) AS pbid, concat('read/', o_orderkey) AS member FROM {orders}""",
    "x_cluster": """SELECT concat('c', o_custkey % 700) AS cluster_id, concat('read/', o_orderkey) AS read_id,
        CASE WHEN o_orderkey % 4 = 0 THEN 'NonFL' ELSE 'FL' END AS read_type FROM {orders}""",
    "x_primer": """SELECT concat('read/', o_orderkey) AS id, o_orderpriority AS primer FROM {orders}""",
    # Sequences over ACGT from the texts, with a quality string of the same length.
    "x_seq": """SELECT doc_id, translate(text, 'acgtEIOUSRNLDMPHBFYVKWJXQZeiousrnldmphbfyvkwjxqz0123456789', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACACGTACGTAC') AS raw
      FROM {documents} WHERE text IS NOT NULL""",
    "x_cigar": """SELECT l_orderkey AS read_id, l_linenumber AS part, l_partkey * 10 AS pos,
        concat(l_suppkey % 9 + 1, 'S', CAST(floor(l_quantity) AS BIGINT), 'M', l_partkey % 5 + 1, 'I', l_partkey % 60 + 1, 'M',
          l_suppkey % 50 + 20, 'N', l_linenumber, 'D', l_partkey % 31 + 1, 'M') AS cigar FROM {lineitem}""",
    # Bases seen at positions.
    "x_pile": """SELECT user_id % 20 AS chr_no, event_id % 500 AS pos, substr('ACGTacgt', CAST(1 + (event_id * 7 + user_id) % 11 % 8 AS INT), 1) AS base,
        substr('ACGT', CAST(1 + (event_id % 500) % 4 AS INT), 1) AS ref FROM {events}""",
    # Isoforms with genes, categories and full-length counts.
    "x_fl": """SELECT concat('PB.', p_partkey) AS pbid, p_brand AS gene, p_type AS category, p_size + 300 AS length, p_partkey % 9 AS fl_count FROM {part}""",
}


def tables_of(name: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", VIEWS[name]))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    return spark.sql(VIEWS[name], **{t: read_table(spark, sf_dir, t) for t in tables_of(name)})


def with_views(sql: str) -> str:
    """The views that ``sql`` names, as CTEs before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    bodies = [f"{v} AS ({VIEWS[v].format(**{t: t for t in tables_of(v)})})" for v in used]
    text = sql.strip()
    if not bodies:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(bodies)}, {text[15:]}"
    return f"WITH {', '.join(bodies)}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {', '.join(bodies)} {text}"
