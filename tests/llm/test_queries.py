"""Queries with SQL give the rows of their SQL on the smallest tables; the others are run whole."""

from collections import Counter

import pytest

from strandlake.llm import queries
from tests.test_queries import SF, duck, normal  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(map(normal, r))) for r in df.select(*columns).collect())
    cursor = duck.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert ours == Counter(repr(tuple(normal(r[i]) for i in at)) for r in cursor.fetchall())


def test_every_document_is_encoded(spark, duck):  # noqa: F811
    rows = queries.p7_ids(spark, SF).collect()
    assert len(rows) == duck.execute("select count(*) from documents").fetchone()[0]


def test_distinct_counts_of_the_table(spark, duck):  # noqa: F811
    got = {r.measure: r.n_distinct for r in queries.p5_distinct(spark, SF).filter("grouping = 'total'").collect()}
    tag = "nullif(nullif(upper(trim({0})), ''), 'NA')"
    for measure in ("umi_ed", "bc_ed"):
        exact = duck.execute(f"select count(distinct {tag.format(measure)}) from dedup_flnc_per_cluster").fetchone()[0]
        assert got[measure] == pytest.approx(exact, rel=0.07)


def test_molecules_of_any_gene_count(spark, tmp_path):
    rows = [("A", "C", g) for g in (None, "", "NA", "g")] + [(None, "C", "g"), ("A", "na", "h")]
    df = spark.createDataFrame(rows, "bc_ed string, umi_ed string, gene string")
    df.selectExpr("*", "'k' AS cluster", "timestamp'2025-01-01 00:00:00' AS deduped_at").write.parquet(str(tmp_path / "dedup_flnc_per_cluster.parquet"))
    found = queries.p5_distinct(spark, str(tmp_path)).filter("measure = 'bc_ed_umi_ed_gene'")
    assert [r.n_distinct for r in found.filter("grouping = 'total'").collect()] == [4]
    assert {r.gene: r.n_distinct for r in found.filter("grouping = 'gene'").collect()} == {None: 1, "": 1, "NA": 1, "g": 1}
