"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.tags import tag_value
from strandlake.llm import bpe, components, distinct, frequent, leaks, spans
from strandlake.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, corrected = (F.concat_ws("-", tag_value(bc), tag_value(umi)) for bc, umi in (("bc", "umi"), ("bc_ed", "umi_ed")))
    whole = [tag_value(c).isNotNull() for c in ("bc", "umi", "bc_ed", "umi_ed")]
    rows = read_table(spark, sf_dir, "umi_bc_error_correct").filter(whole[0] & whole[1] & whole[2] & whole[3])
    pairs = rows.select(raw.alias("raw"), corrected.alias("corrected"))
    return components.groups(pairs, "raw", "corrected").withColumnsRenamed({"value": "tag", "group_value": "group_tag"})


def p4_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "clip_out_umi_cellbc")
    found = frequent.frequent_values(rows, {"bc": tag_value("bc"), "umi": tag_value("umi")}, 1 / 200)
    return found.select("field", "key_value", "n", "n_values")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_frequent(spark, sf_dir).select("field", "key_value")


def p5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "dedup_flnc_per_cluster")
    umi, bc = tag_value("umi_ed"), tag_value("bc_ed")
    # Only a missing tag doesn't count; the gene is as written, null being one of its own.
    both = F.when(umi.isNotNull() & bc.isNotNull(), F.struct(bc, umi, F.col("gene")))
    rows = rows.withColumn("day", F.date_format("deduped_at", "yyyy-MM-dd"))
    keys = ["day", "gene", "cluster"]
    measures = {"umi_ed": umi, "bc_ed": bc, "bc_ed_umi_ed_gene": both}
    return distinct.distinct_by_combination(distinct.registers(rows, keys, measures), keys, list(measures))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each item stand in each document, and the leaked share of the item."""
    spans = leaks.leaked_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return spans.withColumn("share", F.round("share", 9))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    documents = read_table(spark, sf_dir, "documents")
    return spans.shared_shares(documents, spans.shared_spans(documents)).withColumn("share", F.round("share", 9))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p4_found, p4_frequent, p5_distinct, p7_ids, p8_found, p8_spans, p9_found, p9_shares)}


def _tag(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) NOT IN ('', 'NA') THEN upper(trim({c})) END"


_LINKS = f"""SELECT DISTINCT l, r FROM (SELECT ({_tag("bc")}) || '-' || ({_tag("umi")}) AS l, ({_tag("bc_ed")}) || '-' || ({_tag("umi_ed")}) AS r
  FROM umi_bc_error_correct) WHERE l <> r"""

_TAGS = f"SELECT 'bc' AS field, {_tag('bc')} AS key_value FROM clip_out_umi_cellbc UNION ALL SELECT 'umi', {_tag('umi')} FROM clip_out_umi_cellbc"


_RUNS = """w AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items),
  d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
  i AS (SELECT DISTINCT item_id, k, len(w) AS n, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM w)),
  c AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))"""

# Windows of 300 characters come from blocks of 1000 starts, so that no window is sought from the begin of a long text.
_SPANS = """b AS (SELECT doc_id, k * 1000 AS off, substr(text, k * 1000 + 1, 1299) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text) // 1000 + 1)) AS k FROM documents WHERE length(text) >= 300)),
  w AS (SELECT doc_id, off + i AS pos, substr(t, i + 1, 300) AS g FROM (SELECT *, unnest(range(0, least(1000, length(t) - 299))) AS i FROM b WHERE length(t) >= 300)),
  s AS (SELECT g FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id)),
  h AS (SELECT DISTINCT doc_id, pos FROM w JOIN s USING (g)),
  n AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 300 THEN 0 ELSE 1 END AS new FROM h),
  r AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n),
  f AS (SELECT doc_id, min(pos) AS span_start, max(pos) + 300 AS span_end FROM r GROUP BY doc_id, run)"""


def oracle_sql() -> dict:
    return {
        "p1_found": f"""WITH RECURSIVE e AS (SELECT l AS a, r AS b FROM ({_LINKS}) UNION SELECT r, l FROM ({_LINKS})),
          x(tag, other) AS (SELECT a, a FROM e UNION SELECT x.tag, e.b FROM x JOIN e ON x.other = e.a)
          SELECT tag, min(other) AS group_tag FROM x GROUP BY tag""",
        "p4_found": f"""SELECT field, key_value FROM (SELECT field, key_value, count(*) AS n FROM ({_TAGS}) WHERE key_value IS NOT NULL GROUP BY 1, 2)
          QUALIFY n * 200 >= sum(n) OVER (PARTITION BY field)""",
        "p4_frequent": f"""SELECT field, key_value, n, CAST(n_values AS BIGINT) AS n_values FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS n_values
          FROM (SELECT field, key_value, count(*) AS n FROM ({_TAGS}) WHERE key_value IS NOT NULL GROUP BY 1, 2)) WHERE n * 200 >= n_values""",
        "p8_found": f"WITH {_RUNS} SELECT DISTINCT item_id, doc_id FROM i JOIN c USING (g)",
        "p8_spans": f"""WITH {_RUNS}, h AS (SELECT DISTINCT item_id, doc_id, k - 1 AS pos, n FROM i JOIN c USING (g)),
          m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY item_id, doc_id ORDER BY pos) <= 12 THEN 0 ELSE 1 END AS new FROM h),
          r AS (SELECT *, sum(new) OVER (PARTITION BY item_id, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m),
          f AS (SELECT item_id, doc_id, min(pos) AS span_start, max(pos) + 12 AS span_end, max(n) AS n FROM r GROUP BY item_id, doc_id, run)
          SELECT item_id, doc_id, span_start, span_end, round(sum(span_end - span_start) OVER (PARTITION BY item_id, doc_id) / n, 9) AS share FROM f""",
        "p9_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM f",
        "p9_shares": f"""WITH {_SPANS}, t AS (SELECT doc_id, sum(span_end - span_start) AS n FROM f GROUP BY doc_id),
          d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
          SELECT doc_id, n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, round(CASE WHEN n_chars > 0 THEN coalesce(n, 0) / n_chars END, 9) AS share FROM d LEFT JOIN t USING (doc_id)""",
    }
