"""Named queries of the data-quality operators of the core: dates, references, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.operators.dates import normalised_dates
from tmloom.operators.nested import flatten_metadata
from tmloom.plans.base import META, json_list
from tmloom.operators.references import all_orphans, orphan_report
from tmloom.session import table


def _reference_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = ("translation_units", "ai_usage_logs", "context_chunks", "projects", "segments", "project_files", "deletion_log")
    return {n: table(spark, d, n) for n in names}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return normalised_dates(table(spark, d, "tc_requests"), table(spark, d, "segments"))


def p3_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Normalised instants per origin and UTC month."""
    return p3_found(spark, d).groupBy(
        "origin", F.date_format(F.timestamp_micros("utc_us").cast("timestamp_ntz"), "yyyy-MM").alias("month")).agg(F.count("*").alias("instants"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return all_orphans(_reference_tables(spark, d)).drop("ref_key")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(all_orphans(_reference_tables(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_metadata(table(spark, d, "segments"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and parents per flat table."""
    return p6_found(spark, d).groupBy("child_table").agg(
        F.count("*").alias("children"), F.countDistinct("segment_id").alias("segments"))


QUERIES = {f.__name__: f for f in (p3_found, p3_monthly, p4_found, p4_report, p6_found, p6_counts)}

_KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"


def _p4_sql() -> str:
    parts = []
    for child, key, when, parent in (("translation_units", "project_id", "min(created_at)", "projects"),
                                     ("ai_usage_logs", "segment_id", "min(logged_at)", "segments"),
                                     ("context_chunks", "file_id", "min(arrived_at)", "project_files")):
        parts.append(f"""
        SELECT '{child}' AS child_table, c.child_id,
               CASE WHEN p.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason,
               strftime(c.event_time, '%Y-%m') AS period, c.k AS ref_key
        FROM (SELECT CAST(id AS VARCHAR) AS child_id, {_KEY.format(key)} AS k, min(arrived_at) AS a, {when} AS event_time
              FROM {child} GROUP BY 1, 2) c
        LEFT JOIN (SELECT {_KEY.format('id')} AS k, min(arrived_at) AS a FROM {parent} GROUP BY 1) p ON p.k = c.k
        LEFT JOIN (SELECT DISTINCT {_KEY.format('row_id')} AS k FROM deletion_log WHERE table_name = '{parent}') g ON g.k = c.k
        WHERE c.k IS NOT NULL AND (p.k IS NULL OR c.a < p.a)""")
    return " UNION ALL ".join(parts)




def _p6_sql() -> str:
    def listed(path: str, name: str) -> str:
        return (f"SELECT id AS segment_id, '{name}' AS child_table, '' AS parent_key, CAST(i - 1 AS VARCHAR) AS child_key FROM "
                f"(SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, {json_list(path)} AS l FROM {META})) WHERE json_type(x) <> 'NULL'")

    return f"""WITH t AS (SELECT id, k, json_extract(j, '$.tags') -> k AS x FROM (SELECT id, j, unnest(json_keys(j, '$.tags')) AS k FROM {META} WHERE json_type(j, '$.tags') = 'OBJECT')
           UNION ALL SELECT id, x ->> '$.id' AS k, x FROM (SELECT id, unnest(json_extract(j, '$.tags[*]')) AS x FROM {META} WHERE json_type(j, '$.tags') = 'ARRAY') WHERE x ->> '$.id' IS NOT NULL),
       m AS (SELECT id, i - 1 AS i, json_extract(x, '$.metadata') AS x FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, {json_list('$.context_matches')} AS l FROM {META})))
       SELECT id AS segment_id, 'tags' AS child_table, '' AS parent_key, k AS child_key FROM t WHERE json_type(x) <> 'NULL'
       UNION ALL SELECT id, 'tag_attributes', k, a FROM (SELECT id, k, x, unnest(json_keys(x, '$.xml_attributes')) AS a FROM t WHERE json_type(x, '$.xml_attributes') = 'OBJECT') WHERE json_type(json_extract(x, '$.xml_attributes') -> a) <> 'NULL'
       UNION ALL SELECT id, 'match_metadata', CAST(i AS VARCHAR), a FROM (SELECT id, i, x, unnest(json_keys(x)) AS a FROM m WHERE json_type(x) = 'OBJECT') WHERE json_type(x -> a) <> 'NULL'
       UNION ALL {listed('$.metadata.revisions', 'revisions')} UNION ALL {listed('$.metadata.revision_stages', 'revision_stages')} UNION ALL {listed('$.context_matches', 'context_matches')}"""


ORACLES = {
    "p6_found": _p6_sql(),
    "p6_counts": f"SELECT child_table, count(*) AS children, count(DISTINCT segment_id) AS segments FROM ({_p6_sql()}) GROUP BY 1",
    "p4_found": f"SELECT child_table, child_id, reason, period FROM ({_p4_sql()})",
    "p4_report": f"SELECT child_table, period, reason, count(*) AS orphans, count(DISTINCT ref_key) AS dangling_keys FROM ({_p4_sql()}) GROUP BY 1, 2, 3",
}
