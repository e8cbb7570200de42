"""Registration of queries, and the tables in the form the queries share.

A record that was delivered several times is one record here, and keys that refer
to other tables are normalised. The SQL fragments say the same for the SQL
counterparts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.functions.keys import norm_key
from tmloom.functions.text import WS
from tmloom.session import table


class Registry:
    """Collects the queries of a module with their SQL counterparts."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def wrap(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f
        return wrap


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select(
        "id", norm_key("project_id").alias("project_id"), norm_key("file_id").alias("file_id"), F.col("segment_index").alias("idx"),
        F.col("source_content").alias("source"), F.col("target_content").alias("target"), F.col("status")).distinct()


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translation_units").select(
        "id", norm_key("project_id").alias("project_id"), "source_text", "target_text", "origin_type", "created_at", "changed_at").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "context_chunks").select(
        "id", norm_key("file_id").alias("file_id"), "content", "rich_content", "chunk_index").distinct()


def logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ai_usage_logs").select(
        "id", norm_key("project_id").alias("project_id"), norm_key("segment_id").alias("segment_id"), "logged_at",
        F.lower("model_id").alias("model_id"), "trigger_type", "input_tokens", "output_tokens").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project_files").select(
        norm_key("id").alias("id"), norm_key("project_id").alias("project_id"), F.lower(F.trim("category")).alias("category"), "filename", "file_path", "uploaded_at").distinct()


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select(
        norm_key("id").alias("id"), "project_name", F.lower(F.trim("status")).alias("status"), F.lower(F.trim("source_lang")).alias("source_lang"),
        F.lower(F.trim("target_lang")).alias("target_lang"), "created_at", "archived", "rag_progress", "config").distinct()


def k(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


SEG = f"(SELECT DISTINCT id, {k('project_id')} AS project_id, {k('file_id')} AS file_id, segment_index AS idx, source_content AS source, target_content AS target, status FROM segments)"
TU = f"(SELECT DISTINCT id, {k('project_id')} AS project_id, source_text, target_text, origin_type, created_at, changed_at FROM translation_units)"
CHUNK = f"(SELECT DISTINCT id, {k('file_id')} AS file_id, content, rich_content, chunk_index FROM context_chunks)"
LOG = f"(SELECT DISTINCT id, {k('project_id')} AS project_id, {k('segment_id')} AS segment_id, logged_at, lower(model_id) AS model_id, trigger_type, input_tokens, output_tokens FROM ai_usage_logs)"
FILE = f"(SELECT DISTINCT {k('id')} AS id, {k('project_id')} AS project_id, lower(trim(category)) AS category, filename, file_path, uploaded_at FROM project_files)"
PROJECT = f"(SELECT DISTINCT {k('id')} AS id, project_name, lower(trim(status)) AS status, lower(trim(source_lang)) AS source_lang, lower(trim(target_lang)) AS target_lang, created_at, archived, rag_progress, config FROM projects)"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def tags_sql(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def clean_sql(c: str) -> str:
    return strip_sql(rf"regexp_replace({tags_sql(c)}, '\[(?:TAB|COMMENT|SHAPE)\]', '', 'g')")


#: metadata as readable JSON: without a byte-order mark, a string of JSON unwrapped
META = r"""(SELECT DISTINCT id, CASE WHEN json_valid(m) THEN CASE WHEN json_type(m) = 'VARCHAR' THEN CASE WHEN json_valid(m ->> '$') THEN m ->> '$' END ELSE m END END AS j
       FROM (SELECT id, regexp_replace(metadata_json, '^\x{FEFF}+', '') AS m FROM segments WHERE metadata_json IS NOT NULL))"""


def json_list(path: str) -> str:
    return f"(CASE json_type(j, '{path}') WHEN 'ARRAY' THEN json_extract(j, '{path}[*]') WHEN 'OBJECT' THEN [json_extract(j, '{path}')] END)"
