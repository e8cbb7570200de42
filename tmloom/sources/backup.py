"""Backups of projects: one folder of tables, restored under new ids.

Defined cases: a table that a backup lacks is skipped; restoring twice under the same
name gives the same ids, under another name other ids; references to rows outside the
backup become null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.functions import text as T
from tmloom.operators.lifecycle import derived_id

#: columns that hold ids, per table, with the table they refer to
IDS = {
    "projects": {"id": "projects"},
    "project_files": {"id": "project_files", "project_id": "projects"},
    "segments": {"id": "segments", "project_id": "projects", "file_id": "project_files"},
    "translation_units": {"id": "translation_units", "project_id": "projects"},
    "glossary_entries": {"id": "glossary_entries", "project_id": "projects", "segment_id": "segments"},
    "context_chunks": {"id": "context_chunks", "file_id": "project_files"},
    "ai_usage_logs": {"id": "ai_usage_logs", "project_id": "projects", "segment_id": "segments"},
}


def write_backup(tables: dict[str, DataFrame], project_ids: DataFrame, path: str) -> None:
    """The rows of the projects in ``project_ids`` (a column ``id``), a folder per table."""
    chosen = {"projects": tables["projects"].join(project_ids.select("id").distinct(), "id", "left_semi")}
    for name in ("project_files", "segments", "translation_units", "glossary_entries", "ai_usage_logs"):
        if name in tables:
            chosen[name] = tables[name].join(project_ids.select(F.col("id").alias("project_id")).distinct(), "project_id", "left_semi")
    if "context_chunks" in tables and "project_files" in chosen:
        chosen["context_chunks"] = tables["context_chunks"].join(chosen["project_files"].select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi")
    for name, df in chosen.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore_backup(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """The tables of a backup with new ids and references mapped to them."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    there = {s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)}
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in IDS if t in there}
    out = {}
    for t, df in tables.items():
        columns = df.columns
        for column, parent in IDS[t].items():
            if column not in columns:
                continue
            if column != "id":
                known = tables[parent].select(F.col("id").alias("__known")).distinct() if parent in tables else None
                if known is None:
                    df = df.withColumn(column, F.lit(None).cast("string"))
                    continue
                df = df.join(known, F.col(column) == F.col("__known"), "left").withColumn(column, F.col("__known")).drop("__known")
            # whole-number ids, which nothing refers to, stay whole numbers
            fresh = F.xxhash64(F.lit(f"{name}/{parent}"), column) if dict(df.dtypes)[column] == "bigint" else derived_id(f"{name}/{parent}", F.col(column))
            df = df.withColumn(column, F.when(F.col(column).isNotNull(), fresh))
        if t == "projects" and "project_name" in columns:
            df = df.withColumn("project_name", F.concat(F.lit(f"{name} "), F.coalesce("project_name", F.lit(""))))
        out[t] = df.select(columns)
    return out


def last_fingerprint(spark: SparkSession, path: str) -> str | None:
    """The fingerprint in the newest ``*.hash`` file under ``path``; null if there is none."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hash").load(path)
    return f.agg(F.max_by(T.strip(F.decode("content", "UTF-8")), F.struct("modificationTime", "path")).alias("h")).first().h


def list_backups(spark: SparkSession, path: str) -> DataFrame:
    """``path, project, saved_at``: the files under ``path``, newest first; the name is read from the right."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("saved_at"), "length")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return f.select("path", F.regexp_extract(stem, r"^(.*?)_[^_]*$", 1).alias("project"), "saved_at", "length").orderBy(F.desc("saved_at"), "path")
