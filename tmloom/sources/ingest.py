"""Files of any known kind to segments, chunks and units.

The kind of a file follows its ending; documents, spreadsheets and exchange files are read
in one pass each. Defined cases: a file of unknown kind gives one error row and the others
are read; a broken file too; ids are made from the project, the file and the place, so that
reading again gives the same ids.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tmloom.functions import text as T
from tmloom.operators.lifecycle import derived_id
from tmloom.sources import docx, tmx, xlsx

SCHEMA = "path string, kind string, place int, sub_index int, location string, text string, tags string, error string"
_COLUMNS = ["path", "kind", "place", "sub_index", "location", "text", "tags", "error"]


def _rows(path: str, data: bytes) -> list[tuple]:
    end = path.lower().rpartition(".")[2]
    try:
        if end in ("docx", "doc"):
            return [(path, r[0], r[3], r[4], "/".join("" if x is None else str(x) for x in (r[0], r[1], r[2], *r[5:8])), r[8], r[9], None) for r in docx.Document(data).scan()]
        if end in ("xlsx", "xls"):
            return [(path, "cell", n, k, f"{sheet}/{row}/{col}", s, None, None)
                    for n, (sheet, row, col, text) in enumerate(xlsx.cells(data)) for k, s in enumerate(xlsx.sentences(text))]
        raise ValueError("unknown file type")
    except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, AttributeError) as e:
        return [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def parsed_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for p, data in zip(pdf["path"], pdf["content"]):
            yield pd.DataFrame(_rows(p, data), columns=_COLUMNS).astype(object)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, place, sub_index, location, text, tags, error`` of all files under ``path``, by their endings."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(parsed_batches, SCHEMA)


def create_project(spark: SparkSession, path: str, project_id: str) -> tuple[DataFrame, DataFrame]:
    """The segments of a new project as drafts, numbered over its files in order, and the files that could not be read.

    A file's rows are numbered within the file and start after those of the files before it.
    """
    rows = read_documents(spark, path)
    good = rows.filter("error is null")
    inner = good.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("place", "sub_index")) - 1)  # a file was read by one task
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file of a project
    before = good.groupBy("path").agg(F.count("*").alias("rows")).select("path", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    key = F.concat_ws("/", "path", F.col("place").cast("string"), F.col("sub_index").cast("string"))
    segments = inner.join(before, "path").select(
        derived_id(project_id, key).alias("id"), F.lit(project_id).alias("project_id"), derived_id(project_id, F.col("path")).alias("file_id"), (F.col("n") + F.col("start")).cast("int").alias("segment_index"),
        F.col("text").alias("source_content"), F.lit(None).cast("string").alias("target_content"), F.lit("draft").alias("status"), "location", "tags")
    return segments, rows.filter("error is not null").select("path", "error")


def context_chunks(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Chunks of context files: texts of more than three letters under their place among all."""
    rows = read_documents(spark, path).filter("error is null")
    return rows.filter(F.length(T.strip(F.col("text"))) > 3).select(
        derived_id(project_id, F.concat_ws("/", "path", F.col("place").cast("string"), F.col("sub_index").cast("string"))).alias("id"), derived_id(project_id, F.col("path")).alias("file_id"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("rich_content"), F.col("place").alias("chunk_index"))


def reingested(units: DataFrame, chunks: DataFrame, fresh_units: DataFrame, fresh_chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and chunks of a project after its context was read again: a user's own units stay, all else is replaced.

    ``files`` has the ids of the project's context files in ``id``.
    """
    kept = units.filter(F.lower("origin_type") == "user")
    rest = chunks.join(files.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_anti")
    return kept.unionByName(fresh_units, allowMissingColumns=True), rest.unionByName(fresh_chunks, allowMissingColumns=True)


def memory_of(spark: SparkSession, path: str, project_id: str, file_id: str, origin: str = "mandatory") -> tuple[DataFrame, DataFrame]:
    """Units and chunks of an exchange file."""
    rows = tmx.read_tmx(spark, path)
    return tmx.to_units(rows, project_id, origin), tmx.to_chunks(rows, file_id)
