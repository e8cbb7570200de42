"""Glossaries as delimited text.

Defined cases: a byte-order mark is ignored; rows without both terms are dropped;
unknown columns are ignored; without a header that names both terms the first two
columns are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.functions import text as T

# fixed values: header names of the two terms and the note
HEADERS = {
    "source": ("source", "source_term", "term", "original", "lemma", "en", "english", "englisch", "quelle", "ausgangssprache"),
    "target": ("target", "target_term", "translation", "de", "deutsch", "german", "ziel", "zielsprache"),
    "note": ("note", "notes", "context", "context_note", "comment", "comments", "description", "kommentar"),
}


def delimiter(header: str) -> str:
    """The most frequent of tab, semicolon and comma; the first of them on a tie, comma if there is none."""
    best = max("\t;,", key=header.count)
    return best if header.count(best) else ","


def read_glossary(spark: SparkSession, path: str, headers: dict[str, tuple[str, ...]] = HEADERS) -> DataFrame:
    """``source_term, target_term, note``."""
    first = spark.read.text(path).first()
    line = (first[0] if first else "").lstrip("﻿")
    sep = delimiter(line)
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True)
    names = {c: c.lstrip("﻿").strip().lower() for c in df.columns}
    pick = {role: next((c for c, n in names.items() if n in known), None) for role, known in headers.items()}
    if pick["source"] is None or pick["target"] is None:
        pick["source"], pick["target"] = (df.columns + [None, None])[:2]
    if pick["source"] is None or pick["target"] is None:
        return spark.createDataFrame([], "source_term string, target_term string, note string")
    col = lambda role: T.strip(F.col(f"`{pick[role]}`")) if pick[role] else F.lit(None).cast("string")
    return df.select(col("source").alias("source_term"), col("target").alias("target_term"), col("note").alias("note")).filter("source_term <> '' and target_term <> ''")


def write_glossary(df: DataFrame, path: str) -> None:
    """Every field quoted, with a header."""
    df.select("source_term", "target_term", "note").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
