"""Translation-memory exchange files as a source and a sink.

A file is read unit by unit: the text source splits it at the end of each unit, so it may
be of any size and many tasks share it. Defined cases: units without both sides are
skipped; a unit that cannot be parsed gives one error row, and the others are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.functions import text as T

SCHEMA = "path string, pos long, source_text string, target_text string, error string"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def inline_text(seg: ET.Element) -> str:
    """The text of a seg with its inline elements as numbered tags."""
    out = [seg.text or ""]
    for x in seg:
        kind, n = x.tag.rpartition("}")[2], x.get("i") or x.get("x") or x.get("id") or "1"
        out.append({"bpt": f"<{n}>", "ept": f"</{n}>"}.get(kind, f"<{n} />" if kind in ("ph", "it") else "".join(x.itertext())))
        out.append(x.tail or "")
    return "".join(out)


def unit(tu: ET.Element, source: str = "en", target: str = "de") -> tuple[str, str] | None:
    """(source, target) of a unit, or null if a side is missing; without the languages, the first two variants."""
    found, order = {}, []
    for tuv in tu.iter():
        if tuv.tag.rpartition("}")[2] == "tuv":
            seg = next((x for x in tuv if x.tag.rpartition("}")[2] == "seg"), None)
            if seg is not None:
                text, lang = inline_text(seg), (tuv.get(_LANG) or tuv.get("lang") or "").lower()
                order.append(text)
                for want in (source, target):
                    if lang.startswith(want):
                        found.setdefault(want, text)
    a, b = found.get(source), found.get(target)
    if a is None and b is None and len(order) >= 2:
        a, b = order[0], order[1]
    return (" ".join(a.split()), b) if a and b and a.strip() and b.strip() else None


_START = re.compile(r"<tu(?=[\s>])")


def read_tmx(spark: SparkSession, path: str, source: str = "en", target: str = "de") -> DataFrame:
    """``path, pos, source_text, target_text, error`` of the units of all files under ``path``; ``pos`` grows within a file."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, n, text in pdf.itertuples(index=False):
                m = _START.search(text)
                if not m:
                    continue  # what stands before the first unit or after the last
                try:
                    sides = unit(ET.fromstring(text[m.start():] + "</tu>"), source, target)
                    if sides:
                        rows.append((p, n, *sides, None))
                except ET.ParseError as e:
                    rows.append((p, n, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pos", "source_text", "target_text", "error"]).astype({"path": object, "source_text": object, "target_text": object, "error": object, "pos": "int64"})

    # every unit is one record of the text source, so a large file is read by many tasks and never whole
    text = spark.read.option("lineSep", "</tu>").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"), "value")
    return text.mapInPandas(parse, SCHEMA)


def to_units(rows: DataFrame, project_id: str, origin: str = "optional") -> DataFrame:
    """Units of a translation memory: ``project_id, source_hash, source_text, target_text, origin_type``; nothing is merged."""
    return rows.filter("error is null").select(F.lit(project_id).alias("project_id"), T.tm_key(F.col("source_text")).alias("source_hash"), "source_text", "target_text", F.lit(origin).alias("origin_type"))


def to_chunks(rows: DataFrame, file_id: str) -> DataFrame:
    """The same units as chunks of context: ``file_id, content, rich_content, chunk_index``, the target as rich content."""
    return rows.filter("error is null").select(F.lit(file_id).alias("file_id"), F.col("source_text").alias("content"), F.col("target_text").alias("rich_content"), F.col("pos").alias("chunk_index"))


def tmx_units(df: DataFrame, source_lang: str = "en", target_lang: str = "de") -> DataFrame:
    """``line``: the XML of each unit with both sides, tags stripped, in the order of the input."""
    side = lambda lang, c: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), T.xml_escaped(T.strip_tags(F.col(c))), F.lit("</seg></tuv>"))
    return df.filter("source <> '' and target <> ''").select(F.concat(F.lit("<tu>"), side(source_lang, "source"), side(target_lang, "target"), F.lit("</tu>")).alias("line"))


def write_tmx(df: DataFrame, path: str, source_lang: str = "en", target_lang: str = "de", single: bool = False) -> None:
    """A directory of well-formed files, one per partition, or a ``single`` one, in the order of the input."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header srclang="{source_lang}" datatype="plaintext" segtype="sentence" adminlang="en" o-tmf="tmloom" creationtool="tmloom" creationtoolversion="1"/><body>'

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"line": [head]})
        for pdf in batches:
            yield pdf
        yield pd.DataFrame({"line": ["</body></tmx>"]})

    lines = tmx_units(df, source_lang, target_lang)
    (lines.coalesce(1) if single else lines).mapInPandas(wrap, "line string").write.mode("overwrite").text(path)
