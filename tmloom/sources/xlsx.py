"""Spreadsheets as a source of segments and a sink of their translations.

Read with the standard library: a workbook is a zip of XML. Only the active sheet is
read. Defined cases: empty, formula, date, number and truth cells give nothing; text
that is only a number gives nothing unless it is marked as text; a broken file gives
one error row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.functions import text as T

SCHEMA = "path string, sheet string, row int, col int, sentence_index int, is_tail boolean, text string, error string"
_COLUMNS = ["path", "sheet", "row", "col", "sentence_index", "is_tail", "text", "error"]
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NUMBER = re.compile(r"[.,\s€$%]")


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def sentences(text: str) -> list[str]:
    return [s.strip() for s in T.split_sentences(text) if s.strip()]


def cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the text cells of the active sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_M + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_M + "si")]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        view = next(book.iter(_M + "workbookView"), None)
        sheets = list(book.iter(_M + "sheet"))
        sheet = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[sheet.get(_R + "id")]
        quoted = set()
        if "xl/styles.xml" in z.namelist():
            xfs = ET.fromstring(z.read("xl/styles.xml")).find(_M + "cellXfs")
            quoted = {str(n) for n, xf in enumerate(xfs if xfs is not None else []) if xf.get("quotePrefix") in ("1", "true")}
        for c in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else "xl/" + target)).iter(_M + "c"):
            kind, v = c.get("t"), c.find(_M + "v")
            if c.find(_M + "f") is not None:
                continue
            if kind == "s" and v is not None:
                text = shared[int(v.text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(_M + "t"))
            else:
                continue
            if not text.strip() or (c.get("s") not in quoted and _NUMBER.sub("", text).isdigit()):
                continue
            yield (sheet.get("name"), *_place(c.get("r")), text)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    for sheet, r, c, text in cells(data):
                        parts = sentences(text)
                        rows += [(p, sheet, r, c, n, n == len(parts) - 1, s, None) for n, s in enumerate(parts)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError) as e:
                    rows.append((p, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def merged_cells(df: DataFrame) -> DataFrame:
    """``path, sheet, row, col, value``: the translated text of each cell from its sentences.

    ``df`` has the columns of the source and ``target``; a sentence without a target keeps its text.
    """
    text = T.unescaped(T.strip_tags(F.when(F.col("target") != "", F.col("target")).otherwise(F.col("text"))))
    return df.groupBy("path", "sheet", "row", "col").agg(F.array_sort(F.collect_list(F.struct("sentence_index", text.alias("t")))).alias("s")).select(
        "path", "sheet", "row", "col", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("value"))


def rewrite(data: bytes, values: dict[tuple[int, int], str]) -> bytes:
    """A workbook with the texts of cells of its active sheet replaced, as inline strings."""
    src = zipfile.ZipFile(io.BytesIO(data))
    book = ET.fromstring(src.read("xl/workbook.xml"))
    view = next(book.iter(_M + "workbookView"), None)
    sheet = list(book.iter(_M + "sheet"))[int(view.get("activeTab", 0)) if view is not None else 0]
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(src.read("xl/_rels/workbook.xml.rels"))}[sheet.get(_R + "id")]
    name = target.lstrip("/") if target.startswith("/") else "xl/" + target
    root = ET.fromstring(src.read(name))
    for c in root.iter(_M + "c"):
        value = values.get(_place(c.get("r")))
        if value is not None:
            for x in list(c):
                c.remove(x)
            c.set("t", "inlineStr")
            ET.SubElement(ET.SubElement(c, _M + "is"), _M + "t").text = value
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.namelist():
            z.writestr(item, ET.tostring(root, "utf-8", xml_declaration=True) if item == name else src.read(item))
    return out.getvalue()
