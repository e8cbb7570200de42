"""Word-processing documents as a source of segments, and writing translations back.

Read with the standard library: a document is a zip of XML. Text comes from the body,
its tables, headers, footers, notes, text boxes and comments, paragraph by paragraph.
Formatting becomes numbered tags; tracked changes become fragments that keep their
kind, author and date. A paragraph with tracked changes stays whole, any other is
split into sentences. White space and formatting around a whole sentence are kept beside
it. Written back, a paragraph gets its notes, links, drawings and formatting again.

Defined cases: paragraphs without text give nothing; separators among the notes are
skipped; a cell that continues one above gives nothing; of alternative contents the first
counts; unknown file types and broken files give one error row.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.functions import tags as tagging
from tmloom.functions.text import split_sentences

COLUMNS = ["path", "kind", "ref", "section", "p_index", "sub_index", "table", "row", "cell", "text", "tags", "fragments", "done", "error"]
SCHEMA = ("path string, kind string, ref string, section int, p_index int, sub_index int, table int, row int, cell int, "
          "text string, tags string, fragments string, done boolean, error string")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
_W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_PARTS = re.compile(r"word/(?:document|footnotes|endnotes|comments|(?:header|footer)\d+)\.xml")
_SWITCHES = {"b": "bold", "i": "italic", "strike": "strike", "smallCaps": "small_caps", "caps": "caps"}
_VALUES = {"u": "underline", "color": "color", "highlight": "highlight", "sz": "size", "vertAlign": "vertical"}


def _signature(run: ET.Element) -> tuple:
    """The formatting of a run as a sorted tuple of (kind, value)."""
    props, out = run.find(_W + "rPr"), []
    for p in props if props is not None else ():
        name, value = p.tag.removeprefix(_W), p.get(_W + "val")
        if name in _SWITCHES and value not in ("0", "false", "none"):
            out.append((_SWITCHES[name], ""))
        elif name in _VALUES and value not in (None, "none", "auto", "000000", "baseline"):
            out.append((_VALUES[name], value))
        elif name == "rFonts" and p.get(_W + "ascii"):
            out.append(("font", p.get(_W + "ascii")))
    return tuple(sorted(out))


def _children(node: ET.Element) -> Iterator[ET.Element]:
    """The children of a node; of alternative contents those of the first."""
    for x in node:
        if x.tag == _MC + "AlternateContent":
            for y in x[:1]:
                yield from _children(y)
        else:
            yield x


def _boxes(run: ET.Element) -> Iterator[ET.Element]:
    """The text boxes of a run, outermost first."""
    for x in _children(run):
        if x.tag == _W + "txbxContent":
            yield x
        else:
            yield from _boxes(x)


class Paragraph:
    """Tagged text, tags and change fragments of one paragraph."""

    def __init__(self, p: ET.Element):
        self.text, self.tags, self.fragments = "", {}, []
        self._open: tuple = ()
        self._ids: list[str] = []
        self._walk(p, "normal", None, None)
        self._format(())

    def _tag(self, kind: str, **attrs) -> str:
        n = str(len(self.tags) + 1)
        self.tags[n] = {"type": kind} | {k: v for k, v in attrs.items() if v}
        return n

    def _format(self, signature: tuple) -> None:
        if signature == self._open:
            return
        self.text += "".join(f"</{n}>" for n in reversed(self._ids))
        self._ids = [self._tag(kind, value=value) for kind, value in signature]
        self.text += "".join(f"<{n}>" for n in self._ids)
        self._open = signature

    def _single(self, kind: str, ref: str | None) -> None:
        self.text += f"<{self._tag(kind, ref_id=ref)}/>"

    def _walk(self, node: ET.Element, change: str, author: str | None, date: str | None) -> None:
        for x in _children(node):
            name = x.tag.removeprefix(_W)
            if name in ("ins", "del", "moveTo", "moveFrom"):
                kind = "ins" if name in ("ins", "moveTo") else "del"
                self._walk(x, kind, x.get(_W + "author"), x.get(_W + "date"))
            elif name == "hyperlink":
                self._format(())
                n = self._tag("link", ref_id=x.get(_R + "id"), anchor=x.get(_W + "anchor"))
                self.text += f"<{n}>"
                self._walk(x, change, author, date)
                self._format(())
                self.text += f"</{n}>"
            elif name == "r":
                self._run(x, change, author, date)
            elif name in ("smartTag", "sdt", "sdtContent", "fldSimple"):
                self._walk(x, change, author, date)
            elif name == "commentRangeStart":
                self._single("comment", x.get(_W + "id"))

    def _run(self, run: ET.Element, change: str, author: str | None, date: str | None) -> None:
        text = ""
        for x in run:
            name = x.tag.removeprefix(_W)
            text += {"tab": "[TAB]", "br": "\n", "cr": "\n", "noBreakHyphen": "‑"}.get(name, x.text or "" if name in ("t", "delText") else "")
            if name in ("footnoteReference", "endnoteReference"):
                self._single(name.removesuffix("Reference"), x.get(_W + "id"))
            elif name in ("drawing", "pict", "object") or x.tag == _MC + "AlternateContent":
                self._single("shape", None)
        if not text:
            return
        if self.fragments and self.fragments[-1]["type"] == change and (self.fragments[-1]["author"], self.fragments[-1]["date"]) == (author, date):
            self.fragments[-1]["text"] += text
        else:
            self.fragments.append({"type": change, "text": text, "author": author, "date": date})
        if change != "del":
            self._format(() if not re.search(r"\w", text) else _signature(run))
            self.text += text

    @property
    def changed(self) -> bool:
        return any(f["type"] != "normal" for f in self.fragments)

    def parts(self) -> list[tuple[str, dict]]:
        """Sentences with their tags balanced; the space around a sentence and the formatting of all of it beside it."""
        kinds = {n: t["type"] for n, t in self.tags.items()}
        values = {n: t.get("value", "") for n, t in self.tags.items()}
        text = tagging.drop_defaults(self.text, kinds, values)
        whole = [text] if self.changed else split_sentences(text) or [text]
        alike = lambda a, b: kinds.get(a) == kinds.get(b) != "link" and values.get(a) == values.get(b)
        out = []
        for part in tagging.repair(whole):
            bare, wrappers = tagging.strip_wrappers(tagging.merge_adjacent(part, alike), kinds)
            inner = bare.strip()
            if re.sub(r"</?\d+\s*/?>", "", inner).strip():
                used = set(re.findall(r"\d+", " ".join(re.findall(r"</?\d+\s*/?>", inner)))) | set(wrappers)
                space = [bare[:len(bare) - len(bare.lstrip())], bare[len(bare.rstrip()):]]
                out.append((inner, {n: t for n, t in self.tags.items() if n in used} | ({"wrappers": wrappers} if wrappers else {}) | ({"space": space} if any(space) else {})))
        return out


class Document:
    """All paragraphs of a document with their places."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.roots = {}
        for name in self.zip.namelist():
            if _PARTS.fullmatch(name):
                raw = self.zip.read(name)
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(raw), ["start-ns"]):
                    if prefix and not re.fullmatch(r"ns\d+", prefix):
                        ET.register_namespace(prefix, uri)
                self.roots[name] = ET.fromstring(raw)
        self.section = 0

    def _xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.zip.namelist() else None

    def _container(self, node: ET.Element, kind: str, ref=None, place=(None, None, None), table=None) -> Iterator[tuple]:
        table = table if table is not None else [0]
        inner = list(_children(node))
        if kind in ("header", "footer") or place[0] is not None:  # cells and headers: their paragraphs first, then their tables
            inner.sort(key=lambda x: x.tag == _W + "tbl")
        for x in inner:
            if x.tag == _W + "p":
                yield x, kind, ref, place
                for b, box in enumerate(y for r in x.iter(_W + "r") for y in _boxes(r)):
                    for q in box.iter(_W + "p"):
                        yield q, "shape", str(b), place
                if kind == "body" and x.find(f"{_W}pPr/{_W}sectPr") is not None:
                    self.section += 1
            elif x.tag == _W + "tbl":
                t, table[0] = table[0], table[0] + 1
                for r, tr in enumerate(y for y in x if y.tag == _W + "tr"):
                    for c, tc in enumerate(y for y in tr if y.tag == _W + "tc"):
                        merge = tc.find(f"{_W}tcPr/{_W}vMerge")
                        if merge is None or merge.get(_W + "val") == "restart":
                            yield from self._container(tc, kind, ref, (t, r, c), table)
            elif x.tag == _W + "sdt" and x.find(_W + "sdtContent") is not None:
                yield from self._container(x.find(_W + "sdtContent"), kind, ref, place, table)

    def _header_sections(self) -> dict[str, int]:
        """The first section that names a header or footer, by its part."""
        rels = self._xml("word/_rels/document.xml.rels")
        target = {r.get("Id"): "word/" + r.get("Target", "").lstrip("/").removeprefix("word/") for r in (rels if rels is not None else ())}
        out: dict[str, int] = {}
        for n, sect in enumerate(self.roots["word/document.xml"].iter(_W + "sectPr")):
            for x in sect:
                if x.get(_R + "id") in target:
                    out.setdefault(target[x.get(_R + "id")], n)
        return out

    def paragraphs(self) -> Iterator[tuple[ET.Element, str, str | None, int | None, tuple, bool | None]]:
        """Every paragraph in reading order: element, kind, reference, section, place in a table, whether a comment is done."""
        for x, kind, ref, place in self._container(self.roots["word/document.xml"].find(_W + "body"), "body"):
            yield x, kind, ref, self.section, place, None
        sections = self._header_sections()
        for name in sorted(self.roots):
            m = re.fullmatch(r"word/(header|footer)(\d+)\.xml", name)
            if m:
                for x, kind, ref, place in self._container(self.roots[name], m.group(1), m.group(2)):
                    yield x, kind, ref, sections.get(name), place, None
        for note_kind in ("footnote", "endnote"):
            for note in self.roots.get(f"word/{note_kind}s.xml", ()):
                if note.get(_W + "type") not in ("separator", "continuationSeparator", "continuationNotice"):
                    for x, kind, ref, place in self._container(note, note_kind, note.get(_W + "id")):
                        yield x, kind, ref, None, place, None
        extended = self._xml("word/commentsExtended.xml")
        done = {x.get(_W15 + "paraId"): x.get(_W15 + "done") == "1" for x in (extended if extended is not None else ())}
        for comment in self.roots.get("word/comments.xml", ()):
            paras = list(comment.iter(_W + "p"))
            resolved = any(done.get(p.get(_W14 + "paraId"), False) for p in paras)
            for p in paras:
                yield p, "comment", comment.get(_W + "id"), None, (None, None, None), resolved

    def scan(self) -> list[tuple]:
        rows = []
        for index, (p, kind, ref, section, place, done) in enumerate(self.paragraphs()):
            para = Paragraph(p)
            fragments = json.dumps(para.fragments, ensure_ascii=False) if para.changed else None
            for n, (text, tags) in enumerate(para.parts()):
                rows.append((kind, ref, section, index, n, *place, text, json.dumps(tags, ensure_ascii=False), fragments, done, None))
        return rows

    def written(self, texts: dict[int, tuple[str, dict]]) -> bytes:
        """The document with paragraphs replaced: ``texts`` maps ``p_index`` to tagged text and tags."""
        for index, (p, *_) in enumerate(list(self.paragraphs())):
            if index in texts:
                _rebuild(p, *texts[index])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.zip.namelist():
                if item in self.roots:
                    self.roots[item].attrib.pop(_MC + "Ignorable", None)  # it may name prefixes that are not declared any more
                    z.writestr(item, ET.tostring(self.roots[item], "utf-8", xml_declaration=True))
                else:
                    z.writestr(item, self.zip.read(item))
        return out.getvalue()


def parse_rows(path: str, data: bytes) -> list[tuple]:
    """The rows of one file, or one error row."""
    try:
        if not path.lower().endswith((".docx", ".doc")):
            raise ValueError("unknown file type")
        return [(path, *r) for r in Document(data).scan()]
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, AttributeError) as e:
        return [(path, *[None] * 12, f"{type(e).__name__}: {e}")]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of all documents under ``path``."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(parse_rows(p, data), columns=COLUMNS).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


_TOKEN = re.compile(r"<(/?)(\d+)\s*(/?)>")
_PIECE = re.compile(r"(\[TAB\]|\n|‑)")
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _rebuild(p: ET.Element, text: str, tags: dict) -> None:
    """Replace what a paragraph says by tagged text; its notes, comment anchors and drawings are taken over.

    Those that the text does not name stand at the end.
    """
    kept: dict[tuple[str, str | None], list[ET.Element]] = {}
    anchors = []
    for x in p.iter():
        name = x.tag.removeprefix(_W)
        if name == "r":
            for y in x:
                special = {"footnoteReference": "footnote", "endnoteReference": "endnote"}.get(y.tag.removeprefix(_W))
                shape = y.tag.removeprefix(_W) in ("drawing", "pict", "object") or y.tag == _MC + "AlternateContent"
                if special or shape:
                    run = ET.Element(_W + "r")
                    if x.find(_W + "rPr") is not None:
                        run.append(x.find(_W + "rPr"))
                    run.append(y)
                    kept.setdefault((special or "shape", y.get(_W + "id") if special else None), []).append(run)
                elif y.tag == _W + "commentReference":
                    anchors.append(x)
        elif name == "commentRangeStart":
            kept.setdefault(("comment", x.get(_W + "id")), []).append(x)
        elif name == "commentRangeEnd":
            anchors.append(x)
    for x in [x for x in p if x.tag != _W + "pPr"]:
        p.remove(x)
    open_: list[str] = []
    box, at = p, 0
    for m in [*_TOKEN.finditer(text), None]:
        for piece in _PIECE.split(text[at:m.start()] if m else text[at:]):
            if piece:
                box.append(_new_run(piece, [tags.get(n, {}) for n in open_]))
        if not m:
            break
        at = m.end()
        tag = tags.get(m.group(2), {})
        if m.group(3):
            same = kept.get((tag.get("type"), tag.get("ref_id")))
            if same:
                box.append(same.pop(0))
        elif tag.get("type") == "link":
            if m.group(1):
                box = p
            else:
                box = ET.SubElement(p, _W + "hyperlink", {k: v for k, v in ((_R + "id", tag.get("ref_id")), (_W + "anchor", tag.get("anchor"))) if v})
        elif not m.group(1):
            open_.append(m.group(2))
        elif m.group(2) in open_:
            open_.remove(m.group(2))
    for left in kept.values():
        p.extend(left)
    p.extend(anchors)


def _new_run(piece: str, tags: list[dict]) -> ET.Element:
    run = ET.Element(_W + "r")
    props = ET.SubElement(run, _W + "rPr")
    for tag in tags:
        kind, value = tag.get("type"), tag.get("value", "")
        if kind == "font":
            ET.SubElement(props, _W + "rFonts", {_W + "ascii": value, _W + "hAnsi": value})
        for names in (_SWITCHES, _VALUES):
            for w, k in names.items():
                if k == kind:
                    ET.SubElement(props, _W + w, {_W + "val": value} if value else {})
    single = {"[TAB]": "tab", "\n": "br", "‑": "noBreakHyphen"}.get(piece)
    if single:
        ET.SubElement(run, _W + single)
    else:
        ET.SubElement(run, _W + "t", {_SPACE: "preserve"}).text = piece
    return run


def rewrite_body(data: bytes, texts: dict[int, tuple[str, dict]]) -> bytes:
    """A document with paragraphs replaced; ``texts`` maps ``p_index`` to tagged text and tags."""
    return Document(data).written(texts)


def merged_paragraphs(df: DataFrame) -> DataFrame:
    """``path, p_index, text, tags``: the sentences of each paragraph joined, the translation where there is one.

    ``df`` has the columns of the source and ``target``.
    """
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (path, index), part in pdf.sort_values("sub_index").groupby(["path", "p_index"]):
            parts = [(t if t else s, json.loads(x or "{}") | {"source": s}) for s, t, x in zip(part["text"], part["target"], part["tags"])]
            text, tags = tagging.merged(parts)
            rows.append((path, index, text, json.dumps(tags, ensure_ascii=False)))
        return pd.DataFrame(rows, columns=["path", "p_index", "text", "tags"])

    # a paragraph's sentences are a handful of rows
    return (df.filter("error is null").select("path", "p_index", "sub_index", "text", F.col("target").cast("string").alias("target"), "tags")
            .groupBy("path", "p_index").applyInPandas(join, "path string, p_index int, text string, tags string"))


def write_docx(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """``path, content``: the documents under ``path`` with the translations of ``df`` (see ``merged_paragraphs``) put in."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def write(key, file: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if not len(file):
            return pd.DataFrame([], columns=["path", "content"])
        put = {int(i): (t, json.loads(x)) for i, t, x in zip(texts["p_index"], texts["text"], texts["tags"])}
        return pd.DataFrame([(key[0], Document(file["content"].iloc[0]).written(put))], columns=["path", "content"])

    return files.groupBy("path").cogroup(merged_paragraphs(df).groupBy("path")).applyInPandas(write, "path string, content binary")
