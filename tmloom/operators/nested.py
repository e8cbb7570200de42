"""Flat tables of nested segment metadata, with parent and child keys.

One pass of the structural index (``functions.jsonindex``) over each Arrow batch
gives all child tables at once: keys and places, and where values are wanted the span
of each element. ``flat_table`` makes one typed table of them.

Defined cases: null, empty, unreadable and cut-off texts and texts that are no
object give no rows; text that encodes JSON once more is read, also behind a
byte-order mark; of a key that occurs twice in one object the last counts; a
single object stands for a list of one; null entries give no row and keep their
place; an element of a tag list without ``id`` gives no row; deliveries of one
record give one set of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tmloom.functions.jsonindex import ARR, OBJ, JsonIndex
from tmloom.operators.dates import UNWRAPS

SCHEMA = "segment_id string, child_table string, parent_key string, child_key string"
VALUES = SCHEMA + ", value string"
_ARROW = pa.schema([(c, pa.string()) for c in ("segment_id", "child_table", "parent_key", "child_key")])


def unwrap(text: str | None) -> bytes:
    """The bytes of the innermost JSON text; empty if a wrapped text is unreadable."""
    if not text:
        return b""
    text = text.lstrip("﻿")
    for _ in range(UNWRAPS):
        if text.lstrip(" \t\r\n﻿")[:1] != '"':
            break
        try:
            text = json.loads(text.lstrip(" \t\r\n﻿"))
        except ValueError:
            return b""
    return text.lstrip("﻿").encode("utf-8", "replace")


def nested_rows(texts: list[bytes]) -> list[tuple[int, str, str, str]]:
    """``(row, child_table, parent_key, child_key)`` of every nested element of a batch."""
    return [r[:4] for r in located_rows(JsonIndex(texts))]


def located_rows(ix: JsonIndex) -> list[tuple[int, str, str, str, int]]:
    """``(row, child_table, parent_key, child_key, token before the value)`` of every nested element of a batch."""
    out: list[tuple[int, str, str, str, int]] = []
    m = ix.pos.size
    if not m:
        return out
    inside = lambda d, i: ix.inside[d][i]

    def value_by_row(depth: int, name: str, within: np.ndarray | None) -> np.ndarray:
        """Per row the first token of the value of a key, -1 if none; ``within``: the object token per row."""
        i, lo, hi = ix.keys(depth)
        hit = ix.named(lo, hi, name)
        i = i[hit]
        if within is not None:
            i = i[inside(depth, i) == within[ix.row[i]]]
        tok, _ = ix.value_of(i)
        at = np.full(ix.n, -1)
        at[ix.row[i]] = tok
        return at

    def listed(depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the lists or single objects at ``at``: row, place, first token and the token before of each element that is not null."""
        own = at[at >= 0]
        single = own[ix.kind[own] == OBJ]
        arr, place, tok, null, before = ix.elements(depth)
        sel = (at[ix.row[arr]] == arr) & ~null if arr.size else np.zeros(0, bool)
        rows = np.concatenate([ix.row[single], ix.row[arr[sel]]])
        return rows, np.concatenate([np.zeros(single.size, np.int64), place[sel]]), np.concatenate([single, tok[sel]]), np.concatenate([single - 1, before[sel]])

    meta = value_by_row(1, "metadata", None)
    for name in ("revisions", "revision_stages"):
        rows, place, _, before = listed(3, value_by_row(2, name, meta))
        out += [(r, name, "", str(p), b) for r, p, b in zip(rows.tolist(), place.tolist(), before.tolist())]

    matches = value_by_row(1, "context_matches", None)
    rows, place, tok, before = listed(2, matches)
    out += [(r, "context_matches", "", str(p), b) for r, p, b in zip(rows.tolist(), place.tolist(), before.tolist())]
    for depth, sel in ((2, (tok >= 0) & (tok == matches[rows])), (3, (tok >= 0) & (tok != matches[rows]))):
        label = np.full(m, -1)
        label[tok[sel]] = place[sel]
        _children(ix, out, label, depth, "metadata", "match_metadata", lambda x: str(x))

    tags = value_by_row(1, "tags", None)
    own = tags[tags >= 0]
    names: list[str] = []
    entry = np.full(m, -1)  # by the token of the tag's object: its place in names
    i, lo, hi = ix.keys(2)
    in_map = inside(2, i) == tags[ix.row[i]]
    i, lo, hi = i[in_map], lo[in_map], hi[in_map]
    # an object that has a plain id itself is one tag, not a map of tags
    tok, null = ix.value_of(i)
    idk = np.zeros(i.size, bool)
    idk[ix.named(lo, hi, "id")] = True
    idk &= ~null & ((tok < 0) | ix.opening[np.maximum(tok, 0)])
    lone = np.zeros(m, bool)
    lone[inside(2, i[idk])] = True
    mapped = ~lone[inside(2, i)] & ~null
    last: dict[tuple[int, str], tuple[int, int]] = {}
    for r, a, b, t, k in zip(ix.row[i[mapped]].tolist(), lo[mapped].tolist(), hi[mapped].tolist(), tok[mapped].tolist(), (i[mapped] + 2).tolist()):
        last[r, ix.text(a, b)] = (k, t)
    depth_of: dict[int, list[int]] = {2: [], 3: []}
    for (r, name), (k, t) in last.items():
        out.append((r, "tags", "", name, k))
        if t >= 0:
            entry[t] = len(names)
            depth_of[3].append(t)
        names.append(name)
    # lists of objects with their id, and the lone object
    arr, _, tok3, _, _ = ix.elements(2)
    in_list = (arr == tags[ix.row[arr]]) & (tok3 >= 0) if arr.size else np.zeros(0, bool)
    objects = tok3[in_list]
    for depth, tokens in ((3, objects[ix.kind[objects] == OBJ]), (2, own[lone[own]])):
        mine = np.zeros(m, bool)
        mine[tokens] = True
        k, klo, khi = ix.keys(depth)
        hit = ix.named(klo, khi, "id")
        k = k[hit]
        k = k[mine[inside(depth, k)]]
        vtok, vnull = ix.value_of(k)
        for key, t, nul in zip(k.tolist(), vtok.tolist(), vnull.tolist()):
            if nul or (t >= 0 and not ix.opening[t]):
                continue
            a, b = (ix.pos[t] + 1, ix.pos[t + 1]) if t >= 0 else (ix.pos[key + 2] + 1, ix.pos[key + 3])
            name = ix.text(int(a), int(b)) if t >= 0 else ix.text(int(a), int(b)).strip()
            box = int(inside(depth, key))
            out.append((int(ix.row[key]), "tags", "", name, box - 1))
            entry[box] = len(names)
            names.append(name)
            depth_of[depth].append(box)
    for depth, boxes in depth_of.items():
        label = np.full(m, -1)
        label[boxes] = entry[boxes]
        _children(ix, out, label, depth, "xml_attributes", "tag_attributes", names.__getitem__)
    return out


def _children(ix: JsonIndex, out: list, label: np.ndarray, depth: int, key: str, child_table: str, parent) -> None:
    """Add the keys of the object under ``key`` of every labelled object at ``depth``."""
    if depth + 1 > ix.levels:
        return
    k, lo, hi = ix.keys(depth)
    k = k[ix.named(lo, hi, key)]
    k = k[label[ix.inside[depth][k]] >= 0]
    tok, _ = ix.value_of(k)
    owner = ix.inside[depth][k]
    final = np.full(ix.pos.size, -1)
    final[owner] = tok  # of a repeated key the last counts
    box = final[owner]
    box_ok = (box >= 0) & (box == tok)
    k, tok, owner = k[box_ok], tok[box_ok], owner[box_ok]
    obj = ix.kind[tok] == OBJ
    of = np.full(ix.pos.size, -1)
    of[tok[obj]] = label[owner[obj]]
    c, clo, chi = ix.keys(depth + 1)
    mine = of[ix.inside[depth + 1][c]]
    _, null = ix.value_of(c)
    sel = (mine >= 0) & ~null
    out += [(r, child_table, parent(p), ix.text(a, b), t) for r, p, a, b, t in
            zip(ix.row[c[sel]].tolist(), mine[sel].tolist(), clo[sel].tolist(), chi[sel].tolist(), (c[sel] + 2).tolist())]


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [unwrap(t) for t in batch.column(1).to_pylist()]
        rows = nested_rows(texts)
        cols = ([ids[r[0]] for r in rows], *([r[c] for r in rows] for c in (1, 2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=_ARROW)


def _values(child_table: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ix = batch.column(0).to_pylist(), JsonIndex([unwrap(t) for t in batch.column(1).to_pylist()])
            # of a key that occurs again the last counts
            last = {r[:4]: r[4] for r in located_rows(ix) if r[1] == child_table}
            lo, hi = ix.spans(np.array(list(last.values()), np.int64)) if last else ((), ())
            cols = ([ids[r] for r, *_ in last], *([k[c] for k in last] for c in (1, 2, 3)), [ix.value(int(a), int(b)) for a, b in zip(lo, hi)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=_ARROW.append(pa.field("value", pa.string())))
    return run


def _source(segments: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return segments.select(F.col(id_col).cast("string").alias("segment_id"), F.col(json_col).alias("text")).filter(
        F.col("text").contains("{") & (F.col("text").contains("tags") | F.col("text").contains("context_matches") | F.col("text").contains("revision") | F.col("text").contains("\\u00")))


def flatten_metadata(segments: DataFrame, id_col: str = "id", json_col: str = "metadata_json") -> DataFrame:
    """``segment_id, child_table, parent_key, child_key``: one row per nested element."""
    return _source(segments, id_col, json_col).mapInArrow(_flatten, SCHEMA).distinct()


#: the columns of the flat tables: what the parent and child keys are called, and the fields of an element with their types
TABLES: dict[str, tuple[str | None, str, dict[str, str]]] = {
    "tags": (None, "tag_id", {"type": "string", "ref_id": "string", "content": "string"}),
    "tag_attributes": ("tag_id", "name", {}),
    "revisions": (None, "pos", {"type": "string", "text": "string", "author": "string", "date": "string"}),
    "revision_stages": (None, "pos", {"stage": "int", "author": "string", "date": "string", "text": "string"}),
    "context_matches": (None, "pos", {"id": "string", "type": "string", "category": "string", "filename": "string", "content": "string", "source_text": "string", "note": "string",
                                      "score": "int", "raw_logit": "double"}),
    "match_metadata": ("match_pos", "name", {}),
}


def flat_table(segments: DataFrame, child_table: str, id_col: str = "id", json_col: str = "metadata_json") -> DataFrame:
    """One of ``TABLES`` with values: ``segment_id``, the keys, and the fields, or ``value`` where an element is a plain value.

    A field that an element lacks, or that is not of its type, is null; deliveries of one
    record give one set of rows.
    """
    parent, child, fields = TABLES[child_table]
    rows = _source(segments, id_col, json_col).mapInArrow(_values(child_table), VALUES).distinct()
    place = lambda c, name: F.col(c).cast("int").alias(name) if name in ("pos", "match_pos") else F.col(c).alias(name)
    keys = ["segment_id", *([place("parent_key", parent)] if parent else []), place("child_key", child)]
    if not fields:
        return rows.select(*keys, "value")
    return rows.select(*keys, F.try_parse_json("value").alias("v")).select(
        "segment_id", child, *[F.try_variant_get("v", f"$.{f}", t).alias(f) for f, t in fields.items()])
