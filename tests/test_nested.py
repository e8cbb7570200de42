"""Nested metadata: the structural index against a JSON parser."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from tmloom.functions.jsonindex import JsonIndex
from tmloom.operators.nested import flatten_metadata, nested_rows, unwrap


def brute(text):
    try:
        j = json.loads(text.lstrip("﻿"))
        while isinstance(j, str):
            j = json.loads(j)
    except Exception:
        return set()
    if not isinstance(j, dict):
        return set()
    listed = lambda v: list(enumerate(v)) if isinstance(v, list) else [(0, v)] if isinstance(v, dict) else []
    md = j.get("metadata") if isinstance(j.get("metadata"), dict) else {}
    out = {(n, "", str(i)) for n in ("revisions", "revision_stages") for i, x in listed(md.get(n)) if x is not None}
    for i, x in listed(j.get("context_matches")):
        if x is not None:
            out.add(("context_matches", "", str(i)))
            if isinstance(x, dict) and isinstance(x.get("metadata"), dict):
                out |= {("match_metadata", str(i), k) for k, v in x["metadata"].items() if v is not None}
    t = j.get("tags")
    one = isinstance(t, dict) and isinstance(t.get("id"), (str, int, float)) and not isinstance(t.get("id"), bool)
    pairs = [(str(t["id"]), t)] if one else t.items() if isinstance(t, dict) else [(str(x["id"]), x) for x in t if isinstance(x, dict) and isinstance(x.get("id"), (str, int))] if isinstance(t, list) else []
    for k, x in pairs:
        if x is not None:
            out.add(("tags", "", k))
            if isinstance(x, dict) and isinstance(x.get("xml_attributes"), dict):
                out |= {("tag_attributes", k, a) for a, v in x["xml_attributes"].items() if v is not None}
    return out


def mine(texts):
    out = [set() for _ in texts]
    for r, *row in nested_rows([unwrap(t) for t in texts]):
        out[r].add(tuple(row))
    return out


key = st.sampled_from(["a", "w:val", "é\"\\", "id2", "{[:,", ""])
leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(-1, 1), st.text(alphabet='ab{}[],:"\\é\n', max_size=6))
deep = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(key, c, max_size=3)), max_leaves=8)
tag = st.fixed_dictionaries({"type": leaf}, optional={"xml_attributes": st.one_of(st.none(), st.dictionaries(key, deep, max_size=3)), "x": deep})
tags = st.one_of(st.none(), st.dictionaries(key, st.one_of(st.none(), tag), max_size=3),
                 st.lists(st.one_of(st.none(), st.builds(lambda t, i: t | {"id": i}, tag, st.one_of(st.integers(0, 9), st.sampled_from(["1", "b"])))), max_size=3))
match = st.one_of(st.none(), st.fixed_dictionaries({"id": leaf}, optional={"metadata": st.one_of(st.none(), st.dictionaries(key, deep, max_size=3))}))
matches = st.one_of(st.none(), match, st.lists(match, max_size=3))
revs = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.dictionaries(key, deep, max_size=2)), max_size=3), st.dictionaries(key, leaf, min_size=1, max_size=2))
doc = st.fixed_dictionaries({}, optional={"tags": tags, "context_matches": matches, "extra": deep,
                                          "metadata": st.fixed_dictionaries({}, optional={"revisions": revs, "revision_stages": revs, "p": deep})})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(doc, st.integers(0, 5), st.booleans()), min_size=1, max_size=5))
def test_against_parser(docs):
    texts = []
    for d, form, ascii_ in docs:
        t = json.dumps(d, ensure_ascii=ascii_, separators=((",", ":") if form % 2 else (", ", ": ")), indent=1 if form == 4 else None)
        texts.append({2: json.dumps(t), 3: "﻿" + t, 5: t[: len(t) * 2 // 3]}.get(form, t))
    assert mine(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("bad", ['{"tags": {"1": {}}', '{"tags": {"1": {}}}}', '{"tags": {"1": {]}}', '{"tags" {"1": {}}}', '{"tags": {"1": {}} x}', '{"tags": {"1": {}}} {}',
                                 '{"tags": {"1": }}', '[{"tags": {"1": {}}}]', '{"tags": {"1": {}},}', '{"tags: {"1": {}}}', "", "null", '"', '"{"'])
def test_unreadable(bad):
    assert mine([bad, '{"tags": {"7": {}}}']) == [set(), {("tags", "", "7")}]


def test_long_and_empty():
    assert mine([]) == []
    many = {"tags": {str(i): {"xml_attributes": {"a": "{" * 50}} for i in range(3000)}}
    assert len(mine([json.dumps(many)])[0]) == 6000
    assert not JsonIndex([b"", b" "]).ok.any()


def test_deliveries(spark):
    rows = [("a", '{"tags": {"1": {}}}', 1), ("a", '{"tags": {"1": {}}}', 2), ("b", None, 1), (None, '{"tags": {"x": {}}}', 1)]
    df = spark.createDataFrame(rows, "id string, metadata_json string, segment_id int")
    assert sorted((r.segment_id or "", r.child_key) for r in flatten_metadata(df).collect()) == [("", "x"), ("a", "1")]
