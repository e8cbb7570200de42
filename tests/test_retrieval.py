"""Combined retrieval, tracked changes and models: brute force, worked examples, defined cases."""

import random

import pytest

from tmloom.functions import diff, tags, text as T
from tmloom.functions.embedding import embedded
from tmloom.functions.similarity import ratio
from tmloom.operators import glossary, lifecycle as L, models, retrieval as R, revisions as V, tm, topk
from tmloom.streaming import usage

SEG = "id string, project_id string, file_id string, idx int, source string, target string, status string"


def segments(spark, n=300):
    rng = random.Random(3)
    words = "the report on water supply of school kitchen budget annex costs rises falls was approved".split()
    rows = []
    for i in range(n):
        t = " ".join(rng.choices(words, k=rng.randint(1, 7)))
        if i % 3 == 0 and rows:
            t = list(rng.choice(rows)[4] or "x")
            t[rng.randrange(len(t))] = rng.choice("xyzé ")
            t = "".join(t)
        rows.append((f"s{i:03d}", f"p{i % 3}", "f", i, t, "t", rng.choice(["translated", "mt_draft", "draft"])))
    return rows + [("n1", None, "f", 1, "the report", "t", "translated"), ("n2", "p0", "f", 1, None, "t", "translated"), ("n3", "p0", "f", 1, "", "t", "translated")]


def test_fuzzy_search_against_brute(spark, monkeypatch):
    rows = segments(spark)
    df = spark.createDataFrame(rows, SEG)
    q = [r for r in rows if r[0] < "s060"]
    want = {(a[0], b[0], int(ratio(a[4], b[4]))) for a in q for b in rows if a[1] and a[1] == b[1] and a[0] != b[0] and b[6] != "draft" and a[4] and b[4] is not None and len(a[4]) >= 5 and a[4] != b[4] and ratio(a[4], b[4]) >= 80}
    monkeypatch.setattr(R, "QUERY_BLOCK", 25)
    got = {tuple(r) for r in R.fuzzy_search(df.filter("id < 's060' and project_id is not null and source is not null"), df).collect()}
    assert got == want and len(want) > 20


def test_internal_matches(spark):
    a = spark.createDataFrame([("q", "x", 95), ("q", "y", 90), ("q", "z", 85)], "id string, ref_id string, score int")
    b = spark.createDataFrame([("q", "x", 60), ("q", "v", 99), ("q", "w", 10), ("r", "v", 70)], "id string, ref_id string, score int")
    got = sorted(map(tuple, R.internal_matches(a, b).collect()))
    assert got == [("q", "v", 99, 1), ("q", "x", 95, 2), ("q", "y", 90, 3), ("r", "v", 70, 1)]


def test_scoped_topk(spark):
    rng = random.Random(1)
    vec = lambda: [float(rng.randint(0, 3)) for _ in range(6)] + [1.0]
    rows = [(f"v{i:02d}", f"p{i % 2}", vec()) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, scope string, vec array<double>").repartition(3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(a[0], b[0], n) for a in rows for n, b in enumerate(sorted((b for b in rows if b[1] == a[1] and b[0] != a[0]), key=lambda b: (-round(cos(a[2], b[2]), 9), b[0]))[:5], 1)}
    got = {(r.query_id, r.id, r["rank"]) for r in topk.cosine_topk(df, df, 5, scoped=True).collect()}
    assert got == want
    assert {(r.query_id, r.id, r["rank"]) for r in topk.cosine_topk(df, df, 5, blocks=4, scoped=True).collect()} == want


REV = "id string, metadata_json string"


def changes(spark, items):
    import json
    return V.fragments(spark.createDataFrame([("s", json.dumps({"metadata": {"revisions": items}}))], REV))


def item(kind, text, author=None, date=None):
    return {"type": kind, "text": text, "author": author, "date": date}


def test_sessions_and_stage_texts(spark):
    f = changes(spark, [item("normal", "The "), item("ins", "big ", "A", "2024-01-01T10:00:00Z"), item("del", "cat", "A", "2024-01-01T10:04:59Z"), item("ins", "dog", "A", "2024-01-01T10:09:59Z"),
                        item("normal", " sat"), item("ins", "!", "B", "2024-01-01T10:10:00Z"), item("ins", "?", "B", None)])
    assert sorted((r.session, r.author, r.date, r.changes) for r in V.sessions(f).collect()) == [
        (1, "A", "2024-01-01T10:00:00Z", 2), (2, "A", "2024-01-01T10:09:59Z", 1), (3, "B", "2024-01-01T10:10:00Z", 1)]
    assert [r.text for r in V.stage_texts(f).orderBy("stage").collect()] == ["The cat sat", "The big  sat", "The big dog sat", "The big dog sat!"]
    assert V.stage_texts(changes(spark, [item("normal", "x")])).count() == 0


def test_translated_stages(spark):
    rows = spark.createDataFrame([("s", 0, "", "a", "d0"), ("s", 1, "one", "b", "d1"), ("s", 2, "one two", "c", "d2")], "segment_id string, stage int, text string, author string, date string")
    up = lambda df: df.selectExpr("id", "upper(text) as output")
    r = V.first_and_last(rows, up).first()
    assert (r.base, r.final, r.markup) == ("ONE", "ONE TWO", "ONE<ins> TWO</ins>")
    assert V.step_by_step(rows, up).first().markup == '<ins author="b" date="d1">ONE</ins><ins author="c" date="d2"> TWO</ins>'
    shown = spark.createDataFrame([(0, 1, {"2": "m"}, "t"), (2, 1, {"2": "m"}, "t"), (3, 1, {"2": "m"}, "t")], "s int, b int, m map<string,string>, t string")
    assert [x[0] for x in shown.select(V.shown_stage(*[V.F.col(c) for c in "sbmt"])).collect()] == ["t", "m", "t"]


def test_accumulated_changes():
    got = diff.accumulate([("The cat sat", "", ""), ("The big cat sat", "A", "d1"), ("The cat stood", "B", "d2")])
    assert got == 'The<del author="B" date="d2"><ins author="A" date="d1"> big</ins></del> cat <del author="B" date="d2">sat</del><ins author="B" date="d2">stood</ins>'
    assert diff.letter_changes("a", "a") is None and diff.letter_changes("<b", "<c") == "&lt;<del>b</del><ins>c</ins>"


def test_mark_attributes(spark):
    m = spark.createDataFrame([('<ins author="A &amp; B" date="d">',)], "m string").select(diff.attributes(diff.F.col("m"))).first()[0]
    assert m == {"author": "A & B", "date": "d"}


def test_sentences(spark):
    t = 'At 1.5 and 1.200,50 it is. ...and so on. Dr. No met J. Smith am 5. März 2024. "Why?" he said! <1>Yes.</1> Then\n\nnew'
    want = ["At 1.5 and 1.200,50 it is. ...and so on. ", "Dr. No met J. Smith am 5. März 2024. ", '"Why?" he said! ', "<1>Yes.</1> ", "Then\n\n", "new"]
    assert T.split_sentences(t) == want
    assert [x for x in spark.createDataFrame([(t,)], "t string").select(T.sentence_parts(T.F.col("t"))).first()[0] if x] == want
    assert T.split_sentences("") == []
    assert spark.createDataFrame([("&eacute;&#8364;&amp;",), (None,)], "t string").select(T.html_unescaped(T.F.col("t"))).collect()[0][0] == "é€&"


def test_paragraph_defaults_and_merging():
    kinds, values = {"1": "font", "2": "bold"}, {"1": "Arial", "2": ""}
    assert tags.drop_defaults("<1>" + "word " * 20 + "</1><2>x</2>", kinds, values) == "word " * 20 + "<2>x</2>"
    assert tags.drop_defaults("<1>half</1> half", kinds, values) == "<1>half</1> half"
    parts = [("Eins", {"source": "One two <2/>", "2": {"type": "footnote"}, "wrappers": ["3"], "3": {"type": "bold"}, "space": ["", " "]}), ("Zwei", {"source": "<4/> Two more words", "4": {"type": "shape"}})]
    assert tags.merged(parts)[0] == "<3>Eins<2/></3> <4/>Zwei" and tags.merged([("<1>a</1>", {}), ("<1>b</1>", {})])[0] == "<1>ab</1>"
    assert tags.shown("<1><2>x</2></1>") == "<1,2>x</2,1>"
    assert tags.strip_wrappers("a <1> </1>b", {"1": "bold"}) == ("a  b", []) and tags.strip_wrappers("<1>a</1>", {"1": "link"}) == ("a", ["1"])


def test_models(spark):
    assert embedded("") is None and sum(embedded("A b a")) == 3
    by = models.provider()
    df = models.with_vectors(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "n int, t string"), "t", by)
    assert [(r.n, r.embedding is None) for r in df.orderBy("n").collect()] == [(1, False), (2, True), (3, True)]
    c = spark.createDataFrame([("q", "red fox", "red fox", True, None), ("q", "red fox", "red hen", False, 0.0), ("q", "red fox", "blue", False, 0.0)], "id string, query string, key string, exact boolean, raw double")
    raw = {r.key: r.raw for r in models.reranked(c, by).collect()}
    assert raw["red fox"] is None and raw["red hen"] > raw["blue"]
    assert [r.key for r in models.reranked(c, models.Provider()).collect()] == ["red fox"]
    assert models.internal_scores("a", ["a", "b"], models.Provider()) == [60, 60] and models.internal_scores("a", ["a"], by) == [100]
    got = models.extracted_terms(spark.createDataFrame([("s", "p", "Water Board met", "Das Wasser Amt tagte"), ("t", "p", None, "x")], "segment_id string, scope string, source string, target string"), by).collect()
    assert [tuple(r) for r in got] == [("s", "p", "Water", "Wasser")]
    with pytest.raises(KeyError):
        models.provider("none")
    models.register("other", by)
    assert models.provider("other") is by


def test_propagation_and_updates_leave_fixed_rows(spark):
    s = spark.createDataFrame([("a", "p", 0, "x", "X", False), ("b", "p", 1, "x", None, True), ("c", "p", 2, "x", "Y", False), ("d", "p", 3, "x", "", None)], "id string, project_id string, idx int, source string, target string, fixed boolean")
    assert {tuple(r) for r in tm.propagate(s, overwrite=True).collect()} == {("c", "X"), ("d", "X")}
    assert {tuple(r) for r in tm.propagate(s).collect()} == {("d", "X")}
    u = spark.createDataFrame([("a", "new"), ("b", "new")], "id string, new_target string")
    assert {(r.id, r.target, r.rejected) for r in L.guarded(s, u).collect()} == {("a", "new", False), ("b", None, True)}


def test_terms_of_many_words(spark):
    t = spark.createDataFrame([("t1", "p", "reports of the water supply companies"), ("t2", "p", "annex"), ("t3", "p", "...")], "term_id string, scope string, term string")
    s = spark.createDataFrame([("s", "p", "The report of the water supply company and its annexes")], "id string, scope string, source string")
    assert {tuple(r) for r in glossary.phrase_hits(s, t).collect()} == {("s", "t1", 1), ("s", "t2", 9)}


def test_conversation_history(spark):
    df = spark.createDataFrame([("c", 0, "user", "a"), ("c", 1, "bot", "b"), ("c", 2, "user", "c"), ("d", 0, "user", "x")], "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.turn): [h.text for h in r.history] for r in usage.conversations(df).collect()}
    assert got == {("c", 0): [], ("c", 1): ["a"], ("c", 2): ["a", "b"], ("d", 0): []}


def test_variants_results_and_tags(spark):
    from tmloom.operators import matches as M
    old = [("a", "mt", "pre"), ("b", "mt", "post"), ("c", "tm", None)]
    df = spark.createDataFrame([(old, [("n", "mt", "pre")])], "old array<struct<match_id string, kind string, variant string>>, fresh array<struct<match_id string, kind string, variant string>>")
    got = df.select(M.with_variant(V.F.col("old"), V.F.col("fresh"), "pre").alias("m")).first().m
    assert [x.match_id for x in got] == ["b", "c", "n"]
    s = spark.createDataFrame([("a", "x", "draft"), ("b", "y", "draft")], "id string, target string, status string")
    r = spark.createDataFrame([("a", "new"), ("b", " ")], "id string, output string")
    assert {tuple(x) for x in L.results_written(s, r).select("id", "target", "status").collect()} == {("a", "new", "mt_draft"), ("b", "y", "draft")}
    assert tags.accepted("<1>a</1>", "<1>b</1>") == "<1>b</1>" and tags.accepted("<1>a</1>", "<1>b") is None and tags.accepted("<1>a</1>", None) is None
    j = spark.createDataFrame([('{"a": 1, "b": [1]}', '{"b": null, "c": "x"}'), (None, '{"c": 1}'), ('{"a": 1}', "cut{")], "o string, u string")
    import json
    assert [json.loads(x[0]) for x in j.select(L.merged_json(V.F.col("o"), V.F.col("u"))).collect()] == [{"a": 1, "b": None, "c": "x"}, {"c": 1}, {"a": 1}]


def test_default_model(spark):
    from tmloom.sources import catalogue
    m = spark.createDataFrame([(0, "big", "mt"), (1, "flash-1", "mt"), (2, "back", "bg")], "pos int, id string, usage string")
    assert catalogue.default_model(m, "flash-1") == "flash-1" and catalogue.default_model(m, "back", "flash") == "flash-1" and catalogue.default_model(m, "no") == "big"
    assert catalogue.default_model(m.limit(0)) is None


def test_empty_tables_and_nulls(spark):
    s = spark.createDataFrame(segments(spark, 30), SEG)
    none = s.limit(0)
    units = spark.createDataFrame([(1, "p0", "the report", "x", "user", "clash"), (2, "p0", None, "x", None, None), (3, "p0", "the report", "", "mandatory", None)],
                                  "id long, project_id string, source_text string, target_text string, origin_type string, source string")
    chunks = spark.createDataFrame([("c", "f", None, None, 0), ("d", None, "the report", None, None)], "id string, file_id string, content string, rich_content string, chunk_index int")
    files = spark.createDataFrame([("f", "p0", None)], "id string, project_id string, category string")
    terms = spark.createDataFrame([("t", "p0", "..."), ("u", None, "report")], "term_id string, scope string, term string")
    q = spark.createDataFrame([("q", "p0", "f", 1, "the report", None, None)], SEG)
    got = R.combined(q, s, units, chunks, files, terms, R.internal_by_vector(q, s)).collect()
    assert [(r.kind, r.ref_id, r.score, r["rank"]) for r in got if r.part == 1] == [("tm", "1", 99, 1)] and not [r for r in got if r.part == 3]
    assert R.combined(none, s, units, chunks, files, terms, R.internal_by_vector(none, s)).count() == 0
    assert R.combined(q, none, units.limit(0), chunks.limit(0), files.limit(0), terms.limit(0), R.internal_by_vector(q, none)).count() == 0
    assert R.fuzzy_search(none, s).count() == 0 and R.fuzzy_search(q, none).count() == 0
