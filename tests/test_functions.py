"""Functions without SQL counterpart: properties and worked examples."""

import random

from hypothesis import given, settings, strategies as st

from tmloom.functions import diff, tags
from tmloom.functions.similarity import lcs_length, ratio

text = st.text(alphabet="ab c\n", max_size=30)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(text, text)
def test_similarity(a, b):
    assert lcs_length(a, b) == lcs(a, b)
    assert 0 <= ratio(a, b) <= 100 and ratio(a, a) == 100 and ratio(None, a) is None


@settings(max_examples=200, deadline=None)
@given(text, text)
def test_markup_keeps_both_sides(a, b):
    m = diff.markup(a, b, "x", "2024")
    assert diff.side(m, True) == b and diff.side(m, False) == a


@settings(max_examples=200, deadline=None)
@given(st.lists(text, min_size=1, max_size=4))
def test_accumulated_ends_at_the_last_stage(stages):
    import re

    m = diff.accumulate([(t, f"a{n}", "") for n, t in enumerate(stages)])
    inner = re.compile(r'(?s)<del author="a\d" date="">(?:<ins author="a\d" date="">)?.*?(?:</ins>)?</del>')
    final = re.sub(r'</?ins[^>]*>', "", inner.sub("", m))
    assert final == stages[-1]


def test_tags():
    assert tags.repair(["a <1>b", "c</1> d"]) == ["a <1>b</1>", "<1>c</1> d"]
    assert tags.strip_wrappers("<1><2>all</2></1>", {"1": "bold", "2": "italic"}) == ("all", ["1", "2"])
    assert tags.strip_wrappers("x <3></3>", {"3": "footnote"}) == ("x <3></3>", [])
    assert tags.merge_adjacent("<1>a</1><2>b</2> c", lambda a, b: True) == "<1>ab</1> c"
    assert tags.label([1, 2, 3, 7, 9, 10]) == "1-3,7,9,10"
    t = "a<1><2>b</2></1>c<3/>"
    short, known = tags.compress(t)
    assert tags.decompress(short, known) == t and tags.decompress("x<955/>", {}) == "x"


def test_repair_balances():
    random.seed(3)
    for _ in range(200):
        body, open_ = "", []
        for _ in range(12):
            if open_ and random.random() < 0.5:
                body += f"</{open_.pop()}>"
            else:
                open_.append(str(random.randint(1, 5)))
                body += f"<{open_[-1]}>"
            body += random.choice(["x", " "])
        body += "".join(f"</{t}>" for t in reversed(open_))
        cut = sorted(random.sample(range(len(body)), 2))
        if any(body[:c].rfind("<") > body[:c].rfind(">") for c in cut):
            continue
        parts = tags.repair([body[:cut[0]], body[cut[0]:cut[1]], body[cut[1]:]])
        assert all(tags.balanced(x) for x in parts)


def test_errors_marks_and_prompts(spark):
    from pyspark.sql import functions as F

    from tmloom.functions import replies, text as T

    errors = ["429 quota exceeded", "429 too many", "503 unavailable", "Connection reset", "bad key", None]
    got = [r.c for r in spark.createDataFrame([(n, e) for n, e in enumerate(errors)], "n int, e string").orderBy("n").select(T.error_class(F.col("e")).alias("c")).collect()]
    assert got == ["quota", "transient", "transient", "transient", "other", "other"]
    m = spark.createDataFrame([("a <ins>b</ins> <del>c</del>",)], "m string").select(diff.annotated(F.col("m"), 'A "B"', "d")).first()[0]
    assert m == 'a <ins author="A &quot;B&quot;" date="d">b</ins> <del author="A &quot;B&quot;" date="d">c</del>'
    p = spark.createDataFrame([("src", ["m1", "m2", "m3", "m4"], [], "")], "s string, m array<string>, t array<string>, b string").select(
        replies.prompt(F.col("s"), F.col("m"), F.col("t"), F.col("b"), "Be brief")).first()[0]
    assert p == "Be brief\n\nMatches:\nm1\nm2\nm3\n\nText: src"
    assert replies.parsed('[{"id": 1, "target": "a"}, {"segment_id": "2", "translation": "b"}]', ["1", "2"]) == {"1": "a", "2": "b"}
    assert replies.parsed('{"items": [{"id": "1", "target": "a"}]}', ["1"]) == {"1": "a"} and replies.parsed("[1, 2", ["1", "2"]) == {}
