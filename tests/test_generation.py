"""Replies, batched calls, sequential folds, editor markup and streams."""

import json

import pytest

from tmloom.functions import editor, replies
from tmloom.operators import generation, tm
from tmloom.streaming import usage


@pytest.mark.parametrize("reply, want", [
    ('{"1": "a", "2": "b"}', {"1": "a", "2": "b"}), ('Sure:\n```json\n{"1": "a"}\n```', {"1": "a"}), ('{"1": "say "x" now", "2": "b"', {"1": 'say "x" now', "2": "b"}),
    ('{"1": "line\nbreak",}', {"1": "line\nbreak"}), ('"1": "a" and "9": "z"', {"1": "a"}), ("plain", {}), (None, {}), ("", {})])
def test_parsed(reply, want):
    assert replies.parsed(reply, ["1", "2"]) == want


def test_plain_reply_for_one():
    assert replies.parsed("Hallo", ["7"]) == {"7": "Hallo"}


def test_missing_answers_are_asked_for_in_halves():
    calls = []

    def model(batch):
        calls.append(len(batch))
        return json.dumps({i: t.upper() for i, t in batch[:2]})

    got = generation.ask(model, [(str(i), "x") for i in range(9)])
    assert len(got) == 9 and calls[0] == 9

    def failing(batch):
        raise TimeoutError

    assert generation.ask(failing, [("1", "x")], pause=0) == {}
    with pytest.raises(generation.QuotaExceeded):
        generation.ask(lambda b: (_ for _ in ()).throw(generation.QuotaExceeded()), [("1", "x")])


def test_generated_and_sequential(spark):
    df = spark.createDataFrame([(str(i), f"t{i % 3}" if i else None) for i in range(40)], "id string, text string")
    got = generation.generated(df).collect()
    assert len(got) == 39 and all(r.output.startswith("DE: t") and r.error is None for r in got)
    rows = spark.createDataFrame([("g", i, str(i), "ab"[i % 2]) for i in range(6)] + [(None, 0, "x", "y")], "group string, idx int, id string, text string")
    out = {r.id: r.output for r in generation.sequential(rows, lambda t, seen: f"{t}{len(seen)}").collect()}
    assert out == {"0": "a0", "1": "b1", "2": "a0", "3": "b1", "4": "a0", "5": "b1"}


def test_editor():
    t = "A <1>b & c</1> d\nnext"
    assert editor.from_html(editor.to_html(t)) == t
    assert editor.highlighted("Red fox and red foxes, big red fox", ["red", "red fox"]) == "<mark>Red fox</mark> and <mark>red</mark> foxes, big red fox"


def test_reinitialise(spark):
    schema = "id string, project_id string, file_id string, idx int, source string"
    old = spark.createDataFrame([("o1", "p", "f", 0, "A"), ("o2", "p", "f", 1, "A"), ("o3", "p", None, 2, "B"), ("o4", "p", "f", 3, "<1>C</1>"), ("o5", "p", None, 4, "D <2/>"), ("o6", "q", "f", 0, "E")], schema)
    new = spark.createDataFrame([("n1", "p", "f", 0, "A "), ("n2", "p", "f", 1, "A"), ("n3", "p", "f", 2, "A"), ("n4", "p", "f", 3, "B"), ("n5", "p", "f", 4, "C"), ("n6", "p", "g", 0, "D"), ("n7", "p", "f", 5, "E")], schema)
    got = {r.new_id: (r.old_id, r.tier) for r in tm.reinitialise(old, new).collect()}
    assert got == {"n1": ("o1", 1), "n2": ("o2", 1), "n4": ("o3", 2), "n5": ("o4", 3), "n6": ("o5", 4)}


def test_streams(spark, sf, tmp_path):
    import shutil

    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf}/events.parquet", folder / "events.parquet")
    q = usage.hourly(usage.read_events(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    batch = usage.hourly(spark.read.parquet(f"{sf}/events.parquet"))
    assert spark.table("hourly").count() == batch.count()
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", None), ("c", None)], "key string, digest string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = usage.changed_rows(spark.readStream.schema("key string, digest string").parquet(str(tmp_path / "in")), "key", "digest")
    q = s.writeStream.outputMode("append").format("memory").queryName("changed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("changed").collect())) == [("a", "1"), ("b", "2"), ("c", None)]


def test_sequential_goes_on_over_long_groups(spark):
    """What a row sees does not depend on how many rows came before it."""
    rows = spark.createDataFrame([("g", i, f"{i:05d}", f"t{i}" if i != 4000 else "t0") for i in range(4001)] + [("h", 0, "h", "t0")], "group string, idx int, id string, text string").repartition(5)
    step = lambda t, seen: f"{t}<{seen[-1][0] if seen else ''}"
    out = {r.id: r.output for r in generation.sequential(rows, step, memory=2).collect()}
    assert out["00000"] == "t0<" and out["02048"] == "t2048<t2047" and out["03999"] == "t3999<t3998" and out["04000"] == "t0<" and out["h"] == "t0<"
