"""Tracked changes of segments: who changed what when, and the text after each session of changes.

A segment's changes are one list within its record, so the windows below run over a
handful of rows each.

Defined cases: unreadable metadata gives no rows; a fragment without text counts as empty;
changes without a readable date belong to no session, and their text is in no stage; equal
instants keep their order.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tmloom.functions import diff, text as T
from tmloom.functions.instants import with_instant
from tmloom.operators.dates import revision_dates
from tmloom.operators.nested import flat_table

GAP_SECONDS = 300
_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d{1,6})?Z?$"


def iso_instant(c: Column) -> Column:
    """Microseconds of an ISO date with a time of day, its zone mark ignored; null for anything else."""
    plain = F.concat(F.regexp_extract(c, _ISO, 1), F.lit(" "), F.regexp_extract(c, _ISO, 2), F.when(F.regexp_extract(c, _ISO, 3) != "", F.regexp_extract(c, _ISO, 3)).otherwise(":00"),
                     F.regexp_extract(c, _ISO, 4))
    return F.when(c.rlike(_ISO), F.unix_micros(F.try_to_timestamp(plain)))


def fragments(segments: DataFrame, normalised: bool = False) -> DataFrame:
    """``segment_id, pos, type, text, author, date, us``: the changes of segments with their instants.

    Either ISO dates as they stand, or ``normalised`` ones, where every way of writing and
    the zone of the document count.
    """
    rows = flat_table(segments, "revisions")
    if not normalised:
        return rows.withColumn("us", iso_instant(F.col("date")))
    at = with_instant(revision_dates(segments).filter("origin = 'revision'"), "text", "zone", "locale").groupBy(
        F.col("record_id").alias("segment_id"), F.col("pos").cast("int").alias("pos")).agg(F.min("utc_us").alias("us"))
    return rows.join(at, ["segment_id", "pos"], "left")


def with_sessions(frags: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """``frags`` with ``session``: 1 for the first, a new one after a gap or with another author; null if undated or no change."""
    dated = frags.filter("us is not null and type in ('ins', 'del')")
    w = Window.partitionBy("segment_id").orderBy("us", "pos")
    new = F.lag("us").over(w).isNull() | (F.col("us") - F.lag("us").over(w) >= gap_seconds * 1_000_000) | ~F.lag("author").over(w).eqNullSafe(F.col("author"))
    numbered = dated.withColumn("new", new.cast("int")).select("segment_id", "pos", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("session"))
    return frags.join(numbered, ["segment_id", "pos"], "left")


def sessions(frags: DataFrame) -> DataFrame:
    """``segment_id, session, author, date, changes``: of each session its author, the date of its first change and how many it has."""
    return with_sessions(frags).filter("session is not null").groupBy("segment_id", "session").agg(
        F.min_by("author", F.struct("us", "pos")).alias("author"), F.min_by("date", F.struct("us", "pos")).alias("date"), F.count("*").alias("changes"))


def stage_texts(frags: DataFrame) -> DataFrame:
    """``segment_id, stage, text``: the text before all sessions (stage 0) and after each.

    What was there all along, what sessions up to the stage put in, and what later ones take out.
    """
    s = with_sessions(frags)
    listed = s.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", F.coalesce("text", F.lit("")).alias("text"), "session"))).alias("f"), F.max("session").alias("last"))
    staged = listed.filter("last is not null").select("segment_id", "f", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("stage"))
    there = F.filter("f", lambda x: (x["type"] == "normal") | ((x["type"] == "ins") & (x["session"] <= F.col("stage"))) | ((x["type"] == "del") & (x["session"] > F.col("stage"))))
    return staged.select("segment_id", "stage", T.strip(F.array_join(F.transform(there, lambda x: x["text"]), "")).alias("text"))


Translate = Callable[[DataFrame], DataFrame]


def translated_stages(stages: DataFrame, translate: Translate) -> DataFrame:
    """``segment_id, stages``: the stages of a segment (``segment_id, stage, text, author, date``) in order with their translations, as ``text, author, date``.

    ``translate`` takes ``id, text`` and gives ``id, output``; blank stages are not sent and stay blank.
    """
    key = F.concat_ws("\x1f", "segment_id", F.col("stage").cast("string"))
    asked = stages.withColumn("id", key)
    out = translate(asked.filter(T.strip(F.col("text")) != "").select("id", "text")).select("id", "output")
    done = asked.join(out, "id", "left").select("segment_id", F.struct("stage", F.coalesce("output", F.lit("")).alias("text"), "author", "date").alias("s"))
    return done.groupBy("segment_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        "segment_id", F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["author"].alias("author"), x["date"].alias("date"))).alias("stages"))


def first_and_last(stages: DataFrame, translate: Translate) -> DataFrame:
    """``segment_id, base, final, markup``: the first stage with a text and the last one translated, and the changes between the two."""
    done = translated_stages(stages, translate)
    filled = F.filter("stages", lambda x: x["text"] != "")
    pair = done.select("segment_id", F.get(filled, F.lit(0))["text"].alias("base"), F.element_at("stages", -1)["text"].alias("final"))
    return pair.withColumn("markup", diff.change_markup(F.col("base"), F.col("final")))


def step_by_step(stages: DataFrame, translate: Translate) -> DataFrame:
    """``segment_id, markup, valid``: every stage translated, and all as one document of marked changes by their authors."""
    done = translated_stages(stages, translate)
    return done.select("segment_id", diff.accumulated(F.col("stages")).alias("markup"))


def shown_stage(stage: Column, base: Column, markups: Column, target: Column) -> Column:
    """What a stage shows: beyond the base its own marked text if there is one, else the target."""
    return F.when(stage > base, F.coalesce(F.try_element_at(markups, stage.cast("string")), target)).otherwise(target)


def _letters(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff.letter_changes(a, b) for a, b in zip(old, new)], dtype=object)


def letter_changes(old: Column, new: Column) -> Column:
    """``diff.letter_changes`` of two columns, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(_letters, "string")(old, new)
