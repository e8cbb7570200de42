"""Named queries of revision markup, exchange formats and functions in Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmloom.functions import diff, text as T
from tmloom.functions.similarity import indel_ratio
from tmloom.operators import revisions as V
from tmloom.operators.dates import readable_json
from tmloom.plans.base import SEG, Registry, segments, tags_sql
from tmloom.sources.tmx import tmx_units
from tmloom.session import table

Q = Registry()
QUERIES, ORACLES = Q.queries, Q.oracles


def _stages(spark, d):
    v = table(spark, d, "segments").filter(F.col("metadata_json").contains("revision_stages")).select("id", "metadata_json").distinct().select(
        "id", F.try_variant_get(readable_json(F.col("metadata_json")), "$.metadata.revision_stages", "variant").alias("m"))
    items = F.coalesce(F.try_variant_get("m", "$", "array<variant>"), F.when(F.schema_of_variant("m").startswith("OBJECT"), F.array("m")))
    get = lambda x, f: F.try_variant_get(x, f"$.{f}", "string").alias(f)
    return v.select("id", F.transform(F.filter(items, lambda x: ~F.is_variant_null(x)), lambda x: F.struct(get(x, "text"), get(x, "author"), get(x, "date"))).alias("stages")).filter(F.size("stages") > 0)


@Q.add()
def tc_markup(spark, d):
    """Word differences between the first and the last stage of a segment."""
    s = _stages(spark, d).select("id", F.element_at("stages", 1)["text"].alias("old"), F.element_at("stages", -1)["text"].alias("new"))
    return s.select("id", diff.change_markup(F.col("old"), F.col("new")).alias("markup"))


@Q.add()
def tc_accumulated(spark, d):
    """All stages of a segment as one document of marked changes."""
    return _stages(spark, d).select("id", diff.accumulated(F.col("stages")).alias("markup"))


@Q.add()
def revision_sessions(spark, d):
    """Revisions of a segment in sessions: one author, gaps under five minutes, by normalised instants."""
    s = V.with_sessions(V.fragments(table(spark, d, "segments"), normalised=True)).filter("session is not null")
    return s.select(F.col("segment_id").alias("record_id"), "pos", "author", F.col("us").alias("utc_us"), "session")


@Q.add()
def pair_similarity(spark, d):
    """Insertion-deletion similarity of source and target."""
    return segments(spark, d).filter("source is not null and target is not null").select("id", F.round(indel_ratio("source", "target"), 3).alias("ratio"))


_X = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@Q.add("SELECT '<tu><tuv xml:lang=\"en\"><seg>' || " + _X.format(tags_sql("source")) + " || '</seg></tuv><tuv xml:lang=\"de\"><seg>' || " + _X.format(tags_sql("target"))
       + f" || '</seg></tuv></tu>' AS line FROM {SEG} WHERE source <> '' AND target <> ''")
def tmx_lines(spark, d):
    return tmx_units(segments(spark, d))


@Q.add(f"""SELECT file_id, idx, string_agg(t, ' ' ORDER BY id) AS value, count(*) AS parts FROM (SELECT id, file_id, idx, {tags_sql("CASE WHEN target <> '' THEN target ELSE source END")} AS t FROM {SEG}
       WHERE file_id IS NOT NULL AND idx IS NOT NULL AND source IS NOT NULL) GROUP BY 1, 2""")
def merged_cells(spark, d):
    """The parts of each place of a file joined in order, the translation where there is one."""
    t = T.strip_tags(F.when(F.col("target") != "", F.col("target")).otherwise(F.col("source")))
    return segments(spark, d).filter("file_id is not null and idx is not null and source is not null").groupBy("file_id", "idx").agg(
        F.array_sort(F.collect_list(F.struct("id", t.alias("t")))).alias("s"), F.count("*").alias("parts")).select(
        "file_id", "idx", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("value"), "parts")
