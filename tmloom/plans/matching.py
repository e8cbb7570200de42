"""Named queries of translation-memory matching and of the operators over segment order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmloom.functions import scoring as S, text as T
from tmloom.functions.keys import norm_key
from tmloom.operators import ordered as O, tm
from tmloom.operators.nested import flat_table
from tmloom.plans.base import CHUNK, META, SEG, TU, Registry, chunks, clean_sql, collapse_sql, json_list, k, segments, strip_sql, tags_sql, units
from tmloom.session import table

Q = Registry()
QUERIES, ORACLES = Q.queries, Q.oracles

_SCORE = "(CASE lower(origin_type) WHEN 'mandatory' THEN 100 WHEN 'user' THEN 99 ELSE 98 END)::INTEGER"


@Q.add(f"""SELECT s.id, u.id AS unit_id, u.target_text, u.score, row_number() OVER (PARTITION BY s.id ORDER BY u.score DESC, u.id)::INTEGER AS rank
       FROM {SEG} s JOIN (SELECT *, {_SCORE} AS score, {collapse_sql('source_text')} AS key FROM {TU} WHERE target_text <> '') u
       ON s.project_id = u.project_id AND {collapse_sql('s.source')} = u.key QUALIFY rank <= 5""")
def tm_exact_lookup(spark, d):
    return tm.exact_lookup(segments(spark, d), units(spark, d))


@Q.add(f"""SELECT s.id, u.id AS unit_id, u.target_text, u.score, row_number() OVER (PARTITION BY s.id ORDER BY u.score DESC, u.id)::INTEGER AS rank
       FROM {SEG} s JOIN (SELECT DISTINCT id, {k('project_id')} AS project_id, source_hash, target_text, {_SCORE} AS score FROM translation_units WHERE target_text <> '' AND source_text IS NOT NULL) u
       ON s.project_id = u.project_id AND sha256({strip_sql('s.source')}) = u.source_hash QUALIFY rank <= 5""")
def tm_strict_lookup(spark, d):
    u = table(spark, d, "translation_units").select("id", norm_key("project_id").alias("project_id"), "source_hash", "source_text", "target_text", "origin_type").distinct()
    return tm.exact_lookup(segments(spark, d), u, strict=True)


_CAND = f"""(SELECT project_id, {clean_sql('source_text')} AS key, id, target_text, row_number() OVER (PARTITION BY project_id ORDER BY id) AS pos,
       CASE WHEN lower(origin_type) = 'mandatory' THEN 3 WHEN lower(origin_type) = 'user' THEN 2 ELSE 1 END AS prio FROM {TU} WHERE project_id IS NOT NULL)"""


@Q.add(f"""SELECT project_id, key, arg_max(id, prio * 1e12 - pos) AS id, max(prio)::INTEGER AS prio, min(pos)::BIGINT AS first_position, count(*) AS candidates
       FROM {_CAND} GROUP BY 1, 2""")
def tm_priority_distinct(spark, d):
    u = O.positions(units(spark, d).withColumn("n", F.col("id")), ["project_id"], "n", "id", "pos", size=None).select(
        "project_id", T.clean(F.col("source_text")).alias("key"), "id", (F.col("pos") + 1).alias("pos"), tm.priority(F.lower("origin_type"), F.lit(False)).alias("prio"))
    best = tm.priority_distinct(u, ["project_id", "key"], "prio", "pos")
    n = u.groupBy("project_id", "key").agg(F.count("*").alias("candidates"))
    return best.join(n, ["project_id", "key"]).select("project_id", "key", "id", "prio", "first_position", "candidates")


@Q.add(f"SELECT id, project_id, count(*) OVER (PARTITION BY project_id, source) AS repetitions FROM {SEG} WHERE source IS NOT NULL AND project_id IS NOT NULL QUALIFY repetitions > 1")
def repetition_counts(spark, d):
    return tm.repetition_counts(segments(spark, d)).select("id", "project_id", "repetitions")


@Q.add(f"SELECT id, project_id, idx, count(*) OVER (PARTITION BY project_id, source) - 1 AS skipped FROM {SEG} WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, source ORDER BY idx, id) = 1")
def first_occurrences(spark, d):
    return tm.first_occurrences(segments(spark, d)).select("id", "project_id", "idx", "skipped")


_LEAD = f"(SELECT *, first(CASE WHEN target <> '' THEN struct_pack(i := id, t := target) END IGNORE NULLS) OVER (PARTITION BY project_id, source ORDER BY (target <> '') DESC NULLS LAST, idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM {SEG} WHERE source IS NOT NULL AND project_id IS NOT NULL)"


@Q.add(f"SELECT id, f.t AS new_target FROM {_LEAD} WHERE f IS NOT NULL AND f.i <> id AND (target IS NULL OR target = '')")
def propagate_to_empty(spark, d):
    return tm.propagate(segments(spark, d))


@Q.add(f"SELECT id, f.t AS new_target FROM {_LEAD} WHERE f IS NOT NULL AND f.i <> id")
def propagate_overwriting(spark, d):
    return tm.propagate(segments(spark, d), overwrite=True)


_OLD = f"(SELECT id AS old_id, project_id, {strip_sql('source')} AS key, row_number() OVER (PARTITION BY project_id, {strip_sql('source')} ORDER BY idx, id) AS n FROM {SEG} WHERE source IS NOT NULL AND project_id IS NOT NULL AND idx IS NOT NULL)"
_NEW = f"(SELECT id AS new_id, project_id, {strip_sql('source_text')} AS key, row_number() OVER (PARTITION BY project_id, {strip_sql('source_text')} ORDER BY id) AS n FROM {TU} WHERE source_text IS NOT NULL AND project_id IS NOT NULL)"
_MK = strip_sql("translate(" + tags_sql("key") + ", chr(8209) || chr(160), chr(45) || chr(32))")


@Q.add(f"""WITH o AS {_OLD}, n AS {_NEW}, f AS (SELECT new_id, old_id FROM n JOIN o USING (project_id, key, n)),
       o2 AS (SELECT project_id, {_MK} AS norm, min(old_id) AS old_id FROM o WHERE old_id NOT IN (SELECT old_id FROM f) GROUP BY 1, 2 HAVING count(*) = 1),
       n2 AS (SELECT project_id, {_MK} AS norm, min(new_id) AS new_id FROM n WHERE new_id NOT IN (SELECT new_id FROM f) GROUP BY 1, 2 HAVING count(*) = 1)
       SELECT new_id, old_id, 'exact' AS tier FROM f UNION ALL SELECT new_id, old_id, 'normalised' FROM n2 JOIN o2 USING (project_id, norm)""")
def rematch_versions(spark, d):
    new = units(spark, d).select("id", "project_id", F.col("id").alias("idx"), F.col("source_text").alias("source"))
    return tm.rematch(segments(spark, d), new)


def _ordered(spark, d):
    return segments(spark, d).filter("project_id is not null and idx is not null")


_S = f"(SELECT * FROM {SEG} WHERE project_id IS NOT NULL AND idx IS NOT NULL)"


@Q.add(f"""SELECT id, coalesce(array_to_string(list(source ORDER BY idx, id) FILTER (WHERE source IS NOT NULL) OVER (PARTITION BY project_id ORDER BY idx RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
       coalesce(array_to_string(list(source ORDER BY idx, id) FILTER (WHERE source IS NOT NULL) OVER (PARTITION BY project_id ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '|'), '') AS after FROM {_S}""")
def source_neighbours(spark, d):
    s = F.col("source")
    return O.framed(_ordered(spark, d), ["project_id"], "idx", {"b": (s, -3, -1), "a": (s, 1, 3)}, "id").select("id", F.array_join("b", "|").alias("before"), F.array_join("a", "|").alias("after"))


@Q.add(f"SELECT id, coalesce(array_to_string((list_filter(list(CASE WHEN target <> '' THEN id END) OVER (PARTITION BY project_id ORDER BY idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL))[-5:], '|'), '') AS history FROM {_S}")
def translation_history(spark, d):
    """The last five translated rows before each row."""
    return O.last_values(_ordered(spark, d), ["project_id"], "idx", "id", F.when(F.col("target") != "", F.col("id")), 5, "h").select("id", F.array_join("h", "|").alias("history"))


_RICH = "source || CASE WHEN target <> '' THEN ' [Trans: ' || target || ']' ELSE '' END"


@Q.add(f"SELECT id, coalesce(array_to_string((list({_RICH}) OVER (PARTITION BY project_id ORDER BY idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))[-3:], '|'), '') AS context FROM {_S} WHERE source IS NOT NULL")
def rich_preceding(spark, d):
    rich = F.concat("source", F.when(F.col("target") != "", F.concat(F.lit(" [Trans: "), "target", F.lit("]"))).otherwise(""))
    return O.last_values(_ordered(spark, d).filter("source is not null"), ["project_id"], "idx", "id", rich, 3, "h").select("id", F.array_join("h", "|").alias("context"))


@Q.add(f"SELECT id, lag(id) OVER (PARTITION BY file_id ORDER BY chunk_index, id) AS previous_id, lead(id) OVER (PARTITION BY file_id ORDER BY chunk_index, id) AS next_id FROM {CHUNK} WHERE chunk_index IS NOT NULL AND file_id IS NOT NULL")
def chunk_neighbours(spark, d):
    p = O.positions(chunks(spark, d), ["file_id"], "chunk_index", "id").select("file_id", "position", "id")
    at = lambda shift, name: p.select("file_id", (F.col("position") + shift).alias("position"), F.col("id").alias(name))
    return p.join(at(1, "previous_id"), ["file_id", "position"], "left").join(at(-1, "next_id"), ["file_id", "position"], "left").select("id", "previous_id", "next_id")


@Q.add(f"SELECT s.id, p.id AS preceding_id FROM {_S} s LEFT JOIN (SELECT project_id, idx, min(id) AS id FROM {_S} GROUP BY 1, 2) p ON p.project_id = s.project_id AND p.idx = s.idx - 1")
def preceding_segment(spark, d):
    s = _ordered(spark, d)
    p = s.groupBy("project_id", (F.col("idx") + 1).alias("idx")).agg(F.min("id").alias("preceding_id"))
    return s.join(p, ["project_id", "idx"], "left").select("id", "preceding_id")


@Q.add(f"""WITH t AS (SELECT DISTINCT project_id, idx FROM {_S} WHERE target IS NULL OR target = ''), r AS (SELECT *, idx - row_number() OVER (PARTITION BY project_id ORDER BY idx) AS g FROM t)
       SELECT project_id, idx, min(idx) OVER (PARTITION BY project_id, g) AS run_start, ((idx - min(idx) OVER (PARTITION BY project_id, g)) // 5)::BIGINT AS batch FROM r""")
def contiguous_batches(spark, d):
    """Runs of neighbouring untranslated rows, cut into batches of five."""
    return O.batches(_ordered(spark, d).filter("target is null or target = ''"), ["project_id"], "idx", 5)


@Q.add(f"SELECT id, project_id, (row_number() OVER (PARTITION BY project_id ORDER BY idx, id) - 1)::BIGINT AS position FROM {_S}")
def global_index(spark, d):
    return O.positions(_ordered(spark, d), ["project_id"], "idx", "id").select("id", "project_id", "position")


@Q.add("""WITH s AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 300000000 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, (sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM s""")
def revision_clusters(spark, d):
    """Runs of one author without a gap of five minutes."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return O.sessions(e, ["user_id"], "ts", "event_id", 300, "event_type").select("event_id", "user_id", "session")


_ST = f"(SELECT id AS segment_id, i - 1 AS stage, x ->> '$.text' AS text FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, {json_list('$.metadata.revision_stages')} AS l FROM {META})) WHERE json_type(x) <> 'NULL')"


@Q.add(f"SELECT a.segment_id, a.stage::INTEGER AS stage, b.stage::INTEGER AS earlier, greatest(99 - (a.stage - b.stage - 1) * 5, 70)::INTEGER AS score FROM {_ST} a JOIN {_ST} b ON a.segment_id = b.segment_id AND b.stage < a.stage AND {strip_sql('b.text')} <> ''")
def chain_scores(spark, d):
    """The earlier stages of a segment as matches for each later one, scored by their distance; blank ones are none."""
    s = flat_table(table(spark, d, "segments"), "revision_stages").select("segment_id", F.col("pos").alias("stage"), "text")
    b = s.filter(T.strip(F.col("text")) != "").select("segment_id", F.col("stage").alias("earlier"))
    return s.select("segment_id", "stage").join(b, "segment_id").filter("earlier < stage").select("segment_id", "stage", "earlier", S.chain_score(F.col("stage") - F.col("earlier")).alias("score"))


@Q.add(ORACLES["rematch_versions"].replace("SELECT new_id, old_id, 'exact' AS tier FROM f UNION ALL", "SELECT tier, count(*) AS rows FROM (SELECT new_id, old_id, 'exact' AS tier FROM f UNION ALL") + ") GROUP BY 1")
def rematch_summary(spark, d):
    return tm.summary(rematch_versions(spark, d))


@Q.add(f"""WITH o AS (SELECT id, project_id, file_id, {strip_sql('source')} AS key, row_number() OVER (PARTITION BY project_id, file_id, {strip_sql('source')} ORDER BY idx, id) AS n FROM {_S} WHERE source IS NOT NULL AND file_id IS NOT NULL)
       SELECT id AS new_id, id AS old_id, 1::INTEGER AS tier FROM o""")
def reinitialise_unchanged(spark, d):
    """Files parsed again without a change: every row finds itself."""
    s = segments(spark, d).filter("file_id is not null")
    return tm.reinitialise(s, s)
