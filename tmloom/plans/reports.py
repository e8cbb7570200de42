"""Named queries of reports, navigation, changes to tables and usage over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmloom.functions import scoring as S, text as T
from tmloom.operators import lifecycle as L, ordered as O
from tmloom.plans.base import CHUNK, FILE, LOG, META, PROJECT, SEG, TU, Registry, chunks, files, logs, projects, segments, strip_sql, tags_sql, units
from tmloom.operators.dates import readable_json
from tmloom.session import table

Q = Registry()
QUERIES, ORACLES = Q.queries, Q.oracles

_DONE = "('translated', 'approved', 'completed', 'auto_propagated')"


@Q.add(f"""SELECT p.id, coalesce(s.total, 0) AS total, coalesce(s.done, 0) AS done, (CASE WHEN coalesce(s.total, 0) > 0 THEN floor(s.done / s.total * 100) ELSE 0 END)::INTEGER AS progress
       FROM {PROJECT} p LEFT JOIN (SELECT project_id, count(*) AS total, count(*) FILTER (status IN {_DONE}) AS done FROM {SEG} GROUP BY 1) s ON s.project_id = p.id""")
def project_progress(spark, d):
    s = segments(spark, d).groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("translated", "approved", "completed", "auto_propagated")).alias("done"))
    j = projects(spark, d).select("id").join(s.withColumnRenamed("project_id", "id"), "id", "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    return j.select("id", total.alias("total"), done.alias("done"), S.percent(done, total).alias("progress"))


@Q.add(f"""SELECT file_id, count(*) AS visible, count(*) FILTER (status IN ('translated', 'approved')) AS done, floor(count(*) FILTER (status IN ('translated', 'approved')) / count(*) * 100 + 0.5)::INTEGER AS progress
       FROM {SEG} WHERE file_id IS NOT NULL GROUP BY 1""")
def view_progress(spark, d):
    done = F.count_if(F.col("status").isin("translated", "approved"))
    return segments(spark, d).filter("file_id is not null").groupBy("file_id").agg(F.count("*").alias("visible"), done.alias("done"), S.percent_rounded(done, F.count("*")).alias("progress"))


@Q.add(f"""SELECT project_id, count(source) AS n_texts, sum(length({strip_sql(tags_sql('source'))}))::BIGINT AS n_chars,
       sum(len(list_filter(regexp_split_to_array({strip_sql(tags_sql('source'))}, '{T.WS}+'), lambda x: x <> '')))::BIGINT AS n_words FROM {SEG} WHERE source <> '' GROUP BY 1""")
def word_char_counts(spark, d):
    c = F.col("source")
    return segments(spark, d).filter("source <> ''").groupBy("project_id").agg(
        F.count("source").alias("n_texts"), F.sum(F.length(T.strip(T.strip_tags(c)))).alias("n_chars"), F.sum(T.word_count(c)).cast("bigint").alias("n_words"))


@Q.add(f"SELECT f.id, f.category, coalesce(s.n, 0) AS n_segments, coalesce(c.n, 0) AS n_chunks, c.n IS NULL AS without_chunks FROM {FILE} f LEFT JOIN (SELECT file_id, count(*) AS n FROM {SEG} GROUP BY 1) s ON s.file_id = f.id "
       f"LEFT JOIN (SELECT file_id, count(*) AS n FROM {CHUNK} GROUP BY 1) c ON c.file_id = f.id")
def files_with_counts(spark, d):
    count = lambda df, n: df.filter("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias(n))
    return (files(spark, d).select("id", "category").join(count(segments(spark, d), "s"), "id", "left").join(count(chunks(spark, d), "c"), "id", "left")
            .select("id", "category", F.coalesce("s", F.lit(0)).alias("n_segments"), F.coalesce("c", F.lit(0)).alias("n_chunks"), F.col("c").isNull().alias("without_chunks")))


@Q.add(f"SELECT f.id, f.filename FROM {FILE} f WHERE f.category IN ('legal', 'background') AND NOT EXISTS (SELECT 1 FROM {CHUNK} c WHERE c.file_id = f.id)")
def files_to_ingest(spark, d):
    """Context files without any chunk yet."""
    return files(spark, d).filter(F.col("category").isin("legal", "background")).join(chunks(spark, d).select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "filename")


@Q.add(f"SELECT model_id, project_id, sum(greatest(input_tokens, 0))::BIGINT AS input_tokens, sum(greatest(output_tokens, 0))::BIGINT AS output_tokens, count(*) AS calls FROM {LOG} GROUP BY 1, 2")
def usage_by_model(spark, d):
    pos = lambda c: F.sum(F.greatest(F.col(c), F.lit(0))).alias(c)
    return logs(spark, d).groupBy("model_id", "project_id").agg(pos("input_tokens"), pos("output_tokens"), F.count("*").alias("calls"))


@Q.add(f"SELECT model_id, trigger_type, sum(greatest(input_tokens, 0))::BIGINT AS input_tokens, count(*) AS calls FROM {LOG} GROUP BY ROLLUP (model_id, trigger_type)")
def usage_totals(spark, d):
    return logs(spark, d).rollup("model_id", "trigger_type").agg(F.sum(F.greatest("input_tokens", F.lit(0))).alias("input_tokens"), F.count("*").alias("calls"))


@Q.add(f"""SELECT l.project_id, count(*) AS calls, count(s.id) AS calls_on_segments, count(DISTINCT l.segment_id) AS n_segments FROM {LOG} l LEFT JOIN {SEG} s ON lower(s.id) = l.segment_id GROUP BY 1""")
def usage_per_project(spark, d):
    s = segments(spark, d).select(F.lower("id").alias("segment_id"), F.lit(1).alias("hit"))
    return logs(spark, d).join(s, "segment_id", "left").groupBy("project_id").agg(F.count("*").alias("calls"), F.count("hit").alias("calls_on_segments"), F.countDistinct("segment_id").alias("n_segments"))


_FLAGS = f"(SELECT id, j ->> '$.metadata.type' = 'comment' AS is_comment, coalesce(CAST(j ->> '$.metadata.skip' AS BOOLEAN), false) AS skip, coalesce(CAST(j ->> '$.metadata.flagged' AS BOOLEAN), false) AS flagged, j IS NOT NULL AND json_type(j, '$.metadata.revisions') IS NOT NULL AS tracked FROM {META})"


def _flags(spark, d):
    v = table(spark, d, "segments").filter("metadata_json is not null").select("id", "metadata_json").distinct().select("id", readable_json(F.col("metadata_json")).alias("v"))
    flag = lambda p: F.coalesce(F.try_variant_get("v", p, "boolean"), F.lit(False))
    return v.select("id", (F.try_variant_get("v", "$.metadata.type", "string") == "comment").alias("is_comment"), flag("$.metadata.skip").alias("skip"), flag("$.metadata.flagged").alias("flagged"),
                    F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.metadata.revisions", "variant")).isNotNull(), F.lit(False)).alias("tracked"))


@Q.add(f"""SELECT s.project_id, count(*) FILTER (s.target IS NULL OR s.target = '') AS empty, count(*) FILTER (s.status IN ('draft', 'mt_draft')) AS drafts, count(*) FILTER (f.flagged) AS flagged,
       coalesce(bool_or(f.tracked), false) AS any_tracked FROM {SEG} s LEFT JOIN {_FLAGS} f ON f.id = s.id WHERE NOT coalesce(f.is_comment, false) AND NOT coalesce(f.skip, false) GROUP BY 1""")
def qa_counts(spark, d):
    j = segments(spark, d).join(_flags(spark, d), "id", "left").filter("not coalesce(is_comment, false) and not coalesce(skip, false)")
    return j.groupBy("project_id").agg(F.count_if(F.col("target").isNull() | (F.col("target") == "")).alias("empty"), F.count_if(F.col("status").isin("draft", "mt_draft")).alias("drafts"),
                                       F.count_if("flagged").alias("flagged"), F.coalesce(F.bool_or("tracked"), F.lit(False)).alias("any_tracked"))


@Q.add(f"SELECT s.id, s.idx FROM {SEG} s LEFT JOIN {_FLAGS} f ON f.id = s.id WHERE s.file_id IS NOT NULL AND NOT coalesce(f.is_comment, false)")
def view_filter(spark, d):
    """The rows of the file view without comments."""
    return segments(spark, d).filter("file_id is not null").join(_flags(spark, d).filter("is_comment").select("id"), "id", "left_anti").select("id", "idx")


@Q.add(f"SELECT project_id, (coalesce(max(idx), -1) + 1)::INTEGER AS next_index FROM {SEG} GROUP BY 1")
def next_index(spark, d):
    return segments(spark, d).groupBy("project_id").agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("next_index"))


_S = f"(SELECT * FROM {SEG} WHERE project_id IS NOT NULL AND idx IS NOT NULL)"


@Q.add(f"""SELECT id, coalesce(min(CASE WHEN target IS NULL OR target = '' THEN idx END) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
       min(CASE WHEN target IS NULL OR target = '' THEN idx END) OVER (PARTITION BY project_id)) AS next_issue FROM (SELECT project_id, idx, min(id) AS id, min(target) AS target FROM {_S} GROUP BY 1, 2)""")
def next_issue(spark, d):
    """The next row without a target, from the start again after the last."""
    s = segments(spark, d).filter("project_id is not null and idx is not null").groupBy("project_id", "idx").agg(F.min("id").alias("id"), F.min("target").alias("target"))
    issue = F.when(F.col("target").isNull() | (F.col("target") == ""), F.col("idx"))
    ahead = O.last_values(s.withColumn("back", -F.col("idx")), ["project_id"], "back", "id", issue, 1, "n")
    first = s.groupBy("project_id").agg(F.min(issue).alias("first_issue"))
    return ahead.join(first, "project_id").select("id", F.coalesce(F.get("n", F.lit(0)), F.col("first_issue")).alias("next_issue"))


@Q.add(f"SELECT project_id, coalesce(min(idx) FILTER (status IN ('draft', 'mt_draft', 'error') OR target IS NULL OR target = ''), min(idx)) AS first_unfinished FROM {_S} GROUP BY 1")
def first_unfinished(spark, d):
    todo = F.col("status").isin("draft", "mt_draft", "error") | F.col("target").isNull() | (F.col("target") == "")
    return segments(spark, d).filter("project_id is not null and idx is not null").groupBy("project_id").agg(F.coalesce(F.min(F.when(todo, F.col("idx"))), F.min("idx")).alias("first_unfinished"))


@Q.add(f"""SELECT id, coalesce(array_to_string(list(id) OVER (PARTITION BY project_id ORDER BY idx, id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), ','), '') AS ahead FROM {_S}""")
def lookahead(spark, d):
    """The next five rows of the project."""
    p = O.positions(segments(spark, d), ["project_id"], "idx", "id")
    return O.framed(p.select("project_id", "position", "id"), ["project_id"], "position", {"a": (F.col("id"), 1, 5)}, "id").select("id", F.array_join("a", ",").alias("ahead"))


@Q.add(f"""WITH r AS (SELECT project_id, idx, id, sha256(coalesce(status, '') || chr(31) || coalesce(target, '') || chr(31)) AS l, floor(coalesce(idx, -1) / 1024) AS b FROM {SEG} WHERE project_id IS NOT NULL),
       h AS (SELECT project_id, b, count(*) AS n, sha256(string_agg(l, '' ORDER BY idx NULLS FIRST, id, l)) AS h FROM r GROUP BY 1, 2)
       SELECT project_id, sum(n)::BIGINT AS rows, substr(sha256(string_agg(h, '' ORDER BY b)), 1, 16) AS fingerprint FROM h GROUP BY 1""")
def content_fingerprint(spark, d):
    return L.fingerprint(segments(spark, d), "project_id", ["idx", "id"], ["status", "target"])


@Q.add(f"SELECT id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY uploaded_at DESC, id) AS rn FROM {FILE} WHERE project_id IS NOT NULL) WHERE rn > 2")
def backup_rotation(spark, d):
    """Files beyond the newest two of a project."""
    return L.outdated(files(spark, d), "project_id", F.struct((-F.unix_micros(F.col("uploaded_at").cast("timestamp"))).alias("t"), "id"), 2).select("id", "project_id")


@Q.add(f"SELECT id, source AS target FROM {SEG}")
def copy_source(spark, d):
    return L.copied_source(segments(spark, d)).select("id", "target")


@Q.add(f"SELECT id, CASE WHEN coalesce(status IN ('draft', 'mt_draft', 'error'), false) THEN NULL ELSE target END AS target FROM {SEG}")
def clear_drafts(spark, d):
    return L.cleared(segments(spark, d)).select("id", "target")


@Q.add(f"SELECT s.id, coalesce(u.target, s.target) AS target, s.status FROM {SEG} s LEFT JOIN (SELECT segment_id AS id, arg_max(CASE WHEN tc_base_translation <> '' THEN tc_base_translation END, request_id) FILTER (tc_base_translation <> '') AS target FROM tc_requests GROUP BY 1) u ON u.id = s.id")
def update_segments(spark, d):
    """Targets replaced by the last requested translation that is not empty."""
    u = table(spark, d, "tc_requests").filter("tc_base_translation <> ''").select(F.col("segment_id").alias("id"), F.col("tc_base_translation").alias("target"), "request_id").distinct()
    return L.patched(segments(spark, d).select("id", "target", "status"), u, "id", "request_id")


_NEW = "substr(sha256('copy/' || {0}), 1, 32)"


@Q.add(f"SELECT {_NEW.format('id')} AS id, {_NEW.format('project_id')} AS project_id, CASE WHEN file_id IS NOT NULL THEN {_NEW.format('file_id')} END AS file_id, idx, source FROM {SEG}")
def duplicate_project(spark, d):
    """All segments as a copy with new ids and mapped references."""
    return L.duplicated(segments(spark, d).select("id", "project_id", "file_id", "idx", "source"), "copy", {"id": None, "project_id": None, "file_id": None})


@Q.add(f"SELECT s.id, s.project_id FROM {SEG} s WHERE s.project_id IS NULL OR s.project_id NOT IN (SELECT id FROM {PROJECT} WHERE archived)")
def delete_projects(spark, d):
    """The segments that stay when archived projects are deleted."""
    gone = projects(spark, d).filter("archived").select("id")
    return L.without(segments(spark, d), "project_id", gone).select("id", "project_id")


@Q.add(f"SELECT id, project_id, source_text FROM {TU} WHERE project_id IN (SELECT id FROM {PROJECT} WHERE rag_progress >= 50)")
def units_of_projects(spark, d):
    ready = projects(spark, d).filter("rag_progress >= 50").select(F.col("id").alias("project_id"))
    return units(spark, d).join(ready, "project_id", "left_semi").select("id", "project_id", "source_text")


@Q.add("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def usage_tumbling(spark, d):
    """Extension: events per hour and type, as the streaming query gives them."""
    from tmloom.streaming.usage import hourly

    return hourly(table(spark, d, "events")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", "total")


@Q.add("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000 THEN 1 ELSE 0 END AS st FROM events),
       g AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, g""")
def usage_sessions(spark, d):
    """Extension: sessions of a user with gaps of at most half an hour."""
    from tmloom.streaming.usage import user_sessions

    return user_sessions(table(spark, d, "events")).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")
