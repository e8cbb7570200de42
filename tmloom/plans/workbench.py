"""Named queries of combined retrieval, navigation, exports and changes to whole projects."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tmloom.functions import text as T
from tmloom.functions.keys import norm_key
from tmloom.operators import generation, glossary, lifecycle as L, ordered as O, retrieval as R, revisions as V, tm
from tmloom.operators.dates import readable_json
from tmloom.operators.nested import flat_table
from tmloom.plans.base import CHUNK, FILE, LOG, META, PROJECT, SEG, TU, Registry, chunks, clean_sql, collapse_sql, files, json_list, k, logs, projects, segments, strip_sql, tags_sql, units
from tmloom.plans.retrieval import _ENTRY, _LEM, _entries
from tmloom.session import table

Q = Registry()
QUERIES, ORACLES = Q.queries, Q.oracles

_STATED = "('0x' || substr(md5(id), 1, 6))::INTEGER % 100 = 0 AND source IS NOT NULL AND project_id IS NOT NULL"
_HEX = "(instr('0123456789abcdef', substr(md5(w), 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(w), 2, 1)) - 1"
_VEC = f"list_transform(range(0, 64), lambda b: len(list_filter(list_transform(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: ({_HEX}) % 64), lambda x: x = b))::DOUBLE)"
_SCORED = "(CASE WHEN (raw - 0.75) / 0.24 <= 0 THEN 0 WHEN (raw - 0.75) / 0.24 >= 1 THEN 100 ELSE round_even(ln(1 + 9 * ((raw - 0.75) / 0.24)) / ln(10) * 100, 0) END)::INTEGER"


@Q.add(f"""WITH q AS (SELECT id, project_id, source, {_VEC.format('source')} AS v FROM {SEG} WHERE {_STATED}),
    e AS (SELECT q.id, u.id AS unit_id, u.source_text, CASE lower(u.origin_type) WHEN 'mandatory' THEN 100 WHEN 'user' THEN 99 ELSE 98 END AS score,
          row_number() OVER (PARTITION BY q.id ORDER BY CASE lower(u.origin_type) WHEN 'mandatory' THEN 100 WHEN 'user' THEN 99 ELSE 98 END DESC, u.id) AS pos
          FROM q JOIN {TU} u ON u.project_id = q.project_id AND u.target_text <> '' AND {collapse_sql('u.source_text')} = {collapse_sql('q.source')} QUALIFY pos <= 5),
    c AS (SELECT c.id, c.content, f.project_id, f.category, {_VEC.format('c.content')} AS v FROM {CHUNK} c JOIN {FILE} f ON f.id = c.file_id WHERE c.content IS NOT NULL AND f.project_id IS NOT NULL),
    n AS (SELECT q.id, c.id AS ref_id, c.content, CASE WHEN c.category = 'legal' THEN 'mandatory' ELSE 'optional' END AS kind, round(list_cosine_similarity(q.v, c.v), 9) AS raw,
          row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS rank FROM q JOIN c USING (project_id) WHERE list_sum(q.v) > 0 AND list_sum(c.v) > 0 QUALIFY rank <= 20),
    a AS (SELECT id, {clean_sql('source_text')} AS key, unit_id::VARCHAR AS ref_id, 'tm' AS kind, true AS exact, score, NULL::DOUBLE AS raw, pos, 4 AS prio FROM e
          UNION ALL SELECT id, {clean_sql('content')}, ref_id, kind, false, 0, raw, rank + 1000, CASE kind WHEN 'mandatory' THEN 3 ELSE 1 END FROM n),
    b AS (SELECT *, min(pos) OVER (PARTITION BY id, key) AS first_position FROM a QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY prio DESC, pos) = 1),
    s AS (SELECT *, CASE WHEN exact THEN score ELSE {_SCORED} END AS final FROM b),
    main AS (SELECT id, 1 AS part, kind, ref_id, final AS score, row_number() OVER (PARTITION BY id ORDER BY final DESC, first_position) AS rank FROM s
          WHERE exact OR final >= CASE kind WHEN 'mandatory' THEN 60 ELSE 40 END QUALIFY rank <= 5),
    m AS (SELECT id, project_id, source, {_VEC.format('source')} AS v FROM {SEG} WHERE target <> '' AND status IN ('translated', 'mt_draft') AND source IS NOT NULL AND project_id IS NOT NULL),
    i AS (SELECT q.id, m.id AS ref_id, q.source AS qs, m.source AS ms, round(list_cosine_similarity(q.v, m.v), 9) AS c FROM q JOIN m ON m.project_id = q.project_id AND m.id <> q.id WHERE list_sum(q.v) > 0 AND list_sum(m.v) > 0
          QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, m.v), 9) DESC, m.id) <= 20),
    own AS (SELECT id, 2 AS part, 'internal' AS kind, ref_id, floor(round(c * 100, 6)) AS score, row_number() OVER (PARTITION BY id ORDER BY floor(round(c * 100, 6)) DESC, ref_id) AS rank FROM i WHERE c >= 0.5 AND qs <> ms QUALIFY rank <= 3),
    t AS (SELECT term_id, scope, array_to_string({_LEM.format('term')}, ' ') AS phrase FROM {_ENTRY}), tn AS (SELECT DISTINCT scope, len(string_split(phrase, ' ')) AS n FROM t),
    w AS (SELECT id, project_id AS scope, {_LEM.format(tags_sql('source'))} AS w FROM q),
    r AS (SELECT id, scope, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM w JOIN tn USING (scope), unnest(range(1, len(w) + 1)) AS u(i) WHERE i + n - 1 <= len(w)),
    h AS (SELECT id, term_id, min(i) AS word_at FROM r JOIN t USING (scope, phrase) WHERE phrase <> '' GROUP BY 1, 2)
    SELECT id, part::INTEGER AS part, kind, ref_id, score::INTEGER AS score, rank::INTEGER AS rank FROM (SELECT * FROM main UNION ALL SELECT * FROM own
    UNION ALL SELECT id, 3, 'glossary', term_id, 100, row_number() OVER (PARTITION BY id ORDER BY word_at, term_id) FROM h)""")
def combined_retrieval(spark, d):
    """Everything a segment is offered: exact and vector matches, the project's own translations, the glossary."""
    s = segments(spark, d)
    q = R.stated(s)
    return R.combined(q, s, units(spark, d), chunks(spark, d), files(spark, d), _entries(spark, d), R.internal_by_vector(q, s))


@Q.add()
def fuzzy_search(spark, d):
    """For the stated segments, every usable segment of the project at 80 percent or more."""
    s = segments(spark, d)
    return R.fuzzy_search(R.stated(s), s)


@Q.add()
def internal_matches(spark, d):
    """The best three of the project's own translations, by letters and by vector."""
    s = segments(spark, d)
    q = R.stated(s)
    return R.internal_matches(R.fuzzy_search(q, s), R.internal_by_vector(q, s))


@Q.add(f"SELECT f.category, count(*) AS n_chunks, count(DISTINCT f.project_id) AS n_projects FROM {CHUNK} c JOIN {FILE} f ON f.id = c.file_id GROUP BY 1")
def chunk_categories(spark, d):
    f = files(spark, d).select(F.col("id").alias("file_id"), "project_id", "category")
    return chunks(spark, d).join(f, "file_id").groupBy("category").agg(F.count("*").alias("n_chunks"), F.countDistinct("project_id").alias("n_projects"))


_C = f"(SELECT * FROM {CHUNK} WHERE chunk_index IS NOT NULL AND file_id IS NOT NULL)"


@Q.add(f"""SELECT id, coalesce(array_to_string(list(id ORDER BY chunk_index, id) OVER (PARTITION BY file_id ORDER BY chunk_index RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
       coalesce(array_to_string(list(id ORDER BY chunk_index, id) OVER (PARTITION BY file_id ORDER BY chunk_index RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS after FROM {_C}""")
def chunk_context(spark, d):
    """The chunks up to two places before and after."""
    c = chunks(spark, d).select("id", "file_id", "chunk_index")
    return O.framed(c, ["file_id"], "chunk_index", {"b": (F.col("id"), -2, -1), "a": (F.col("id"), 1, 2)}, "id").select("id", F.array_join("b", "|").alias("before"), F.array_join("a", "|").alias("after"))


@Q.add(f"""WITH n AS (SELECT project_id, filename, category, min(id) AS new_id FROM {FILE} GROUP BY 1, 2, 3)
       SELECT f.id, n.new_id FROM {FILE} f JOIN n ON n.project_id = f.project_id AND n.filename = f.filename AND n.category = f.category""")
def file_remap(spark, d):
    """Each file and the first file of its name and category in the project, as a copy finds its files again."""
    f = files(spark, d)
    first = f.groupBy("project_id", "filename", "category").agg(F.min("id").alias("new_id"))
    return f.join(first, ["project_id", "filename", "category"]).select("id", "new_id")


@Q.add(f"""SELECT s.id, s.project_id, (row_number() OVER (PARTITION BY s.project_id ORDER BY f.uploaded_at, f.id, s.idx, s.id) - 1)::BIGINT AS position
       FROM {SEG} s JOIN {FILE} f ON f.id = s.file_id WHERE s.project_id IS NOT NULL AND s.idx IS NOT NULL AND f.uploaded_at IS NOT NULL""")
def file_order_index(spark, d):
    """One running number over a project's files in the order of upload: the place in the file, and the rows of the files before."""
    f = files(spark, d).filter("uploaded_at is not null").select(F.col("id").alias("file_id"), "uploaded_at")
    s = segments(spark, d).filter("project_id is not null and idx is not null").join(f, "file_id").select("id", "project_id", "file_id", "idx", "uploaded_at")
    inner = O.positions(s, ["project_id", "file_id"], "idx", "id")
    w = Window.partitionBy("project_id").orderBy("uploaded_at", "file_id").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file of a project
    before = s.groupBy("project_id", "file_id", "uploaded_at").agg(F.count("*").alias("n")).select("project_id", "file_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"))
    return inner.join(before, ["project_id", "file_id"]).select("id", "project_id", (F.col("position") + F.col("earlier")).alias("position"))


_FLAG = "coalesce(CAST(j ->> '$.metadata.{0}' AS BOOLEAN), false)"
_FIXED = f"(SELECT id, {_FLAG.format('locked')} OR {_FLAG.format('skip')} OR {_FLAG.format('propagation_excluded')} AS fixed, coalesce(j ->> '$.metadata.type' = 'comment', false) AS is_comment, {_FLAG.format('is_done')} AS is_done, {_FLAG.format('reviewed')} AS reviewed FROM {META} WHERE json_type(j) = 'OBJECT')"
_FSEG = f"(SELECT s.*, coalesce(f.fixed, false) AS fixed, coalesce(f.is_comment, false) AS is_comment, coalesce(f.is_done, false) AS is_done, coalesce(f.reviewed, false) AS reviewed FROM {SEG} s LEFT JOIN {_FIXED} f ON f.id = s.id)"


def _flagged(spark, d):
    """The segments with the flags of their metadata; what is unreadable has none."""
    v = table(spark, d, "segments").filter("metadata_json is not null").select("id", "metadata_json").distinct().select("id", readable_json(F.col("metadata_json")).alias("v"))
    flag = lambda p: F.coalesce(F.try_variant_get("v", f"$.metadata.{p}", "boolean"), F.lit(False))
    flags = v.select("id", (flag("locked") | flag("skip") | flag("propagation_excluded")).alias("fixed"), F.coalesce(F.try_variant_get("v", "$.metadata.type", "string") == "comment", F.lit(False)).alias("is_comment"),
                     flag("is_done").alias("is_done"), flag("reviewed").alias("reviewed"))
    off = [F.coalesce(c, F.lit(False)).alias(c) for c in ("fixed", "is_comment", "is_done", "reviewed")]
    s = segments(spark, d)
    return s.join(flags, "id", "left").select(*s.columns, *off)


_NAV = f"(SELECT project_id, idx, min(id) AS id, bool_or(NOT fixed) AS free, bool_or(NOT fixed AND (target IS NULL OR target = '')) AS open FROM {_FSEG} WHERE project_id IS NOT NULL AND idx IS NOT NULL GROUP BY 1, 2)"


@Q.add(f"""SELECT id, last_value(CASE WHEN free THEN idx END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_idx,
       first_value(CASE WHEN free THEN idx END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_idx,
       first_value(CASE WHEN open THEN idx END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open FROM {_NAV}""")
def navigation(spark, d):
    """From each place the free places before and after it, and the next one without a target."""
    s = _flagged(spark, d).filter("project_id is not null and idx is not null").groupBy("project_id", "idx").agg(
        F.min("id").alias("id"), F.bool_or(~F.col("fixed")).alias("free"), F.bool_or(~F.col("fixed") & (F.col("target").isNull() | (F.col("target") == ""))).alias("open"))
    at = lambda flag: F.when(F.col(flag), F.col("idx"))
    back = O.last_values(s, ["project_id"], "idx", "id", at("free"), 1, "p").withColumn("back", -F.col("idx"))
    ahead = O.last_values(back, ["project_id"], "back", "id", at("free"), 1, "n")
    return O.last_values(ahead, ["project_id"], "back", "id", at("open"), 1, "o").select(
        "id", F.get("p", F.lit(0)).alias("previous_idx"), F.get("n", F.lit(0)).alias("next_idx"), F.get("o", F.lit(0)).alias("next_open"))


@Q.add(f"SELECT project_id, id FROM {LOG} WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY logged_at DESC, id) <= 5")
def usage_tail(spark, d):
    """The last five calls of each project."""
    latest = logs(spark, d).filter("project_id is not null").select("project_id", F.struct((-F.unix_micros(F.col("logged_at").cast("timestamp"))).alias("t"), "id").alias("u"))
    return tm.smallest(latest, ["project_id"], "u", 5).select("project_id", F.explode("best").alias("u")).select("project_id", F.col("u.id").alias("id"))


@Q.add(f"SELECT project_id, count(*) AS n, count(*) FILTER (reviewed) AS n_reviewed, floor(count(*) FILTER (reviewed) / count(*) * 100 + 0.5)::INTEGER AS progress FROM {_FSEG} GROUP BY 1")
def review_progress(spark, d):
    n, done = F.count("*"), F.count_if("reviewed")
    return _flagged(spark, d).groupBy("project_id").agg(n.alias("n"), done.alias("n_reviewed"), F.floor(done / n * 100 + 0.5).cast("int").alias("progress"))


@Q.add(f"SELECT id, true AS shown_with_all, NOT is_comment OR NOT is_done AS shown_with_active, NOT is_comment AS shown_with_none FROM {_FSEG}")
def comment_modes(spark, d):
    """Whether a row is shown with all comments, the open ones, or none."""
    c = F.col("is_comment")
    return _flagged(spark, d).select("id", F.lit(True).alias("shown_with_all"), (~c | ~F.col("is_done")).alias("shown_with_active"), (~c).alias("shown_with_none"))


_STAGED = f"(SELECT id, len(list_filter({json_list('$.metadata.revision_stages')}, lambda x: json_type(x) <> 'NULL')) AS n FROM {META})"


@Q.add(f"SELECT s.id FROM {SEG} s LEFT JOIN {_STAGED} t ON t.id = s.id WHERE coalesce(t.n, 0) < 2 AND {strip_sql('s.source')} <> '' AND coalesce({strip_sql('s.target')}, '') = ''")
def regular_segments(spark, d):
    """Rows without stages of changes that have a source and still no target."""
    staged = flat_table(table(spark, d, "segments"), "revision_stages").groupBy(F.col("segment_id").alias("id")).agg(F.count("*").alias("n")).filter("n >= 2")
    s = segments(spark, d).filter((T.strip(F.col("source")) != "") & (F.coalesce(T.strip(F.col("target")), F.lit("")) == ""))
    return s.join(staged, "id", "left_anti").select("id")


_TAGS = f"""(SELECT id, kk AS tag_id, json_extract(j, '$.tags') -> kk AS x FROM (SELECT id, j, unnest(json_keys(j, '$.tags')) AS kk FROM {META} WHERE json_type(j, '$.tags') = 'OBJECT')
       UNION ALL SELECT id, x ->> '$.id', x FROM (SELECT id, unnest(json_extract(j, '$.tags[*]')) AS x FROM {META} WHERE json_type(j, '$.tags') = 'ARRAY') WHERE x ->> '$.id' IS NOT NULL)"""


@Q.add(f"SELECT id AS segment_id, coalesce(x ->> '$.ref_id', x ->> '$.content', '') AS comment, count(*) AS n FROM {_TAGS} WHERE x ->> '$.type' = 'comment' GROUP BY 1, 2")
def segment_comments(spark, d):
    """The different comments of a segment, by what they refer to or else by what they say."""
    t = flat_table(table(spark, d, "segments"), "tags").filter("type = 'comment'")
    return t.groupBy("segment_id", F.coalesce("ref_id", "content", F.lit("")).alias("comment")).agg(F.count("*").alias("n"))


def _lists(path: str, fields: str) -> str:
    return f"SELECT id AS segment_id, (i - 1)::INTEGER AS pos, {fields} FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, {json_list(path)} AS l FROM {META})) WHERE json_type(x) <> 'NULL'"


_REV = _lists("$.metadata.revisions", "x ->> '$.type' AS type, x ->> '$.text' AS text, x ->> '$.author' AS author, x ->> '$.date' AS date")


@Q.add(f"SELECT id AS segment_id, tag_id, x ->> '$.type' AS type, x ->> '$.ref_id' AS ref_id, x ->> '$.content' AS content FROM {_TAGS} WHERE json_type(x) <> 'NULL'")
def p6_tags(spark, d):
    return flat_table(table(spark, d, "segments"), "tags")


@Q.add(f"""SELECT id AS segment_id, tag_id, a AS name, json_extract(x, '$.xml_attributes') ->> a AS value FROM (SELECT id, tag_id, x, unnest(json_keys(x, '$.xml_attributes')) AS a FROM {_TAGS} WHERE json_type(x, '$.xml_attributes') = 'OBJECT')
       WHERE json_type(json_extract(x, '$.xml_attributes') -> a) <> 'NULL'""")
def p6_attributes(spark, d):
    return flat_table(table(spark, d, "segments"), "tag_attributes")


@Q.add(_REV)
def p6_revisions(spark, d):
    return flat_table(table(spark, d, "segments"), "revisions")


@Q.add(_lists("$.metadata.revision_stages", "CAST(x ->> '$.stage' AS INTEGER) AS stage, x ->> '$.author' AS author, x ->> '$.date' AS date, x ->> '$.text' AS text"))
def p6_stages(spark, d):
    return flat_table(table(spark, d, "segments"), "revision_stages")


@Q.add(_lists("$.context_matches", "x ->> '$.id' AS id, x ->> '$.type' AS type, x ->> '$.category' AS category, x ->> '$.filename' AS filename, x ->> '$.content' AS content, x ->> '$.source_text' AS source_text, "
              "x ->> '$.note' AS note, CAST(x ->> '$.score' AS INTEGER) AS score, CAST(x ->> '$.raw_logit' AS DOUBLE) AS raw_logit"))
def p6_matches(spark, d):
    return flat_table(table(spark, d, "segments"), "context_matches")


@Q.add(f"""SELECT id AS segment_id, (i - 1)::INTEGER AS match_pos, a AS name, m ->> a AS value FROM (SELECT id, i, m, unnest(json_keys(m)) AS a FROM (SELECT id, i, json_extract(x, '$.metadata') AS m FROM
       (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, {json_list('$.context_matches')} AS l FROM {META}))) WHERE json_type(m) = 'OBJECT') WHERE json_type(m -> a) <> 'NULL'""")
def p6_match_metadata(spark, d):
    return flat_table(table(spark, d, "segments"), "match_metadata")


_ISO = r"'^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d{1,6})?Z?$'"
_US = f"CASE WHEN regexp_matches(date, {_ISO}) THEN epoch_us(TRY_CAST(regexp_replace(regexp_replace(date, 'Z$', ''), 'T', ' ') AS TIMESTAMP)) END"
_SESSION = f"""f AS (SELECT *, {_US} AS us FROM ({_REV})), n AS (SELECT segment_id, pos, author, date, us, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w >= 300000000 OR lag(author) OVER w IS DISTINCT FROM author THEN 1 ELSE 0 END AS fresh
       FROM f WHERE us IS NOT NULL AND type IN ('ins', 'del') WINDOW w AS (PARTITION BY segment_id ORDER BY us, pos)),
       s AS (SELECT *, (sum(fresh) OVER (PARTITION BY segment_id ORDER BY us, pos))::INTEGER AS session FROM n)"""


@Q.add(f"WITH {_SESSION} SELECT segment_id, session, arg_min(author, us * 1000 + pos) AS author, arg_min(date, us * 1000 + pos) AS date, count(*) AS changes FROM s GROUP BY 1, 2")
def revision_session_list(spark, d):
    """The sessions of changes of a segment: one author, gaps under five minutes, by ISO dates as they stand."""
    return V.sessions(V.fragments(table(spark, d, "segments")))


@Q.add(f"""WITH {_SESSION}, a AS (SELECT f.segment_id, f.pos, f.type, coalesce(f.text, '') AS text, s.session FROM f LEFT JOIN s USING (segment_id, pos)),
       m AS (SELECT segment_id, unnest(range(0, max(session) + 1)) AS stage FROM s GROUP BY 1)
       SELECT m.segment_id, m.stage::INTEGER AS stage, {strip_sql("coalesce(string_agg(a.text, '' ORDER BY a.pos) FILTER (a.type = 'normal' OR (a.type = 'ins' AND a.session <= m.stage) OR (a.type = 'del' AND a.session > m.stage)), '')")} AS text
       FROM m JOIN a USING (segment_id) GROUP BY 1, 2""")
def revision_stage_texts(spark, d):
    """The text of a segment before its changes and after each session of them."""
    return V.stage_texts(V.fragments(table(spark, d, "segments")))


def _stage_rows(spark, d):
    """The stages of segments that have two or more."""
    s = flat_table(table(spark, d, "segments"), "revision_stages").select("segment_id", F.col("pos").alias("stage"), F.coalesce("text", F.lit("")).alias("text"), "author", "date")
    many = s.groupBy("segment_id").agg(F.count("*").alias("n")).filter("n >= 2").select("segment_id")
    return s.join(many, "segment_id", "left_semi")


@Q.add(f"""WITH r AS (SELECT segment_id, pos, CASE WHEN {strip_sql("coalesce(text, '')")} <> '' THEN 'DE: ' || text ELSE '' END AS t FROM ({_lists('$.metadata.revision_stages', "x ->> '$.text' AS text")})),
       g AS (SELECT segment_id, list(t ORDER BY pos) AS l FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT segment_id, list_filter(l, lambda x: x <> '')[1] AS base, l[-1] AS final FROM g""")
def tc_first_last(spark, d):
    """Base and final translation of tracked changes, by the stand-in model."""
    return V.first_and_last(_stage_rows(spark, d), generation.generated).select("segment_id", "base", "final")


@Q.add()
def tc_step_by_step(spark, d):
    """All stages translated, and their changes as one document, by the stand-in model."""
    return V.step_by_step(_stage_rows(spark, d), generation.generated)


@Q.add(f"""SELECT request_id, CASE WHEN regexp_matches(date, {_ISO}) THEN epoch_us(TRY_CAST(regexp_replace(regexp_replace(date, 'Z$', ''), 'T', ' ') AS TIMESTAMP)) END AS us,
       CASE WHEN regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN date WHEN regexp_matches(date, '^\\d{{13}}$') THEN strftime(make_timestamp(CAST(date AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%SZ')
       WHEN regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}(:\\d{{2}})?$') THEN replace(date, ' ', 'T') || CASE WHEN length(date) = 16 THEN ':00' ELSE '' END || 'Z' ELSE '1970-01-01T00:00:00Z' END AS written
       FROM (SELECT DISTINCT request_id, {strip_sql('tc_date')} AS date FROM tc_requests)""")
def fn_change_dates(spark, d):
    """Dates of changes read as ISO, and written as ISO for export; what cannot be read gets a given date."""
    t = table(spark, d, "tc_requests").select("request_id", T.strip(F.col("tc_date")).alias("date")).distinct()
    return t.select("request_id", V.iso_instant(F.col("date")).alias("us"), T.export_date(F.col("date"), F.lit("1970-01-01T00:00:00Z")).alias("written"))


@Q.add(f"""WITH f AS (SELECT project_id, arg_min(id, (epoch_us(uploaded_at), id)) AS first_file FROM {FILE} WHERE project_id IS NOT NULL AND uploaded_at IS NOT NULL GROUP BY 1)
       SELECT s.project_id, coalesce(s.file_id, f.first_file) AS file_id, count(*) AS n_segments, count(*) FILTER (s.target <> '') AS n_translated FROM {SEG} s LEFT JOIN f ON f.project_id = s.project_id WHERE s.project_id IS NOT NULL GROUP BY 1, 2""")
def export_groups(spark, d):
    """The rows that go to each file of an export; those without a file go to the project's first."""
    first = files(spark, d).filter("project_id is not null and uploaded_at is not null").groupBy("project_id").agg(F.min_by("id", F.struct("uploaded_at", "id")).alias("first_file"))
    s = segments(spark, d).filter("project_id is not null").join(first, "project_id", "left")
    return s.groupBy("project_id", F.coalesce("file_id", "first_file").alias("file_id")).agg(F.count("*").alias("n_segments"), F.count_if(F.col("target") != "").alias("n_translated"))


@Q.add(f"SELECT project_id, to_json({{'id': id, 'index': idx, 'source': source, 'target': target}})::VARCHAR AS line FROM {SEG} WHERE target <> '' AND source IS NOT NULL AND idx IS NOT NULL AND project_id IS NOT NULL")
def segment_backup_lines(spark, d):
    """Translated rows as lines of JSON, as they are kept before a file is replaced."""
    s = segments(spark, d).filter("target <> '' and source is not null and idx is not null and project_id is not null")
    return s.select("project_id", F.to_json(F.struct("id", F.col("idx").alias("index"), "source", "target")).alias("line"))


@Q.add(f"SELECT id, CASE WHEN is_comment THEN source ELSE target END AS target, CASE WHEN is_comment AND status IN ('new', 'draft') THEN 'translated' ELSE status END AS status FROM {_FSEG}")
def copy_comments(spark, d):
    return L.copied_comments(_flagged(spark, d)).select("id", "target", "status")


@Q.add(f"SELECT id, CASE WHEN coalesce(status IN ('draft', 'mt_draft', 'error'), false) THEN NULL ELSE target END AS target, CASE WHEN coalesce(status IN ('draft', 'mt_draft', 'error'), false) THEN 'draft' ELSE status END AS status FROM {SEG}")
def clear_drafts_status(spark, d):
    return L.cleared(segments(spark, d)).select("id", "target", "status")


_LEADF = f"(SELECT *, first(CASE WHEN target <> '' THEN struct_pack(i := id, t := target) END IGNORE NULLS) OVER (PARTITION BY project_id, source ORDER BY (target <> '') DESC NULLS LAST, idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM {_FSEG} WHERE source IS NOT NULL AND project_id IS NOT NULL)"


@Q.add(f"SELECT id, f.t AS new_target FROM {_LEADF} WHERE f IS NOT NULL AND f.i <> id AND NOT fixed")
def propagate_guarded(spark, d):
    """Repetitions take over the first translation; locked, skipped and excluded rows stay as they are."""
    return tm.propagate(_flagged(spark, d), overwrite=True)


_UPD = "(SELECT segment_id AS id, arg_max(tc_base_translation, request_id) AS target FROM tc_requests WHERE tc_base_translation <> '' GROUP BY 1)"


@Q.add(f"SELECT s.id, CASE WHEN s.fixed THEN s.target ELSE u.target END AS target, s.fixed AS rejected FROM {_FSEG} s JOIN {_UPD} u ON u.id = s.id")
def update_guarded(spark, d):
    """Updates of targets with those of locked and skipped rows rejected."""
    u = table(spark, d, "tc_requests").filter("tc_base_translation <> ''").groupBy(F.col("segment_id").alias("id")).agg(F.max_by("tc_base_translation", "request_id").alias("new_target"))
    return L.guarded(_flagged(spark, d), u).select("id", "target", "rejected")


@Q.add("""SELECT p.id, len(json_keys(json_merge_patch(CASE WHEN json_valid(p.config) AND json_type(p.config) = 'OBJECT' THEN p.config ELSE '{}' END, '{"ai_settings": 1, "patched": {"by": "x"}}'))) AS n_keys,
       json_merge_patch(CASE WHEN json_valid(p.config) AND json_type(p.config) = 'OBJECT' THEN p.config ELSE '{}' END, '{"ai_settings": 1, "patched": {"by": "x"}}') ->> '$.patched.by' AS patched FROM (SELECT DISTINCT lower(trim(id)) AS id, config FROM projects) p""")
def settings_patch(spark, d):
    """Stored settings with some keys put in or replaced."""
    merged = L.merged_json(F.col("config"), F.lit('{"ai_settings": 1, "patched": {"by": "x"}}'))
    v = projects(spark, d).select("id", F.parse_json(merged).alias("v"))
    return v.select("id", F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))).cast("bigint").alias("n_keys"), F.try_variant_get("v", "$.patched.by", "string").alias("patched"))


@Q.add(f"SELECT id, CASE WHEN coalesce(target, '') = '' AND {strip_sql('source')} <> '' THEN 'DE: ' || source ELSE target END AS target, CASE WHEN {strip_sql('source')} <> '' THEN 'DE: ' || source END AS draft FROM {SEG}")
def write_back_drafts(spark, d):
    """A draft for every row by the stand-in model; the target is filled only where there was none."""
    s = segments(spark, d)
    made = generation.generated(s.filter(T.strip(F.col("source")) != "").select("id", F.col("source").alias("text")))
    return L.written_back(s, made.select("id", F.col("output").alias("draft"))).select("id", "target", "draft")


@Q.add(f"""SELECT id, mode, CASE mode WHEN 'copy_source' THEN source WHEN 'translate' THEN coalesce(draft, target) ELSE target END AS target, CASE WHEN mode IN ('draft', 'translate') THEN draft END AS draft
       FROM (SELECT id, source, target, CASE WHEN {strip_sql('source')} <> '' THEN 'DE: ' || source END AS draft FROM {SEG} WHERE {_STATED}), (SELECT unnest(['copy_source', 'analyze', 'draft', 'translate']) AS mode)""")
def draft_modes(spark, d):
    """What each way of drafting writes, for the stated segments."""
    s = R.stated(segments(spark, d))
    made = generation.generated(s.filter(T.strip(F.col("source")) != "").select("id", F.col("source").alias("text"))).select("id", F.col("output").alias("draft"))
    return L.drafted(s.join(made, "id", "left")).select("id", "mode", "target", "draft")


_COPY = "substr(sha256('all/' || {0}), 1, 32)"


@Q.add(" UNION ALL ".join([f"SELECT 'projects' AS table_name, {_COPY.format('id')} AS id, NULL AS parent_id FROM {PROJECT}", f"SELECT 'project_files', {_COPY.format('id')}, {_COPY.format('project_id')} FROM {FILE}",
                           f"SELECT 'segments', {_COPY.format('id')}, {_COPY.format('project_id')} FROM {SEG}", f"SELECT 'translation_units', {_COPY.format('id::VARCHAR')}, {_COPY.format('project_id')} FROM {TU}",
                           f"SELECT 'context_chunks', {_COPY.format('id')}, {_COPY.format('file_id')} FROM {CHUNK}"]))
def duplicate_all(spark, d):
    """All tables of all projects as copies with new ids, references mapped alike."""
    t = {"projects": projects(spark, d), "project_files": files(spark, d), "segments": segments(spark, d), "translation_units": units(spark, d), "context_chunks": chunks(spark, d)}
    out = None
    for name, df in L.duplicated_tables(t, "all").items():
        parent = next((c for c in ("project_id", "file_id") if c in df.columns), None)
        part = df.select(F.lit(name).alias("table_name"), "id", (F.col(parent) if parent else F.lit(None)).cast("string").alias("parent_id"))
        out = part if out is None else out.unionByName(part)
    return out


_GONE = f"(SELECT id FROM {PROJECT} WHERE archived)"


@Q.add(f"""SELECT 'projects' AS table_name, count(*) AS stays FROM {PROJECT} WHERE NOT coalesce(archived, false) UNION ALL SELECT 'project_files', count(*) FROM {FILE} WHERE project_id IS NULL OR project_id NOT IN {_GONE}
       UNION ALL SELECT 'segments', count(*) FROM {SEG} WHERE project_id IS NULL OR project_id NOT IN {_GONE} UNION ALL SELECT 'translation_units', count(*) FROM {TU} WHERE project_id IS NULL OR project_id NOT IN {_GONE}
       UNION ALL SELECT 'ai_usage_logs', count(*) FROM {LOG} WHERE project_id IS NULL OR project_id NOT IN {_GONE}
       UNION ALL SELECT 'context_chunks', count(*) FROM {CHUNK} WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM {FILE} WHERE project_id IN {_GONE})""")
def delete_all(spark, d):
    """How many rows of each table stay when the archived projects are deleted with all that hangs on them."""
    t = {"projects": projects(spark, d), "project_files": files(spark, d), "segments": segments(spark, d), "translation_units": units(spark, d), "ai_usage_logs": logs(spark, d), "context_chunks": chunks(spark, d)}
    out = None
    for name, df in L.deleted_tables(t, projects(spark, d).filter("archived").select("id")).items():
        part = df.agg(F.count("*").alias("stays")).select(F.lit(name).alias("table_name"), "stays")
        out = part if out is None else out.unionByName(part)
    return out


@Q.add(f"""WITH e AS (SELECT term_id, scope, term, CASE WHEN term_id LIKE 'u%' THEN 'auto' ELSE 'manual' END AS origin FROM {_ENTRY}), u AS (SELECT term_id, scope, upper(term) AS term FROM e WHERE term_id LIKE 'n%')
       SELECT term_id, scope, term, {_LEM.format('term')} AS lemmas FROM (SELECT term_id, scope, term FROM e WHERE term_id NOT IN (SELECT term_id FROM u) UNION ALL SELECT * FROM u)""")
def glossary_upsert(spark, d):
    """Terms with some of them changed; the words they are matched by are made anew."""
    e = _entries(spark, d)
    changed = e.filter(F.col("term_id").startswith("n")).withColumn("term", F.upper("term"))
    return glossary.upserted(e, changed)


def _four_tiers() -> str:
    third = "('0x' || substr(md5(id), 1, 6))::INTEGER % 3"
    changed = f"""(SELECT 'v2-' || s.id AS id, s.project_id, coalesce(s.file_id, f.first_file) AS file_id, s.idx, CASE WHEN {third.replace('id', 's.id', 1)} = 1 THEN translate(s.source, '- ', chr(8209) || chr(160)) ELSE s.source END AS source
        FROM {SEG} s LEFT JOIN (SELECT project_id, min(file_id) AS first_file FROM {SEG} WHERE file_id IS NOT NULL GROUP BY 1) f ON f.project_id = s.project_id)"""
    norm = strip_sql("translate(" + tags_sql("source") + ", chr(8209) || chr(160), chr(45) || chr(32))")
    side = lambda rows, name, by, where: f"""(SELECT id AS {name}, project_id, file_id, idx, {strip_sql('source')} AS kk, {norm} AS norm, row_number() OVER (PARTITION BY project_id, {by}{strip_sql('source')} ORDER BY idx, id) AS n
        FROM {rows} WHERE source IS NOT NULL AND project_id IS NOT NULL AND idx IS NOT NULL AND {where})"""  # noqa: E731
    single = lambda rows, name, by, gone: f"(SELECT project_id, {by} norm, min({name}) AS {name} FROM {rows} WHERE {name} NOT IN ({gone}) GROUP BY ALL HAVING count(*) = 1)"
    before = lambda name, n: " UNION ".join(f"SELECT {name} FROM t{x}" for x in range(1, n + 1))
    return f"""WITH n AS {side(changed, 'new_id', "coalesce(file_id, ''), ", 'true')}, o AS {side(SEG, 'old_id', 'file_id, ', 'file_id IS NOT NULL')}, p AS {side(SEG, 'old_id', '', 'file_id IS NULL')},
        t1 AS (SELECT new_id, old_id, 1 AS tier FROM n JOIN o USING (project_id, file_id, kk, n)),
        m AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY project_id, kk ORDER BY idx, new_id) AS n FROM n WHERE new_id NOT IN (SELECT new_id FROM t1)),
        t2 AS (SELECT new_id, old_id, 2 AS tier FROM m JOIN p USING (project_id, kk, n)),
        t3 AS (SELECT new_id, old_id, 3 AS tier FROM {single('n', 'new_id', 'file_id,', before('new_id', 2))} JOIN {single('o', 'old_id', 'file_id,', before('old_id', 2))} USING (project_id, file_id, norm)),
        t4 AS (SELECT new_id, old_id, 4 AS tier FROM {single('n', 'new_id', '', before('new_id', 3))} JOIN {single('p', 'old_id', '', before('old_id', 3))} USING (project_id, norm))
        SELECT new_id, old_id, tier::INTEGER AS tier FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3 UNION ALL FROM t4)"""


@Q.add(_four_tiers())
def reinitialise_changed(spark, d):
    """Files parsed again after changes: some rows with other spacing and dashes, some put into a file that had none."""
    return tm.reinitialise(segments(spark, d), _changed(spark, d))


def _changed(spark, d):
    """A new version of the segments: ids anew, hyphens typed otherwise in a third, rows without a file in the first file of their project."""
    s = segments(spark, d)
    first = s.filter("file_id is not null").groupBy("project_id").agg(F.min("file_id").alias("first_file"))
    third = F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long"), F.lit(3))
    source = F.when(third == 1, F.translate("source", "- ", "‑\xa0")).otherwise(F.col("source"))
    return s.join(first, "project_id", "left").select(F.concat(F.lit("v2-"), "id").alias("id"), "project_id", F.coalesce("file_id", "first_file").alias("file_id"), "idx", source.alias("source"))
