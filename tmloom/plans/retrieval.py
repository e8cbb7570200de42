"""Named queries of match lists, glossary, vector and fuzzy retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmloom.functions import text as T
from tmloom.functions.keys import norm_key
from tmloom.operators import fuzzy, glossary, matches as M, topk
from tmloom.operators.dates import readable_json
from tmloom.plans.base import META, PROJECT, SEG, TU, Registry, clean_sql, json_list, projects, segments, strip_sql, tags_sql, units
from tmloom.session import table

Q = Registry()
QUERIES, ORACLES = Q.queries, Q.oracles

_M = f"""(SELECT id, pos - 1 AS pos, x ->> '$.id' AS match_id, x ->> '$.type' AS kind, coalesce(CAST(x ->> '$.score' AS INTEGER), 0) AS score, CAST(x ->> '$.raw_logit' AS DOUBLE) AS raw
       FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT id, {json_list('$.context_matches')} AS l FROM {META})) WHERE json_type(x) <> 'NULL')"""


def _lists(spark, d):
    return M.match_lists(table(spark, d, "segments"))


@Q.add(f"SELECT id, pos::INTEGER AS pos, match_id, kind, score, raw FROM {_M}")
def match_table(spark, d):
    return _lists(spark, d).select("id", F.explode("matches").alias("m")).select("id", "m.pos", "m.match_id", "m.kind", "m.score", "m.raw")


@Q.add(f"SELECT id, string_agg(match_id, ',' ORDER BY CASE WHEN kind = 'mt' THEN 0 ELSE 1 END, score DESC, pos) AS shown FROM {_M} GROUP BY id")
def match_display_order(spark, d):
    return _lists(spark, d).filter(F.size("matches") > 0).select("id", F.array_join(F.transform(M.display_order(F.col("matches")), lambda m: m["match_id"]), ",").alias("shown"))


@Q.add(f"""SELECT id, count(*) AS n, count(*) FILTER (kind <> 'glossary' AND (kind = 'mt' OR score >= CASE kind WHEN 'mandatory' THEN 60 WHEN 'internal' THEN 90 ELSE 40 END)) AS n_visible,
       coalesce(string_agg(match_id, ',' ORDER BY pos) FILTER (pos < 3 AND kind NOT IN ('glossary', 'history') AND score < 100), '') AS prompt FROM {_M} GROUP BY id""")
def match_visible(spark, d):
    m = F.col("matches")
    return _lists(spark, d).filter(F.size("matches") > 0).select("id", F.size(m).cast("bigint").alias("n"), F.size(M.visible(m)).cast("bigint").alias("n_visible"),
                                                                F.array_join(F.transform(M.prompt_matches(m), lambda x: x["match_id"]), ",").alias("prompt"))


@Q.add(f"""SELECT id, arg_min(match_id, pos) FILTER (kind = 'mandatory' AND score >= 98) AS mandatory_pick, arg_min(match_id, pos) FILTER (score >= 100 AND kind <> 'glossary') AS exact_pick,
       string_agg(match_id, ',' ORDER BY rank) FILTER (rank <= 5) AS top_five FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM {_M}) GROUP BY id""")
def match_picks(spark, d):
    m = F.col("matches")
    return _lists(spark, d).filter(F.size("matches") > 0).select(
        "id", M.first_of(m, lambda x: (x["kind"] == "mandatory") & (x["score"] >= 98))["match_id"].alias("mandatory_pick"),
        M.first_of(m, lambda x: (x["score"] >= 100) & (x["kind"] != "glossary"))["match_id"].alias("exact_pick"),
        F.array_join(F.transform(F.slice(M.by_score(m), 1, 5), lambda x: x["match_id"]), ",").alias("top_five"))


@Q.add(f"""SELECT id, j ->> '$.segment_id' AS segment_key, j ->> '$.metadata.type' AS kind, CAST(j ->> '$.metadata.p_index' AS INTEGER) AS p_index,
       CAST(j ->> '$.metadata.table_index' AS INTEGER) AS table_index, coalesce(CAST(j ->> '$.metadata.locked' AS BOOLEAN), false) AS locked,
       coalesce(CAST(j ->> '$.metadata.skip' AS BOOLEAN), false) AS skip FROM {META} WHERE json_type(j) = 'OBJECT'""")
def nested_projection(spark, d):
    v = table(spark, d, "segments").select("id", "metadata_json").distinct().select("id", readable_json(F.col("metadata_json")).alias("v")).filter(
        F.schema_of_variant("v").startswith("OBJECT"))
    g = lambda p, t: F.try_variant_get("v", p, t)
    return v.select("id", g("$.segment_id", "string").alias("segment_key"), g("$.metadata.type", "string").alias("kind"), g("$.metadata.p_index", "int").alias("p_index"),
                    g("$.metadata.table_index", "int").alias("table_index"), F.coalesce(g("$.metadata.locked", "boolean"), F.lit(False)).alias("locked"),
                    F.coalesce(g("$.metadata.skip", "boolean"), F.lit(False)).alias("skip"))


@Q.add(f"""WITH r AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT id, {json_list('$.metadata.revisions')} AS l FROM {META}))
       SELECT id, coalesce(string_agg(x ->> '$.text', '' ORDER BY pos) FILTER (x ->> '$.type' IN ('normal', 'del')), '') AS original_text,
       coalesce(string_agg(x ->> '$.text', '' ORDER BY pos) FILTER (x ->> '$.type' IN ('normal', 'ins')), '') AS final_text,
       coalesce(bool_or(x ->> '$.type' IN ('ins', 'del')), false) AS changed FROM r GROUP BY id""")
def revision_texts(spark, d):
    """The text before and after all tracked changes."""
    v = table(spark, d, "segments").filter(F.col("metadata_json").contains("revision")).select("id", "metadata_json").distinct().select(
        "id", F.try_variant_get(readable_json(F.col("metadata_json")), "$.metadata.revisions", "variant").alias("m"))
    items = F.coalesce(F.try_variant_get("m", "$", "array<variant>"), F.when(F.schema_of_variant("m").startswith("OBJECT"), F.array("m")))
    part = F.transform(items, lambda x: F.struct(F.try_variant_get(x, "$.type", "string").alias("t"), F.try_variant_get(x, "$.text", "string").alias("x")))
    text = lambda *kinds: F.array_join(F.transform(F.filter("p", lambda y: y["t"].isin(*kinds)), lambda y: y["x"]), "")
    return v.select("id", part.alias("p")).filter(F.size("p") > 0).select(
        "id", text("normal", "del").alias("original_text"), text("normal", "ins").alias("final_text"), F.exists("p", lambda y: F.coalesce(y["t"].isin("ins", "del"), F.lit(False))).alias("changed"))


@Q.add(f"""WITH s AS (SELECT id, {json_list('$.metadata.revision_stages')} AS l FROM {META}), t AS (SELECT id, list_filter(l, lambda x: json_type(x) <> 'NULL') AS l FROM s WHERE len(l) > 0)
       SELECT id, len(l) AS n_stages, len(l) >= 2 AS staged, coalesce((trim(coalesce(l[1] ->> '$.text', '')) = '' AND len(l) = 2) OR trim(coalesce(l[-1] ->> '$.text', '')) = '', false) AS simple,
       (CASE WHEN trim(coalesce(l[1] ->> '$.text', '')) = '' THEN 1 ELSE 0 END)::INTEGER AS base_stage FROM t WHERE len(l) > 0""")
def stage_routing(spark, d):
    """Segments by their revision stages: staged or regular, simple or proper, and the stage to start from."""
    v = table(spark, d, "segments").filter(F.col("metadata_json").contains("revision_stages")).select("id", "metadata_json").distinct().select(
        "id", F.try_variant_get(readable_json(F.col("metadata_json")), "$.metadata.revision_stages", "variant").alias("m"))
    items = F.coalesce(F.try_variant_get("m", "$", "array<variant>"), F.when(F.schema_of_variant("m").startswith("OBJECT"), F.array("m")))
    v = v.select("id", F.filter(items, lambda x: ~F.is_variant_null(x)).alias("l")).filter(F.size("l") > 0)
    blank = lambda i: F.trim(F.coalesce(F.try_variant_get(F.element_at("l", i), "$.text", "string"), F.lit(""))) == ""
    n = F.size("l")
    return v.select("id", n.cast("bigint").alias("n_stages"), (n >= 2).alias("staged"), ((blank(1) & (n == 2)) | blank(-1)).alias("simple"), F.when(blank(1), 1).otherwise(0).alias("base_stage"))


@Q.add(f"""SELECT id, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS complete, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS n_missing
       FROM (SELECT id, regexp_extract_all(source, '</?(\\d+)>', 1) AS a, regexp_extract_all(target, '</?(\\d+)>', 1) AS b FROM {SEG} WHERE source IS NOT NULL AND target IS NOT NULL)""")
def tag_subset(spark, d):
    """Whether the target has all tags of the source."""
    ids = lambda c: F.regexp_extract_all(c, F.lit(r"</?(\d+)>"), F.lit(1))
    missing = F.size(F.array_except(ids("source"), ids("target"))).cast("bigint")
    return segments(spark, d).filter("source is not null and target is not null").select("id", (missing == 0).alias("complete"), missing.alias("n_missing"))


@Q.add(f"""SELECT id, coalesce(list(match_id ORDER BY pos) FILTER (kind = 'mt'), list(match_id ORDER BY pos))[1] AS first_mt, (list(match_id ORDER BY pos) FILTER (kind = 'mt'))[2] AS second_mt,
       (list(match_id ORDER BY pos) FILTER (kind <> 'mt'))[1] AS other_1, (list(match_id ORDER BY pos) FILTER (kind <> 'mt'))[2] AS other_2, (list(match_id ORDER BY pos) FILTER (kind <> 'mt'))[3] AS other_3 FROM {_M} GROUP BY id""")
def match_shortcuts(spark, d):
    return _lists(spark, d).filter(F.size("matches") > 0).select("id", M.shortcuts(F.col("matches")).alias("s")).select("id", "s.*")


_TERM = f"(SELECT id AS term_id, id AS scope, array_to_string(list_slice(regexp_extract_all(project_name, '[\\p{{L}}\\p{{N}}]+'), 1, 2), ' ') AS term FROM {PROJECT} WHERE project_name IS NOT NULL)"


def _terms(spark, d):
    words = F.regexp_extract_all("project_name", F.lit(glossary.WORD), F.lit(0))
    return projects(spark, d).filter("project_name is not null").select(F.col("id").alias("term_id"), F.col("id").alias("scope"), F.array_join(F.slice(words, 1, 2), " ").alias("term"))


_ENTRY = f"""(SELECT term_id, scope, term FROM {_TERM} UNION ALL SELECT 'n' || id, id, project_name FROM {PROJECT} WHERE project_name IS NOT NULL
        UNION ALL SELECT 'u' || id, project_id, array_to_string(list_slice(regexp_extract_all(source_text, '[\\p{{L}}\\p{{N}}]+'), 1, 6), ' ') FROM {TU} WHERE lower(origin_type) = 'mandatory' AND project_id IS NOT NULL AND source_text IS NOT NULL)"""


def _entries(spark, d):
    """Terms of one word to many: the names of projects, their first two words, and the first six words of mandatory units."""
    p = projects(spark, d).filter("project_name is not null").select(F.concat(F.lit("n"), "id").alias("term_id"), F.col("id").alias("scope"), F.col("project_name").alias("term"))
    words = F.regexp_extract_all("source_text", F.lit(glossary.WORD), F.lit(0))
    u = units(spark, d).filter("lower(origin_type) = 'mandatory' and project_id is not null and source_text is not null").select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("term_id"), F.col("project_id").alias("scope"), F.array_join(F.slice(words, 1, 6), " ").alias("term"))
    return _terms(spark, d).unionByName(p).unionByName(u)


def _scoped(spark, d):
    return segments(spark, d).select("id", F.col("project_id").alias("scope"), "source")


_LEM = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda w: " + glossary.lemma_sql("w").replace("{", "{{").replace("}", "}}") + ")"


@Q.add(f"""WITH t AS (SELECT term_id, scope, array_to_string({_LEM.format('term')}, ' ') AS phrase FROM {_ENTRY}), n AS (SELECT DISTINCT scope, len(string_split(phrase, ' ')) AS n FROM t), w AS (SELECT id, project_id AS scope, {_LEM.format(tags_sql('source'))} AS w FROM {SEG} WHERE source IS NOT NULL),
       r AS (SELECT id, scope, i - 1 AS word_at, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM w JOIN n USING (scope), unnest(range(1, len(w) + 1)) AS u(i) WHERE i + n - 1 <= len(w))
       SELECT id, term_id, min(word_at)::INTEGER AS word_at FROM r JOIN t USING (scope, phrase) WHERE phrase <> '' GROUP BY 1, 2""")
def glossary_phrase_hits(spark, d):
    return glossary.phrase_hits(_scoped(spark, d), _entries(spark, d)).withColumnRenamed("at", "word_at")


@Q.add(f"SELECT term_id, scope, term FROM {_ENTRY} WHERE contains(lower(term), 'report') OR contains(lower(term_id), 'report')")
def glossary_search(spark, d):
    """Entries with a text in them, letter case aside."""
    hit = F.lower("term").contains("report") | F.lower("term_id").contains("report")
    return _entries(spark, d).filter(hit)


@Q.add(f"""SELECT term_id, scope, array_to_string(l, ' ') AS phrase, len(l)::INTEGER AS n_words FROM (SELECT term_id, scope, {_LEM.format('term')} AS l FROM {_ENTRY}) WHERE len(l) > 0""")
def glossary_matcher(spark, d):
    """The terms as they are matched."""
    return glossary.matcher(_entries(spark, d))


@Q.add()
def glossary_fuzzy_hits(spark, d):
    """Terms without a hit of their own that sound like a run of as many words, at 95 percent or more."""
    s, t = _scoped(spark, d), _entries(spark, d)
    return glossary.fuzzy_hits(s, t, glossary.phrase_hits(s, t), least=95.0)


@Q.add(f"""SELECT id, term, target_term FROM (SELECT id, {strip_sql('split_part(source, chr(32), 1)')} AS term, {strip_sql('split_part(target, chr(32), 1)')} AS target_term FROM {SEG} WHERE source IS NOT NULL AND target IS NOT NULL)
       WHERE term <> '' AND target_term <> '' AND lower(term) <> lower(target_term) AND NOT (term = upper(term) AND target_term = upper(target_term) AND length(term) <= 6) AND length(term) > 2""")
def auto_glossary_filter(spark, d):
    first = lambda c: T.strip(F.split_part(c, F.lit(" "), F.lit(1)))
    return segments(spark, d).filter("source is not null and target is not null").select("id", first(F.col("source")).alias("term"), first(F.col("target")).alias("target_term")).filter(
        glossary.acceptable(F.col("term"), F.col("target_term")))




@Q.add(f"""WITH g AS (SELECT id AS segment_id, project_id AS scope, lower({strip_sql('split_part(source, chr(32), 1)')}) AS term FROM {SEG} WHERE source IS NOT NULL AND project_id IS NOT NULL),
       m AS (SELECT DISTINCT scope, lower({strip_sql('term')}) AS term FROM {_TERM}), a AS (SELECT scope, term, min(segment_id) AS lo, max(segment_id) AS hi FROM g GROUP BY 1, 2)
       SELECT g.segment_id, g.scope, g.term FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scope = g.scope AND m.term = g.term) AND NOT EXISTS (SELECT 1 FROM a WHERE a.scope = g.scope AND a.term = g.term AND (a.lo <> g.segment_id OR a.hi <> g.segment_id))""")
def glossary_new_terms(spark, d):
    g = segments(spark, d).filter("source is not null and project_id is not null").select(
        F.col("id").alias("segment_id"), F.col("project_id").alias("scope"), F.lower(T.strip(F.split_part("source", F.lit(" "), F.lit(1)))).alias("term"))
    return glossary.new_terms(g, _terms(spark, d), g).select("segment_id", "scope", "term")


@Q.add("""WITH c AS (SELECT DISTINCT id, embedding AS v FROM context_chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
       s AS (SELECT e.vec_id AS query_id, c.id, list_cosine_similarity(e.embedding::DOUBLE[], c.v::DOUBLE[]) AS cos FROM embeddings e, c)
       SELECT query_id, id, round(cos, 4) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def vector_topk_chunks(spark, d):
    q = topk.usable(table(spark, d, "embeddings"), "vec_id", "embedding", 64)
    c = topk.usable(table(spark, d, "context_chunks"), "id", "embedding", 64)
    return topk.cosine_topk(q, c, 20).select("query_id", "id", F.round("cosine", 4).alias("cosine"), "rank")


@Q.add()
def fuzzy_segments(spark, d):
    """The five most similar other sources of a project, at 90 percent or more."""
    s = segments(spark, d).select("id", F.col("project_id").alias("scope"), T.strip_tags(F.col("source")).alias("text"))
    return fuzzy.similar_texts(s)
