"""Named queries of the scalar functions and of projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmloom.functions import scoring as S, text as T
from tmloom.plans.base import (CHUNK, FILE, PROJECT, SEG, TU, Registry, chunks, clean_sql, collapse_sql, files, k, projects, segments, strip_sql,
                               tags_sql, units)
from tmloom.session import table

Q = Registry()
QUERIES, ORACLES = Q.queries, Q.oracles


@Q.add(f"SELECT id, {clean_sql('source')} AS cleaned, {tags_sql('source')} AS untagged, regexp_replace(source, '</?\\d+>', '', 'g') AS unnumbered, "
       f"{strip_sql('translate(' + tags_sql('source') + ', chr(8209) || chr(160), chr(45) || chr(32))')} AS match_key FROM {SEG}")
def fn_clean_text(spark, d):
    c = F.col("source")
    return segments(spark, d).select("id", T.clean(c).alias("cleaned"), T.strip_tags(c).alias("untagged"), T.strip_numbered_tags(c).alias("unnumbered"), T.match_key(c).alias("match_key"))


@Q.add(f"SELECT id, {collapse_sql('source')} AS collapsed, sha256({collapse_sql('source')}) AS tm_key, md5(source) AS content_md5, "
       f"lower({collapse_sql(tags_sql('source'))}) AS glossary_text FROM {SEG}")
def fn_hashes(spark, d):
    c = F.col("source")
    return segments(spark, d).select("id", T.collapse(c).alias("collapsed"), T.tm_key(c).alias("tm_key"), F.md5(c).alias("content_md5"),
                                     F.lower(T.collapse(T.strip_tags(c))).alias("glossary_text"))


def _cut_sql(c: str) -> str:
    for pattern, put in T.SENTENCE_STEPS:
        c = f"regexp_replace({c}, '" + pattern.replace("'", "''") + "', '" + put.replace("$", "\\") + "', 'g')"
    return f"string_split({c}, chr(30))"


@Q.add(f"""SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_sentence_chars, array_to_string(s, '|') AS sentences, array_to_string(p, '') = text AS lossless
       FROM (SELECT doc_id, text, p, list_filter(list_transform(p, lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM (SELECT doc_id, text, {_cut_sql('text')} AS p FROM documents WHERE text IS NOT NULL))""")
def fn_sentences(spark, d):
    c = F.col("text")
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", T.sentence_parts(c).alias("p"), T.sentences(c).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_sentence_chars"),
                    F.array_join("s", "|").alias("sentences"), (F.array_join("p", "") == c).alias("lossless"))


@Q.add(f"SELECT id, len(regexp_extract_all(source, '{T.TOKEN}')) AS n_tokens, len(list_filter(regexp_split_to_array({strip_sql(tags_sql('source'))}, '{T.WS}+'), lambda x: x <> '')) AS n_words, "
       f"array_to_string(regexp_extract_all(source, '{T.TOKEN}'), '') = source AS lossless FROM {SEG} WHERE source IS NOT NULL")
def fn_tokens(spark, d):
    c = F.col("source")
    return segments(spark, d).filter(c.isNotNull()).select("id", F.size(T.tokens(c)).cast("bigint").alias("n_tokens"), T.word_count(c).cast("bigint").alias("n_words"),
                                                          (F.array_join(T.tokens(c), "") == c).alias("lossless"))


@Q.add(r"""SELECT event_id, raw, (CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 100 ELSE round_even(ln(1 + 9 * t) / ln(10) * 100, 0) END)::INTEGER AS score
       FROM (SELECT event_id, value / 100 AS raw, (value / 100 - 0.75) / greatest(0.99 - 0.75, 1e-6) AS t FROM events)""")
def fn_relevance(spark, d):
    raw = F.col("value") / 100
    return table(spark, d, "events").select("event_id", raw.alias("raw"), S.relevance_score(raw).alias("score"))


@Q.add(f"SELECT id, (CASE lower(origin_type) WHEN 'mandatory' THEN 100 WHEN 'user' THEN 99 ELSE 98 END)::INTEGER AS score, "
       f"(CASE WHEN lower(origin_type) = 'mandatory' THEN 60 ELSE 40 END)::INTEGER AS least FROM {TU}")
def fn_origin_scores(spark, d):
    o = F.col("origin_type")
    return units(spark, d).select("id", S.origin_score(o).alias("score"), S.threshold(F.lower(o), F.lit("background")).alias("least"))


@Q.add(f"""SELECT id, substr(replace(trim(regexp_replace(project_name, '[^\\p{{L}}\\p{{N}}\\-_ ]', '', 'g')), ' ', '_'), 1, 40) AS stem,
       replace(lower(project_name), ' ', '_') || '__stage_' || CAST(rag_progress AS VARCHAR) AS author FROM {PROJECT}""")
def fn_names(spark, d):
    n = F.col("project_name")
    return projects(spark, d).select("id", T.file_stem(n).alias("stem"), T.author_id(n, F.col("rag_progress")).alias("author"))


_X = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@Q.add(f"""SELECT id, {_X.format('target')} AS escaped, replace({_X.format('target')}, '"', '&quot;') AS attribute,
       {strip_sql("regexp_replace(regexp_replace(regexp_replace(target, chr(9), ' ', 'g'), ' +', ' ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")} AS prompt_text,
       regexp_replace(target, '^(?:{T.WS}|["''“”„])+|(?:{T.WS}|["''“”„])+$', '', 'g') AS unquoted FROM {SEG}""")
def fn_escapes(spark, d):
    c = F.col("target")
    return segments(spark, d).select("id", T.xml_escaped(c).alias("escaped"), T.attr_escaped(c).alias("attribute"), T.prompt_safe(c).alias("prompt_text"), T.unquoted(c).alias("unquoted"))


@Q.add(f"SELECT id, {_X.format('source')} <> source AS has_specials, true AS round_trip FROM {SEG} WHERE source IS NOT NULL")
def fn_unescape_round_trip(spark, d):
    c = F.col("source")
    return segments(spark, d).filter(c.isNotNull()).select("id", (T.xml_escaped(c) != c).alias("has_specials"), (T.unescaped(T.xml_escaped(c)) == c).alias("round_trip"))


_LAKH = r"list_transform(regexp_extract_all(t, '(?i)(\d+(?:\.\d+)?)\s*{0}s?\b', 1), lambda a: a || ' {1} = ' || format('{{:,}}', CAST(floor(CAST(a AS DECIMAL(20,4)) * {2}) AS BIGINT)))"


@Q.add(f"""SELECT id, list_concat({_LAKH.format('lakh', 'Lakh', 100000)}, {_LAKH.format('crore', 'Crore', 10000000)}) AS facts FROM
       (SELECT id, replace(replace(source, ' percent', ' lakh'), ' EUR', ' crores') AS t FROM {SEG} WHERE source IS NOT NULL)""")
def fn_unit_facts(spark, d):
    t = F.replace(F.replace(F.col("source"), F.lit(" percent"), F.lit(" lakh")), F.lit(" EUR"), F.lit(" crores"))
    return segments(spark, d).filter("source is not null").select("id", T.unit_facts(t).alias("facts"))


_MARKED = r"regexp_replace(target, '(\w+) (\w+) (\w+)', '<del>\1</del> <ins>\2</ins> \3')"


@Q.add(f"""SELECT id, {strip_sql("regexp_replace(regexp_replace(regexp_replace(m, '(?s)<del[^>]*>.*?</del>', '', 'g'), '</?ins[^>]*>', '', 'g'), ' {2,}', ' ', 'g')")} AS final_text,
       true AS valid, false AS valid_when_cut FROM (SELECT id, {_MARKED} AS m FROM {SEG} WHERE target IS NOT NULL) WHERE m LIKE '%<ins>%'""")
def tc_clean_text(spark, d):
    m = F.regexp_replace("target", r"^(.*?)([0-9A-Za-z_]+) ([0-9A-Za-z_]+) ([0-9A-Za-z_]+)", "$1<del>$2</del> <ins>$3</ins> $4")
    m = segments(spark, d).filter("target is not null").select("id", m.alias("m")).filter(F.col("m").contains("<ins>"))
    return m.select("id", T.clean_of_markup(F.col("m")).alias("final_text"), T.valid_markup(F.col("m")).alias("valid"),
                    T.valid_markup(F.regexp_replace("m", "</ins>", "")).alias("valid_when_cut"))


@Q.add(f"""SELECT id, target IS NOT NULL AND target <> '' AS translated, target IS NULL OR target = '' AS untranslated,
       coalesce(target IS NOT NULL AND target <> '' AND status IN ('translated', 'mt_draft'), false) AS tm_usable,
       regexp_matches({strip_sql(tags_sql('source'))}, '{T.NON_TEXT.replace("'", "''")}') AS non_text,
       {strip_sql("regexp_replace(source, '</?[0-9]+>', '', 'g')")} <> '' AS real_content FROM {SEG}""")
def segment_predicates(spark, d):
    t = F.col("target")
    has = t.isNotNull() & (t != "")
    return segments(spark, d).select("id", has.alias("translated"), (t.isNull() | (t == "")).alias("untranslated"),
                                     F.coalesce(has & F.col("status").isin("translated", "mt_draft"), F.lit(False)).alias("tm_usable"),
                                     T.is_non_text(F.col("source")).alias("non_text"), T.has_content(F.col("source")).alias("real_content"))


@Q.add(f"SELECT id, file_id, chunk_index FROM {CHUNK} WHERE length({strip_sql('content')}) > 3")
def chunk_admission(spark, d):
    return chunks(spark, d).filter(F.length(T.strip(F.col("content"))) > 3).select("id", "file_id", "chunk_index")


@Q.add(f"SELECT project_id, category, count(*) AS n_files, count(file_path) AS n_stored, min(uploaded_at) AS first_upload FROM {FILE} WHERE category IN ('legal', 'background', 'source') GROUP BY 1, 2")
def files_by_category(spark, d):
    return files(spark, d).filter(F.col("category").isin("legal", "background", "source")).groupBy("project_id", "category").agg(
        F.count("*").alias("n_files"), F.count("file_path").alias("n_stored"), F.min("uploaded_at").alias("first_upload"))


@Q.add(f"SELECT id, project_name FROM {PROJECT} WHERE NOT coalesce(archived, false) AND (lower(project_name) LIKE '%report%' OR lower(source_lang) LIKE '%report%')")
def project_search(spark, d):
    """Substring search without letter case over several columns, among projects that are not archived."""
    hit = F.lower("project_name").contains("report") | F.lower("source_lang").contains("report")
    return projects(spark, d).filter(~F.coalesce("archived", F.lit(False)) & hit).select("id", "project_name")


@Q.add(f"SELECT coalesce(target_lang, '(unsorted)') AS folder, count(*) AS n_projects, min(project_name) AS first_name, target_lang IS NULL AS last FROM {PROJECT} GROUP BY target_lang")
def archive_folders(spark, d):
    """Projects by folder; what has none sorts last."""
    return projects(spark, d).groupBy("target_lang").agg(F.count("*").alias("n_projects"), F.min("project_name").alias("first_name")).select(
        F.coalesce("target_lang", F.lit("(unsorted)")).alias("folder"), "n_projects", "first_name", F.col("target_lang").isNull().alias("last"))


@Q.add(f"SELECT id, project_id, file_id, idx, source FROM {SEG} WHERE project_id IS NOT NULL ORDER BY project_id, idx, id")
def segments_ordered(spark, d):
    return segments(spark, d).filter("project_id is not null").select("id", "project_id", "file_id", "idx", "source").orderBy("project_id", "idx", "id")


@Q.add(f"SELECT id, project_name, created_at FROM {PROJECT} ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def projects_page(spark, d):
    """One page of the newest projects."""
    return projects(spark, d).select("id", "project_name", "created_at").orderBy(F.desc("created_at"), "id").offset(10).limit(50)


@Q.add(f"""SELECT id, json_extract_string(config, '$.ai_settings.model') AS model, CAST(json_extract_string(config, '$.ai_settings.batch_size') AS INTEGER) AS batch_size,
       coalesce(json_extract_string(config, '$.ai_settings.model'), 'default-model') AS effective_model FROM {PROJECT} WHERE config IS NULL OR json_valid(config)""")
def settings_merge(spark, d):
    """Stored settings over defaults: the later map wins."""
    p = projects(spark, d).withColumn("v", F.try_parse_json("config")).filter("config is null or v is not null")
    stored = F.try_variant_get("v", "$.ai_settings", "map<string,string>")
    merged = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("model").alias("key"), F.coalesce(F.element_at(stored, "model"), F.lit("default-model")).alias("value")))))
    return p.select("id", F.try_variant_get("v", "$.ai_settings.model", "string").alias("model"), F.try_variant_get("v", "$.ai_settings.batch_size", "int").alias("batch_size"),
                    F.element_at(merged, "model").alias("effective_model"))
