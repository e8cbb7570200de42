"""SQL counterparts of the queries of this package that SQL can express."""

from __future__ import annotations

_SPACE = r"\s\x{85}\x{A0}\x{AD}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}"


def _bare(c: str) -> str:
    for sign, mark in ((",", 17), (r"\.", 18)):
        for _ in range(2):  # a digit can belong to two separators
            c = rf"regexp_replace({c}, '(\d){sign}(\d)', '\1' || chr({mark}) || '\2', 'g')"
    return rf"replace(lower(regexp_replace({c}, '[|\p{{P}}{_SPACE}]+', '', 'g')), 'ß', 'ss')"


def _records(name: str, text: str) -> str:
    cut = rf"regexp_split_to_array(regexp_replace(t, '[;|\r\n]+[{_SPACE}\p{{P}}]*([^\d:;|{_SPACE}][^:;|\r\n]*:)', chr(29) || '\1', 'g'), chr(29))"
    return rf"""SELECT '{name}' AS record_table, id, scope, CASE WHEN len(p) >= 2 AND regexp_matches(p[1], '^[{_SPACE}\p{{P}}]*[^\d:;|][^:;|\r\n]*:')
        THEN chr(29) || array_to_string(list_sort(list_transform(p, lambda f: {_bare("split_part(f, ':', 1)")} || chr(30) || {_bare("substr(f, strpos(f, ':') + 1)")})), chr(31)) ELSE {_bare('t')} END AS canon
        FROM (SELECT id, scope, t, {cut} AS p FROM (SELECT DISTINCT CAST(id AS VARCHAR) AS id, lower(trim(project_id)) AS scope, regexp_replace({text}, '</?\d+\s*/?>', '', 'g') AS t FROM {name} WHERE {text} IS NOT NULL))"""


_P2 = f"""SELECT record_table, min(id) OVER (PARTITION BY record_table, scope, canon) AS keep_id, id AS copy_id
    FROM ({_records('segments', 'source_content')} UNION ALL {_records('translation_units', 'source_text')}) QUALIFY copy_id <> keep_id"""

_P5 = """WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM context_chunks WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
    n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 3)
    """

_WORDS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"
_RUNS = "SELECT {0}, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT {0}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {1})"
_P7 = f"""WITH i AS (SELECT item_id, w, least(12, len(w)) AS n FROM (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items) WHERE len(w) > 0),
    d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), dn AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
    SELECT DISTINCT doc_id, item_id FROM ({_RUNS.format('doc_id', 'dn')}) JOIN ({_RUNS.format('item_id', 'i')}) USING (n, g)"""

ORACLES = {
    "p2_found": _P2,
    "p2_counts": f"SELECT record_table, keep_id, count(*) + 1 AS n_copies FROM ({_P2}) GROUP BY 1, 2",
    "p2_collapsed": f"""SELECT record_table, id AS keep_id, t AS text, n AS n_copies FROM (SELECT record_table, id, scope, canon, count(*) OVER w AS n, id = min(id) OVER w AS keep
        FROM ({_records('segments', 'source_content')} UNION ALL {_records('translation_units', 'source_text')}) WINDOW w AS (PARTITION BY record_table, scope, canon))
        JOIN (SELECT 'segments' AS record_table, id, min(source_content) AS t FROM segments GROUP BY id UNION ALL SELECT 'translation_units', id::VARCHAR, min(source_text) FROM translation_units GROUP BY id) USING (record_table, id) WHERE keep""",
    "p5_found": _P5 + "SELECT DISTINCT least(a, b) AS low_id, greatest(a, b) AS high_id FROM n WHERE c >= 0.85",
    "p5_neighbours": _P5 + "SELECT a AS id, b AS other_id, round(c, 4) AS cosine FROM n WHERE c >= 0.85",
    "p7_found": _P7,
}
