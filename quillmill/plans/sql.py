"""SQL counterparts of text rules and of the longer queries, for DuckDB; written apart from the Spark plans."""

from __future__ import annotations

from quillmill.functions import text as X

# Fixed value: white space, as the tokenizer and DuckDB see it.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Fixed value: white space within a line.
BLANK = r"[\t\f\v\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def left_of(x: str, drop: str) -> str:
    return f"length(regexp_replace(coalesce({x}, ''), '{drop}', '', 'g'))"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def bare(pattern: str) -> str:
    """A pattern of the text rules without its look-arounds and flags."""
    return pattern.replace("(?i)", "").replace("(?iu)", "").replace(X._ON, "").replace(X._OFF, "")


def found_words(x: str, pattern: str) -> str:
    """Matches that stand as words; letters and digits beyond ASCII have been made underscores, which are word signs too."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return rf"regexp_extract_all({x}, {quoted(flag + chr(92) + 'b(' + bare(pattern) + ')(?:[^0-9A-Za-z_]|$)')}, 1)"


def distinct_strings(x: str) -> str:
    """Squeezed strings without blanks, the first spelling of each, in order."""
    clean = f"list_filter(list_transform({x}, lambda v: {squeezed('v')}), lambda v: length(v) > 0)"
    return f"(SELECT list_transform(list_filter(list_zip(z.a, range(1, len(z.a) + 1)), lambda p: list_position(list_transform(z.a, lambda v: lower(v)), lower(p[1])) = p[2]), lambda p: p[1]) FROM (SELECT {clean} AS a) z)"


def longest_first(x: str) -> str:
    return f"(SELECT coalesce(list(u.v ORDER BY -length(u.v), u.i), []) FROM (SELECT unnest(y.a) AS v, unnest(range(len(y.a))) AS i FROM (SELECT {x} AS a) y) u)"


def when_list(x: str, rules: tuple) -> str:
    """Concatenated term lists of the rules whose pattern stands in the text."""
    one = [f"CASE WHEN regexp_matches({x}, {quoted(p)}) THEN {list(t if isinstance(t, tuple) else (t,))!r} ELSE [] END" for p, t in rules]
    return "flatten([" + ", ".join(one) + "])"


_TRIMMED = r"regexp_replace(regexp_replace(v, '^[ \t\r\n.,;:()\[\]{}]+|[ \t\r\n.,;:()\[\]{}]+$', '', 'g'), '\s+', ' ', 'g')"
_RAW = "flatten([" + ", ".join(found_words("m", p) for p in X.TERM_PATTERNS) + "])"
_ORDERED = distinct_strings(
    f"list_concat(list_filter(list_transform({_RAW}, lambda v: {_TRIMMED}), lambda v: length(v) >= 2), CASE WHEN regexp_matches(question, '[^\\x00-\\x7F]') THEN {found_words('m', X.LATIN_TOKEN)} ELSE [] END)"
)
_NUMBERED = "list_concat(list_transform(regexp_extract_all(question, '表\\s*([0-9]+)', 1), lambda n: 'Table ' || n), list_transform(regexp_extract_all(question, '图\\s*([0-9]+)', 1), lambda n: 'Figure ' || n))"
# q_id, question (as asked), terms, focus, structure, query_en, is_table, heavy of every question
TERMS = (
    r"asked0 AS (SELECT DISTINCT q_id, question, regexp_replace(coalesce(question, ''), '[^\P{L}A-Za-z]|[^\P{N}0-9]', '_', 'g') AS m FROM sample_questions), "
    f"asked1 AS (SELECT q_id, question, {_ORDERED} AS ordered FROM asked0), asked2 AS (SELECT q_id, question, {longest_first('ordered')} AS terms FROM asked1), "
    f"asked3 AS (SELECT *, {distinct_strings('list_concat(terms, list_transform(regexp_extract_all(question, ' + quoted('(?i)' + bare(X.TABLE_FOCUS)) + '), lambda v: trim(v)))')} AS f0, "
    f"{distinct_strings('list_concat(' + when_list('question', X.STRUCTURE_RULES) + ', ' + _NUMBERED + ')')} AS structure, {distinct_strings(when_list('question', X.QUESTION_RULES))} AS template, "
    f"{left_of('question', '[^\\x{4e00}-\\x{9fff}]')} AS h, {left_of('question', '[^A-Za-z]')} AS l, "
    r"regexp_matches(regexp_replace(question, '[^\P{L}A-Za-z]|[^\P{N}0-9]', '_', 'g'), '(?i)\b(?:table|tab\.?|figure|fig\.?)\s*[0-9]+') OR regexp_matches(question, '[表图]\s*[0-9]+') AS is_table FROM asked2), "
    f"asked AS (SELECT *, {longest_first('f0')} AS focus, array_to_string(list_slice({distinct_strings('list_concat(list_concat(list_filter(terms, lambda v: regexp_matches(v, ' + quoted('[A-Za-z]') + ')), template), structure)')}, 1, 8), ' ') AS query_en, "
    "CASE WHEN is_table THEN true WHEN h > 0 AND h >= greatest(2 * l, 8) THEN false ELSE len(terms) >= 2 END AS heavy FROM asked3)"
)
QUESTION_TERMS = f"WITH {TERMS} SELECT q_id, array_to_string(terms, '|') AS terms, array_to_string(focus, '|') AS focus, array_to_string(structure, '|') AS structure, query_en, is_table, heavy FROM asked"


def terms_of(source: str, tag: str) -> str:
    """The steps of TERMS for another source of (q_id, question), ending in the table `tag`."""
    out = TERMS.replace("(SELECT DISTINCT q_id, question, regexp_replace", f"(SELECT q_id, question, regexp_replace").replace("FROM sample_questions)", f"FROM {source})")
    for n in ("0", "1", "2", "3"):
        out = out.replace(f"asked{n}", f"{tag}_{n}")
    return out.replace("asked AS (", f"{tag} AS (")


PLAN = (
    f"plan0 AS (SELECT DISTINCT q_id, {squeezed('question')} AS question FROM sample_questions), {terms_of('plan0', 'plan1')}, "
    "plan2 AS (SELECT q_id, question, CASE WHEN length(question) = 0 THEN 'unknown' WHEN h > l THEN 'zh' WHEN h > 0 AND l > 0 THEN 'mixed' WHEN h > 0 THEN 'zh' ELSE 'en' END AS language, query_en FROM plan1), "
    "plan3 AS (SELECT q_id, question, language IN ('zh', 'mixed') AS is_foreign, CASE WHEN language IN ('zh', 'mixed') THEN query_en ELSE '' END AS query_en FROM plan2), "
    f"target AS (SELECT q_id, coalesce(nullif(query_en, ''), question) AS question FROM plan3), {terms_of('target', 'aim')}"
)
VARIANTS = (
    f"WITH {PLAN} SELECT q_id, CASE WHEN is_foreign THEN 'zh_original' ELSE 'default' END AS variant, question AS query, CASE WHEN is_foreign THEN 'zh' ELSE 'en' END AS language, NOT is_foreign AS use_sparse, true AS use_dense, 'original' AS role FROM plan3 "
    "UNION ALL SELECT q_id, 'en_rewrite', query_en, 'en', true, true, 'rewrite' FROM plan3 WHERE is_foreign AND length(query_en) > 0"
)
LIMITS = f"WITH {PLAN} SELECT q_id, CASE WHEN heavy THEN 40 ELSE 20 END::INTEGER AS sparse_limit, 20::INTEGER AS dense_limit, CASE WHEN heavy THEN 40 ELSE 20 END::INTEGER AS fusion_limit FROM aim"

# blocks of papers in reading order: paper_id, idx, text as stored, block_type, section_path, page_number, heading_level
ORDERED = (
    "ordered AS (SELECT paper_id, block_type, section_path, page_number, heading_level, text, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY reading_order IS NULL, coalesce(reading_order, page_number, 0), block_index) - 1 AS INTEGER) AS pos "
    f"FROM (SELECT DISTINCT id, paper_id, block_index, text, block_type, section_path, page_number, heading_level, reading_order FROM paper_document_blocks) WHERE length({stripped('text')}) > 0)"
)
MERGED = f"WITH {ORDERED} SELECT paper_id, pos, 'block' AS kind, block_type, page_number, CAST(length(text) AS INTEGER) AS size FROM ordered"
RENDERED = (
    f"WITH {ORDERED}, l AS (SELECT paper_id, pos, CASE WHEN block_type = 'heading' THEN repeat('#', CAST(least(greatest(coalesce(heading_level, 1), 1), 6) AS INTEGER)) || ' ' || {stripped('text')} ELSE {stripped('text')} END AS l FROM ordered), "
    "t AS (SELECT paper_id, string_agg(l, chr(10) || chr(10) ORDER BY pos) AS t FROM l GROUP BY 1) "
    rf"SELECT paper_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^{BLANK}+|{BLANK}+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n+$', '') AS text FROM t"
)
# a heading stays open until one of its level or above follows
SECTIONS = (
    "WITH b AS (SELECT DISTINCT id, paper_id, page_number, block_index, block_type, heading_level, text FROM paper_document_blocks), "
    f"n AS (SELECT id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page_number NULLS FIRST, block_index NULLS FIRST, id) AS rn, coalesce(block_type = 'heading', false) AS head, least(greatest(coalesce(heading_level, 1), 1), 6) AS lv, {stripped('text')} AS t FROM b), "
    "h AS (SELECT * FROM n WHERE head), s AS (SELECT h.paper_id, h.rn, h.t, min(c.rn) AS closed FROM h LEFT JOIN h c ON c.paper_id = h.paper_id AND c.rn > h.rn AND c.lv <= h.lv GROUP BY 1, 2, 3) "
    "SELECT n.id, coalesce(string_agg(s.t, ' > ' ORDER BY s.rn), '') AS section_path FROM n LEFT JOIN s ON s.paper_id = n.paper_id AND s.rn <= n.rn AND (s.closed IS NULL OR s.closed > n.rn) GROUP BY n.id"
)


def table_body(t: str) -> str:
    focus, value = quoted(X.TABLE_FOCUS.replace("(?iu)", "")), quoted(X.TABLE_VALUE.replace("(?iu)", ""))
    n, g = f"len(regexp_extract_all({t}, '[-+]?[0-9]+(?:\\.[0-9]+)?'))", f"length(regexp_replace({t}, '[^\\p{{Nd}}]', '', 'g'))"
    return f"(({n} >= 3 AND regexp_matches({t}, {focus}, 'i')) OR ({n} >= 4 AND {g} >= 8 AND regexp_matches({t}, {value}, 'i')) OR ({g} >= 10 AND contains({t}, '±')))"


# packing step by step: a block joins the open chunk of its run while it fits
CHUNKS = (
    f"WITH RECURSIVE {ORDERED}, p0 AS (SELECT *, {stripped('text')} AS t FROM ordered), p1 AS (SELECT *, block_type = 'table_like' OR {table_body('t')} AS body FROM p0), "
    f"p2 AS (SELECT paper_id, pos AS idx, CASE WHEN coalesce(block_type, '') IN ('table_caption', 'table_like') OR body THEN t ELSE {squeezed('t')} END AS text, coalesce(nullif(block_type, ''), 'paragraph') AS block_type, "
    f"coalesce(nullif({stripped('section_path')}, ''), 'Document') AS section_id, page_number, coalesce(body, false) AS body FROM p1), "
    f"lead AS (SELECT paper_id, sum({left_of('text', '[^\\x{4e00}-\\x{9fff}]')}) AS h, sum({left_of('text', '[^A-Za-z]')}) AS l FROM p2 WHERE idx < 80 AND block_type <> 'heading' GROUP BY 1), "
    "p3 AS (SELECT p2.*, coalesce(h > 0 AND h >= greatest(2 * l, 8), false) AS han_doc, block_type = 'table_caption' AND coalesce(lead(section_id) OVER w = section_id AND lead(body) OVER w, false) AS pair FROM p2 LEFT JOIN lead USING (paper_id) WINDOW w AS (PARTITION BY p2.paper_id ORDER BY idx)), "
    "p4 AS (SELECT *, CASE WHEN han_doc THEN 850 ELSE 500 END AS child, CASE WHEN block_type = 'heading' THEN 'heading' WHEN lag(pair, 1, false) OVER w THEN 'tail' WHEN pair THEN 'pair' WHEN length(text) > 1000 THEN 'long' "
    "WHEN block_type IN ('table_like', 'table_caption', 'figure_caption') THEN 'alone' ELSE 'plain' END AS kind FROM p3 WINDOW w AS (PARTITION BY paper_id ORDER BY idx)), "
    "k AS (SELECT paper_id, idx, kind, section_id, length(text) AS used, idx AS key FROM p4 WHERE idx = 0 UNION ALL "
    "SELECT n.paper_id, n.idx, n.kind, n.section_id, CASE WHEN n.kind = 'plain' AND k.kind = 'plain' AND k.section_id = n.section_id AND k.used + length(n.text) + 2 <= n.child THEN k.used + length(n.text) + 2 ELSE length(n.text) END, "
    "CASE WHEN n.kind = 'tail' OR (n.kind = 'plain' AND k.kind = 'plain' AND k.section_id = n.section_id AND k.used + length(n.text) + 2 <= n.child) THEN k.key ELSE n.idx END FROM k JOIN p4 n ON n.paper_id = k.paper_id AND n.idx = k.idx + 1), "
    "m AS (SELECT p4.paper_id, k.key, arg_min(p4.section_id, p4.idx) AS section_id, arg_min(p4.kind, p4.idx) AS kind, bool_or(han_doc) AS han_doc, min(page_number) AS page_from, max(page_number) AS page_to, list_sort(list(DISTINCT block_type)) AS block_types, "
    "min(p4.idx) AS first_block, max(p4.idx) AS last_block, bool_or(body OR block_type IN ('table_like', 'table_caption', 'figure_caption')) AS structured, string_agg(text, chr(10) || chr(10) ORDER BY p4.idx) AS body FROM p4 JOIN k ON k.paper_id = p4.paper_id AND k.idx = p4.idx WHERE p4.kind <> 'heading' GROUP BY 1, 2), "
    f"q AS (SELECT m.*, 0 AS piece, body AS body_text FROM m WHERE kind <> 'long' UNION ALL SELECT m.*, i AS piece, trim(substr({squeezed('body')}, CAST(i * 850 + 1 AS BIGINT), 1000)) FROM m, range(CAST(greatest(ceil((length({squeezed('body')}) - 1000) / 850.0), 0) AS BIGINT) + 1) r(i) WHERE kind = 'long'), "
    "kids AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY key, piece) - 1 AS INTEGER) AS chunk_index FROM q), "
    "want AS (SELECT DISTINCT paper_id, section_id, key, first_block AS lo, last_block AS hi FROM kids WHERE (structured OR NOT han_doc) AND last_block > 0), "
    "near AS (SELECT w.paper_id, w.key, b.idx, b.text, coalesce(sum(length(b.text)) OVER (PARTITION BY w.paper_id, w.key ORDER BY CASE WHEN b.idx < lo THEN lo - b.idx ELSE b.idx - hi END, b.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
    "FROM want w JOIN p4 b ON b.paper_id = w.paper_id AND b.section_id = w.section_id AND (b.idx < lo OR b.idx > hi)), "
    "lent AS (SELECT paper_id, key, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS supporting_context FROM near WHERE before < 420 GROUP BY 1, 2), "
    "par AS (SELECT paper_id, section_id, min(idx) AS first_block, max(idx) AS last_block, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS body_text, min(page_number) AS page_from, max(page_number) AS page_to, list_sort(list(DISTINCT block_type)) AS block_types FROM p4 GROUP BY 1, 2), "
    "num AS (SELECT par.*, CAST(n + row_number() OVER (PARTITION BY par.paper_id ORDER BY first_block) - 1 AS INTEGER) AS chunk_index FROM par JOIN (SELECT paper_id, count(*) AS n FROM kids GROUP BY 1) c ON c.paper_id = par.paper_id), "
    "every AS (SELECT kids.paper_id, chunk_index, 'child' AS chunk_role, kids.section_id, kids.body_text, supporting_context, substr(par.body_text, 1, 2200) AS parent_text, kids.page_from, kids.page_to, kids.block_types, kids.first_block, kids.last_block FROM kids "
    "LEFT JOIN lent ON lent.paper_id = kids.paper_id AND lent.key = kids.key LEFT JOIN par ON par.paper_id = kids.paper_id AND par.section_id = kids.section_id UNION ALL "
    "SELECT paper_id, chunk_index, 'parent', section_id, body_text, NULL, NULL, page_from, page_to, block_types, first_block, last_block FROM num)"
)
_TITLE, _SECTION = stripped("t.title"), stripped("CASE WHEN section_id <> 'Document' THEN section_id END")
HEADED = (
    f"{CHUNKS}, headed AS (SELECT e.*, concat_ws(chr(10), CASE WHEN length({_TITLE}) > 0 THEN '论文标题: ' || {_TITLE} END, CASE WHEN length({_SECTION}) > 0 THEN '章节: ' || {_SECTION} END, "
    "CASE WHEN page_from IS NOT NULL THEN '页码: ' || CASE WHEN page_to IS NOT NULL AND page_to <> page_from THEN page_from || '-' || page_to ELSE CAST(page_from AS VARCHAR) END END) AS context_header FROM every e LEFT JOIN (SELECT id, title FROM papers) t ON t.id = e.paper_id)"
)
GREEDY = (
    f"{HEADED} SELECT paper_id, chunk_index, chunk_role, section_id, concat_ws(chr(10) || chr(10), nullif(context_header, ''), body_text) AS content, body_text, context_header, supporting_context, parent_text, "
    f"CAST(len({words('body_text')}) AS INTEGER) AS token_count, page_from, page_to, array_to_string(block_types, ',') AS block_types, CAST(first_block AS INTEGER) AS first_block, CAST(last_block AS INTEGER) AS last_block FROM headed"
)
PARENTS = f"{CHUNKS} SELECT paper_id, section_id, chunk_index, CAST(first_block AS INTEGER) AS first_block, CAST(last_block AS INTEGER) AS last_block, body_text FROM every WHERE chunk_role = 'parent'"
LINKED = f"{CHUNKS} SELECT c.paper_id, c.chunk_index, p.chunk_index AS parent_index FROM every c LEFT JOIN every p ON p.paper_id = c.paper_id AND p.section_id = c.section_id AND p.chunk_role = 'parent' WHERE c.chunk_role = 'child'"

WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
FOLDED = f"SELECT DISTINCT id, translate(text, {quoted(WIDE)}, {quoted(''.join(chr(0x21 + i) for i in range(94)) + ' ')}) AS folded FROM ocr_text_results"


def match_form(x: str) -> str:
    return f"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _sequence(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+|[-+]?[0-9]+(?:\\.[0-9]+)?')"


def gold_steps(n: int) -> str:
    """gold (gold_id, q_id, paper_id, snippet), chunks, and held (gold_id, chunk_id): chunks of the paper that share a run of n signs or the words in sequence."""
    return (
        "q AS (SELECT DISTINCT q_id, gold_evidence FROM sample_questions), e AS (SELECT q_id, unnest(gold_evidence) AS g, unnest(range(len(gold_evidence))) AS n FROM q), keys AS (SELECT DISTINCT paper_key, paper_id FROM sample_papers), "
        "gold AS (SELECT q_id || '#' || n AS gold_id, q_id, k.paper_id, g.snippet AS snippet FROM e JOIN keys k ON k.paper_key = e.g.paper_key), "
        "chunks AS (SELECT DISTINCT id AS chunk_id, paper_id, content AS text, chunk_index AS position FROM paper_chunks), "
        f"gf AS (SELECT gold_id, paper_id, {match_form('snippet')} AS f, {_sequence('snippet')} AS w FROM gold), cf AS (SELECT chunk_id, paper_id, {match_form('text')} AS f, {_sequence('text')} AS w FROM chunks), "
        f"held AS (SELECT DISTINCT gold_id, chunk_id FROM gf JOIN cf USING (paper_id) WHERE (length(gf.f) > 0 AND contains(cf.f, gf.f)) OR len(list_filter(range(length(gf.f) - {n - 1}), lambda i: contains(cf.f, substr(gf.f, CAST(i + 1 AS BIGINT), {n})))) > 0 "
        "OR (len(gf.w) >= 3 AND contains(' ' || array_to_string(cf.w, ' ') || ' ', ' ' || array_to_string(gf.w, ' ') || ' ')))"
    )


def gold_matches(n: int) -> str:
    return f"WITH {gold_steps(n)} SELECT gold_id, chunk_id FROM held"


GRADES = (
    f"WITH {gold_steps(8)}, hits AS (SELECT DISTINCT g.q_id, h.chunk_id FROM held h JOIN gold g USING (gold_id)), a AS (SELECT DISTINCT id, q_id, content, answer_mode, citations_json FROM assistant_drafts WHERE q_id IS NOT NULL), "
    "ci AS (SELECT id, q_id, unnest(citations_json).chunk_id AS chunk_id FROM a), cg AS (SELECT id, count(*) AS cited_gold FROM ci WHERE EXISTS (SELECT 1 FROM hits WHERE hits.q_id = ci.q_id AND hits.chunk_id = ci.chunk_id) GROUP BY 1), "
    "sq AS (SELECT DISTINCT q_id, expected_keywords, keyword_hit_threshold, expected_abstention FROM sample_questions), "
    f"j AS (SELECT a.id, {match_form('a.content')} AS f, coalesce(expected_keywords, []) AS k, coalesce(keyword_hit_threshold, 1) AS t, coalesce(expected_abstention, false) AS ea, coalesce(a.answer_mode = 'kb_insufficient_evidence', false) AS ab, coalesce(len(citations_json), 0) AS n, coalesce(cited_gold, 0) AS cited FROM a JOIN sq USING (q_id) LEFT JOIN cg ON cg.id = a.id), "
    r"h AS (SELECT *, len(list_filter(list_transform(k, lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}_]+', '', 'g'))), lambda x: length(x) > 0 AND contains(f, x))) AS kh FROM j) "
    "SELECT id, CAST(kh AS INTEGER) AS keyword_hits, ea = ab AS abstention_ok, round(CASE WHEN n > 0 THEN cited / CAST(n AS DOUBLE) WHEN ea THEN 1.0 ELSE 0.0 END, 4)::DOUBLE AS citation_precision, CASE WHEN ea THEN ea = ab ELSE (ea = ab) AND kh >= t AND cited > 0 END AS grounded FROM h"
)
