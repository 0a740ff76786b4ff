"""Registered queries of single functions and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.functions import vector as V
from quillmill.operators import catalog, chunking, evaluate, retrieval, structure
from quillmill.plans import sql
from quillmill.plans.reference import LABELLED, R, _gold, _labelled, query

_STORED = "(SELECT DISTINCT id, paper_id, chunk_role, content, page_from, page_to, metadata FROM paper_chunks)"


@query(
    f"WITH {sql.TERMS}, t AS (SELECT q_id, unnest(terms) AS term FROM asked), c AS (SELECT DISTINCT id AS chunk_id, lower(coalesce(content, '')) AS body FROM paper_chunks WHERE chunk_role = 'child'), "
    "h AS (SELECT q_id, chunk_id, sum(round(least(0.35::DOUBLE, 0.08::DOUBLE + length(term) * 0.01::DOUBLE), 4)) AS score FROM t JOIN c ON contains(body, lower(term)) GROUP BY 1, 2) "
    "SELECT q_id, chunk_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 20"
)
def exact_term_hits(s: SparkSession, d: str) -> DataFrame:
    """The twenty child chunks of each question that hold most of its exact terms, anywhere in their text."""
    q = R(s, d, "sample_questions").select("q_id", F.lit("default").alias("variant"), "question").distinct()
    c = catalog.children(R(s, d, "paper_chunks")).select("id", "content").distinct()
    best = retrieval.best_by_terms(c, q.select("q_id", "variant", X.exact_terms(F.col("question")).alias("terms")), 20)
    return best.select("q_id", "chunk_id", F.round("bonus", 4).alias("score"), "rank")


@query(
    "WITH a AS (SELECT DISTINCT id, q_id, content FROM assistant_drafts WHERE q_id IS NOT NULL), q AS (SELECT DISTINCT q_id, question FROM sample_questions), "
    "n AS (SELECT id, list_distinct(regexp_extract_all(coalesce(content, ''), '[-+]?[0-9]+(?:\\.[0-9]+)?')) AS l, regexp_extract_all(coalesce(question, ''), '[-+]?[0-9]+(?:\\.[0-9]+)?') AS r FROM a JOIN q USING (q_id)) "
    "SELECT id, round(CASE WHEN len(l) = 0 THEN 0 ELSE len(list_intersect(l, r)) / CAST(len(l) AS DOUBLE) END, 6) AS overlap FROM n"
)
def number_overlaps(s: SparkSession, d: str) -> DataFrame:
    a = R(s, d, "assistant_drafts").filter("q_id IS NOT NULL").select("id", "q_id", "content").distinct()
    q = R(s, d, "sample_questions").select("q_id", "question").distinct()
    return a.join(q, "q_id").select("id", F.round(X.number_overlap(F.col("content"), F.col("question")), 6).alias("overlap"))


@query(
    rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^{sql.BLANK}+|{sql.BLANK}+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n+$', '') AS compacted FROM documents"
)
def compacted_lines(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "documents").select("doc_id", X.compact_lines(F.col("text")).alias("compacted"))


@query(
    f"SELECT id, repeat('#', CAST(least(greatest(coalesce(heading_level, 1), 1), 6) AS INTEGER)) || ' ' || {sql.stripped('text')} AS line FROM (SELECT DISTINCT id, text, heading_level, block_type FROM paper_document_blocks) WHERE block_type = 'heading' AND text IS NOT NULL"
)
def heading_lines(s: SparkSession, d: str) -> DataFrame:
    b = R(s, d, "paper_document_blocks").filter("block_type = 'heading' AND text IS NOT NULL").select("id", "text", "heading_level").distinct()
    return b.select("id", X.heading_line(X.strip(F.col("text")), F.col("heading_level")).alias("line"))


_T, _S = sql.stripped("t.title"), sql.stripped("c.metadata.section_path")
_PAGES = "CASE WHEN page_from IS NOT NULL THEN '页码: ' || CASE WHEN page_to IS NOT NULL AND page_to <> page_from THEN page_from || '-' || page_to ELSE CAST(page_from AS VARCHAR) END END"


@query(
    f"WITH h AS (SELECT c.id, c.content, concat_ws(chr(10), CASE WHEN length({_T}) > 0 THEN '论文标题: ' || {_T} END, CASE WHEN length({_S}) > 0 THEN '章节: ' || {_S} END, {_PAGES}) AS header FROM {_STORED} c LEFT JOIN papers t ON t.id = c.paper_id), "
    f"p AS (SELECT *, concat_ws(chr(10) || chr(10), nullif({sql.stripped('header')}, ''), nullif({sql.stripped('content')}, '')) AS j FROM h) SELECT id, header, CASE WHEN length(j) > 0 THEN j ELSE coalesce(content, '') END AS payload FROM p"
)
def chunk_payloads(s: SparkSession, d: str) -> DataFrame:
    """Context header and payload of every stored chunk."""
    c = R(s, d, "paper_chunks").select("id", "paper_id", "content", "page_from", "page_to", F.col("metadata.section_path").alias("section")).distinct()
    p = R(s, d, "papers").select(F.col("id").alias("paper_id"), "title")
    j = c.join(p, "paper_id", "left").withColumn("header", X.context_header(F.col("title"), F.col("section"), F.col("page_from"), F.col("page_to")))
    return j.select("id", "header", X.chunk_payload(F.col("header"), F.lit(None).cast("string"), F.col("content")).alias("payload"))


@query(
    f"WITH c AS (SELECT id, list_transform(coalesce(metadata.block_types, []), lambda x: lower(x)) AS b, {sql.stripped('content')} AS t FROM {_STORED}), n AS (SELECT id, b, {sql.table_body('t')} AS body FROM c) "
    "SELECT id, list_contains(b, 'table_like') OR body AS has_body, len(b) > 0 AND len(list_filter(b, lambda x: x <> 'table_caption')) = 0 AND NOT body AS caption_only FROM n"
)
def table_chunks(s: SparkSession, d: str) -> DataFrame:
    c = R(s, d, "paper_chunks").select("id", "content", F.col("metadata.block_types").alias("b")).distinct()
    return c.select("id", X.has_table_body(F.col("b"), F.col("content")).alias("has_body"), X.caption_only(F.col("b"), F.col("content")).alias("caption_only"))


@query(
    f"WITH {sql.gold_steps(8)}, a AS (SELECT DISTINCT id, q_id, citations_json FROM assistant_drafts WHERE q_id IS NOT NULL), ci AS (SELECT q_id, unnest(citations_json).chunk_id AS chunk_id FROM a), "
    "m AS (SELECT DISTINCT g.q_id, h.gold_id FROM held h JOIN gold g USING (gold_id) WHERE EXISTS (SELECT 1 FROM ci WHERE ci.q_id = g.q_id AND ci.chunk_id = h.chunk_id)), n AS (SELECT q_id, count(*) AS gold FROM gold GROUP BY 1) "
    "SELECT q_id, round(CASE WHEN gold > 0 THEN (SELECT count(*) FROM m WHERE m.q_id = n.q_id) / CAST(gold AS DOUBLE) ELSE 0 END, 4) AS coverage FROM n"
)
def citation_coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of each question's gold evidence that its drafts cite."""
    gold, chunks = _gold(s, d)
    held = evaluate.gold_matches(gold, chunks).join(gold.select("gold_id", "q_id"), "gold_id")
    cited = R(s, d, "assistant_drafts").filter("q_id IS NOT NULL").select("q_id", F.explode("citations_json").alias("c")).select("q_id", F.col("c.chunk_id").alias("chunk_id")).distinct()
    return evaluate.coverage(held.join(cited, ["q_id", "chunk_id"], "left_semi"), gold.groupBy("q_id").agg(F.count("*").alias("gold")))


@query(
    "SELECT count(*) AS count, round(coalesce(avg(CAST(keyword_hits AS DOUBLE)), 0), 4) AS keyword_hits, round(coalesce(avg(citation_precision), 0), 4) AS citation_precision FROM (" + sql.GRADES + ")"
)
def grade_summary(s: SparkSession, d: str) -> DataFrame:
    from quillmill.plans.reference import answer_grades

    return evaluate.summary(answer_grades(s, d), ["keyword_hits", "citation_precision"])


@query(
    LABELLED + ", g AS (SELECT q_id, count(*) FILTER (WHERE ql = el AND q_id <> chunk_id) AS gold FROM p GROUP BY 1), dc AS (SELECT q_id, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM r WHERE ql = el AND q_id <> chunk_id AND rank <= 5 GROUP BY 1), "
    "n AS (SELECT q_id, count(*) AS found FROM r WHERE ql = el AND q_id <> chunk_id GROUP BY 1) "
    "SELECT n.q_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(found, 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 4) AS ndcg FROM n LEFT JOIN dc ON dc.q_id = n.q_id"
)
def binary_ndcg_at_5(s: SparkSession, d: str) -> DataFrame:
    """How early the chunks of the asker's label stand among the first five, of those in its list of ten."""
    ranked, hits = _labelled(s, d)
    return evaluate.binary_ndcg(ranked, hits, 5)


@query(
    "WITH q AS (SELECT DISTINCT q_id, session_id, turn_index FROM sample_questions), i AS (SELECT session_id, q_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_index, q_id) - 1 AS INTEGER) AS place FROM q WHERE session_id IS NOT NULL) "
    "SELECT session_id, place, q_id FROM i UNION ALL SELECT NULL, 0, q_id FROM q WHERE session_id IS NULL"
)
def question_run_order(s: SparkSession, d: str) -> DataFrame:
    q = R(s, d, "sample_questions").select("q_id", "session_id", "turn_index").distinct()
    sessions = q.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "q_id"))), lambda x: x["q_id"]).alias("question_ids"))
    return evaluate.run_order(sessions, q.select("q_id")).select("session_id", "place", "q_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings WHERE embedding IS NOT NULL")
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT id, {sql.match_form('title')} AS form FROM papers")
def title_forms(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "papers").select("id", X.match_form("title").alias("form"))


@query("WITH c AS (SELECT paper_id, count(*) AS rows, max(chunk_index) AS last_at FROM (SELECT DISTINCT id, paper_id, chunk_index FROM paper_chunks) GROUP BY 1) SELECT p.id AS paper_id, coalesce(c.rows, 0) AS rows, c.last_at FROM papers p LEFT JOIN c ON c.paper_id = p.id")
def papers_with_chunk_stats(s: SparkSession, d: str) -> DataFrame:
    stats = catalog.group_stats(R(s, d, "paper_chunks").select("id", "paper_id", "chunk_index").distinct(), "paper_id", "chunk_index")
    return catalog.with_stats(R(s, d, "papers").select(F.col("id").alias("paper_id")), stats, "paper_id")


@query("SELECT id, 'data:image/png;base64,' || to_base64(encode(title)) AS url FROM papers WHERE title IS NOT NULL")
def data_urls(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "papers").filter("title IS NOT NULL").select("id", X.png_data_url(F.encode("title", "UTF-8")).alias("url"))


@query("SELECT id, title, CASE WHEN id % 3 = 0 THEN '10.1/x' WHEN id % 3 = 1 THEN NULL ELSE doi END AS doi, status FROM papers")
def patched_papers(s: SparkSession, d: str) -> DataFrame:
    """Papers after updates that set or clear the identifier, try to clear the title (which stays) and name an unknown column."""
    p = R(s, d, "papers").select("id", "title", "doi", "status")
    fields = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("doi"), F.lit(" 10.1/x "), F.lit("title"), F.lit(" "))).otherwise(F.create_map(F.lit("doi"), F.lit(""), F.lit("organization_id"), F.lit("9")))
    return catalog.partial_update(p, p.filter("id % 3 < 2").select("id", fields.alias("fields")), "id", ["title", "doi"])


@query(
    f"WITH q AS (SELECT DISTINCT q_id, category, turn_index, question FROM sample_questions), i AS (SELECT category, turn_index AS position, q_id AS id, {sql.stripped('question')} AS question FROM q WHERE length({sql.stripped('question')}) > 0), "
    "a AS (SELECT q_id, max(content) AS answer FROM (SELECT DISTINCT id, q_id, content FROM assistant_drafts) GROUP BY 1) SELECT i.category, i.position, i.id, i.question, coalesce(a.answer, '') AS answer FROM i LEFT JOIN a ON a.q_id = i.id"
)
def answered_items(s: SparkSession, d: str) -> DataFrame:
    """Question sets by category with the answer of each question."""
    q = R(s, d, "sample_questions").select("q_id", "category", "turn_index", "question").distinct()
    clean, _ = catalog.question_items(q.select("category", F.col("turn_index").alias("position"), F.concat(F.lit(" "), "q_id", F.lit(" ")).alias("id"), "question"), "category")
    a = R(s, d, "assistant_drafts").select("id", "q_id", "content").distinct().join(q.select("q_id", "category"), "q_id").select("category", F.col("q_id").alias("id"), F.col("content").alias("answer"))
    return catalog.answers_in_order(clean, a, "category").select("category", "position", "id", "question", "answer")


@query(
    "WITH l AS (SELECT n_regionkey, n_nationkey, 'key: ' || n_nationkey || '; name: ' || trim(n_name) AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation), "
    "t AS (SELECT n_regionkey, string_agg(line, chr(10) ORDER BY n_nationkey) AS body FROM l WHERE i <= 3 GROUP BY 1) SELECT r_regionkey, trim(r_name) || chr(10) || body AS text FROM region JOIN t ON t.n_regionkey = r_regionkey"
)
def region_tables(s: SparkSession, d: str) -> DataFrame:
    """Small tables as text: caption and first three rows."""
    row = F.struct("n_nationkey", F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name"), F.lit("blank"), F.lit(" ")).alias("m"))
    rows = R(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(row).alias("x"))
    rows = rows.withColumn("x", F.transform(F.array_sort("x", lambda a, b: F.when(a["n_nationkey"] < b["n_nationkey"], -1).otherwise(1)), lambda v: v["m"]))
    return R(s, d, "region").join(rows, "r_regionkey").select("r_regionkey", X.table_text(F.col("r_name"), F.lit(None).cast("string"), F.col("x"), 3).alias("text"))


_ALL = "(SELECT DISTINCT id, paper_id, block_index, text, block_type, section_path, page_number, heading_level, reading_order FROM paper_document_blocks)"


@query(
    f"WITH b AS (SELECT paper_id, reading_order, page_number, section_path, block_index AS i, CASE block_type WHEN 'table_like' THEN 1 WHEN 'caption' THEN 2 ELSE 0 END AS g, block_type, CASE block_type WHEN 'table_like' THEN {sql.stripped('text')} WHEN 'caption' THEN {sql.stripped('text')} ELSE text END AS text FROM {_ALL}) "
    "SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY reading_order IS NULL, coalesce(reading_order, page_number, 0), g, i) - 1 AS INTEGER) AS pos, CASE g WHEN 1 THEN 'table' WHEN 2 THEN 'picture' ELSE 'block' END AS kind, "
    f"CASE g WHEN 1 THEN 'table_like' WHEN 2 THEN 'figure_caption' ELSE block_type END AS block_type, section_path, page_number, text FROM b WHERE length({sql.stripped('text')}) > 0"
)
def merged_parts(s: SparkSession, d: str) -> DataFrame:
    """Blocks, tables and pictures of every paper in one reading order; table-like blocks stand for tables, captions for pictures."""
    b = R(s, d, "paper_document_blocks").distinct()
    tables = b.filter("block_type = 'table_like'").select(
        "paper_id", "reading_order", F.col("page_number").alias("page_from"), "section_path", "heading_level", F.col("block_index").alias("table_index"),
        F.lit(None).cast("string").alias("caption"), F.col("text").alias("markdown"), F.lit(None).cast("array<map<string,string>>").alias("data"),
    )
    pictures = b.filter("block_type = 'caption'").select("paper_id", "reading_order", "page_number", "section_path", "heading_level", F.col("block_index").alias("picture_index"), F.col("text").alias("caption"), F.lit(" ").alias("description"))
    rest = b.filter("block_type NOT IN ('table_like', 'caption') OR block_type IS NULL")
    return structure.merge_structure(rest, tables, pictures).select("paper_id", "pos", "kind", "block_type", "section_path", "page_number", "text")


@query(
    "WITH r AS (SELECT doc_id AS q_id, nullif(doc_id % 23, 0) AS sparse, nullif(doc_id % 19, 0) AS dense, CASE WHEN doc_id % 5 < 2 THEN doc_id % 29 + 1 END AS fused, CASE WHEN doc_id % 7 = 0 THEN doc_id % 31 + 1 END AS reranked, doc_id % 3 + 1 AS gold_chunks FROM documents) "
    "SELECT q_id, CASE WHEN reranked <= 10 THEN 'retrieved' WHEN fused <= 10 THEN 'rerank' WHEN sparse <= 10 OR dense <= 10 THEN 'fusion' WHEN gold_chunks > 1 THEN 'chunking' WHEN sparse IS NULL AND dense IS NOT NULL THEN 'sparse' WHEN dense IS NULL AND sparse IS NOT NULL THEN 'dense' ELSE 'recall' END AS stage FROM r"
)
def stage_precedence(s: SparkSession, d: str) -> DataFrame:
    """The stage at which an evidence is lost, for every combination of ranks."""
    i = F.col("q_id")
    ranks = R(s, d, "documents").select(F.col("doc_id").alias("q_id")).withColumns({
        "sparse": F.nullif(i % 23, F.lit(0)), "dense": F.nullif(i % 19, F.lit(0)), "fused": F.when(i % 5 < 2, i % 29 + 1), "reranked": F.when(i % 7 == 0, i % 31 + 1), "gold_chunks": i % 3 + 1,
    })
    return evaluate.failure_stage(ranks).select("q_id", "stage")


@query(
    f"SELECT id AS paper_id, 'Structured blocks unavailable for chunking' AS error FROM papers p WHERE NOT EXISTS (SELECT 1 FROM paper_document_blocks b WHERE b.paper_id = p.id AND length({sql.stripped('b.text')}) > 0)"
)
def papers_without_structure(s: SparkSession, d: str) -> DataFrame:
    papers = R(s, d, "papers").select(F.col("id").alias("paper_id"))
    return chunking.without_structure(papers, R(s, d, "paper_document_blocks").select("paper_id", "text"))
