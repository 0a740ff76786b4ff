"""Registered queries of the catalog, structure, retrieval, evidence, evaluation and event operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.operators import catalog, chunking, evaluate, evidence, retrieval, structure
from quillmill.plans import sql
from quillmill.session import read_table, shared_folder
from quillmill.sources.plugins import embed_with, rerank_with
from quillmill.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(counterpart: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if counterpart:
            ORACLE[f.__name__] = counterpart
        return f

    return register


R = read_table
_words, _squeezed, _left, _cosine = sql.words, sql.squeezed, sql.left_of, sql.cosine


@query("SELECT organization_id, count(*) AS live, max(updated_at) AS last_at FROM papers WHERE deleted_at IS NULL GROUP BY 1")
def live_papers_by_tenant(s: SparkSession, d: str) -> DataFrame:
    return catalog.live(R(s, d, "papers")).groupBy("organization_id").agg(F.count("*").alias("live"), F.max("updated_at").alias("last_at"))


@query("SELECT id, title, updated_at FROM papers WHERE deleted_at IS NULL ORDER BY updated_at DESC, id DESC LIMIT 50")
def paper_list_latest50(s: SparkSession, d: str) -> DataFrame:
    return catalog.top_rows(catalog.live(R(s, d, "papers")), [F.desc("updated_at"), F.desc("id")], 50).select("id", "title", "updated_at")


@query(
    "SELECT p.id, p.title, a.id AS asset_id, a.metadata_json.original_filename AS filename, n.assets FROM papers p "
    "LEFT JOIN (SELECT * FROM (SELECT DISTINCT id, paper_id, metadata_json FROM paper_assets) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) = 1) a ON a.paper_id = p.id "
    "LEFT JOIN (SELECT paper_id, count(DISTINCT id) AS assets FROM paper_assets GROUP BY 1) n ON n.paper_id = p.id WHERE p.deleted_at IS NULL"
)
def paper_detail_latest_asset(s: SparkSession, d: str) -> DataFrame:
    assets = R(s, d, "paper_assets").select("id", "paper_id", F.col("metadata_json.original_filename").alias("filename")).distinct()
    last = catalog.latest_by(assets, ["paper_id"], [F.desc("id")]).select("paper_id", F.col("id").alias("asset_id"), "filename")
    n = assets.groupBy("paper_id").agg(F.countDistinct("id").alias("assets"))
    p = catalog.live(R(s, d, "papers")).select("id", "title")
    return p.join(last, p.id == last.paper_id, "left").drop("paper_id").join(n, F.col("id") == n.paper_id, "left").drop("paper_id")


@query(
    "SELECT p.organization_id, count(*) AS chunks, CAST(sum(c.token_count) AS BIGINT) AS tokens FROM (SELECT DISTINCT id, paper_id, chunk_role, token_count FROM paper_chunks) c "
    "JOIN papers p ON p.id = c.paper_id WHERE p.deleted_at IS NULL AND c.chunk_role = 'child' GROUP BY 1"
)
def child_chunks_by_tenant(s: SparkSession, d: str) -> DataFrame:
    chunks = R(s, d, "paper_chunks").select("id", "paper_id", "chunk_role", "token_count").distinct()
    j = catalog.chunks_of_papers(chunks, R(s, d, "papers"))
    return j.groupBy("organization_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query(
    "WITH a AS (SELECT DISTINCT id, paper_id, metadata_json.original_filename AS f FROM paper_assets), b AS (SELECT p.organization_id, lower(regexp_extract(a.f, '[^/\\\\]*$')) AS file_key, a.id FROM a JOIN papers p ON p.id = a.paper_id WHERE p.deleted_at IS NULL AND a.f IS NOT NULL) "
    "SELECT organization_id, file_key, count(*) AS copies, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY 1, 2 HAVING count(*) > 1"
)
def duplicate_filenames(s: SparkSession, d: str) -> DataFrame:
    a = R(s, d, "paper_assets").select("id", "paper_id", F.col("metadata_json.original_filename").alias("f")).distinct().filter("f IS NOT NULL")
    p = catalog.live(R(s, d, "papers")).select(F.col("id").alias("paper_id"), "organization_id")
    return catalog.duplicate_groups(a.join(p, "paper_id").withColumn("file_key", catalog.file_key(F.col("f"))), ["organization_id", "file_key"], "id")


@query(
    "SELECT sha256(text) AS content_hash, substr(sha256(text), 1, 2) AS shard, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
)
def duplicate_content_groups(s: SparkSession, d: str) -> DataFrame:
    docs = R(s, d, "documents").filter("text IS NOT NULL").withColumn("content_hash", F.sha2("text", 256)).withColumn("shard", F.substring("content_hash", 1, 2))
    return catalog.duplicate_groups(docs, ["content_hash", "shard"], "doc_id")


@query("SELECT id, title FROM papers p WHERE NOT EXISTS (SELECT 1 FROM paper_chunks c WHERE c.paper_id = p.id AND c.chunk_role = 'child')")
def papers_without_chunks(s: SparkSession, d: str) -> DataFrame:
    chunks = catalog.children(R(s, d, "paper_chunks")).select(F.col("paper_id").alias("id"))
    return R(s, d, "papers").select("id", "title").join(chunks, "id", "left_anti")


def _turns(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "sample_questions").filter("session_id IS NOT NULL").select("q_id", "session_id", "turn_index", "question", F.lit("user").alias("role")).distinct()


TURNS = "(SELECT DISTINCT q_id, session_id, turn_index, question FROM sample_questions WHERE session_id IS NOT NULL)"


@query(f"SELECT session_id, count(*) AS turns, max(turn_index) AS last_turn FROM {TURNS} GROUP BY 1")
def topic_stats(s: SparkSession, d: str) -> DataFrame:
    return catalog.group_stats(_turns(s, d), "session_id", "turn_index").withColumnsRenamed({"rows": "turns", "last_at": "last_turn"})


@query(
    f"WITH f AS (SELECT session_id, arg_min(question, turn_index) AS q FROM {TURNS} GROUP BY 1), z AS (SELECT session_id, {_squeezed('q')} AS q FROM f) "
    "SELECT session_id, CASE WHEN length(q) <= 24 THEN q ELSE rtrim(substr(q, 1, 24)) || '...' END AS title FROM z"
)
def topic_title(s: SparkSession, d: str) -> DataFrame:
    return catalog.session_titles(_turns(s, d), "session_id", "turn_index", "role", "question")


@query(
    f"SELECT q_id, concat_ws(chr(10), lag(question, 2) OVER w, lag(question, 1) OVER w, question) AS context FROM {TURNS} WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)"
)
def context_query_last2(s: SparkSession, d: str) -> DataFrame:
    return catalog.previous_turns(_turns(s, d), "session_id", "turn_index", "role", "question").select("q_id", "context")


@query(
    f"SELECT q_id, coalesce(array_to_string(list(question) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history FROM {TURNS}"
)
def history_last8(s: SparkSession, d: str) -> DataFrame:
    h = catalog.history(_turns(s, d), "session_id", "turn_index", "question")
    return h.select("q_id", F.array_join("history", "\n").alias("history"))


@query(
    "WITH a AS (SELECT DISTINCT id, content FROM assistant_drafts WHERE length(content) > 0) SELECT id, CAST(i AS INTEGER) AS seq, substr(content, CAST(i * 24 + 1 AS BIGINT), 24) AS piece FROM a, range(CAST(ceil(length(content) / 24.0) AS BIGINT)) t(i)"
)
def answer_pieces_24(s: SparkSession, d: str) -> DataFrame:
    return catalog.stream_pieces(R(s, d, "assistant_drafts").select("id", "content").distinct(), "id", "content")


@query(f"SELECT doc_id, len({_words('text')}) AS token_count, len(list_distinct({_words('text')})) AS distinct_tokens FROM documents")
def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    t = R(s, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("token_count"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


HAN, LATIN = _left("text", r"[^\x{4e00}-\x{9fff}]"), _left("text", "[^A-Za-z]")


@query(
    f"WITH c AS (SELECT doc_id, {HAN} AS h, {LATIN} AS l, length({_squeezed('text')}) AS n FROM documents) "
    "SELECT doc_id, h AS han, l AS latin, CASE WHEN n = 0 THEN 'unknown' WHEN h > l THEN 'zh' WHEN h > 0 AND l > 0 THEN 'mixed' WHEN h > 0 THEN 'zh' ELSE 'en' END AS language, h > 0 AND h >= greatest(2 * l, 8) AS han_dominant FROM c"
)
def script_language(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return R(s, d, "documents").select("doc_id", X.han_count(t).cast("long").alias("han"), X.latin_count(t).cast("long").alias("latin"), X.question_language(t).alias("language"), X.han_dominant(t).alias("han_dominant"))


@query(
    f"WITH c AS (SELECT doc_id, {_squeezed('text')} AS t FROM documents) SELECT doc_id, length(t) AS squeezed, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 180)) || '...' END AS clipped, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '...' END AS preview FROM c"
)
def clip_snippet(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return R(s, d, "documents").select("doc_id", F.length(X.squeeze(t)).cast("long").alias("squeezed"), X.clip(t, 180).alias("clipped"), X.preview(t).alias("preview"))


@query(sql.QUESTION_TERMS)
def question_terms(s: SparkSession, d: str) -> DataFrame:
    """Exact terms, focus terms, structure and template terms, and the English query of every question."""
    q = R(s, d, "sample_questions").select("q_id", "question").distinct()
    t = q.withColumn("terms", X.exact_terms(F.col("question")))
    return t.select(
        "q_id", F.array_join("terms", "|").alias("terms"), F.array_join(X.focus_terms(F.col("question")), "|").alias("focus"), F.array_join(X.structure_terms(F.col("question")), "|").alias("structure"),
        X.english_query(F.col("question"), F.col("terms")).alias("query_en"), X.asks_for_table(F.col("question")).alias("is_table"), X.exact_heavy(F.col("question")).alias("heavy"),
    )


@query(
    "WITH c AS (SELECT id, regexp_replace(regexp_replace(trim(coalesce(doi, '')), '^doi:\\s*', '', 'i'), '^https?://(dx\\.)?doi\\.org/', '', 'i') AS v, trim(coalesce(source_url, '')) AS u FROM papers) "
    "SELECT id, CASE WHEN regexp_full_match(v, '10\\.\\S+/\\S+') THEN v END AS doi, CASE WHEN regexp_matches(u, '^https?://[^/?#]+', 'i') THEN u END AS url FROM c"
)
def doi_url_normalize(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "papers").select("id", X.normalize_doi(F.col("doi")).alias("doi"), X.valid_url(F.col("source_url")).alias("url"))


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def json_props(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return R(s, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k_sum"))


@query(
    f"WITH c AS (SELECT doc_id, {_squeezed('text')} AS t FROM documents), w AS (SELECT doc_id, i, substr(t, CAST(i * 850 + 1 AS BIGINT), 1000) AS w FROM c, range(CAST(greatest(ceil((length(t) - 1000) / 850.0), 0) AS BIGINT) + 1) r(i) WHERE length(t) > 0) "
    "SELECT doc_id, CAST(i AS INTEGER) AS piece, trim(w) AS content, CAST(i * 850 + length(w) - length(ltrim(w)) AS INTEGER) AS char_start FROM w"
)
def window_chunks(s: SparkSession, d: str) -> DataFrame:
    w = R(s, d, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 1000, 150)).alias("piece", "w"))
    return w.select("doc_id", "piece", "w.content", "w.char_start")


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "paper_document_blocks").distinct()


def _parts(s: SparkSession, d: str) -> DataFrame:
    return structure.merge_structure(_blocks(s, d))


ORDERED = "(SELECT DISTINCT id, paper_id, block_index, text, block_type, section_path, page_number, heading_level, reading_order FROM paper_document_blocks)"


@query(
    f"WITH b AS (SELECT * FROM {ORDERED} WHERE length(trim(coalesce(text, ''))) > 0) SELECT id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY block_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM b WINDOW w AS (PARTITION BY paper_id ORDER BY block_index, id)"
)
def block_offsets(s: SparkSession, d: str) -> DataFrame:
    b = _blocks(s, d).filter("length(trim(coalesce(text, ''))) > 0")
    return chunking.block_offsets(b, "paper_id", ["block_index", "id"], "text").select("id", "pos", "char_start")


@query("SELECT DISTINCT id, CASE WHEN regexp_matches(docling_label, 'section|heading|title', 'i') THEN 'heading' WHEN docling_label ILIKE '%table%' THEN 'table_like' WHEN regexp_matches(docling_label, 'picture|figure', 'i') THEN 'figure_caption' WHEN docling_label ILIKE '%list%' THEN 'list' ELSE 'paragraph' END AS block_type FROM paper_document_blocks")
def label_block_types(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("id", structure.block_type(F.col("docling_label")).alias("block_type"))


@query(sql.MERGED)
def merged_structure(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select("paper_id", "pos", "kind", "block_type", "page_number", F.length("text").alias("size"))


@query(sql.RENDERED)
def rendered_papers(s: SparkSession, d: str) -> DataFrame:
    return structure.render(_parts(s, d))


@query(sql.GREEDY)
def greedy_chunks(s: SparkSession, d: str) -> DataFrame:
    """Child and parent chunks of every paper."""
    titles = R(s, d, "papers").select(F.col("id").alias("paper_id"), "title")
    c = chunking.chunk_papers(_parts(s, d), titles)
    return c.withColumn("block_types", F.array_join("block_types", ","))


@query(sql.SECTIONS)
def section_paths(s: SparkSession, d: str) -> DataFrame:
    b = _blocks(s, d).withColumn("o", F.struct("page_number", "block_index", "id"))
    out = chunking.section_paths(b.drop("section_path"), "paper_id", "o", "heading_level", "text", F.coalesce(F.col("block_type") == "heading", F.lit(False)))
    return out.select("id", "section_path")


@query(sql.PARENTS)
def parent_sections(s: SparkSession, d: str) -> DataFrame:
    """The parent chunk of every section."""
    c = chunking.chunk_papers(_parts(s, d)).filter("chunk_role = 'parent'")
    return c.select("paper_id", "section_id", "chunk_index", "first_block", "last_block", "body_text")


@query(sql.LINKED)
def parent_child_link(s: SparkSession, d: str) -> DataFrame:
    """Every child chunk with the place of its parent."""
    return chunking.link_parents(chunking.chunk_papers(_parts(s, d))).select("paper_id", "chunk_index", "parent_index")


@query(
    "WITH c AS (SELECT DISTINCT id, paper_id, parent_chunk_id, chunk_role, content FROM paper_chunks) SELECT k.id, p.id AS parent_id, length(p.content) AS parent_chars FROM c k LEFT JOIN c p ON p.id = k.parent_chunk_id AND p.chunk_role = 'parent' WHERE k.chunk_role = 'child'"
)
def stored_parents(s: SparkSession, d: str) -> DataFrame:
    """Stored children with the parent their column names."""
    c = R(s, d, "paper_chunks").select("id", "parent_chunk_id", "chunk_role", "content").distinct()
    p = c.filter("chunk_role = 'parent'").select(F.col("id").alias("parent_id"), F.length("content").cast("long").alias("parent_chars"))
    return catalog.children(c).join(p, F.col("parent_chunk_id") == F.col("parent_id"), "left").select("id", "parent_id", "parent_chars")


@query(f"SELECT id, {sql.table_body('t')} AS table_body FROM (SELECT id, trim(coalesce(text, '')) AS t FROM {ORDERED})")
def table_body_predicate(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("id", X.looks_like_table_body(F.col("text")).alias("table_body"))


@query("SELECT page_number, count(*) AS blocks, count(linked) AS linked FROM (SELECT b.page_number, p.id AS linked FROM (SELECT DISTINCT id, paper_id, page_number FROM paper_document_blocks) b LEFT JOIN paper_document_pages p ON p.paper_id = b.paper_id AND p.page_number = b.page_number) GROUP BY 1")
def page_lookup(s: SparkSession, d: str) -> DataFrame:
    b = structure.page_ids(_blocks(s, d).select("id", "paper_id", "page_number"), R(s, d, "paper_document_pages"))
    return b.groupBy("page_number").agg(F.count("*").alias("blocks"), F.count("linked_page_id").alias("linked"))


@query("SELECT coalesce(p.paper_id, b.paper_id) AS paper_id, coalesce(pages, 0) AS pages, coalesce(blocks, 0) AS blocks FROM (SELECT paper_id, count(*) AS pages FROM paper_document_pages GROUP BY 1) p FULL JOIN (SELECT paper_id, count(DISTINCT id) AS blocks FROM paper_document_blocks GROUP BY 1) b ON p.paper_id = b.paper_id")
def extraction_counters(s: SparkSession, d: str) -> DataFrame:
    return structure.counters(R(s, d, "paper_document_pages"), _blocks(s, d))


@query(
    "WITH t AS (SELECT DISTINCT id, text FROM ocr_text_results WHERE text IS NOT NULL), n AS (SELECT id, length(regexp_replace(text, '[^\\x{FF01}-\\x{FF5E}]', '', 'g')) AS a, length(regexp_replace(text, '[^\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]', '', 'g')) AS l, "
    "length(regexp_replace(text, '[^\\x{FF10}-\\x{FF19}]', '', 'g')) AS g, length(regexp_replace(text, '[^\\x{3000}]', '', 'g')) AS s FROM t) SELECT id, a AS fullwidth_ascii_count, l AS fullwidth_latin_count, g AS fullwidth_digit_count, a - l - g AS fullwidth_ascii_punctuation_count, s AS fullwidth_space_count FROM n"
)
def ocr_fold_counts(s: SparkSession, d: str) -> DataFrame:
    t = R(s, d, "ocr_text_results").select("id", "text").distinct().filter("text IS NOT NULL").select("id", X.fullwidth_counts(F.col("text")).alias("c"))
    names = ("fullwidth_ascii_count", "fullwidth_latin_count", "fullwidth_digit_count", "fullwidth_ascii_punctuation_count", "fullwidth_space_count")
    return t.select("id", *[F.col(f"c.{x}").cast("long").alias(x) for x in names])


@query(sql.FOLDED)
def ocr_folded(s: SparkSession, d: str) -> DataFrame:
    return R(s, d, "ocr_text_results").select("id", X.fold_fullwidth(F.col("text")).alias("folded")).distinct()


@query(
    "WITH a AS (SELECT paper_id, min(metadata_json.structured_summary.doi) AS found FROM paper_assets GROUP BY 1) SELECT p.id, coalesce(nullif(trim(p.doi), ''), nullif(trim(a.found), '')) AS doi, "
    "CASE WHEN trim(coalesce(p.doi, '')) = '' THEN NULL WHEN lower(trim(p.doi)) = lower(trim(coalesce(a.found, ''))) THEN 'auto' ELSE 'manual' END AS origin FROM papers p LEFT JOIN a ON a.paper_id = p.id"
)
def fill_doi(s: SparkSession, d: str) -> DataFrame:
    found = R(s, d, "paper_assets").groupBy("paper_id").agg(F.min("metadata_json.structured_summary.doi").alias("found"))
    p = R(s, d, "papers").select("id", "doi").join(found, F.col("id") == F.col("paper_id"), "left")
    return p.select("id", catalog.fill_if_empty(F.col("doi"), F.col("found")).alias("doi"), catalog.provenance(F.col("doi"), F.col("found")).alias("origin"))


@query("SELECT id, published_at, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS place FROM papers WHERE deleted_at IS NULL")
def papers_sorted_nulls_last(s: SparkSession, d: str) -> DataFrame:
    """The place of every live paper."""
    return catalog.date_places(catalog.live(R(s, d, "papers")).select("id", "published_at"), "published_at", "id")


# --- retrieval over documents and vectors: the vector of a document is the one of its number; every 50th asks ---


def _vector_docs(s: SparkSession, d: str) -> DataFrame:
    """Every document; those without a vector have a null one and are searched and ask by their text alone."""
    e = R(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(e, "id", "left")


def _askers(docs: DataFrame) -> DataFrame:
    return docs.filter("id % 50 = 0 AND length(content) > 0").select(F.col("id").alias("q_id"), F.lit("default").alias("variant"), F.col("content").alias("query"), F.col("embedding").alias("vector"))


DOCS = "docs AS (SELECT d.doc_id AS id, d.text AS content, e.embedding AS v FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id), asks AS (SELECT id AS q_id, content AS query, v AS qv FROM docs WHERE id % 50 = 0 AND length(content) > 0)"
PAIRS = f"pairs AS (SELECT q_id, id AS chunk_id, {_cosine('qv', 'v')} AS cos, list_distinct({_words('query')}) AS q, {_words('content')} AS c FROM asks, docs)"
LEX = "CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / CAST(len(q) AS DOUBLE) END"


@query(
    f"WITH a AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT q.vec_id AS q_id, e.vec_id AS chunk_id, {_cosine('q.embedding', 'e.embedding')} AS score FROM a q, a e WHERE q.vec_id % 50 = 0) "
    "SELECT q_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10"
)
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    e = R(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter("id % 50 = 0").select(F.col("id").alias("q_id"), F.lit("default").alias("variant"), F.col("embedding").alias("vector"))
    return retrieval.dense_search(e, q, 10).select("q_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


MIXED = f"WITH {DOCS}, {PAIRS}, m AS (SELECT q_id, chunk_id, cos, {LEX} AS lex FROM pairs), sc AS (SELECT q_id, chunk_id, CASE WHEN cos > 0 AND lex > 0 THEN 0.8::DOUBLE * cos + 0.2::DOUBLE * lex WHEN cos > 0 THEN cos ELSE lex END AS score FROM m)"


@query(MIXED + " SELECT q_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM sc WHERE score >= 0.12 QUALIFY rank <= 5")
def fallback_hybrid(s: SparkSession, d: str) -> DataFrame:
    docs = _vector_docs(s, d)
    return retrieval.fallback_search(docs, _askers(docs)).select("q_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"WITH a AS (SELECT doc_id AS q_id, list_distinct({_words('text')}) AS q FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL), c AS (SELECT doc_id AS chunk_id, {_words('text')} AS c FROM documents) "
    "SELECT q_id, chunk_id FROM a, c WHERE len(q) > 0 AND list_has_all(c, q)"
)
def sparse_and_match(s: SparkSession, d: str) -> DataFrame:
    docs = R(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = docs.filter("id % 50 = 0 AND content IS NOT NULL").select(F.col("id").alias("q_id"), F.lit("default").alias("variant"), F.col("content").alias("query"), F.array().cast("array<string>").alias("terms"))
    return retrieval.sparse_search(docs, q, 1 << 30).select("q_id", "chunk_id")


def _hybrid(s: SparkSession, d: str, k: int = 20) -> DataFrame:
    docs = _vector_docs(s, d)
    asks = _askers(docs)
    lex = retrieval.overlap_search(docs, asks, k).select("q_id", F.lit("sparse").alias("source"), F.lit(0).alias("source_pos"), "chunk_id", "score", "rank")
    cos = retrieval.dense_search(docs, asks, k).select("q_id", F.lit("dense").alias("source"), F.lit(1).alias("source_pos"), "chunk_id", "score", "rank")
    return retrieval.fuse(lex.unionByName(cos), k)


FUSED = (
    f"WITH {DOCS}, {PAIRS}, m AS (SELECT q_id, chunk_id, cos, {LEX} AS lex FROM pairs), l AS (SELECT q_id, 0 AS sp, chunk_id, lex AS score, row_number() OVER (PARTITION BY q_id ORDER BY round(lex, 9) DESC, chunk_id) AS rank FROM m WHERE lex > 0 QUALIFY rank <= 20), "
    "e AS (SELECT q_id, 1 AS sp, chunk_id, cos AS score, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 9) DESC, chunk_id) AS rank FROM m WHERE cos IS NOT NULL QUALIFY rank <= 20), u AS (SELECT * FROM l UNION ALL SELECT * FROM e), "
    "g AS (SELECT q_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, max(score) AS best, min(sp * 1000 + rank) AS f FROM u GROUP BY 1, 2), "
    "r AS (SELECT q_id, chunk_id, score, best, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, round(best, 9) DESC, f, chunk_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 20)"
)


@query(FUSED + " SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM r")
def hybrid_retrieval(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d).select("q_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


SUPPORT = FUSED + ", n AS (SELECT q_id, chunk_id, rank, score / max(score) OVER (PARTITION BY q_id) AS share, count(*) OVER (PARTITION BY q_id) AS n FROM r), ev AS (SELECT q_id, chunk_id, rank, round(least(0.99::DOUBLE, greatest(0.05::DOUBLE, share * 0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN n = 1 THEN 1 ELSE 1 - (rank - 1) / CAST(greatest(n - 1, 1) AS DOUBLE) END)), 4) AS s FROM n)"


@query(SUPPORT + " SELECT q_id, chunk_id, 'chunk-' || chunk_id AS evidence_id, round(s, 3) AS support_score FROM ev")
def evidence_support(s: SparkSession, d: str) -> DataFrame:
    return evidence.support(_hybrid(s, d)).select("q_id", "chunk_id", "evidence_id", F.round("support_score", 3).alias("support_score"))


@query(
    SUPPORT + ", z AS (SELECT *, coalesce(sum(s) OVER w, 0) AS before, count(*) OVER w AS c FROM ev WINDOW w AS (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), x AS (SELECT * FROM z WHERE NOT (c >= 2 AND before >= 0.9) AND c < 4) "
    "SELECT q_id, count(*) AS evidence_count, round(max(s), 3) AS top_support, max(s) >= 0.55 AND sum(s) >= 0.9 AS sufficient FROM x GROUP BY 1"
)
def sufficiency(s: SparkSession, d: str) -> DataFrame:
    e = evidence.select_evidence(evidence.support(_hybrid(s, d)))
    out = evidence.sufficiency(e.select("q_id").distinct(), e)
    return out.select("q_id", "evidence_count", F.round("top_support", 3).alias("top_support"), "sufficient")


@query(
    SUPPORT + ", z AS (SELECT *, coalesce(sum(s) OVER w, 0) AS before, count(*) OVER w AS c FROM ev WINDOW w AS (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), x AS (SELECT * FROM z WHERE NOT (c >= 2 AND before >= 0.9) AND c < 4), "
    "y AS (SELECT q_id, count(*) AS evidence_count, max(s) >= 0.55 AND round(sum(s), 4) >= 0.9 AS sufficient, round(avg(s), 4) AS mean FROM x GROUP BY 1) SELECT q_id, evidence_count, sufficient, true AS supported, CASE WHEN sufficient AND mean >= 0.5 THEN 'knowledge_base' ELSE 'kb_insufficient_evidence' END AS answer_mode FROM y"
)
def answer_decision(s: SparkSession, d: str) -> DataFrame:
    e = evidence.select_evidence(evidence.support(_hybrid(s, d)))
    out = evidence.decide(evidence.verify(evidence.sufficiency(e.select("q_id").distinct(), e)))
    return out.select("q_id", "evidence_count", "sufficient", "supported", "answer_mode")


def _labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense lists of ten without the asker itself, and the chunks of the asker's label."""
    e = R(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = e.filter("id % 50 = 0")
    ranked = retrieval.dense_search(e, q.select(F.col("id").alias("q_id"), F.lit("default").alias("variant"), F.col("embedding").alias("vector")), 10)
    hits = ranked.join(q.select(F.col("id").alias("q_id"), F.col("label").alias("ql")), "q_id").join(e.select(F.col("id").alias("chunk_id"), "label"), "chunk_id").filter("label = ql AND q_id <> chunk_id")
    return ranked, hits.select("q_id", "chunk_id")


LABELLED = (
    f"WITH p AS (SELECT q.vec_id AS q_id, e.vec_id AS chunk_id, q.label AS ql, e.label AS el, {_cosine('q.embedding', 'e.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p QUALIFY rank <= 10), h AS (SELECT q_id, min(CASE WHEN ql = el AND q_id <> chunk_id THEN rank END) AS hr FROM r GROUP BY 1)"
)


@query(LABELLED + " SELECT q_id, CASE WHEN hr <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_1, CASE WHEN hr <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_5, CASE WHEN hr <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_10, round(coalesce(1.0::DOUBLE / hr, 0), 4) AS mrr FROM h")
def hit_at_k_mrr(s: SparkSession, d: str) -> DataFrame:
    ranked, hits = _labelled(s, d)
    return evaluate.rank_metrics(evaluate.first_hits(ranked, hits, ["q_id"]))


@query(
    LABELLED + ", t AS (SELECT q_id, count(*) FILTER (WHERE ql = el AND q_id <> chunk_id) AS gold FROM p GROUP BY 1), dc AS (SELECT q_id, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM r WHERE ql = el AND q_id <> chunk_id GROUP BY 1) "
    "SELECT t.q_id, round(CASE WHEN gold > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END, 4) AS ndcg FROM t LEFT JOIN dc ON dc.q_id = t.q_id"
)
def ndcg_at_10(s: SparkSession, d: str) -> DataFrame:
    ranked, hits = _labelled(s, d)
    e = R(s, d, "embeddings").select("vec_id", "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    gold = e.filter("vec_id % 50 = 0").join(sizes, "label").select(F.col("vec_id").alias("q_id"), "gold")
    return evaluate.ndcg(ranked, hits.withColumn("gold_id", F.col("chunk_id")), gold, 10)


@query(
    "WITH q AS (SELECT DISTINCT q_id, category, keyword_hit_threshold, len(expected_keywords) AS k FROM sample_questions) SELECT category, count(*) AS count, round(avg(CAST(k AS DOUBLE)), 4) AS keywords, round(avg(CAST(keyword_hit_threshold AS DOUBLE)), 4) AS threshold FROM q GROUP BY 1"
)
def metric_breakdown(s: SparkSession, d: str) -> DataFrame:
    q = R(s, d, "sample_questions").select("q_id", "category", F.col("keyword_hit_threshold").cast("double").alias("threshold"), F.size("expected_keywords").cast("double").alias("keywords")).distinct()
    return evaluate.breakdown(q, "category", ["keywords", "threshold"])


def _gold(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = R(s, d, "sample_questions").select("q_id", "gold_evidence").distinct().select("q_id", F.posexplode("gold_evidence").alias("n", "g"))
    keys = R(s, d, "sample_papers").select("paper_key", "paper_id").distinct()
    gold = q.select(F.concat_ws("#", "q_id", "n").alias("gold_id"), "q_id", F.col("g.paper_key").alias("paper_key"), F.col("g.snippet").alias("snippet")).join(keys, "paper_key")
    chunks = R(s, d, "paper_chunks").select(F.col("id").alias("chunk_id"), "paper_id", F.col("content").alias("text"), F.col("chunk_index").alias("position")).distinct()
    return gold, chunks


@query(sql.gold_matches(8))
def gold_match_8gram(s: SparkSession, d: str) -> DataFrame:
    gold, chunks = _gold(s, d)
    return evaluate.gold_matches(gold, chunks)


@query(sql.gold_matches(24))
def gold_match_24gram(s: SparkSession, d: str) -> DataFrame:
    gold, chunks = _gold(s, d)
    return evaluate.gold_matches(gold, chunks, 24)


@query()
def gold_resolution(s: SparkSession, d: str) -> DataFrame:
    gold, chunks = _gold(s, d)
    return evaluate.resolve_gold(gold.select("gold_id", "paper_id", "snippet"), chunks).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


def _searched(s: SparkSession, d: str) -> dict[str, DataFrame]:
    chunks = catalog.children(R(s, d, "paper_chunks")).select("id", "content", "metadata.block_types").dropDuplicates(["id"])
    chunks = embed_with()(chunks.withColumn("content", F.coalesce("content", F.lit(""))), "content", "embedding")
    questions = R(s, d, "sample_questions").select("q_id", "question").distinct()
    return retrieval.hybrid_search(chunks, questions, embed_with(), top_k=10)


@query(sql.VARIANTS)
def query_variants(s: SparkSession, d: str) -> DataFrame:
    q = R(s, d, "sample_questions").select("q_id", "question").distinct()
    return retrieval.variants(retrieval.plan_questions(q)).drop("terms")


@query(sql.LIMITS)
def adaptive_limits(s: SparkSession, d: str) -> DataFrame:
    return retrieval.limits(retrieval.plan_questions(R(s, d, "sample_questions").select("q_id", "question").distinct()))


@query()
def hybrid_search_questions(s: SparkSession, d: str) -> DataFrame:
    """All stages for all questions: ten results each."""
    return _searched(s, d)["results"].select("q_id", "chunk_id", F.round("score", 6).alias("score"), "bonus", "rank")


@query()
def stage_failures(s: SparkSession, d: str) -> DataFrame:
    """Where the gold of each question is first found, and the stage at which it is lost."""
    found = _searched(s, d)
    gold, chunks = _gold(s, d)
    hits = evaluate.gold_matches(gold, chunks).join(gold.select("gold_id", "q_id"), "gold_id").select("q_id", "chunk_id").distinct()
    ranks = gold.groupBy("q_id").agg(F.count("*").alias("gold_chunks"))
    for name, stage in (("sparse", "sparse"), ("dense", "dense"), ("fused", "fused"), ("reranked", "results")):
        ranks = ranks.join(evaluate.first_hits(found[stage], hits, ["q_id"]).withColumnRenamed("hit_rank", name), "q_id", "left")
    return evaluate.failure_stage(ranks)


@query(
    FUSED + ", w AS (SELECT r.*, list_distinct(list_filter(string_split_regex(lower(a.query), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda v: length(v) > 0)) AS want, string_split_regex(lower(d.content), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+') AS has FROM r JOIN asks a ON a.q_id = r.q_id JOIN docs d ON d.id = r.chunk_id), "
    "v AS (SELECT q_id, chunk_id, rank, len(list_intersect(want, has)) / CAST(greatest(len(want), 1) AS DOUBLE) AS rel FROM w) SELECT q_id, chunk_id, round(rel, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY rel DESC, rank) AS INTEGER) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rel DESC, rank) <= 10"
)
def reranked_by_overlap(s: SparkSession, d: str) -> DataFrame:
    """Hybrid results reordered by a plug-in that counts common words."""

    def overlap(question: str, texts: list[str]) -> list[tuple[int, float]]:
        want = set(question.lower().split())
        return [(i, len(want & set(t.lower().split())) / max(len(want), 1)) for i, t in enumerate(texts)]

    docs = _vector_docs(s, d)
    fused = _hybrid(s, d)
    texts = fused.select("q_id", "chunk_id").join(docs.select(F.col("id").alias("chunk_id"), F.col("content").alias("text")), "chunk_id").join(_askers(docs).select("q_id", "query"), "q_id")
    return retrieval.merge_reranked(fused, rerank_with(overlap, texts)(fused), 10).select("q_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(sql.GRADES)
def answer_grades(s: SparkSession, d: str) -> DataFrame:
    """Keyword hits, abstention, citation precision and groundedness of every draft."""
    gold, chunks = _gold(s, d)
    held = evaluate.gold_matches(gold, chunks).join(gold.select("gold_id", "q_id"), "gold_id").select("q_id", "chunk_id").distinct()
    a = R(s, d, "assistant_drafts").filter("q_id IS NOT NULL").select("id", "q_id", "content", "answer_mode", "citations_json").distinct()
    cited = a.select("id", "q_id", F.explode("citations_json").alias("c")).select("id", "q_id", F.col("c.chunk_id").alias("chunk_id")).join(held, ["q_id", "chunk_id"], "left_semi").groupBy("id").agg(F.count("*").alias("cited_gold"))
    q = R(s, d, "sample_questions").select("q_id", "expected_keywords", "keyword_hit_threshold", "expected_abstention").dropDuplicates(["q_id"])
    j = a.join(q, "q_id").join(cited, "id", "left").withColumns({"citations": F.greatest(F.size("citations_json"), F.lit(0)), "cited_gold": F.coalesce("cited_gold", F.lit(0)), "abstained": F.coalesce(F.col("answer_mode") == "kb_insufficient_evidence", F.lit(False))})
    return evaluate.grade_answers(j).select("id", "keyword_hits", "abstention_ok", "citation_precision", "grounded")


# --- events ---


@query("SELECT user_id, event_type, max(ts) AS last_at, count(*) AS events, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_job_per_type(s: SparkSession, d: str) -> DataFrame:
    return streams.latest_event(R(s, d, "events"), ["user_id", "event_type"], "ts", "event_id", ["value"])


@query("SELECT user_id, CAST(max(ts) AS TIMESTAMPTZ) AS last_at, count(*) AS events, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_event_stream(s: SparkSession, d: str) -> DataFrame:
    """The same as over the table, read as a stream until all files are done."""
    out, mark = shared_folder(s, "stream-"), shared_folder(s, "stream-")
    schema = R(s, d, "events").schema
    stream = streams.read_events(s, f"{d}/events.parquet*", schema)
    latest = streams.latest_event(stream, ["user_id"], "ts", "event_id", ["event_type"])
    streams.write_snapshots(latest, out, mark).awaitTermination()
    return s.read.parquet(out)


@query("SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 8")
def progress_last8(s: SparkSession, d: str) -> DataFrame:
    return catalog.latest_by(R(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8).select("user_id", "event_id", "ts", "rank")


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMPTZ) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    e = R(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed(e, "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query(
    "WITH a AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a) "
    "SELECT user_id, CAST(min(ts) AS TIMESTAMPTZ) AS session_start, CAST(max(ts) + INTERVAL '30 minutes' AS TIMESTAMPTZ) AS session_end, count(*) AS events FROM g GROUP BY user_id, n"
)
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    e = R(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "ts", "30 minutes", ["user_id"])
