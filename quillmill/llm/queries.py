"""Registered queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.glyphs import equal_looking, normalize_glyphs
from quillmill.llm.languages import LANGUAGES, check_labels, count_trigrams, detect_languages, label_code
from quillmill.llm.mixture import mix_sources, mixture_report
from quillmill.llm.neighbours import mutual_pairs, similar_vectors, unit_vectors
from quillmill.llm.pairs import flag_read, read_answers
from quillmill.llm.tokens import encode_texts
from quillmill.llm.quality import text_kind, text_quality
from quillmill.llm.scans import repair_texts, scan_defects
from quillmill.session import cut, read_table


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "papers").select(F.col("id").alias("paper_id"), "title")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of print and of misreading in pages and blocks."""
    pages, blocks = read_table(spark, sf_dir, "paper_document_pages"), read_table(spark, sf_dir, "paper_document_blocks")
    return scan_defects(pages, blocks, _titles(spark, sf_dir))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every block as continuous paragraphs; copies count once."""
    blocks = read_table(spark, sf_dir, "paper_document_blocks").select("id", "page_id", "block_index", "text").distinct()
    return repair_texts(read_table(spark, sf_dir, "paper_document_pages"), blocks, _titles(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR rows that read like the page they name and differ from it in code points."""
    ocr = read_table(spark, sf_dir, "ocr_text_results").select("id", "page_id", "text")
    pages = read_table(spark, sf_dir, "paper_document_pages").select("id", "text").withColumn("page_id", F.col("id"))
    pairs = equal_looking(pages, ocr, "page_id", "page_id", "id", "id")
    return pairs.select(F.col("left_id").alias("page_id"), F.col("right_id").alias("ocr_id"))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and OCR text in its one form, with the count that agrees with the text as read."""
    ocr = normalize_glyphs(read_table(spark, sf_dir, "ocr_text_results").distinct())
    pages = normalize_glyphs(read_table(spark, sf_dir, "paper_document_pages"))
    cols = [F.col("id").alias("row_id"), F.col("canonical").alias("text"), F.col("fullwidth_found").alias("fullwidth_ascii_count")]
    return pages.select(F.lit("page").alias("src"), *cols).unionByName(ocr.select(F.lit("ocr").alias("src"), *cols))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and wrong labels (seg 0) and the stretches of mixed texts (seg from 1)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pages = read_table(spark, sf_dir, "paper_document_pages").select("id", "paper_id", "text")
    samples = read_table(spark, sf_dir, "sample_papers").select("paper_key", "paper_id", label_code(F.col("language")).alias("label_code"))
    counts = cut(count_trigrams(docs, "text", "lang"))
    # found rows hold no text, so what is kept between the steps is narrow
    doc = cut(check_labels(docs, "doc_id", "text", "lang", counts))
    page = detect_languages(pages, "text", counts)
    page = cut(page.withColumn("kind", text_kind(F.when(F.size("found.segments") > 1, F.col("text")))).drop("text"))

    wrong = F.col("label_code").isNull() | (F.col("label_code") != F.col("found.lang"))
    one = doc.filter((F.size("found.segments") == 1) & ~F.col("found.ambiguous") & (F.col("found.confidence") >= 0.8) & (F.col("kind") == "prose") & wrong)
    by_doc = one.select(F.lit("document").alias("src"), F.col("doc_id").cast("string").alias("row_key"), F.lit(0).alias("seg"), F.col("found.lang").alias("lang"))

    paper = page.groupBy("paper_id").agg(*[F.sum(F.col("found.signs")[i]).alias(k) for i, k in enumerate(LANGUAGES)])
    most = F.greatest(*LANGUAGES)
    lang = F.coalesce(*[F.when((F.col(k) == most) & (most > 0), F.lit(k)) for k in LANGUAGES])
    told = samples.distinct().join(paper.select("paper_id", lang.alias("lang")).filter("lang IS NOT NULL"), "paper_id")
    by_sample = told.filter("label_code IS NULL OR label_code <> lang").select(F.lit("sample").alias("src"), F.col("paper_key").alias("row_key"), F.lit(0).alias("seg"), "lang")

    def parts(df: DataFrame, src: str, key: str) -> DataFrame:
        mixed = df.filter((F.size("found.segments") > 1) & (F.col("kind") == "prose"))
        each = mixed.select(F.lit(src).alias("src"), F.col(key).cast("string").alias("row_key"), F.posexplode("found.segments").alias("p", "s"))
        return each.select("src", "row_key", (F.col("p") + 1).alias("seg"), F.col("s.lang").alias("lang"))

    every = by_doc.unionByName(by_sample).unionByName(parts(page, "page", "id")).unionByName(parts(doc, "document", "doc_id"))
    return every.distinct()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and ambiguity of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = detect_languages(docs, "text", cut(count_trigrams(docs, "text", "lang")))
    return found.select("doc_id", "found.lang", F.round("found.confidence", 4).alias("confidence"), "found.ambiguous", F.size("found.segments").alias("segments"))


DIMENSIONS = 64


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least 0.9 of which each is among the other's ten nearest."""
    vectors = unit_vectors(read_table(spark, sf_dir, "paper_chunks"), "id", "embedding", DIMENSIONS)
    # a list of ten cut at 0.9 holds the same pairs of 0.9 and more as the list of ten
    lists = similar_vectors(vectors, k=10, min_similarity=0.9)
    return mutual_pairs(lists).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every chunk whose id is divisible by 50, among all chunks."""
    vectors = unit_vectors(read_table(spark, sf_dir, "paper_chunks"), "id", "embedding", DIMENSIONS)
    lists = similar_vectors(vectors, vectors.filter("_id % 50 = 0"), k=10, ef=160)
    return lists.select(F.col("a").alias("chunk_id"), F.col("b").alias("similar_id"), F.round("similarity", 6).alias("similarity"), "rank")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = read_table(spark, sf_dir, "sample_questions").select("q_id", "question", "language", "expected_abstention")
    drafts = read_table(spark, sf_dir, "assistant_drafts").select(F.col("id").alias("draft_id"), "q_id", "content")
    counts = count_trigrams(read_table(spark, sf_dir, "documents").select("text", "lang"), "text", "lang")
    read = read_answers(drafts.filter("q_id IS NOT NULL").distinct(), "content", counts).drop("content")
    return flag_read(read.join(questions.dropDuplicates(["q_id"]), "q_id"), "question", "_answer", "language", "expected_abstention")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective drafts with their defect."""
    return _flagged(spark, sf_dir).filter("defect IS NOT NULL").select("draft_id", "defect")


def p7_all_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect type that fired, one row each."""
    return _flagged(spark, sf_dir).select("draft_id", F.posexplode("defects").alias("priority", "defect"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixture_report(p9_mixture(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every document."""
    return text_quality(read_table(spark, sf_dir, "documents"), "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no natural prose as a whole."""
    return p10_statistics(spark, sf_dir).filter("kind <> 'prose'").select("doc_id", "kind").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_texts, p5_found, p5_languages, p6_found, p6_neighbours, p7_found, p7_all_defects, p8_ids, p9_mixture, p9_shares, p10_found, p10_statistics)
}
ORACLE: dict[str, str] = {}
