"""Evidence of ranked results: support, selection, sufficiency, verification, answer decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import clip, json_object

MOST, TOP_SUPPORT, TOTAL_SUPPORT, VERIFIED = 4, 0.55, 0.9, 0.5


def support(results: DataFrame) -> DataFrame:
    """Adds evidence_id and support_score: 0.6 of the share of the best score and 0.4 of the rank's place, kept in 0.05 to 0.99."""
    w = Window.partitionBy("q_id")
    best, n = F.max("score").over(w), F.count("*").over(w)
    place = F.when(n == 1, 1.0).otherwise(1.0 - (F.col("rank") - 1) / F.greatest(n - 1, F.lit(1)))
    share = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    s = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), share * 0.6 + place * 0.4)), 4)
    return results.withColumns({"evidence_id": F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")), "support_score": s})


def with_snippets(evidence: DataFrame, chunks: DataFrame, size: int = 320) -> DataFrame:
    """Evidence with a clipped snippet of its chunk; chunks are joined for the survivors only."""
    return evidence.join(chunks.select(F.col("id").alias("chunk_id"), clip(F.col("content"), size).alias("snippet")), "chunk_id", "left")


def select_evidence(evidence: DataFrame, most: int = MOST, enough: float = TOTAL_SUPPORT) -> DataFrame:
    """In rank order until two or more hold `enough` support together, `most` at the utmost."""
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before, count = F.coalesce(F.sum("support_score").over(w), F.lit(0.0)), F.count("*").over(w)
    return evidence.withColumns({"_s": before, "_c": count}).filter(~((F.col("_c") >= 2) & (F.col("_s") >= enough)) & (F.col("_c") < most)).drop("_s", "_c")


def merge_selection(evidence: DataFrame, claims: DataFrame, named: DataFrame, most: int = MOST) -> DataFrame:
    """Selection of a model: ids it names, unknown ones dropped, support the larger of its own and the claims', named order first.

    `claims` has q_id, evidence_id, support_score, claim; `named` has q_id, evidence_id, position. Questions it says nothing about
    keep the plain selection.
    """
    c = claims.groupBy("q_id", "evidence_id").agg(F.max("support_score").alias("_cs"), F.array_sort(F.collect_set("claim")).alias("claims"))
    n = named.groupBy("q_id", "evidence_id").agg(F.min("position").alias("_p"))
    j = evidence.join(c, ["q_id", "evidence_id"], "left").join(n, ["q_id", "evidence_id"], "left").filter("_cs IS NOT NULL OR _p IS NOT NULL")
    j = j.withColumn("support_score", F.greatest("support_score", F.coalesce("_cs", F.lit(0.0))))
    w = Window.partitionBy("q_id").orderBy(F.col("_p").asc_nulls_last(), F.col("support_score").desc(), "rank")
    mine = j.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n", "_p", "_cs")
    plain = select_evidence(evidence).join(mine.select("q_id").distinct(), "q_id", "left_anti").withColumn("claims", F.array().cast("array<string>"))
    return mine.unionByName(plain)


def sufficiency(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """q_id, evidence_count, top_support, total_support, mean_support, sufficient, reasons."""
    a = selected.groupBy("q_id").agg(
        F.count("*").alias("evidence_count"), F.max("support_score").alias("top_support"), F.round(F.sum("support_score"), 4).alias("total_support"), F.round(F.avg("support_score"), 4).alias("mean_support")
    )
    j = questions.select("q_id").join(a, "q_id", "left").fillna({"evidence_count": 0, "top_support": 0.0, "total_support": 0.0, "mean_support": 0.0})
    why = F.array_compact(
        F.array(
            F.when(F.col("evidence_count") == 0, F.lit("no_evidence")), F.when(F.col("top_support") < TOP_SUPPORT, F.lit("top_support_below_threshold")),
            F.when(F.col("total_support") < TOTAL_SUPPORT, F.lit("total_support_below_threshold")),
        )
    )
    return j.withColumns({"reasons": why, "sufficient": F.size(why) == 0})


def verify(decisions: DataFrame, abstained: str | None = None) -> DataFrame:
    """Adds supported and verifier_score: answering on enough evidence and abstaining without are supported."""
    said_no = F.col(abstained) if abstained else ~F.col("sufficient")
    ok = (F.col("sufficient") & ~said_no) | (said_no & ~F.col("sufficient"))
    return decisions.withColumns({"supported": ok, "verifier_score": F.when(ok, F.col("mean_support")).otherwise(0.0)})


def decide(verified: DataFrame) -> DataFrame:
    """Adds answer_mode: knowledge_base where evidence suffices and the answer is supported well enough."""
    ok = F.col("sufficient") & F.col("supported") & (F.col("verifier_score") >= VERIFIED)
    return verified.withColumn("answer_mode", F.when(ok, "knowledge_base").otherwise("kb_insufficient_evidence"))


# The fields of a structured summary.
SUMMARY_FIELDS = ("abstract_cn", "research_question", "method", "findings", "limitations", "authors", "doi", "source_url", "published_at")


def parse_summaries(df: DataFrame, text: str) -> DataFrame:
    """Adds `summary`: the fields of the JSON object in a model's answer, blank where missing, key points without blanks; null without object."""
    schema = ", ".join(f"{x} string" for x in SUMMARY_FIELDS) + ", key_points array<string>"
    o = F.from_json(json_object(F.col(text)), schema)
    points = F.filter(F.transform(F.coalesce(o["key_points"], F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: F.length(x) > 0)
    parts = [F.trim(F.coalesce(o[x], F.lit(""))).alias(x) for x in SUMMARY_FIELDS]
    return df.withColumn("summary", F.when(o.isNotNull(), F.struct(*parts, points.alias("key_points"))))
