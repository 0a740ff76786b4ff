"""Mixing sources to target weights, measured in tokens of a public tokenizer.

Documents get a hash-random key; equal-width key ranges cut each source into buckets, so a
source with a third of all rows is spread like any other. Bucket sums give each bucket its
offset; a running sum inside a bucket gives each document its place; the cut is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.tokens import count_tokens
from quillmill.session import cut

#: Key ranges per source. A range holds its share of a source, so more rows need more ranges.
RANGES = 4096


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    row_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total_tokens: int | None = None,
    seed: int = 0,
    ranges: int = RANGES,
    sizes: str | None = None,
) -> DataFrame:
    """One row per document of the mixture: row_id, source, tokens, uses, cut_tokens, tokens_used.

    `targets` has source, target_share and max_repeats; shares are brought to a sum of 1, sources without
    documents included: what they lack is not given to others, so the shares reached are those of the documents used. Each
    source gets round-robin epochs in hash order: `uses` whole uses, and `cut_tokens` tokens of
    one more use for the document at the exact cut (0 for the others). Without `total_tokens`
    the total is the largest at which every share can be met. With a larger one, short sources
    give all they may (max_repeats uses) and the shares reached fall behind. Documents without
    tokens, null or unknown sources are not used; of equal documents each row counts.
    An empty table gives an empty mixture. `sizes` names a column that already holds the tokens.
    """
    sized = documents.withColumn("_n", F.col(sizes).cast("long")) if sizes else count_tokens(documents, text, "_n")
    sized = sized.filter(F.col(source).isNotNull()).select(
        F.col(row_id).alias("_id"), F.col(source).alias("_s"), "_n", F.xxhash64(F.lit(seed), F.col(row_id), F.col(text) if text in documents.columns else F.lit("")).alias("_key")
    )
    sized = sized.filter("_n > 0").withColumn("_b", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(ranges)).cast("int"))
    sized = cut(sized)  # five narrow columns a row: texts are encoded once
    # one row per source and range: the only table the offsets need (sources x ranges rows)
    sums = sized.groupBy("_s", "_b").agg(F.sum("_n").alias("_t"))
    have = sums.groupBy("_s").agg(F.sum("_t").alias("_all"))
    want = targets.filter("target_share > 0").groupBy(F.col("source").alias("_s")).agg(
        F.max("target_share").alias("_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("_max")
    )
    norm = want.agg(F.sum("_share").alias("_norm"))
    plan = have.join(F.broadcast(want), "_s").join(F.broadcast(norm)).withColumn("_share", F.col("_share") / F.col("_norm"))
    reach = plan.agg(F.min(F.col("_all") * F.col("_max") / F.col("_share")).alias("_total"))
    plan = plan.join(F.broadcast(reach)) if total_tokens is None else plan.withColumn("_total", F.lit(float(total_tokens)))
    plan = plan.select(
        "_s", "_all", F.least(F.floor(F.col("_total") * F.col("_share")), F.col("_all") * F.col("_max")).cast("long").alias("_budget")
    ).select("_s", F.floor(F.col("_budget") / F.col("_all")).alias("_epochs"), (F.col("_budget") % F.col("_all")).alias("_rest"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # sources are as few as the rows of `targets`; ranges bound the rest
    offsets = sums.withColumn("_off", before).join(F.broadcast(plan), "_s").select("_s", "_b", "_off", "_epochs", "_rest")
    inside = Window.partitionBy("_s", "_b").orderBy("_key", "_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, ["_s", "_b"]).withColumn("_at", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    extra = F.least(F.greatest(F.col("_rest") - F.col("_at"), F.lit(0)), F.col("_n"))
    whole = (extra == F.col("_n")).cast("long")
    out = placed.select(
        F.col("_id").alias(row_id),
        F.col("_s").alias(source),
        F.col("_n").alias("tokens"),
        (F.col("_epochs") + whole).cast("long").alias("uses"),
        F.when(whole == 1, 0).otherwise(extra).cast("long").alias("cut_tokens"),
        (F.col("_epochs") * F.col("_n") + extra).cast("long").alias("tokens_used"),
    )
    return out.filter("tokens_used > 0")


def mixture_report(mixture: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per source of `targets`: target_share, tokens_used, share_reached, documents, most_uses (a cut use counts)."""
    got = mixture.groupBy(F.col(source).alias("source")).agg(
        F.sum("tokens_used").alias("tokens_used"),
        F.count("*").alias("documents"),
        F.max(F.col("uses") + (F.col("cut_tokens") > 0).cast("long")).alias("most_uses"),
    )
    total = got.agg(F.sum("tokens_used").alias("_all"))
    return (
        targets.select("source", "target_share").join(got, "source", "left").join(F.broadcast(total)).select(
            "source",
            "target_share",
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)).alias("share_reached"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
