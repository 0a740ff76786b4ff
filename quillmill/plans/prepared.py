"""Queries of the general data-preparation operators (problems 3 and 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.timestamps import parse_instant, zone_ids
from quillmill.operators.multivalue import split_values
from quillmill.operators.timestamps import estimate_zones, normalize_timestamps
from quillmill.session import read_table

SUMMARY = "metadata_json.structured_summary"

def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author of every asset, fields with one author included."""
    assets = read_table(spark, sf_dir, "paper_assets").select(F.col("id").alias("asset_id"), F.col(f"{SUMMARY}.authors").alias("authors"))
    return split_values(assets, "asset_id", "authors").withColumnRenamed("value", "author")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of the assets whose field names two or more."""
    several = Window.partitionBy("asset_id")
    return p3_values(spark, sf_dir).withColumn("_n", F.count("*").over(several)).filter("_n > 1").drop("_n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value that names a real date or instant; copies count once."""
    assets = read_table(spark, sf_dir, "paper_assets").select("id", F.col(f"{SUMMARY}.published_at").alias("value"))
    web = read_table(spark, sf_dir, "web_import_results").select("record_id", "publish_date", "site_zone")
    a = normalize_timestamps(assets, "value").select(F.lit("asset").alias("src"), F.col("id").alias("row_id"), "utc")
    w = normalize_timestamps(web, "publish_date", "site_zone").select(
        F.lit("web").alias("src"), F.col("record_id").alias("row_id"), "utc"
    )
    return a.unionByName(w).filter("utc IS NOT NULL").distinct()


def p4_site_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared zones, hidden and estimated again, with the share of rows at which the estimate has the declared offset.

    Web results whose date carries its own zone have a known instant. Their local time in the declared zone is written without
    zone, as a site would, and the estimator sees it with an ingestion time up to an hour after the instant (fetched_at lies years from
    most dates here and tells nothing). A group is one declared zone.
    """
    zones = zone_ids(spark)
    web = read_table(spark, sf_dir, "web_import_results").select("record_id", "publish_date", F.trim("site_zone").alias("declared")).distinct()
    known = web.select("record_id", "declared", parse_instant(F.col("publish_date"), zones)["instant"].alias("i")).filter(F.col("i").isNotNull() & F.col("declared").isin(zones))
    local = F.convert_timezone(F.lit("UTC"), F.col("declared"), F.col("i"))
    bare = known.select(
        "declared", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("written"), local.alias("l"),
        (F.col("i") + F.make_interval(mins=F.pmod(F.xxhash64("record_id"), F.lit(60)).cast("int"))).alias("at"),
    )
    found = estimate_zones(bare, "declared", "written", "at")
    held = "(since IS NULL OR l >= since) AND (until IS NULL OR l < until)"
    both = bare.join(found, "declared").filter(held)
    same = F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("l")) == F.convert_timezone(F.col("declared"), F.lit("UTC"), F.col("l"))
    return both.groupBy("declared", "since", "zone", "rows", "violations", "margin").agg(F.round(F.avg(same.cast("double")), 4).alias("agreement"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_values": p3_values, "p4_found": p4_found, "p4_site_zones": p4_site_zones}
