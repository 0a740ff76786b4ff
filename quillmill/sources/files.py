"""File sources and sinks: documents, JSON sets, partitioned tables, reports, event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Binary documents below a folder, empty ones left out: path, name, content, length, content_hash, shard (first two hex digits)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).filter("length > 0")
    digest = F.sha2("content", 256)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length", digest.alias("content_hash"), F.substring(digest, 1, 2).alias("shard"))


def write_blobs(documents: DataFrame, path: str) -> None:
    """Content-addressed store: one copy per hash, in folders by the first two digits."""
    documents.dropDuplicates(["content_hash"]).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True) -> DataFrame:
    """JSON objects, one per line or one array per file, with a declared schema (nothing is inferred)."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def replace_papers(df: DataFrame, path: str, key: str = "paper_id", buckets: int = 256) -> None:
    """Overwrites only the partitions of the papers in `df`; partitions are hash buckets, so many papers make few folders.

    `df` must hold all rows of the buckets it touches.
    """
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.repartition("bucket").sortWithinPartitions(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def links_of(pages: DataFrame, html: str) -> DataFrame:
    """Adds title, description and pdf_link (first link to a PDF) of an HTML column; null where there are none."""
    first = lambda p: F.nullif(F.trim(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), p, 1)), F.lit(""))
    return pages.withColumns({
        "title": first(r"(?is)<title[^>]*>(.*?)</title>"), "description": first(r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"'](.*?)[\"']"),
        "pdf_link": first(r"(?is)href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']"),
    })
