"""Extracted documents to ordered structure: labels, boxes, matching, merge, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import compact_lines, heading_line, strip, table_text, text_or_empty
from quillmill.operators.sequence import places

# Parts of a layout label and the block type they stand for, the first that fits.
LABELS = (
    ("section", "heading"), ("heading", "heading"), ("title", "heading"), ("table", "table_like"), ("picture", "figure_caption"), ("figure", "figure_caption"),
    ("list", "list"),
)


def block_type(label: Column) -> Column:
    """heading, table_like, figure_caption, list or paragraph of a layout label."""
    x = F.lower(text_or_empty(label))
    return F.coalesce(*[F.when(x.contains(part), kind) for part, kind in LABELS], F.lit("paragraph"))


def box_distance(a: Column, b: Column) -> Column:
    """Manhattan distance of the centres of two boxes; null where either is missing."""
    mid = lambda r, lo, hi: (r[lo] + r[hi]) / 2
    return F.abs(mid(a, "x0", "x1") - mid(b, "x0", "x1")) + F.abs(mid(a, "y0", "y1") - mid(b, "y0", "y1"))


def pages_of(documents: DataFrame, doc: str, pages: str) -> DataFrame:
    """doc, page_number, page from MAP<INT, STRUCT> pages, in page order."""
    return documents.select(doc, F.explode(F.array_sort(F.map_entries(pages))).alias("e")).select(doc, F.col("e.key").alias("page_number"), F.col("e.value").alias("page"))


def number_blocks(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """Text blocks without tables, pictures and blanks, numbered anew from 0."""
    kept = rows.filter(~F.col("kind").isin("table", "picture") & (F.length(strip(text_or_empty(F.col("text")))) > 0))
    return kept.withColumn("block_index", F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1)


def match_nearest(items: DataFrame, rows: DataFrame, doc: str) -> DataFrame:
    """item_index and row_index: each table or picture takes the closest free context row of its page, rows of its kind first.

    Items choose in order, so a row is used once. Works one page at a time.
    """

    def greedy(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for i in a.sort_values("item_index").itertuples():
            best = None
            for r in b.sort_values("row_index").itertuples():
                if r.row_index in used:
                    continue
                d = abs(i.cx - r.cx) + abs(i.cy - r.cy) if i.cx == i.cx and r.cx == r.cx else float("inf")
                key = (r.kind != i.kind, d, r.row_index)
                if best is None or key < best:
                    best = key
            if best:
                used.add(best[2])
                out.append((getattr(i, doc), i.item_index, best[2]))
        return pd.DataFrame(out, columns=[doc, "item_index", "row_index"])

    centre = lambda df: df.withColumns({"cx": (F.col("bbox.x0") + F.col("bbox.x1")) / 2, "cy": (F.col("bbox.y0") + F.col("bbox.y1")) / 2}).drop("bbox")
    kind = items.schema[doc].dataType.simpleString()
    a = centre(items.select(doc, "page_number", "item_index", "kind", "bbox")).groupBy(doc, "page_number")
    b = centre(rows.select(doc, "page_number", "row_index", "kind", "bbox")).groupBy(doc, "page_number")
    return a.cogroup(b).applyInPandas(greedy, f"{doc} {kind}, item_index int, row_index int")


def merge_structure(blocks: DataFrame, tables: DataFrame | None = None, pictures: DataFrame | None = None, max_rows: int = 8) -> DataFrame:
    """paper_id, pos, kind, text, block_type, section_path, heading_level, page_number of all parts in reading order; blanks go."""
    base = ["paper_id", "reading_order", "page_number", "section_path", "heading_level"]
    every = blocks.select(*base, F.lit(0).alias("g"), F.col("block_index").alias("i"), F.lit("block").alias("kind"), F.col("text"), F.col("block_type"))
    if tables is not None:
        text = table_text(F.col("caption"), F.col("markdown"), F.col("data"), max_rows)
        every = every.unionByName(tables.select(*base[:2], F.col("page_from").alias("page_number"), *base[3:], F.lit(1).alias("g"), F.col("table_index").alias("i"), F.lit("table").alias("kind"), text.alias("text"), F.lit("table_like").alias("block_type")))
    if pictures is not None:
        text = F.concat_ws("\n\n", F.nullif(strip(text_or_empty(F.col("caption"))), F.lit("")), F.nullif(strip(text_or_empty(F.col("description"))), F.lit("")))
        every = every.unionByName(pictures.select(*base, F.lit(2).alias("g"), F.col("picture_index").alias("i"), F.lit("picture").alias("kind"), text.alias("text"), F.lit("figure_caption").alias("block_type")))
    kept = every.filter(F.length(strip(text_or_empty(F.col("text")))) > 0)
    order = [F.col("reading_order").isNull().cast("int"), F.coalesce("reading_order", "page_number", F.lit(0)), "g", "i"]
    return places(kept, "paper_id", order, "pos").select("paper_id", "pos", "kind", "text", "block_type", *base[2:])


def render(parts: DataFrame) -> DataFrame:
    """paper_id, text: the parts of each paper as one marked-up text. A paper's text is one value, as its reader needs it."""
    line = F.when(F.col("block_type") == "heading", heading_line(strip(F.col("text")), F.col("heading_level"))).otherwise(strip(F.col("text")))
    each = parts.select("paper_id", F.struct("pos", line.alias("l")).alias("x"))
    joined = each.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n\n").alias("t"))
    return joined.select("paper_id", compact_lines(F.col("t")).alias("text"))


def page_ids(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with the id of the page of their number (null without one)."""
    keys = pages.groupBy("paper_id", "page_number").agg(F.min("id").alias("linked_page_id"))
    return blocks.join(keys, ["paper_id", "page_number"], "left")


def counters(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """paper_id, pages, blocks of every paper that has either."""
    a, b = pages.groupBy("paper_id").agg(F.count("*").alias("pages")), blocks.groupBy("paper_id").agg(F.count("*").alias("blocks"))
    return a.join(b, "paper_id", "full").fillna(0, ["pages", "blocks"])


def picture_context(pictures: DataFrame, blocks: DataFrame, n: int = 5) -> DataFrame:
    """Pictures with the first n non-blank block texts of their page."""
    kept = blocks.filter(F.length(strip(text_or_empty(F.col("text")))) > 0)
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id", "page_number").orderBy("block_index"))).filter(F.col("_r") <= n)
    text = first.groupBy("paper_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]), "\n").alias("context"))
    return pictures.join(text, ["paper_id", "page_number"], "left")
