"""Ordered blocks of papers to child and parent chunks.

Packing only depends on lengths inside a run of plain blocks between headings, section changes and
blocks that stand alone, so runs are packed independently and only lengths are collected.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import context_header, han_count, latin_count, looks_like_table_body, squeeze, strip, text_or_empty, tokens
from quillmill.operators.sequence import last_before, places, sliced
from quillmill.session import cut

ALONE = ("table_like", "table_caption", "figure_caption")


def windows(text: Column, size: Column | int, overlap: Column | int) -> Column:
    """ARRAY<STRUCT<content, char_start, char_end>>: overlapping pieces of the squeezed text, the last one ending with it."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    t = squeeze(text)
    step = F.greatest(size - overlap, F.lit(1))
    last = F.greatest(F.ceil((F.length(t) - size) / step), F.lit(0)).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("at"), F.substring(t, i * step + 1, size).alias("w")))
    out = F.transform(
        each,
        lambda e: F.struct(
            F.trim(e["w"]).alias("content"),
            (e["at"] + F.length(e["w"]) - F.length(F.ltrim(e["w"]))).alias("char_start"),
            (e["at"] + F.length(e["w"]) - F.length(F.ltrim(e["w"])) + F.length(F.trim(e["w"]))).alias("char_end"),
        ),
    )
    return F.when(F.length(t) > 0, F.filter(out, lambda e: F.length(e["content"]) > 0)).otherwise(F.filter(out, lambda e: F.lit(False)))


def section_paths(rows: DataFrame, paper: str, order: str, level: str, text: str, is_heading: Column) -> DataFrame:
    """Adds section_path: the texts of the open headings, joined by " > "; a heading closes those of its level and below.

    The open heading of each level is the last one of that level after the last shallower one.
    """
    w = Window.partitionBy(paper).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out, at = rows, {}
    for k in range(1, 7):
        here = is_heading & (F.least(F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1)), F.lit(6)) == k)
        out = out.withColumn(f"_s{k}", F.last(F.when(here, F.struct(F.col(order).alias("o"), strip(F.col(text)).alias("t"))), ignorenulls=True).over(w))
        at[k] = F.col(f"_s{k}")
    parts, above = [], F.lit(None).cast(rows.schema[order].dataType)
    for k in range(1, 7):
        alive = at[k].isNotNull() & (above.isNull() | (at[k]["o"] > above))
        parts.append(F.when(alive, at[k]["t"]))
        above = F.greatest(above, at[k]["o"])
    return out.withColumn("section_path", F.concat_ws(" > ", *parts)).drop(*[f"_s{k}" for k in range(1, 7)])


def block_offsets(blocks: DataFrame, paper: str, order: list[str], text: str) -> DataFrame:
    """Adds pos (from 0), char_start and char_end in the paper: two signs between blocks."""
    out = places(blocks, paper, order, "pos", {"char_start": F.length(text).cast("long") + 2})
    return out.withColumn("char_end", F.col("char_start") + F.length(text))


def reading_order(blocks: DataFrame, kind_rank: Column, index: str) -> list[Column]:
    """Sort keys of merged blocks, tables and pictures: reading order first, else by page."""
    return [F.col("reading_order").isNull().cast("int"), F.coalesce("reading_order", "page_number", F.lit(0)), kind_rank, F.col(index)]


def prepare_blocks(blocks: DataFrame) -> DataFrame:
    """paper_id, idx (from 0), text, block_type, section_id, page_number, heading_level, char_start, body (table-like text).

    `blocks` has paper_id, pos, text, block_type, section_path, page_number, heading_level. Blank texts go;
    white space is squeezed outside tables; a missing section is Document.
    """
    t = strip(text_or_empty(F.col("text")))
    kind = text_or_empty(F.col("block_type"))
    kept = blocks.withColumn("_t", t).filter(F.length("_t") > 0).withColumn("body", (kind == "table_like") | looks_like_table_body(F.col("_t")))
    section = F.coalesce(F.nullif(strip(text_or_empty(F.col("section_path"))), F.lit("")), F.lit("Document"))
    body = F.when(kind.isin("table_caption", "table_like") | F.col("body"), F.col("_t")).otherwise(squeeze(F.col("_t")))
    rows = kept.select("paper_id", "pos", body.alias("text"), F.when(kind == "", "paragraph").otherwise(kind).alias("block_type"), section.alias("section_id"), "page_number", "heading_level", "body")
    return places(rows, "paper_id", ["pos"], "idx", {"char_start": F.length("text").cast("long") + 2}).drop("pos")


def _context(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk the neighbours in its section that lend it context: by distance, left before right, until 420 signs.

    Rows come sorted by paper and section, the section's blocks (kind 0) before its chunks (kind 1); only lengths are held.
    """
    section, at, size = None, [], []
    for rows in batches:
        out = []
        for paper, name, kind, key, lo, hi, n in rows.itertuples(index=False, name=None):
            if (paper, name) != section:
                section, at, size = (paper, name), [], []
            if kind == 0:
                at.append(lo)
                size.append(n)
                continue
            if hi == 0:
                continue  # a chunk of the very first block alone gets none
            left, right, chars = bisect_left(at, lo) - 1, bisect_right(at, hi), 0
            while chars < 420 and (left >= 0 or right < len(at)):
                if left >= 0 and (right >= len(at) or lo - at[left] <= at[right] - hi):
                    i, left = left, left - 1
                else:
                    i, right = right, right + 1
                out.append((paper, key, at[i]))
                chars += size[i]
        yield pd.DataFrame(out, columns=["paper_id", "key", "idx"])


def chunk_papers(blocks: DataFrame, titles: DataFrame | None = None, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks of every paper: paper_id, chunk_index, chunk_role, section_id, content, body_text, context_header, supporting_context,
    parent_text, token_count, page_from, page_to, block_types, first_block, last_block.

    Headings end a chunk and belong to parents only; captions and tables stand alone, a caption with the
    table after it together; long blocks give overlapping windows; other blocks are packed up to
    the child size of their paper. One parent per section, numbered after the children.
    Papers without text give no rows.
    """
    size = max(size, 200)
    overlap = max(min(overlap, size - 1), 0)
    b = prepare_blocks(blocks)
    lead = b.filter("idx < 80 AND block_type <> 'heading'").groupBy("paper_id").agg(F.sum(han_count(F.col("text"))).alias("_h"), F.sum(latin_count(F.col("text"))).alias("_l"))
    dominant = (F.col("_h") > 0) & (F.col("_h") >= F.greatest(F.col("_l") * 2, F.lit(8)))
    child = F.when(dominant, min(size, max(int(size * 0.85), size - overlap, 320))).otherwise(min(size, max(min(size // 2, 500), 220)))
    b = b.join(lead.select("paper_id", dominant.alias("han_doc"), child.alias("child")), "paper_id", "left").fillna({"han_doc": False, "child": min(size, max(min(size // 2, 500), 220))})
    # neighbours are looked at in slices of the paper
    w = Window.partitionBy("paper_id", "_slice").orderBy("idx")
    b = sliced(b, "paper_id", "idx")
    b = b.withColumn("pair", (F.col("block_type") == "table_caption") & (F.lead("section_id").over(w) == F.col("section_id")) & F.coalesce(F.lead("body").over(w), F.lit(False)))
    b = b.withColumn("tail", F.coalesce(F.lag("pair").over(w), F.lit(False)))
    kind = (
        F.when(F.col("block_type") == "heading", "heading").when(F.col("tail"), "tail").when(F.col("pair"), "pair")
        .when(F.length("text") > size, "long").when(F.col("block_type").isin(*ALONE), "alone").otherwise("plain")
    )
    b = b.withColumn("kind", kind)
    breaks = (F.col("kind") != "plain") | (F.lag("kind", 1, "x").over(w) != "plain") | (F.lag("section_id", 1, "").over(w) != F.col("section_id"))
    b = b.withColumn("_break", breaks).filter(~F.col("_aside"))
    # a run is named by the place it begins at
    b = cut(last_before(b, "paper_id", "idx", F.col("_break"), "run").drop("_break", "_slice", "_aside"))  # ordered once; five branches read it
    # plain runs: only lengths are collected
    lengths = b.filter("kind = 'plain'").groupBy("paper_id", "run").agg(F.array_sort(F.collect_list(F.struct("idx", F.length("text").alias("n")))).alias("x"), F.max("child").alias("child"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("key"), F.array().cast("array<struct<idx:int,key:int>>").alias("out"))

    def pack(acc: Column, x: Column) -> Column:
        fits = (acc["used"] > 0) & (acc["used"] + x["n"] + 2 <= F.col("child"))
        key = F.when(fits, acc["key"]).otherwise(x["idx"])
        return F.struct(
            F.when(fits, acc["used"] + x["n"] + 2).otherwise(x["n"]).alias("used"), key.alias("key"),
            F.array_append(acc["out"], F.struct(x["idx"].alias("idx"), key.alias("key"))).alias("out"),
        )

    groups = lengths.select("paper_id", F.explode(F.aggregate("x", start, pack, lambda a: a["out"])).alias("g")).select("paper_id", "g.idx", "g.key")
    keyed = b.join(groups, ["paper_id", "idx"], "left").withColumn(
        "key", F.when(F.col("kind") == "plain", F.col("key")).when(F.col("kind") == "tail", F.col("idx") - 1).otherwise(F.col("idx"))
    )
    keyed = keyed.filter("kind <> 'heading'")
    members = keyed.groupBy("paper_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"), F.min_by("section_id", "idx").alias("section_id"), F.max("han_doc").alias("han_doc"),
        F.min("page_number").alias("page_from"), F.max("page_number").alias("page_to"), F.array_sort(F.collect_set("block_type")).alias("block_types"),
        F.min("idx").alias("first_block"), F.max("idx").alias("last_block"), F.min_by("kind", "idx").alias("kind"), F.max(F.col("body") | F.col("block_type").isin(*ALONE)).alias("structured"),
    )
    texts = F.transform("t", lambda x: x["text"])
    caption, body = texts[0], F.get(texts, F.lit(1))
    room = F.greatest(F.greatest(F.lit(size) - F.length(caption) - 2, F.lit(min(size // 2, 220))), F.lit(min(size, 220)))
    pieces = F.transform(windows(body, room, F.least(F.lit(overlap), F.greatest(room - 1, F.lit(0)))), lambda x: x["content"])
    long_pair = (F.col("kind") == "pair") & (F.length(caption) + F.length(body) + 2 > size)
    contents = (
        F.when(long_pair, F.transform(pieces, lambda x, i: F.when(i == 0, F.concat(caption, F.lit("\n\n"), x)).otherwise(x)))
        .when(F.col("kind") == "long", F.transform(windows(caption, size, overlap), lambda x: x["content"]))
        .otherwise(F.array(F.array_join(texts, "\n\n")))
    )
    kids = members.withColumn("_c", contents).select("*", F.posexplode("_c").alias("piece", "body_text")).drop("t", "_c")
    kids = places(kids, "paper_id", ["key", "piece"], "chunk_index")

    # context: narrow rows of one section at a time
    wants = kids.filter(F.col("structured") | ~F.col("han_doc")).select("paper_id", "section_id", F.lit(1).alias("kind"), "key", F.col("first_block").alias("lo"), F.col("last_block").alias("hi"), F.lit(0).alias("n")).distinct()
    offers = b.select("paper_id", "section_id", F.lit(0).alias("kind"), F.lit(-1).alias("key"), F.col("idx").alias("lo"), F.col("idx").alias("hi"), F.length("text").alias("n"))
    id_type = b.schema["paper_id"].dataType.simpleString()
    sections = wants.unionByName(offers).repartition("paper_id", "section_id").sortWithinPartitions("paper_id", "section_id", "kind", "lo")
    near = sections.mapInPandas(_context, f"paper_id {id_type}, key int, idx int")
    lent = near.join(b.select("paper_id", "idx", "text"), ["paper_id", "idx"]).groupBy("paper_id", "key").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("x"))
    lent = lent.select("paper_id", "key", F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("supporting_context"))

    parents = b.groupBy("paper_id", "section_id").agg(
        F.min("idx").alias("first_block"), F.max("idx").alias("last_block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("body_text"),
        F.min("page_number").alias("page_from"), F.max("page_number").alias("page_to"), F.array_sort(F.collect_set("block_type")).alias("block_types"),
    )
    counts = kids.groupBy("paper_id").agg(F.count("*").alias("_n"))
    parents = places(parents, "paper_id", ["first_block"], "_at").join(counts, "paper_id").withColumn("chunk_index", (F.col("_n") + F.col("_at")).cast("int")).drop("_at")
    above = parents.select("paper_id", "section_id", F.substring("body_text", 1, 2200).alias("parent_text"))
    kids = kids.join(lent, ["paper_id", "key"], "left").join(above, ["paper_id", "section_id"], "left").withColumn("chunk_role", F.lit("child"))
    parents = parents.withColumns({"chunk_role": F.lit("parent"), "supporting_context": F.lit(None).cast("string"), "parent_text": F.lit(None).cast("string")})
    cols = ["paper_id", "chunk_index", "chunk_role", "section_id", "body_text", "supporting_context", "parent_text", "page_from", "page_to", "block_types", "first_block", "last_block"]
    every = kids.select(*cols).unionByName(parents.select(*cols))
    title = F.lit(None).cast("string")
    if titles is not None:
        every = every.join(titles.select("paper_id", F.col("title").alias("_title")).dropDuplicates(["paper_id"]), "paper_id", "left")
        title = F.col("_title")
    header = context_header(title, F.when(F.col("section_id") != "Document", F.col("section_id")), F.col("page_from"), F.col("page_to"))
    return every.withColumn("context_header", header).withColumns(
        {"content": F.concat_ws("\n\n", F.nullif("context_header", F.lit("")), "body_text"), "token_count": F.size(tokens(F.col("body_text")))}
    ).select("paper_id", "chunk_index", "chunk_role", "section_id", "content", "body_text", "context_header", *cols[5:7], "token_count", *cols[7:])


def without_structure(papers: DataFrame, parts: DataFrame) -> DataFrame:
    """paper_id and error of the papers that cannot be chunked because they have no text; the check before `chunk_papers`, which gives no rows for them."""
    some = parts.filter(F.length(strip(text_or_empty(F.col("text")))) > 0).select("paper_id").distinct()
    return papers.select("paper_id").distinct().join(some, "paper_id", "left_anti").withColumn("error", F.lit("Structured blocks unavailable for chunking"))


def link_parents(chunks: DataFrame) -> DataFrame:
    """Children with parent_index, the chunk_index of the parent of their section (null without one)."""
    parents = chunks.filter("chunk_role = 'parent'").select("paper_id", "section_id", F.col("chunk_index").alias("parent_index"))
    return chunks.filter("chunk_role = 'child'").join(parents, ["paper_id", "section_id"], "left")
