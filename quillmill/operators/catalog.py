"""Catalog and conversation reads: tenant scope, latest rows, lists, merges, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import excerpt, strip
from quillmill.session import cut


def live(df: DataFrame, tenant: int | None = None, tenant_column: str = "organization_id") -> DataFrame:
    """Rows that are not deleted, of one tenant where given. Rows without tenant belong to none."""
    df = df.filter(F.col("deleted_at").isNull())
    return df if tenant is None else df.filter(F.col(tenant_column) == tenant)


def children(chunks: DataFrame, embedded: bool = False) -> DataFrame:
    """Child chunks, optionally only those with a vector."""
    out = chunks.filter(F.col("chunk_role") == "child")
    return out.filter(F.col("embedding").isNotNull()) if embedded else out


def chunks_of_papers(chunks: DataFrame, papers: DataFrame, tenant: int | None = None) -> DataFrame:
    """Child chunks of live papers with the paper's title. Spark broadcasts papers only if they are small."""
    p = live(papers, tenant).select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"), "organization_id")
    return children(chunks).join(p, "paper_id")


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The n first rows of each key in the given order, with their rank. Spark cuts each task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the whole table."""
    return df.orderBy(*order).limit(n)


def title_order(df: DataFrame, title: str, row_id: str, descending: bool = False) -> DataFrame:
    """Rows by title as Chinese collation has it (case and outer space apart), then by id."""
    key = F.collate(F.lower(strip(F.col(title))), "zh")
    return df.orderBy(key.desc() if descending else key.asc(), F.col(row_id))


def date_order(df: DataFrame, date: str, row_id: str, descending: bool = True) -> DataFrame:
    """Rows by date, missing dates last in both directions, then by id."""
    key = F.col(date).desc_nulls_last() if descending else F.col(date).asc_nulls_last()
    return df.orderBy(key, F.col(row_id))


def date_places(df: DataFrame, date: str, row_id: str, descending: bool = True) -> DataFrame:
    """Adds the place of every row in `date_order`, from 1. Ranges of the order are numbered apart and moved by the rows before them."""
    ranged = cut(date_order(df, date, row_id, descending).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    key = F.col(date).desc_nulls_last() if descending else F.col(date).asc_nulls_last()
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key, F.col(row_id)))
    return ranged.withColumn("_at", inside).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def file_key(name: Column) -> Column:
    """Base name in lower case, the key of duplicate detection."""
    return F.lower(F.element_at(F.split(name, r"[\\/]"), -1))


def duplicate_groups(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Keys held by more than one row: rows, first and last id. Counted before the shuffle; members are not listed."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")).filter("copies > 1")


def fill_if_empty(current: Column, found: Column) -> Column:
    """The current text, or the found one where the current is blank. Blank found texts fill nothing."""
    return F.coalesce(F.nullif(strip(current), F.lit("")), F.nullif(strip(found), F.lit("")))


def provenance(current: Column, extracted: Column) -> Column:
    """null without a value, auto if it equals the extracted one (case and space apart), else manual."""
    norm = lambda x: F.lower(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\s+", " "))
    return F.when(F.length(norm(current)) == 0, F.lit(None).cast("string")).when(norm(current) == norm(extracted), "auto").otherwise("manual")


def group_stats(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows and latest time of each key."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.max(at).alias("last_at"))


def with_stats(groups: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Every group with its statistics, 0 and null where there are none."""
    return groups.join(stats, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def previous_turns(turns: DataFrame, session: str, turn: str, role: str, text: str, n: int = 2) -> DataFrame:
    """Each turn with `context`: the texts of the n user turns before it and its own, joined by line ends.

    A frame of the user turns alone, so a session of any length needs no list of all its turns.
    """
    w = Window.partitionBy(session).orderBy(turn)
    said = turns.filter(F.col(role) == "user")
    texts = F.array(*[F.lag(text, i).over(w) for i in range(n, 0, -1)], F.col(text))
    return said.withColumn("context", F.array_join(F.array_compact(texts), "\n"))


def history(turns: DataFrame, session: str, turn: str, text: str, n: int = 8) -> DataFrame:
    """Each turn with `history`: the texts of the n turns before it."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(text).over(w))


def session_titles(turns: DataFrame, session: str, turn: str, role: str, text: str, default: str = "New topic") -> DataFrame:
    """Title of each session from its first user turn."""
    first = turns.groupBy(session).agg(F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(turn))).alias("_t"))
    return first.select(session, excerpt(F.col("_t"), default).alias("title"))


def stream_pieces(df: DataFrame, row_id: str, text: str, size: int = 24) -> DataFrame:
    """row_id, seq (from 0), piece: a text in pieces of `size` signs; none for empty and null texts."""
    t = F.col(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t), F.lit(size)))
    return df.select(row_id, F.posexplode(F.transform(starts, lambda i: F.substring(t, i, F.lit(size)))).alias("seq", "piece"))


def partial_update(current: DataFrame, updates: DataFrame, row_id: str, columns: list[str], required: tuple[str, ...] = ("title",)) -> DataFrame:
    """Rows with the given columns replaced where an update names them.

    `updates` has row_id and MAP<STRING,STRING> fields. Names outside `columns` are ignored; blanks clear a column, but a required one
    keeps its value. Rows without update stay; of several updates of a row the one with the most names counts.
    """
    one = updates.groupBy(row_id).agg(F.max_by("fields", F.size("fields")).alias("_f"))
    j = current.join(one, row_id, "left")
    for c in columns:
        new = F.nullif(strip(F.try_element_at("_f", F.lit(c))), F.lit(""))
        named = F.coalesce(F.array_contains(F.map_keys("_f"), c), F.lit(False))
        j = j.withColumn(c, F.when(named & (new.isNotNull() | F.lit(c not in required)), new).otherwise(F.col(c)))
    return j.drop("_f")


def question_items(items: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(clean items, duplicates): trimmed id and question, incomplete items left out; ids an owner uses more than once.

    `items` has owner, position, id, question.
    """
    clean = items.select(owner, "position", strip(F.col("id")).alias("id"), strip(F.col("question")).alias("question")).filter("length(id) > 0 AND length(question) > 0")
    twice = clean.groupBy(owner, "id").agg(F.count("*").alias("n")).filter("n > 1")
    return clean, twice


def answers_in_order(items: DataFrame, answers: DataFrame, owner: str) -> DataFrame:
    """Every item with its answer, "" where there is none; `answers` has owner, id, answer."""
    a = answers.groupBy(owner, "id").agg(F.max("answer").alias("answer"))
    return items.join(a, [owner, "id"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))
