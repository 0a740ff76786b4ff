"""Evaluation: gold matching, hit ranks, gains, failure stages, breakdowns, answer grades."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import match_form
from quillmill.session import cut

GRAM = 8


def grams(form: Column, n: int = GRAM) -> Column:
    """Distinct runs of n signs; none for shorter forms."""
    return F.when(F.length(form) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form) - n + 1), lambda i: F.substring(form, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def snippet_words(text: Column) -> Column:
    """Latin words and numbers of a text, lower case, joined and fenced by spaces."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]+|[-+]?[0-9]+(?:\.[0-9]+)?)"), 1)
    return F.when(F.size(words) >= 3, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))


def gold_matches(gold: DataFrame, chunks: DataFrame, gram: int = GRAM) -> DataFrame:
    """gold_id, chunk_id: chunks of the same paper that hold the snippet.

    `gold` has gold_id, paper_id, snippet; `chunks` has chunk_id, paper_id, text. A snippet is held if its form shares a run of `gram`
    signs with the chunk's (shorter ones: is contained), or its words stand in the chunk in sequence; blank snippets match nothing.
    """
    g = gold.select("gold_id", "paper_id", match_form("snippet").alias("f"), snippet_words(F.col("snippet")).alias("w"))
    c = chunks.select("chunk_id", "paper_id", match_form("text").alias("f"), snippet_words(F.col("text")).alias("w"))
    return _holders(g, c, ["chunk_id"], gram).distinct()


#: Snippets and texts of a paper that meet in one group; longer papers make more groups. Hits sent on at once.
SNIPPET_PART, TEXT_PART, HITS = 2048, 2048, 65536


def _holders(gold: DataFrame, texts: DataFrame, keep: list[str], gram: int) -> DataFrame:
    """gold_id and the columns `keep` of the texts that hold each snippet.

    `gold` has gold_id, paper_id, f, w; `texts` has paper_id, f, w and `keep`: forms and fenced words. Both move once, as they are: sorted by paper, the
    snippets of a group come first and its texts stream past them, so runs of signs never leave the task.
    """
    kind = texts.schema["paper_id"].dataType
    gold = gold.withColumn("paper_id", F.col("paper_id").cast(kind))
    parts = lambda df, n, name: df.groupBy("paper_id").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = parts(gold, SNIPPET_PART, "_a").join(parts(texts, TEXT_PART, "_b"), "paper_id")
    one = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = F.struct(*keep)
    empty = F.lit(None).cast(texts.select(row.alias("x")).schema["x"].dataType)
    g = gold.join(sizes, "paper_id").select("paper_id", one(["gold_id"], "_a").alias("_s"), every("_b").alias("_t"), F.lit(0).alias("_side"), "gold_id", empty.alias("_row"), "f", "w")
    t = texts.join(sizes, "paper_id").select("paper_id", every("_a").alias("_s"), one(keep, "_b").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(gold.schema["gold_id"].dataType).alias("gold_id"), row.alias("_row"), "f", "w")
    key = ["paper_id", "_s", "_t"]
    met = g.unionByName(t).repartition(*key).sortWithinPartitions(*key, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, _Snippets(gram)
        for b in batches:
            rows, ids, found, at = b.column("_row"), b.column("gold_id"), [], []
            send = lambda: pa.RecordBatch.from_arrays([pa.array(found, ids.type), rows.take(pa.array(at, pa.int64()))], names=["gold_id", "_row"])  # noqa: B023, E731
            columns = [b.column(x).to_pylist() for x in (*key, "_side", "gold_id", "f", "w")]
            for i, (p, s, n, side, gold_id, f, w) in enumerate(zip(*columns)):
                if (p, s, n) != group:
                    group, held = (p, s, n), _Snippets(gram)
                if side == 0:
                    held.add(gold_id, f, w)
                elif mine := held.of(f, w):
                    found += mine
                    at += [i] * len(mine)
                    if len(at) >= HITS:
                        yield send()
                        found, at = [], []
            yield send()

    out = met.mapInArrow(run, met.select("gold_id", "_row").schema)
    return out.select("gold_id", *[F.col("_row")[x].alias(x) for x in keep])


class _Snippets:
    """Snippets by their runs of signs and by their words; tells which of them a text holds."""

    #: More texts than this are looked up by their runs, fewer one by one.
    FEW = 16

    def __init__(self, gram: int):
        self.gram = gram
        self.ids: dict[str, set] = {}  # of each form and of each fenced word list, which no form equals
        self.runs: dict[str, list[str]] = {}
        self.short: dict[int, set[str]] = {}
        self.words: dict[str, set[str]] = {}  # by their first three

    def add(self, gold_id, f: str | None, w: str | None) -> None:
        for x in (f, w):
            if x:
                self.ids.setdefault(x, set()).add(gold_id)
        if f and len(self.ids[f]) == 1:
            if len(f) < self.gram:
                self.short.setdefault(len(f), set()).add(f)
            else:
                for r in _runs(f, self.gram):
                    self.runs.setdefault(r, []).append(f)
        if w:
            self.words.setdefault(" ".join(w.split(" ", 4)[:4]), set()).add(w)

    def of(self, f: str | None, w: str | None) -> list:
        hits: set[str] = set()
        if f and self.runs:
            for r in self.runs.keys() & _runs(f, self.gram):
                hits.update(self.runs[r])
        if f:
            for n, forms in self.short.items():
                hits.update(forms & _runs(f, n) if len(forms) > self.FEW else (x for x in forms if x in f))
        if w and self.words:
            starts = self.words.keys()
            if len(starts) > self.FEW:
                ws = w.split(" ")
                starts = starts & {" " + " ".join(ws[i : i + 3]) for i in range(1, len(ws) - 3)}
            hits.update(x for s in starts for x in self.words[s] if x in w)
        return list(set().union(*[self.ids[x] for x in hits]))


def _runs(form: str, n: int) -> set[str]:
    return {form[i : i + n] for i in range(len(form) - n + 1)}


#: Sizes of the runs of chunks that may hold a snippet together, and chunks one task compares.
WINDOWS, RANGE = (2, 3, 4, 5, 6, 8, 10, 12, 16), 2048


def _chunk_windows(chunks: DataFrame, keep: int, words: int) -> DataFrame:
    """chunk_id (first of the run), size, paper_id, position, text forms of runs of chunks: only what lies around the seams.

    `keep` signs of the form and `words` words on either side of a seam decide whether something stands across it, so
    the middle of longer chunks is left out (a control sign takes its place).
    """
    f, w = F.col("form"), F.filter(F.split(F.trim(F.coalesce("w", F.lit(""))), " "), lambda x: F.length(x) > 0)
    short_form = F.when(F.length(f) <= 2 * keep, f).otherwise(F.concat(F.substring(f, 1, keep), F.lit("\x00"), F.right(f, F.lit(keep))))
    short_words = F.when(F.size(w) <= 2 * words, w).otherwise(F.concat(F.slice(w, 1, words), F.array(F.lit("\x00")), F.slice(w, -words, words)))
    base = chunks.select("chunk_id", "paper_id", "position", short_form.alias("f"), short_words.alias("w"))
    out = None
    for n in WINDOWS:
        ahead = Window.partitionBy("paper_id").orderBy("position", "chunk_id").rowsBetween(0, n - 1)
        run = base.select(
            "paper_id", "position", F.lit(n).alias("size"), F.collect_list("chunk_id").over(ahead).alias("ids"), F.array_join(F.collect_list("f").over(ahead), "").alias("f"),
            F.array_join(F.flatten(F.collect_list("w").over(ahead)), " ").alias("w"),
        ).filter(F.size("ids") == n)
        out = run if out is None else out.unionByName(run)
    return out


def resolve_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """gold_id, chunk_ids (ARRAY<STRING>), how (single, window, closest): where each snippet stands.

    The first chunk that holds it; else the first of the smallest runs of chunks (sizes WINDOWS) that hold it together; else the run
    that comes closest. `chunks` also has position, counted from 0 in each paper. Only papers with a snippet that no chunk holds go through the later
    steps. Blank snippets give no row (see `unresolved`).
    """
    m = gold_matches(gold, chunks).join(chunks.select("chunk_id", "position"), "chunk_id")
    direct = m.groupBy("gold_id").agg(F.min_by("chunk_id", F.struct("position", "chunk_id")).alias("chunk_id"))
    single = direct.select("gold_id", F.array(F.col("chunk_id").cast("string")).alias("chunk_ids"), F.lit("single").alias("how"))
    left = cut(gold.join(direct, "gold_id", "left_anti").select("gold_id", "paper_id", "snippet", match_form("snippet").alias("form"), snippet_words(F.col("snippet")).alias("gw")))
    formed = chunks.join(left.select("paper_id").distinct(), "paper_id", "left_semi")
    formed = cut(formed.select("chunk_id", "paper_id", "position", "text", match_form("text").alias("form"), _all_words(F.col("text")).alias("w")))
    words = left.agg(F.max(F.size(F.split(F.trim("gw"), " ")))).first()[0] or 1
    runs = _chunk_windows(formed, GRAM - 1, max(words - 1, 1))
    asked = left.filter(F.length("form") > 0).select("gold_id", "paper_id", F.explode(F.when(F.length("form") < GRAM, F.array("form")).otherwise(grams(F.col("form")))).alias("r"))
    wanted = asked.groupBy("paper_id").agg(F.collect_set(F.length("r")).alias("sizes"))
    parts = runs.join(wanted, "paper_id").select("paper_id", "size", "position", "ids", F.explode(F.array_distinct(F.flatten(F.transform("sizes", lambda n: _form_runs(F.col("f"), n))))).alias("r"))
    crossing = asked.join(parts, ["paper_id", "r"]).select("gold_id", "size", "position", "ids")
    worded = left.filter("gw IS NOT NULL").select("gold_id", "paper_id", "gw", _triples(F.col("gw"))[0].alias("r"))
    fenced = runs.select("paper_id", "size", "position", "ids", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w")).filter(F.size(F.split("w", " ")) >= 5)
    in_words = fenced.select("*", F.explode(F.array_distinct(_triples(F.col("w")))).alias("r")).join(worded, ["paper_id", "r"]).filter(F.contains("w", "gw")).select("gold_id", "size", "position", "ids")
    first = crossing.unionByName(in_words).groupBy("gold_id").agg(F.min_by("ids", F.struct("size", "position")).alias("ids"))
    window = first.select("gold_id", F.col("ids").cast("array<string>").alias("chunk_ids"), F.lit("window").alias("how"))
    rest = left.join(first, "gold_id", "left_anti").filter(F.length("form") > 0)
    return single.unionByName(window).unionByName(_closest_runs(rest, formed))


def _form_runs(form: Column, n: Column) -> Column:
    return F.when(F.length(form) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form) - n + 1), lambda i: F.substring(form, i, n)))).otherwise(F.array().cast("array<string>"))


def _triples(words: Column) -> Column:
    """Runs of three words of a fenced word list."""
    w = F.split(F.trim(words), " ")
    return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))


def _all_words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]+|[-+]?[0-9]+(?:\.[0-9]+)?)"), 1), " ")


def _closest_runs(rest: DataFrame, formed: DataFrame) -> DataFrame:
    """gold_id, chunk_ids, how: the run of 1 to 16 chunks with the best score for each snippet.

    Score: 0.45 numbers in common, 0.35 longest common stretch, 0.2 similarity of the forms. Chunks of a paper are compared in
    overlapping ranges, so a paper of any length makes bounded tasks. In a range a bound of every score comes from counts
    of signs and of numbers at once, and only runs whose bound beats the best score so far are compared sign by sign.
    """
    longest = max(WINDOWS)
    spread = formed.select("*", F.explode(F.array_distinct(F.array(F.floor(F.col("position") / RANGE), F.floor(F.greatest(F.col("position") - longest + 1, F.lit(0)) / RANGE)))).alias("_range"))
    ranges = spread.select(F.col("paper_id").alias("_p"), F.col("_range").alias("_r")).distinct()
    asked = rest.select("gold_id", "paper_id", "snippet", "form").join(ranges, F.col("paper_id") == F.col("_p")).drop("paper_id")
    kind = rest.schema["gold_id"].dataType.simpleString()

    def compare(snippets: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values(["position", "chunk_id"])
        forms, ids, places = texts["form"].tolist(), texts["chunk_id"].astype(str).tolist(), texts["position"].to_numpy()
        start, size = _run_places(len(forms))
        signs = {c: i for i, c in enumerate(sorted(set("".join(forms))))}
        counts = np.zeros((len(forms) + 1, len(signs) + 1), np.int32)
        for i, f in enumerate(forms):
            for c, n in Counter(f).items():
                counts[i + 1, signs[c]] = n
        sums = counts.cumsum(axis=0)
        sizes = sums.sum(axis=1)
        lengths = sizes[start + size] - sizes[start]
        held = [set(_NUMBERS.findall(t or "")) for t in texts["text"]]
        out = []
        for s in snippets.itertuples():
            want = set(_NUMBERS.findall(s.snippet or ""))
            numeric = np.zeros(len(start))
            for x in want:
                has = np.concatenate(([0], np.cumsum([x in h for h in held])))
                numeric += (has[start + size] - has[start] > 0) / len(want)
            mine = Counter(s.form)
            common = np.zeros(len(start), np.int64)
            for c, n in mine.items():
                if c in signs:
                    col = sums[:, signs[c]]
                    common += np.minimum(col[start + size] - col[start], n)
            base = 0.45 * numeric
            bound = base + 0.35 * np.minimum(common, len(s.form)) / len(s.form) + 0.4 * common / np.maximum(lengths + len(s.form), 1)
            bound[lengths == 0] = -1
            best, at = 0.0, -1
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < best - 1e-12:
                    break
                m = SequenceMatcher(None, s.form, "".join(forms[start[i] : start[i] + size[i]]))
                blocks = [b.size for b in m.get_matching_blocks()]
                score = float(base[i]) + 0.35 * max(blocks) / len(s.form) + 0.4 * sum(blocks) / (len(s.form) + int(lengths[i]))
                if score > best + 1e-12 or (at >= 0 and abs(score - best) <= 1e-12 and (size[i], start[i]) < (size[at], start[at])):
                    best, at = max(score, best), i
            if at >= 0:
                out.append((s.gold_id, best, int(size[at]), int(places[start[at]]), ids[start[at] : start[at] + size[at]]))
        return pd.DataFrame(out, columns=["gold_id", "score", "size", "position", "chunk_ids"])

    each = asked.groupBy("_p", "_r").cogroup(spread.groupBy("paper_id", "_range")).applyInPandas(compare, f"gold_id {kind}, score double, size int, position int, chunk_ids array<string>")
    top = each.groupBy("gold_id").agg(F.min_by("chunk_ids", F.struct((-F.round("score", 12)).alias("s"), "size", "position")).alias("chunk_ids"))
    return top.select("gold_id", "chunk_ids", F.lit("closest").alias("how"))


_NUMBERS = re.compile(r"[-+]?\d+(?:\.\d+)?")


def _run_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of all runs of 1 and of WINDOWS chunks among n, the smaller ones first."""
    pairs = [(np.arange(n - w + 1), np.full(n - w + 1, w)) for w in (1, *WINDOWS) if w <= n]
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def unresolved(gold: DataFrame, resolved: DataFrame) -> DataFrame:
    """Gold evidence that was found nowhere (blank snippets, papers without chunks); the check before an evaluation."""
    return gold.join(resolved.select("gold_id"), "gold_id", "left_anti")


def first_hits(ranked: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hit_rank: rank of the first hit, null for lists without. `hits` has q_id, chunk_id."""
    h = hits.select("q_id", "chunk_id").distinct().withColumn("_hit", F.lit(True))
    return ranked.join(h, ["q_id", "chunk_id"], "left").groupBy(*keys).agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("hit_rank"))


def rank_metrics(hit_ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """q_id, hit_at_k for each k and reciprocal rank, rounded to 4 places."""
    rank = F.col("hit_rank")
    cols = [F.when(rank <= k, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in ks]
    return hit_ranks.select("q_id", *cols, F.round(F.coalesce(F.lit(1.0) / rank, F.lit(0.0)), 4).alias("mrr"))


def ndcg(ranked: DataFrame, matches: DataFrame, gold_count: DataFrame, k: int) -> DataFrame:
    """q_id, ndcg: gain of a rank is the number of evidences first covered there; the ideal covers one per rank. May exceed 1.

    `matches` has q_id, chunk_id, gold_id; `gold_count` has q_id, gold.
    """
    first = ranked.filter(F.col("rank") <= k).join(matches, ["q_id", "chunk_id"]).groupBy("q_id", "gold_id").agg(F.min("rank").alias("rank"))
    dcg = first.groupBy("q_id").agg(F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    j = gold_count.join(dcg, "q_id", "left")
    return j.select("q_id", F.round(F.when(F.col("gold") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 4).alias("ndcg"))


def binary_ndcg(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """q_id, ndcg with one gain per relevant chunk. `relevant` has q_id, chunk_id."""
    r = relevant.select("q_id", "chunk_id").distinct()
    return ndcg(ranked, r.withColumn("gold_id", F.col("chunk_id")), r.groupBy("q_id").agg(F.count("*").alias("gold")), k)


def failure_stage(stage_ranks: DataFrame, max_k: int = 10) -> DataFrame:
    """Adds stage: retrieved, rerank, fusion, chunking, sparse, dense or recall, in that precedence.

    `stage_ranks` has q_id, sparse, dense, fused, reranked (null: not found) and gold_chunks.
    """
    within = lambda c: F.col(c).isNotNull() & (F.col(c) <= max_k)
    return stage_ranks.withColumn(
        "stage",
        F.when(within("reranked"), "retrieved").when(within("fused"), "rerank").when(within("sparse") | within("dense"), "fusion")
        .when(F.col("gold_chunks") > 1, "chunking").when(F.col("sparse").isNull() & F.col("dense").isNotNull(), "sparse")
        .when(F.col("dense").isNull() & F.col("sparse").isNotNull(), "dense").otherwise("recall"),
    )


def breakdown(rows: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """Mean of each score (4 places) and count by key."""
    return rows.groupBy(key).agg(F.count("*").alias("count"), *[F.round(F.avg(s), 4).alias(s) for s in scores])


def summary(rows: DataFrame, scores: list[str]) -> DataFrame:
    """One row: count and the mean of each score, 0 for an empty table."""
    return rows.agg(F.count("*").alias("count"), *[F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias(s) for s in scores])


def grade_answers(answers: DataFrame) -> DataFrame:
    """Adds keyword_hits, abstention_ok, citation_precision and grounded.

    `answers` has content, expected_keywords, keyword_hit_threshold, expected_abstention, abstained, citations, cited_gold (counts).
    """
    form = match_form("content")
    keyed = answers.withColumn("_f", form).withColumn("_k", F.transform(F.coalesce("expected_keywords", F.array().cast("array<string>")), lambda k: F.lower(F.regexp_replace(k, r"[^\p{L}\p{N}_]+", ""))))
    hits = F.size(F.filter("_k", lambda k: (F.length(k) > 0) & F.contains("_f", k)))
    keyed = keyed.withColumn("keyword_hits", hits)
    ok = F.coalesce("expected_abstention", F.lit(False)) == F.coalesce("abstained", F.lit(False))
    precision = F.when(F.col("citations") > 0, F.col("cited_gold") / F.col("citations")).when(F.coalesce("expected_abstention", F.lit(False)), 1.0).otherwise(0.0)
    grounded = F.when(F.coalesce("expected_abstention", F.lit(False)), ok).otherwise(ok & (F.col("keyword_hits") >= F.coalesce("keyword_hit_threshold", F.lit(1))) & (F.col("cited_gold") > 0))
    return keyed.withColumns({"abstention_ok": ok, "citation_precision": F.round(precision, 4), "grounded": grounded}).drop("_f", "_k")


def coverage(matches: DataFrame, gold_count: DataFrame) -> DataFrame:
    """q_id, coverage: share of the gold evidences that any of the selected rows holds. `matches` has q_id, gold_id."""
    got = matches.groupBy("q_id").agg(F.countDistinct("gold_id").alias("_n"))
    return gold_count.join(got, "q_id", "left").select("q_id", F.round(F.when(F.col("gold") > 0, F.coalesce("_n", F.lit(0)) / F.col("gold")).otherwise(0.0), 4).alias("coverage"))


def run_order(sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with the session they run in and their place; those of no session run alone, after the sessions.

    `sessions` has session_id, question_ids; `questions` has q_id. Unknown ids are dropped.
    """
    inside = sessions.select("session_id", F.posexplode("question_ids").alias("place", "q_id")).join(questions, "q_id")
    alone = questions.join(inside.select("q_id"), "q_id", "left_anti").withColumns({"session_id": F.lit(None).cast("string"), "place": F.lit(0)})
    return inside.unionByName(alone)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, the check before a load."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
