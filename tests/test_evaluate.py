import math

from pyspark.sql import functions as F

from quillmill.operators import catalog, evaluate


def test_gold_matches_like_brute_force(spark):
    snippets = ["the quick brown fox", "short", "Ünïcode – text here", "", "one 2 three", "absent entirely zzzz"]
    texts = ["A quick brown foxy story", "a SHORT one", "unicode text", "see one, 2: three!", "", None]
    gold = spark.createDataFrame([(i, 1, s) for i, s in enumerate(snippets)], "gold_id int, paper_id int, snippet string")
    chunks = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(99, 2, "the quick brown fox")], "chunk_id int, paper_id int, text string")
    got = {(r["gold_id"], r["chunk_id"]) for r in evaluate.gold_matches(gold, chunks).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (4, 3)}


def test_resolution(spark):
    gold = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 1, "qqqq 17 wwww"), (3, 1, "")], "gold_id int, paper_id int, snippet string")
    chunks = spark.createDataFrame([(10, 1, 0, "nothing 17 here"), (11, 1, 1, "so alpha beta gamma"), (12, 1, 2, "alpha beta gamma")], "chunk_id int, paper_id int, position int, text string")
    got = {r["gold_id"]: (r["chunk_ids"], r["how"]) for r in evaluate.resolve_gold(gold, chunks).collect()}
    assert got[1] == (["11"], "single") and got[2][1] == "closest" and "10" in got[2][0] and 3 not in got


def test_ranks_and_gains(spark):
    ranked = spark.createDataFrame([(1, c, r) for r, c in enumerate([5, 6, 7], 1)] + [(2, 5, 1)], "q_id int, chunk_id int, rank int")
    hits = spark.createDataFrame([(1, 6), (1, 7)], "q_id int, chunk_id int")
    first = evaluate.first_hits(ranked, hits, ["q_id"])
    m = {r["q_id"]: r for r in evaluate.rank_metrics(first).collect()}
    assert (m[1]["hit_at_1"], m[1]["hit_at_5"], m[1]["mrr"]) == (0.0, 1.0, 0.5) and m[2]["mrr"] == 0.0
    matches = spark.createDataFrame([(1, 6, 1), (1, 6, 2), (1, 7, 1)], "q_id int, chunk_id int, gold_id int")
    counts = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "q_id int, gold int")
    n = {r["q_id"]: r["ndcg"] for r in evaluate.ndcg(ranked, matches, counts, 10).collect()}
    assert n[1] == round((2 / math.log2(3)) / (1 + 1 / math.log2(3)), 4) and n[2] == n[3] == 0.0
    b = {r["q_id"]: r["ndcg"] for r in evaluate.binary_ndcg(ranked, hits, 10).collect()}
    assert b[1] == round((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)), 4)


def test_failure_stages(spark):
    rows = [(1, 1, 1, 1, 1, 1), (2, 1, None, 3, None, 1), (3, 2, None, None, None, 1), (4, None, None, None, None, 2), (5, None, 30, None, None, 1), (6, 30, None, None, None, 1), (7, None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "q_id int, sparse int, dense int, fused int, reranked int, gold_chunks int")
    assert [r["stage"] for r in evaluate.failure_stage(df).orderBy("q_id").collect()] == ["retrieved", "rerank", "fusion", "chunking", "sparse", "dense", "recall"]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", None)], "k string, s double")
    assert {r["k"]: (r["count"], r["s"]) for r in evaluate.breakdown(df, "k", ["s"]).collect()} == {"a": (2, 0.5), "b": (1, None)}
    assert evaluate.summary(df.limit(0), ["s"]).first().asDict() == {"count": 0, "s": 0.0}
    s = spark.createDataFrame([("s1", ["q1", "q9"])], "session_id string, question_ids array<string>")
    q = spark.createDataFrame([("q1",), ("q2",)], "q_id string")
    assert {(r["q_id"], r["session_id"]) for r in evaluate.run_order(s, q).collect()} == {("q1", "s1"), ("q2", None)}


def test_grades(spark):
    rows = [("The Value is x-1", ["value", "X1"], 2, False, False, 2, 1), ("no", ["yes"], 1, True, True, 0, 0), (None, None, None, None, None, 0, 0)]
    df = spark.createDataFrame(rows, "content string, expected_keywords array<string>, keyword_hit_threshold int, expected_abstention boolean, abstained boolean, citations int, cited_gold int")
    got = evaluate.grade_answers(df).collect()
    assert [(r["keyword_hits"], r["grounded"], r["citation_precision"]) for r in got] == [(2, True, 0.5), (0, True, 1.0), (0, False, 0.0)]


def test_catalog(spark):
    df = spark.createDataFrame([(1, "b", 1, None), (2, "a", 1, "x"), (3, None, 2, None)], "id int, title string, organization_id int, deleted_at string")
    assert [r["id"] for r in catalog.live(df, 1).collect()] == [1] and catalog.live(df).count() == 2
    assert [r["id"] for r in catalog.title_order(df.filter("title IS NOT NULL"), "title", "id").collect()] == [2, 1]
    dated = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, d int")
    assert [r["id"] for r in catalog.date_order(dated, "d", "id").collect()] == [3, 2, 1] and [r["id"] for r in catalog.date_order(dated, "d", "id", False).collect()] == [2, 3, 1]
    p = spark.createDataFrame([(" ", "10"), ("a", "A "), ("a", "b"), (None, None)], "cur string, found string")
    assert [tuple(r) for r in p.select(catalog.fill_if_empty(F.col("cur"), F.col("found")), catalog.provenance(F.col("cur"), F.col("found"))).collect()] == [("10", None), ("a", "auto"), ("a", "manual"), (None, None)]


def _brute(snippet, rows):
    """The same search without bounds: every run of chunks compared in order."""
    import re
    from difflib import SequenceMatcher

    form = lambda t: "".join(c for c in t.lower() if c.isalnum())
    f, want = form(snippet), set(re.findall(r"[-+]?\d+(?:\.\d+)?", snippet))
    scored = []
    for n in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16):
        for a in range(len(rows) - n + 1):
            g = "".join(form(t) for _, t in rows[a : a + n])
            if g:
                m = SequenceMatcher(None, f, g)
                have = set().union(*[re.findall(r"[-+]?\d+(?:\.\d+)?", t) for _, t in rows[a : a + n]])
                scored.append((round(0.45 * (len(want & have) / len(want) if want else 0) + 0.35 * max(b.size for b in m.get_matching_blocks()) / len(f) + 0.2 * m.ratio(), 12), -n, -a))
    s, n, a = max(scored)
    return [str(i) for i, _ in rows[-a : -a - n]]


def test_gold_over_seams_and_closest(spark, monkeypatch):
    import random

    r = random.Random(2)
    pick = lambda k: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5))) for _ in range(k))
    rows = [(100 + i, f"{pick(r.randint(1, 12))} {r.randint(1, 40)} {pick(2)}") for i in range(60)]
    rows[20], rows[21], rows[22] = (120, "so it began and the river"), (121, "was"), (122, "rising fast 7 by night")
    chunks = spark.createDataFrame([(i, 1, t, n) for n, (i, t) in enumerate(rows)] + [(900, 2, None, 0)], "chunk_id long, paper_id long, text string, position int")
    texts = {"a": "began and the river", "b": "iverwasris", "c": "and the river was rising fast", "d": "Xqz 33 wvx 12 kpl", "e": "zzzz yyyy 5", "f": " ", "g": "x", "h": "qq rr ss tt uu vv 17"}
    gold = spark.createDataFrame([(k, 1, t) for k, t in texts.items()] + [("z", 2, "some text")], "gold_id string, paper_id long, snippet string")
    for size in (2048, 24):
        monkeypatch.setattr("quillmill.operators.evaluate.RANGE", size)
        got = {x["gold_id"]: (x["how"], x["chunk_ids"]) for x in evaluate.resolve_gold(gold, chunks).collect()}
        assert got["a"] == ("single", ["120"]) and got["b"][0] == "window" and got["b"][1] == ["120", "121", "122"]
        assert got["c"][0] == "single"
        for k in "dh":
            assert got[k] == ("closest", _brute(texts[k], rows)), k
        assert {x["gold_id"] for x in evaluate.unresolved(gold, evaluate.resolve_gold(gold, chunks)).collect()} >= {"f", "z"}
