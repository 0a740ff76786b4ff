from quillmill.operators import catalog, evidence, retrieval


def test_partial_update(spark):
    cur = spark.createDataFrame([(1, "T", "D"), (2, "U", None), (3, "V", "x")], "id int, title string, doi string")
    upd = spark.createDataFrame([(1, {"title": " ", "doi": ""}), (2, {"title": "New ", "other": "z"})], "id int, fields map<string,string>")
    got = {r["id"]: (r["title"], r["doi"]) for r in catalog.partial_update(cur, upd, "id", ["title", "doi"]).collect()}
    assert got == {1: ("T", None), 2: ("New", None), 3: ("V", "x")}


def test_question_sets(spark):
    items = spark.createDataFrame([(1, 0, " a ", "Q1"), (1, 1, "b", " "), (1, 2, "a", "Q3"), (2, 0, "c", "Q4")], "org int, position int, id string, question string")
    clean, twice = catalog.question_items(items, "org")
    assert clean.count() == 3 and [tuple(r) for r in twice.collect()] == [(1, "a", 2)]
    ans = spark.createDataFrame([(2, "c", "yes")], "org int, id string, answer string")
    assert {r["id"]: r["answer"] for r in catalog.answers_in_order(clean, ans, "org").collect()} == {"a": "", "c": "yes"}


def test_summaries(spark):
    df = spark.createDataFrame([('```json\n{"method": " m ", "key_points": ["a", " ", null]}\n```',), ("none",), (None,)], "t string")
    got = [r["summary"] for r in evidence.parse_summaries(df, "t").collect()]
    assert got[0]["method"] == "m" and got[0]["doi"] == "" and got[0]["key_points"] == ["a"] and got[1] is None and got[2] is None


def test_merge_terms(spark):
    q = spark.createDataFrame([(1, "表 3 的结果"), (2, "表 4 的结果")], "q_id int, question string")
    a = spark.createDataFrame([(1, "results in Table 3 for tDCS-1", ["tDCS-1"])], "q_id int, query_en string, terms array<string>")
    got = {r["q_id"]: r for r in retrieval.merge_terms(retrieval.plan_questions(q), a).collect()}
    assert got[1]["rewrite_status"] == "llm_rewritten" and "tDCS-1" in got[1]["terms"] and "Table 3" in got[1]["terms"] and got[2]["rewrite_status"] == "heuristic_template"


def test_merge_selection(spark):
    res = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.6, 2), (1, 3, 0.1, 3), (2, 9, 0.5, 1)], "q_id int, chunk_id long, score double, rank int")
    claims = spark.createDataFrame([(1, "chunk-3", 0.8, "c1"), (1, "chunk-99", 0.9, "c2")], "q_id int, evidence_id string, support_score double, claim string")
    named = spark.createDataFrame([(1, "chunk-2", 0)], "q_id int, evidence_id string, position int")
    got = {(r["q_id"], r["chunk_id"]): r["support_score"] for r in evidence.merge_selection(evidence.support(res), claims, named).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 9)} and got[1, 3] == 0.8
