import random

from pyspark.sql import functions as F

from quillmill.operators import structure
from quillmill.operators.chunking import chunk_papers, link_parents, section_paths, windows

SCHEMA = "paper_id long, pos int, text string, block_type string, section_path string, page_number int, heading_level int"


def _chunks(spark, rows, **kw):
    got = chunk_papers(spark.createDataFrame(rows, SCHEMA), **kw).orderBy("paper_id", "chunk_index").collect()
    return got


def test_windows_like_a_loop(spark):
    texts = ["", None, "abc", "word " * 400, "x" * 1000, "y" * 1001, "  a  b " * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(w["content"], w["char_start"], w["char_end"]) for w in r["w"]] for r in df.select("i", windows(F.col("t"), 200, 50).alias("w")).collect()}
    for i, t in enumerate(texts):
        s, want, at = " ".join((t or "").split()), [], 0
        while at < len(s):
            w = s[at : at + 200]
            a = at + len(w) - len(w.lstrip())
            want.append((w.strip(), a, a + len(w.strip())))
            if at + 200 >= len(s):
                break
            at += 150
        assert got[i] == want


def test_packing_like_a_loop(spark):
    r, rows = random.Random(5), []
    for p in range(12):
        for i in range(r.randint(1, 40)):
            kind = r.choice(["paragraph"] * 6 + ["heading", "table_like", "list", "figure_caption"])
            rows.append((p, i, r.choice("abcd") * r.randint(1, 330), kind, r.choice(["S1", "S2"]) if r.random() < 0.2 else "S1", 1 + i // 5, 1))
    got: dict = {}
    for c in _chunks(spark, rows):
        if c["chunk_role"] == "child":
            got.setdefault(c["paper_id"], []).append(c["body_text"])
    for p in range(12):
        want, pend, size, section = [], [], 0, None
        flush = lambda: (want.append("\n\n".join(pend)), pend.clear()) if pend else None  # noqa: E731, B023
        for _, _, text, kind, sec, _, _ in sorted(x for x in rows if x[0] == p):
            if kind == "heading":
                flush()
                continue
            if pend and (sec != section or kind in ("table_like", "figure_caption")):
                flush()
            if pend and size + len(text) + 2 > 500:
                flush()
            size = size + len(text) + 2 if pend else len(text)
            pend.append(text)
            section = sec
            if kind in ("table_like", "figure_caption"):
                flush()
        flush()
        assert got.get(p, []) == want, p


def test_roles_parents_and_context(spark):
    para = [(1, i, f"{w} " * 30, "paragraph", "Intro", 1, None) for i, w in enumerate(["alpha", "beta", "gamma", "delta"], 1)]
    rows = [(1, 0, "1 Introduction", "heading", "Intro", 1, 1), *para, (1, 9, "last words", "paragraph", "End", 2, None), (1, 10, "   ", "paragraph", "End", 2, None), (1, 11, None, "paragraph", "End", 2, None)]
    got = _chunks(spark, rows, size=260, overlap=40)
    kids, parents = [c for c in got if c["chunk_role"] == "child"], [c for c in got if c["chunk_role"] == "parent"]
    assert [c["chunk_index"] for c in got] == list(range(len(got))) and [p["section_id"] for p in parents] == ["Intro", "End"]
    assert parents[0]["body_text"].startswith("1 Introduction") and all(not c["body_text"].startswith("1 Introduction") for c in kids)
    assert kids[0]["supporting_context"] and kids[0]["supporting_context"] not in kids[0]["content"]
    assert all(c["parent_text"] for c in kids) and kids[-1]["page_from"] == 2
    linked = link_parents(chunk_papers(spark.createDataFrame(rows, SCHEMA))).collect()
    assert all(c["parent_index"] is not None for c in linked)


def test_caption_goes_with_its_table(spark):
    table = "baseline 1.2 3.4 5.6 7.8"
    rows = [(1, 0, "Table 1. Scores", "table_caption", "R", 1, None), (1, 1, table, "table_like", "R", 1, None), (1, 2, "text after", "paragraph", "R", 1, None)]
    first = _chunks(spark, rows)[0]
    assert first["body_text"] == f"Table 1. Scores\n\n{table}" and first["block_types"] == ["table_caption", "table_like"]
    long = [(1, 0, "Cap", "table_caption", "R", 1, None), (1, 1, "score 1 2 3 4 " * 200, "table_like", "R", 1, None)]
    kids = [c for c in _chunks(spark, long) if c["chunk_role"] == "child"]
    assert len(kids) > 2 and kids[0]["body_text"].startswith("Cap\n\n") and not kids[1]["body_text"].startswith("Cap")


def test_empty(spark):
    assert _chunks(spark, [(1, 0, "", "paragraph", None, 1, None)]) == []
    assert spark.createDataFrame([], SCHEMA).count() == 0 and chunk_papers(spark.createDataFrame([], SCHEMA)).count() == 0


def test_section_stack(spark):
    rows = [(1, 0, "A", 1), (1, 1, "p", None), (1, 2, "B", 2), (1, 3, "C", 3), (1, 4, "p", None), (1, 5, "D", 2), (1, 6, "E", 1), (1, 7, "p", None)]
    df = spark.createDataFrame(rows, "paper long, o int, t string, level int")
    got = [r["section_path"] for r in section_paths(df, "paper", "o", "level", "t", F.col("level").isNotNull()).orderBy("o").collect()]
    assert got == ["A", "A", "A > B", "A > B > C", "A > B > C", "A > D", "E", "E"]


def test_structure(spark):
    df = spark.createDataFrame([("section_header",), ("Table",), ("list_item",), ("caption",), (None,), ("text",), ("page_header",), ("heading",), ("title",), ("picture",), ("figure_caption",)], "l string")
    assert [r[0] for r in df.select(structure.block_type(F.col("l"))).collect()] == [
        "heading", "table_like", "list", "paragraph", "paragraph", "paragraph", "paragraph", "heading", "heading", "figure_caption", "figure_caption",
    ]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    items = spark.createDataFrame([(1, 1, 0, "table", (0.0, 0.0, 2.0, 2.0)), (1, 1, 1, "table", (0.0, 0.0, 2.0, 2.0)), (1, 2, 2, "picture", None)], f"doc long, page_number int, item_index int, kind string, bbox {box}")
    rows = spark.createDataFrame([(1, 1, 5, "table", (1.0, 1.0, 2.0, 2.0)), (1, 1, 6, "text", (0.0, 0.0, 2.0, 2.0)), (1, 2, 7, "picture", None)], f"doc long, page_number int, row_index int, kind string, bbox {box}")
    got = {r["item_index"]: r["row_index"] for r in structure.match_nearest(items, rows, "doc").collect()}
    assert got == {0: 5, 1: 6, 2: 7}
