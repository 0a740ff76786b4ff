import random

from pyspark.sql import functions as F

from quillmill.operators import sequence
from quillmill.operators.chunking import chunk_papers


def test_places_and_sums(spark):
    r = random.Random(1)
    rows = [(1 if i % 3 else None if i % 5 == 0 else i % 7, i, r.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    got = {(x["g"], x["o"]): (x["at"], x["before"]) for x in sequence.places(df, "g", [-F.col("o")], "at", {"before": F.col("v")}).collect()}
    assert len(got) == 600
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: -x[1])
        for i, x in enumerate(mine):
            assert got[g, x[1]] == (i, sum(y[2] for y in mine[:i]))
    assert sequence.places(df.limit(0), "g", ["o"], "at").count() == 0


def test_last_before_over_slices(spark, monkeypatch):
    monkeypatch.setattr(sequence, "SLICE", 8)
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(50)], "g int, i int")
    s = sequence.sliced(df, "g", "i").filter("NOT _aside")
    got = {(x["g"], x["i"]): x["last"] for x in sequence.last_before(s, "g", "i", F.col("i") % 19 == 3, "last").collect()}
    assert got == {(g, i): max((k for k in range(i + 1) if k % 19 == 3), default=None) for g in (1, 2) for i in range(50)}


def test_chunks_do_not_depend_on_slices(spark, monkeypatch):
    r = random.Random(2)
    kinds = ["paragraph"] * 6 + ["heading", "table_caption", "table_like", "figure_caption", None]
    rows = [(1 if i % 4 else 2, i, " ".join("word" for _ in range(r.randint(1, 90))), r.choice(kinds), r.choice(["A", "A", "A", "B", None]) if i % 11 == 0 else "A", i // 9 + 1, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "paper_id long, pos int, text string, block_type string, section_path string, page_number int, heading_level int")
    key = lambda d: sorted(map(str, d.collect()))
    whole = key(chunk_papers(df))
    monkeypatch.setattr(sequence, "SLICE", 16)
    assert key(chunk_papers(df)) == whole
