"""Snippets meet the texts of their paper in groups of bounded size; what is shuffled are the texts, not their runs of signs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions.text import match_form
from quillmill.operators import evaluate


def _tables(spark):
    r = random.Random(5)
    pick = lambda k: " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 4))) for _ in range(k))
    texts = [(i, i % 3 and 1, pick(r.randint(0, 30))) for i in range(200)]
    held = [(f"s{i}", p, " ".join(t.split()[2 : 2 + i % 7])) for i, p, t in texts if i % 4 == 0]
    gold = [*held, *[(f"n{i}", i % 2, pick(r.randint(0, 5))) for i in range(40)], ("same", 1, held[3][2]), ("none", None, "ab ab ab"), ("blank", 1, None)]
    return spark.createDataFrame(gold, "gold_id string, paper_id long, snippet string"), spark.createDataFrame(texts, "chunk_id long, paper_id long, text string")


@pytest.mark.parametrize("gram", [8, 24])
def test_parts_give_the_pairs_of_brute_force(spark, monkeypatch, gram):
    for name, n in (("SNIPPET_PART", 7), ("TEXT_PART", 11), ("HITS", 3)):
        monkeypatch.setattr(f"quillmill.operators.evaluate.{name}", n)
    monkeypatch.setattr("quillmill.operators.evaluate._Snippets.FEW", 2)
    gold, chunks = _tables(spark)
    got = [tuple(x) for x in evaluate.gold_matches(gold, chunks, gram).collect()]
    f, w = match_form("x").alias("f"), evaluate.snippet_words(F.col("x")).alias("w")
    gs = gold.withColumnRenamed("snippet", "x").select("gold_id", "paper_id", f, w).collect()
    cs = chunks.withColumnRenamed("text", "x").select("chunk_id", "paper_id", f, w).collect()

    def holds(g, c):
        runs = any(g.f[i : i + gram] in c.f for i in range(len(g.f) - gram + 1))
        return runs or (g.f != "" and g.f in c.f) or (g.w and c.w and g.w in c.w)

    want = {(g.gold_id, c.chunk_id) for g in gs for c in cs if g.paper_id == c.paper_id and g.paper_id is not None and holds(g, c)}
    assert set(got) == want and len(got) == len(want) > 100


def test_no_runs_are_joined(spark):
    plan = evaluate.gold_matches(*_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan and "array_distinct" not in plan
