import re

import numpy as np
import pytest

from quillmill.plans import reference


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """160 documents, of which only the first 60 have vectors; the askers 100 and 150 have none."""
    rng = np.random.default_rng(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [" ".join(rng.choice(words, 8)) for _ in range(160)]
    vectors = [[float(x) for x in rng.normal(size=8)] for _ in range(60)]
    d = str(tmp_path_factory.mktemp("missing"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, texts, np.array(vectors, dtype=np.float32).astype(float)


def _scores(texts, vectors):
    """Overlap and cosine (NaN without vectors) of each asker and document."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    held = [set(re.findall(r"\w+", t)) for t in texts]
    for q in range(0, len(texts), 50):
        ask = set(re.findall(r"\w+", texts[q]))
        cos = np.full(len(texts), np.nan)
        if q < len(unit):
            cos[: len(unit)] = unit @ unit[q]
        yield q, np.array([len(ask & h) / len(ask) for h in held]), cos


def test_fallback_searches_documents_without_vector(spark, folder):
    d, texts, vectors = folder
    want = {}
    for q, lex, cos in _scores(texts, vectors):
        c = np.nan_to_num(cos)
        score = np.where((c > 0) & (lex > 0), 0.8 * c + 0.2 * lex, np.where(c > 0, c, lex))
        want[q] = [i for i in sorted(range(len(texts)), key=lambda i: (-round(score[i], 9), i)) if score[i] >= 0.12][:5]
    got = {}
    for r in reference.fallback_hybrid(spark, d).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["chunk_id"])
    assert got == want and set(want) == {0, 50, 100, 150}


def test_hybrid_searches_documents_without_vector(spark, folder):
    d, texts, vectors = folder
    want = {}
    for q, lex, cos in _scores(texts, vectors):
        lists = [[i for i in sorted(range(len(texts)), key=lambda i: (-round(lex[i], 9), i)) if lex[i] > 0][:20], [i for i in sorted(range(len(vectors)), key=lambda i: (-round(cos[i], 9), i)) if cos[i] == cos[i]][:20]]
        score, best, first = {}, {}, {}
        for n, (found, by) in enumerate(zip(lists, (lex, cos))):
            for rank, i in enumerate(found, 1):
                score[i] = score.get(i, 0) + 1 / (60 + rank)
                best[i] = max(best.get(i, -9), by[i])
                first.setdefault(i, (n, rank))
        want[q] = sorted(score, key=lambda i: (-round(score[i], 12), -round(best[i], 9), first[i], i))[:20]
    got = {}
    for r in reference.hybrid_retrieval(spark, d).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["chunk_id"])
    assert got == want and any(i >= 60 for x in want.values() for i in x)


def test_all_askers_get_evidence(spark, folder):
    d = folder[0]
    for name in ("evidence_support", "sufficiency", "answer_decision", "reranked_by_overlap"):
        assert {r["q_id"] for r in reference.QUERIES[name](spark, d).select("q_id").collect()} == {0, 50, 100, 150}, name
