import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quillmill.llm.mixture import mix_sources, mixture_report
from quillmill.llm.tokens import Encoder, count_tokens, encode_texts, load_ranks, merge_word, split_pattern


@pytest.fixture(scope="module")
def own():
    ranks = load_ranks()
    return Encoder(ranks, split_pattern()), tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_same_as_the_public_library(own):
    mine, theirs = own
    r = random.Random(1)
    alphabet = "ab cdé漢字🙂\n\t 0123'-.,;  " * 2 + "the and ing "
    for n in [0, 1, 2, 5, 30, 200, 3000] * 12:
        t = "".join(r.choices(alphabet, k=n))
        assert mine.encode(t) == theirs.encode_ordinary(t)
        assert bytes().join(theirs.decode_single_token_bytes(i) for i in mine.encode(t)).decode() == t


def test_long_words_use_the_same_rule(own):
    mine, theirs = own
    r = random.Random(2)
    for n in (255, 256, 257, 400, 1500):
        w = "".join(r.choices("aabeinrst", k=n))
        assert merge_word(w.encode(), mine.ranks) == theirs.encode_ordinary(w) if " " not in w else True
    assert len(mine.encode("a" * 100_000)) == len(theirs.encode_ordinary("a" * 100_000))


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", [9]), (2, "", [9]), (3, None, [9]), (4, "hello world", [9])], "id int, text string, ids array<int>")
    got = {r["id"]: r["ids"] for r in encode_texts(df).collect()}
    assert got[1] == got[4] and len(got[1]) == 2 and got[2] == [] and got[3] == []
    assert {r["id"]: r["tokens"] for r in count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert encode_texts(df.limit(0)).count() == 0


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("absent", 0.0, 1)]


def _docs(spark, n=3000):
    r = random.Random(3)
    rows = [(i, r.choices(["a", "b", "c", None], [0.7, 0.2, 0.1, 0.05])[0], r.randint(0, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_shares_and_repeats(spark):
    docs, targets = _docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, sizes="size", ranges=16).cache()
    rep = {r["source"]: r for r in mixture_report(mix, targets).collect()}
    for s, share, most in TARGETS[:3]:
        assert abs(rep[s]["share_reached"] - share) < 1e-3 and rep[s]["most_uses"] <= most
    for r in mix.collect():
        assert r["tokens_used"] == r["uses"] * r["tokens"] + r["cut_tokens"] and 0 <= r["cut_tokens"] < r["tokens"]
    # at most one document of a source is cut, and every source uses its documents evenly
    assert all(r["n"] <= 1 for r in mix.filter("cut_tokens > 0").groupBy("source").agg(F.count("*").alias("n")).collect())
    same = mix_sources(docs.repartition(7), targets, sizes="size", ranges=16)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, mix.collect()))


def test_larger_total_is_reported_not_forced(spark):
    docs, targets = _docs(spark, 300), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, sizes="size", total_tokens=10**6)
    rep = {r["source"]: r for r in mixture_report(mix, targets).collect()}
    assert rep["a"]["most_uses"] == 1 and rep["b"]["most_uses"] == 3 and rep["c"]["most_uses"] == 2 and rep["absent"]["tokens_used"] == 0
    assert mix_sources(docs.limit(0), targets, sizes="size").count() == 0
