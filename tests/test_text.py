import re

from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.functions.vector import cosine

TEXTS = [None, "", "  ", "Hello,  World\n", "naïve café №5 über", "在第二阶段，结果 Table 3 显示", "a b　c", "x" * 500, "ADHD-RS and tES/rTMS in Fig. 2b", "表 3 与图4"]


def _one(spark, expr, text=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokens_and_space_like_python(spark):
    # Python's \w also takes marks and odd digits; letters, digits and _ are the common ground
    want = [re.findall(r"[^\W]+", (t or "").lower()) for t in TEXTS]
    assert _one(spark, X.tokens) == want
    assert _one(spark, X.squeeze) == [re.sub(r"\s+", " ", (t or "").strip()) for t in TEXTS]


def test_clips(spark):
    squeezed = [re.sub(r"\s+", " ", (t or "").strip()) for t in TEXTS]
    assert _one(spark, lambda t: X.clip(t, 10)) == [s if len(s) <= 10 else s[:10].rstrip() + "..." for s in squeezed]
    assert _one(spark, lambda t: X.preview(t, 10)) == [s if len(s) <= 10 else s[:7] + "..." for s in squeezed]
    assert _one(spark, lambda t: X.excerpt(t, "none", 10))[:2] == ["none", "none"]


def test_terms(spark):
    terms = _one(spark, X.exact_terms, ["Compare ADHD-RS in Table 3 with the within-subject p2 value", "这个 Table 3 里 tDCS 的结果", "在第二阶段", None, "rTMS/tES T1-weighted"])
    assert terms[0] == ["within-subject", "ADHD-RS", "Table 3", "p2"] or set(terms[0]) >= {"within-subject", "ADHD-RS", "Table 3", "p2"}
    assert "Table 3" in terms[1] and "tDCS" in terms[1] and terms[2] == [] and terms[3] == []
    assert all(len(a) >= len(b) for t in terms for a, b in zip(t, t[1:]))
    assert _one(spark, X.asks_for_table, ["see Table 3", "tables", "表3", None]) == [True, False, True, False]
    assert _one(spark, X.structure_terms, ["表 3 的P值和基线，图12"]) == [["p-value", "baseline", "Table 3", "Figure 12"]]
    assert _one(spark, lambda t: X.english_query(t, X.exact_terms(t)), ["对照组的样本量是多少？"]) == ["sample size participants control group"]


def test_language(spark):
    assert _one(spark, X.question_language, ["", "abc", "这个问题", "这 abc def", None]) == ["unknown", "en", "zh", "mixed", "unknown"]


def test_table_text(spark):
    df = spark.createDataFrame([("Cap", None, [{"a": "1", "b": " "}, {"c": "2"}]), (None, "| x |", []), (None, None, None)], "c string, m string, d array<map<string,string>>")
    got = [r[0] for r in df.select(X.table_text(F.col("c"), F.col("m"), F.col("d"))).collect()]
    assert got == ["Cap\na: 1\nc: 2", "| x |", ""]
    assert _one(spark, X.looks_like_table_body, ["1.2 3 4 baseline", "1 2 3", "12345 67890 ± 1", None]) == [True, False, True, False]


def test_small_functions(spark):
    assert _one(spark, X.normalize_doi, ["doi: 10.1/ab", "https://doi.org/10.2/x", "10.3/", "abc", None]) == ["10.1/ab", "10.2/x", None, None, None]
    assert _one(spark, X.valid_url, ["https://a.b/c", "ftp://a.b", "http://", "nonsense", None]) == ["https://a.b/c", None, None, None, None]
    assert _one(spark, X.fold_fullwidth, ["Ａ１　，", None]) == ["A1 ,", None]
    assert _one(spark, X.json_object, ['```json\n{"a": 1}\n```', 'so: {"b": {"c": 2}} ok', "[1]", "{bad", None]) == ['{"a": 1}', '{"b": {"c": 2}}', None, None, None]
    assert _one(spark, X.match_form, ["Ｃafé – x_1", None]) == ["cafex_1", ""]
    assert _one(spark, X.compact_lines, [" a \n\n\n b \n\n"]) == ["a\n\nb"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0, 0.0]
