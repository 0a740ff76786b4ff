import random

from quillmill.llm.languages import count_trigrams
from quillmill.llm.pairs import breaks_off, flag_pairs, unquoted
from quillmill.llm.quality import cut_text, finish, merge, summarize, text_quality

PAIRS = [
    # (question, answer, language, may abstain, defect)
    ("What is it?", None, "en", False, "empty"), ("What is it?", " ​\n", "en", False, "empty"), ("What is it?", "N/A", "en", False, "empty"), ("是什么？", "（无）", "zh", False, "empty"),
    ("What is it?", "...", "en", False, "empty"), ("What is it?", "<p></p>", "en", False, "empty"),
    ("What is it?", "What is it?", "en", False, "copied_question"), ("What is it?", "You asked: \"what is it\"", "en", False, "copied_question"), ("是什么？", "问题：是什么？", "zh", False, "copied_question"),
    ("What is it?", "What is it? It is a small red fox.", "en", False, None),
    ("What is it?", "I'm sorry, but I cannot help with that.", "en", False, "refusal"), ("What is it?", "I'm sorry, but I cannot help with that.", "en", True, None),
    ("是什么？", "抱歉，我无法回答这个问题。", "zh", False, "refusal"), ("Was ist das?", "Das kann ich leider nicht beantworten.", "de", False, "refusal"),
    ("What is it?", "Patients who were unable to answer the form were left out.", "en", False, None), ("是什么？", "无法排除练习效应的影响。", "zh", False, None),
    ("What is it?", "这是一只红色的小狐狸。", "en", False, "other_language"), ("是什么？", "It is a small red fox in the wood.", "zh", False, "other_language"),
    ("What is it?", "Das ist ein kleiner roter Fuchs und er wohnt in dem Wald.", "en", False, "other_language"), ("这个 fox 是什么？", "It is a small red fox in the wood.", "mixed", False, None),
    ("What is it?", "The source reads \"这是一只红色的小狐狸\" and stops there.", "en", False, None),
    ("What is it?", "It is a small red fox that lives in", "en", False, "truncated"), ("What is it?", "It is a fox. It lives in the (see", "en", False, "truncated"), ("是什么？", "这是一只红色的小狐狸，因为", "zh", False, "truncated"),
    ("What is it?", "Points:\n- red\n- small\n- fast", "en", False, None), ("What is it?", "Points:\n1. Red fur.\n2.", "en", False, "truncated"), ("What is it?", "12 ms", "en", False, None), ("What is it?", "A fox. [E1][E2]", "en", False, None),
    (None, "A plain answer.", None, None, None),
]


LABELLED = [
    ("en", "The fox is a small animal and it lives in the wood. It was seen by two people in the morning, who were on their way to the town."),
    ("de", "Der Fuchs ist ein kleines Tier und lebt in dem Wald. Er wurde von zwei Leuten am Morgen gesehen, die auf dem Weg in die Stadt waren."),
    ("fr", "Le renard est un petit animal et il vit dans le bois. Il a été vu le matin par deux personnes qui étaient en route vers la ville."),
    ("es", "El zorro es un animal pequeño y vive en el bosque. Fue visto por la mañana por dos personas que iban camino de la ciudad."),
    ("zh", "狐狸是一种小动物，生活在树林里。"),
]


def _counts(spark):
    return count_trigrams(spark.createDataFrame(LABELLED, "lang string, text string"), "text", "lang")


def test_pairs(spark):
    df = spark.createDataFrame([(i, *p[:4], "x") for i, p in enumerate(PAIRS)], "i int, q string, a string, lang string, may boolean, defect string")
    got = {r["i"]: r["defect"] for r in flag_pairs(df, "q", "a", "lang", "may", _counts(spark)).collect()}
    assert {i: got[i] for i in got} == {i: p[4] for i, p in enumerate(PAIRS)}
    assert flag_pairs(df.limit(0), "q", "a").count() == 0


def test_every_rule_that_fires_is_listed(spark):
    df = spark.createDataFrame([("What is it?", "抱歉，我无法回答这个问题（")], "q string, a string")
    assert flag_pairs(df, "q", "a").first()["defects"] == ["refusal", "other_language", "truncated"]


def test_languages_of_one_script_need_counts(spark):
    df = spark.createDataFrame([("What is it?", "Das ist ein kleiner roter Fuchs und er wohnt in dem Wald.")], "q string, a string")
    assert flag_pairs(df, "q", "a").first()["defect"] is None
    assert flag_pairs(df, "q", "a", counts=_counts(spark)).first()["defects"] == ["other_language"]


def test_rules_do_not_hide_each_other(spark):
    df = spark.createDataFrame([(1, "What is it", "What is it"), (2, "What was the name of it", "What was the name of it"), (3, "What is it?", "...")], "i int, q string, a string")
    got = {r["i"]: r["defects"] for r in flag_pairs(df, "q", "a").collect()}
    assert got == {1: ["copied_question"], 2: ["copied_question", "truncated"], 3: ["empty", "truncated"]}


def test_long_answers():
    assert unquoted('a "' + "x" * 5000 + '" b “' + "y" * 3000 + "” c").split() == ["a", "b", "c"]
    assert unquoted("“" * 200_000) == "“" * 200_000
    assert breaks_off("A sentence. And then some more words without " + "end " * 100_000, 0) and not breaks_off("Done. " * 100_000 + "[E1]" * 1000, 0)


PROSE = "The sample was small, and so the estimates should be read with care. Two raters scored every form in the same week."
KINDS = [
    (PROSE, "prose"), (PROSE.replace(" ", "\n", 6), "prose"), (PROSE + "\n- one thing\n- two things", "prose"), ("样本量较小，因此对结论仍需谨慎解释。我们在两周之后重复了所有的分析。", "prose"),
    ("Q: Was the sample small in the end?\nA: It was small, and so we read it with care.", "prose"),
    ("- red apples\n- green pears\n- blue plums", "list"), ("1. red\n2. green\n3. blue", "list"), ("[1] Holm A, Lindt B. Effects of tea on sleep. 2011;3:1-9.\n[2] Nolde C. Tea and rest. 2012;4:2-8.", "list"),
    ("sleep: time at rest\ntea: warm drink\nrain: water", "list"), ("apple tree\npear tree\nplum tree\nfig tree", "list"),
    ("a,b,c\nx,1.2,3\ny,4,5.6", "table"), ("| a | b |\n|---|---|\n| 1 | 2 |", "table"), ("Table 1. Scores\nname\tn\nx\t1\ny\t2", "table"), ("name      n    m\nfirst     1    2\nsecond    3    4", "table"),
    ("hahahahahahahahahahahahahahahahahahahahahahahaha", "junk"), ("3f 9a 00 1c 7e d2 88 41 0b c7 5f 20 9d ee", "junk"), ("@#[]{}~~^^//\\\\ ;;:: ##@@ ~~{}[] //", "junk"),
    ("xkcd qwrt zzpf hjkl vbnm wrtp sdfg klmn bcdf", "junk"), ("", None), ("  \n ", None), (None, None),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(KINDS)], "i int, text string, kind string")
    got = {r["i"]: r["kind"] for r in text_quality(df, "i").collect()}
    assert {i: got[i] for i in got} == {i: k for i, (_, k) in enumerate(KINDS)}
    assert text_quality(df.limit(0), "i").count() == 0


def _pieced(text, size, r):
    parts = [summarize(p) for p in cut_text(text, size)]
    left = parts[0]
    for p in parts[1:]:
        left = merge(left, p)
    while len(parts) > 1:  # as a tree of any form
        i = r.randrange(len(parts) - 1)
        parts[i : i + 2] = [merge(*parts[i : i + 2])]
    return finish(left), finish(parts[0])


def test_pieces_merge_to_the_whole():
    r = random.Random(4)
    bits = [PROSE, "\n- item one\n", "a\tb\tc\n", " 样本量较小。", "\n\n", "word ", "it's well-known ", "12.5; ", "x  y   z\r\n", "哈哈哈哈", "| a | b |\n", "end.  )" + " " * 90, "3f 9a ", "A" * 60, "　　"]
    for _ in range(60):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 120)))
        whole = finish(summarize(text, joins=False))
        for size in (1, 3, 17, 64, 500):
            assert "".join(cut_text(text, size)) == text
            for got in _pieced(text, size, r):
                assert got == whole, (size, text)


def test_repetition_reaches_over_pieces():
    r = random.Random(5)
    for text in ("one two three " * 400, "哈" * 3000, "词语重复" * 700, " ".join(str(r.randrange(150)) for _ in range(2000))):
        whole = finish(summarize(text, joins=False))
        for size in (2, 40, 333):
            assert all(got == whole for got in _pieced(text, size, r))


def test_huge_text_goes_by_pieces(spark):
    text = (PROSE + " ") * 60
    other = "Zeile mit Wörtern und 样本量较小 darin.\n" * 90
    df = spark.createDataFrame([(1, text), (2, PROSE), (1, text), (1, other), (None, other)], "id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(text_quality(df, "id")) == key(text_quality(df, "id", piece=97)) == key(text_quality(df, "id", piece=1000))


def test_texts_are_measured_once(spark):
    df = spark.createDataFrame([(1, PROSE)], "id long, text string")
    plan = text_quality(df, "id").filter("kind <> 'prose'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("direct(") == 1
