"""Broken prompt and response pairs.

Ordered rules: emptiness, copied prefixes, refusal phrases of several languages, script mismatch
(languages of one script are told apart by the output codes of `languages`), unclosed delimiters,
abrupt endings. Every rule that fires is reported; `defect` is the first of them.
What an answer shows by itself is read in one pass per text before it meets its question.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.languages import FULL_LETTERS, LANGUAGES, Decoder, fit

INVISIBLE = "[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff]"
# What stands where an answer should be, without signs and spaces.
PLACEHOLDERS = (
    "na none null nil nan empty blank undefined void missing placeholder tbd tba tbc todo unknownanswer noanswer noresponse notavailable "
    "noanswergiven noanswerprovided notapplicable noreply nocontent responsehere answerhere youranswerhere insertanswerhere answer response "
    "loremipsum 无 暂无 空 空白 略 没有 无内容 无回答 无答案 暂缺 待补充 待定 未填写 此处填写答案 keine leer keineantwort vide aucune vacío ninguna sinrespuesta"
).split()
# Words that may stand around a question that is only given back.
WRAPPERS = (
    "(question|q|thequestion(is|was)?|youasked|youaskedme|yourquestion(is|was)?|theuserasked|userasked|prompt|query|user|asked|input|instruction"
    "|问题|提问|问|您的问题是|您的问题|你的问题是|你的问题|您问的是|你问的是|您问|你问|用户问|frage|ihrefragewar|ihrefragelautet|votrequestion|votrequestionest|pregunta|supregunta|supreguntaes)*"
)
# Phrases by which an answer is declined, at places where no subject of a study can stand; before each the words (_ is a space) of
# which it holds at least one.
REFUSALS = [
    ("sorry afraid", r"\b(i|we)('m| am|'re| are)( \w+){0,2} (sorry|afraid)\b[^.!?]{0,60}\b(can ?not|can't|won't|unable|not able|couldn't|must|no)\b"),
    ("sorry apologies unfortunately", r"(^|[.!?:;,…] ?)(sorry|apologies|my apologies|unfortunately)\b[^.!?]{0,30}\b(i|we)( \w+)? ?(can ?not|can't|won't|am|are|'m|'re|couldn't|do not|don't|must)\b"),
    ("declin refus abstain pass leave refrain", r"\b(i|we) (must|have to|need to|will have to|would have to|prefer to|would rather|choose to|am going to|are going to)( \w+)? (decline|refuse|abstain|pass|leave|refrain)"),
    ("declin refus abstain", r"\b(i|we) (respectfully |politely )?(decline|refuse|abstain)\b"),
    ("not n't unable", r"\b(i|we)( \w+)?( (can ?not|can't|could not|couldn't|won't|will not|do not|don't|may not|must not|shall not)|('m| am|'re| are)( \w+)? (unable|not able|not permitted|not allowed|not in a position|not prepared|not willing|not authori[sz]ed) to)( \w+)? (answer|help|assist|comply|discuss|provide|comment|share|respond|give|offer|say|tell|speculate|advise|reply|address|judge|fulfil)"),
    ("beyond outside", r"\b(that|this|it|the question|your question|which)( is| lies| goes|'s| falls)? (beyond|outside)( of)? (what (i|we)|my|our|the scope of (my|what i|this assistant))"),
    ("comply answer help assist respond say comment tell give provide", r"(^|[.!?:;,…] ?)(can ?not|can't|unable to|not able to|i'm unable to|not possible to) (comply|answer|help|assist|respond|say|comment|tell|give|provide)"),
    ("position", r"\bnot in a position to (comment|answer|say|help|judge|respond)"),
    ("no_", r"\bno (answer|reply|response|comment|conclusion) (can|could|will|may) be (given|provided|offered|drawn|made)"),
    ("not_be can't_be", r"\b(question|request|this|that|it) (can ?not|can't|could not) be (answered|fulfilled|addressed)"),
    ("insufficient not_enough too_little no_relevant no_usable", r"(^|[.!?:;,…] ?)(there is |there's |i have |we have )?(insufficient|not enough|too little|no relevant|no usable) (context|information|evidence|data|material|passages?|excerpts?|sources?)(?! (for|of|in|on|that|power))\b[^.!?]{0,40}([.!?]|$)"),
    ("no_", r"(^|[.!?:;,…] ?)no (evidence|passages?|excerpts?|context|information|sources?|documents?) (was|were|could be) (retrieved|found|available|provided) (for|on|about|in|to)\b"),
    ("n't not", r"\b(do not|does not|don't|doesn't|did not|didn't) (contain|hold|provide|give|offer|have) (the |any |enough |sufficient )*(evidence|information|answer|context|details?)( needed| required| to)?\b"),
    ("as_a", r"\bas an? (ai|artificial|language|virtual)\b"),
    ("upload", r"\bupload more\b[^.]{0,30}\bask again\b"),
    ("consult ask", r"\b(please )?(consult|ask) (a|an|another) (expert|professional|source)\b[^.]{0,20}instead"),
    ("instruction guideline rule polic setting brief training configuration", r"\bmy (instructions?|guidelines?|rules|policy|policies|settings|brief|training|configuration)( \w+)? (do not|does not|don't|doesn't|forbids?|prevents?|prohibits?|bars?|keeps?|stops?)\b"),
    ("rather_not", r"\bi('d| would) rather not\b"),
    ("against_", r"\bagainst (my|our|the) (policy|policies|guidelines|rules)\b"),
    ("no_answer no_comment no_way", r"\b(i|we) (have|has) no (answer|comment|way of)\b"),
    ("抱歉 对不起 很遗憾 遗憾的是 不好意思", r"(抱歉|对不起|很遗憾|遗憾的是|不好意思)[^。！？]{0,30}(无法|不能|不便|难以|没法|不会|不予|未能)"),
    ("无法 不能 不便 难以 没法 没办法 拒绝 不予 无从 不会 不打算 不愿", r"(^|[。！？：:，,；\s])(我|我们|本助手|本人|小助手|系统|目前我|这里|暂|暂时|恕我|实在)?(还|也|只能|就|均|都|暂时|目前|实在)?(无法|不能|不便|难以|没法|没办法|拒绝|不予|无从|不会|不打算|不愿)(就此|对此|为此|直接|准确|给您|为您|向您)?(回答|作答|答复|解答|置评|评论|讨论|协助|透露|提供|作出判断|做出判断|判断|下结论|给出结论|得出结论|给出答案|提供答案|告知|帮助|回复|给出)"),
    ("不能 无法 难以 不便 不予", r"(因此|所以|故|故此|从而)(不能|无法|难以|不便|不予)(作答|回答|答复|判断|给出|下结论|置评)"),
    ("不予 暂不 恕不 不便 无可", r"(不予|暂不|恕不|不便|无可)(置评|作答|回答|奉告|评论|讨论)"),
    ("不予", r"(暂|恕)?不予(置评|回答|作答|讨论)"),
    ("恕", r"恕[^。]{0,16}(不能|无法|难以|难)(回答|作答|从命|奉告|讨论|提供|评论|告知)"),
    ("我", r"我(不便|不能|无法|不想|不会|不愿|没法)(对此|就此)?(作出|做出|讨论|评论|判断|回答|作答|提供|透露|猜测|回应|协助)"),
    ("超出", r"超出[^。，]{0,6}(我|本|能力|权限|职责|服务|回答|可)[^。，]{0,8}(范围|权限|能力)"),
    ("无法 不能 难以 不便", r"(资料|信息|证据|材料|内容|依据|上下文|片段)(不足|不够|有限|缺乏|缺失)，?(因此|所以|故|我)?(无法|不能|难以|不便)"),
    ("请", r"请(先)?(补充|上传|提供)[^。]{0,14}(再|后)[^。]{0,6}(提问|询问|试|问)"),
    ("只好 只能 暂且", r"(只好|只能|暂且)(空缺|留空|空着|作罢|放弃|搁置)"),
    ("测 揣", r"不(作|做|再)?(猜测|臆测|揣测)了?。?"),
    ("讨论", r"(不能|无法|不便|不可|不宜)讨论"),
    ("没有", r"没有(找到|检索到)?(相关|足够|可用)?(的)?(依据|证据|内容|资料|信息)，(我|故|因此|所以|只|不|无)"),
    ("未 没", r"(未|没有|没能)(检索|查询|搜索|找)到[^。]{0,24}(因此|所以|故|，(不|无|暂))"),
    ("tut_mir nicht keine_antwort dazu leider_kann", r"\b(tut mir leid|leider kann ich|ich kann (diese|ihre|die|das|dazu|darauf|hierzu)[^.]{0,40}nicht|kann ich (leider )?nicht (beantworten|helfen|sagen)|keine antwort möglich|dazu darf ich|nicht befugt)\b"),
    ("je_ désolé impossible", r"\b(je suis désolée?|désolée?,|je regrette|je ne (peux|puis) (pas|malheureusement)|impossible de répondre|je ne suis pas (en mesure|autorisée?)|je préfère ne pas)\b"),
    ("lo_siento lamento no_ prefiero", r"\b(lo siento|lamento|no puedo (responder|ayudar|contestar|comentar|ofrecer|dar|decir)|no me es posible|no estoy en condiciones|no es posible responder|prefiero no)\b"),
]
#: Confidence from which an answer's language counts against it.
SURE = 0.98
_INVISIBLE, _TAG = re.compile(INVISIBLE), re.compile(r"</?[A-Za-z][^<>]{0,40}>|&nbsp;|&#160;")
_PLACEHOLDERS = frozenset(PLACEHOLDERS)
_SIGNS = re.compile(r"[\W_]+")
_OPENED, _CLOSED = re.compile("[\"“「『«]"), re.compile("[\"”」』»]")
_CITED = re.compile(r"[\[(]E?\d+[\])]")
_CITED_END = re.compile(r"[\[(（]E?\d+(?:\s*[,;]\s*E?\d+)*[\])）]")
_HAN, _LATIN = re.compile("[一-鿿]"), re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]{2,}")
_FENCE, _LINE = re.compile(r"(?m)^\s*```"), re.compile(r"\r?\n")
_TERMINAL = tuple(".!?。！？\"”’'’)）」』》]】:：>*|")
_ITEM = re.compile(r"\s*([-*•+–]|\(?\d{1,3}[.)、]|[a-zA-Z][.)])\s+\S")
_MARKER = re.compile(r"\s*([-*•+–]|\(?\d{1,3}[.)、]|[a-zA-Z][.)])\s*")
_TRAILING = re.compile(r"(…|\.{2,}|[,，;；、=(（\[{&/–—-]|[:：]|(?<![A-Za-z])(Fig|Tab|e\.g|i\.e|vs|cf|approx|No|Eq|Dr)\.)$")
_SENTENCE = re.compile(r"[^\d\s][.!?](\s|[\"”)）])|[。！？]")
_ITEM_END = re.compile(r"[.!?。！？][\"”)）]?\s*$")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|['’-])*")
_REFUSALS = [(tuple(x.replace("_", " ") for x in hints.split()), re.compile(pattern)) for hints, pattern in REFUSALS]


def form_of(text: str) -> str:
    """Letters and digits of a text, lower case."""
    return _SIGNS.sub("", text).lower()


def unquoted(text: str) -> str:
    """The text without quoted stretches and citations, which say nothing about the answer's own language."""
    out, at = [], 0
    while (o := _OPENED.search(text, at)) and (c := _CLOSED.search(text, o.end())):
        out += text[at : o.start()], " "
        at = c.end()
    return _CITED.sub(" ", "".join((*out, text[at:])))


def refuses(low: str) -> bool:
    """Does a text in lower case decline to answer? A phrase is looked for only where one of its words stands."""
    return any(any(h in low for h in hints) and pattern.search(low) is not None for hints, pattern in _REFUSALS)


def breaks_off(text: str, han: int) -> bool:
    """Unclosed delimiters or an abrupt end. `han` is the number of Chinese signs outside quotations."""
    end = text
    while end[-1:] in ("]", ")", "）") and _CITED_END.fullmatch(end, at := max(end.rfind("["), end.rfind("("), end.rfind("（"), 0)):
        end = end[:at].rstrip()
    if "```" in end and len(_FENCE.findall(end)) % 2 or end.count('"') % 2:
        return True
    # a round bracket of either width closes the other
    if end.count("(") > end.count(")") + end.count("）") or end.count("（") > end.count(")") + end.count("）"):
        return True
    if any(end.count(o) > end.count(c) for o, c in ("[]", "“”", "《》", "「」", "{}")):
        return True
    lines = [x for x in _LINE.split(end) if x.strip()]
    last, prior = lines[-1] if lines else "", lines[-2] if len(lines) > 1 else ""
    if len(lines) > 1 and _MARKER.fullmatch(last) or _TRAILING.search(end[-16:]):
        return True
    if end.endswith(_TERMINAL):
        return False
    if _ITEM.match(last):
        return bool(_ITEM.match(prior) and _ITEM_END.search(prior))
    figured = any(map(str.isdigit, last))
    return bool(_SENTENCE.search(end)) or (not han and len(_TOKEN.findall(last)) >= (5 if figured else 4)) or han >= (8 if figured else 5)


_READ = T.StructType().add("form", "string").add("empty", "boolean").add("refused", "boolean").add("truncated", "boolean").add("said", "string")


def read_answers(df: DataFrame, answer: str, counts: DataFrame | None = None, out: str = "_answer") -> DataFrame:
    """Adds `out`: form, empty, refused, truncated and said (language of the answer's own words: zh, en, de, fr, es, latin, or null).

    `counts` (see languages.count_trigrams) tells the languages of the Latin script apart; without them they are all `latin`.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(counts.toPandas())) if counts is not None else None  # SIZE x 10 numbers at most

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(model.value) if model else None
        for texts in batches:
            rows, own = [], []
            for t in texts:
                t = t or ""
                if not t.isascii():
                    t = _INVISIBLE.sub("", t)
                if "<" in t or "&" in t:
                    t = _TAG.sub(" ", t)
                t = t.strip()
                form = form_of(t)
                mine = unquoted(t)
                han, words = len(_HAN.findall(mine)), len(_LATIN.findall(mine))
                script = "zh" if han >= 2 and han > 1.5 * words else "latin" if words >= 3 and words > 1.5 * han else None
                rows.append([form, not form or form in _PLACEHOLDERS, refuses(mine.lower().replace("’", "'")), breaks_off(t, han), script])
                own.append(mine)
            for i, lang in _languages(own, [i for i, r in enumerate(rows) if r[4] == "latin"], decoder):
                rows[i][4] = lang
            yield pd.DataFrame(rows, columns=_READ.names)

    # nondeterministic to Spark, so that no filter or projection makes it run twice
    return df.withColumn(out, F.pandas_udf(_iterates(run), _READ).asNondeterministic()(F.col(answer)))


def _iterates(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return f(batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def _languages(texts: list[str], at: list[int], decoder: Decoder | None) -> Iterator[tuple[int, str]]:
    """(number, language) of the texts in Latin script whose language is sure."""
    if not at or decoder is None:
        return
    starts = np.cumsum([0, *(len(texts[i]) + 1 for i in at[:-1])])
    sums, letters, _ = decoder.scores("\n".join(texts[i] for i in at), starts)
    langs, conf, unsure = decoder.decode(sums, letters, np.zeros_like(letters))
    for i, k, c, u, n in zip(at, langs, conf, unsure, letters):
        if not u and c >= SURE and n >= FULL_LETTERS:
            yield i, LANGUAGES[k]


def flag_read(df: DataFrame, question: str, read: str, language: str | None = None, may_abstain: str | None = None) -> DataFrame:
    """Adds `defects` and `defect` to rows that hold an answer as read by `read_answers` and its question."""
    q = F.coalesce(F.col(question), F.lit(""))
    a = F.col(read)
    asked_form = F.lower(F.regexp_replace(q, r"[^\p{L}\p{N}]+", ""))
    copied = (F.length(asked_form) > 0) & F.endswith(a["form"], asked_form) & F.replace(a["form"], asked_form, F.lit("")).rlike(f"^{WRAPPERS}$")
    refused = a["refused"] & (~F.coalesce(F.col(may_abstain), F.lit(False)) if may_abstain else F.lit(True))
    q_han, q_words = F.regexp_count(q, F.lit(r"[一-鿿]")), F.regexp_count(q, F.lit(r"\p{IsLatin}{2,}"))
    by_script = F.when((q_han > 0) & (q_words > 1), F.lit("mixed")).when(q_han > 0, "zh").when(q_words > 0, "en")
    label = F.lower(F.trim(F.col(language))) if language else F.lit(None).cast("string")
    asked = F.coalesce(F.when(label.isin("mixed", *LANGUAGES), label), by_script)
    said = a["said"]
    other = (
        F.when(said.isNull() | asked.isNull(), False)
        .when(asked == "mixed", ~said.isin("zh", "en", "latin"))
        .when(asked == "zh", said != "zh")
        .otherwise((said != asked) & (said != "latin"))
    )
    rules = (("empty", a["empty"]), ("copied_question", copied), ("refusal", refused), ("other_language", other), ("truncated", a["truncated"]))
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    kept = [c for c in df.columns if c not in ("defects", "defect", read)]
    return df.select(*kept, found.alias("defects")).withColumn("defect", F.try_element_at("defects", F.lit(1)))


def flag_pairs(
    df: DataFrame, question: str, answer: str, language: str | None = None, may_abstain: str | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Adds `defects` (ARRAY<STRING>, every rule that fired, in rule order) and `defect` (the first, or null).

    Defects: empty, copied_question, refusal, other_language, truncated. A null answer is empty.
    Without a question (null) only the rules that need none can fire. A refusal is sound where
    `may_abstain` is true. `language` is en, zh, mixed or another code; where it is missing the
    script of the question decides. `counts` see `read_answers`. Copies stay copies, other columns pass through.
    """
    return flag_read(read_answers(df, answer, counts), question, "_answer", language, may_abstain)
